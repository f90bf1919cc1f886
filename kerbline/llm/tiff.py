"""TIFF pages: a writer of baseline files and a reader that walks image directories.

The reader follows the directory chain, decodes uncompressed, PackBits, LZW and deflate strips
or tiles, undoes horizontal differencing, and yields one row per page. Broken files give one
row with an error text instead of ending the job.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_batches, id_and_text

# Fixed values of the TIFF 6.0 format.
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 273, 277, 278, 279
DESCRIPTION = 270
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 284, 317, 322, 323, 324, 325
FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}

ROW = 576  # samples in a row of the stored form; payloads are padded to whole rows
SLICE, PAGE_BATCH = 4 << 20, 4 << 20  # bytes of text written and of samples read at a time
STRIP_ROWS, TILE = 128, (192, 16)
PAGE_ROWS = 16384  # a page holds 9.4 MB at most, a longer payload goes on in the next page


# -- codecs ---------------------------------------------------------------------------------


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more equal bytes as (257 - n, byte), the rest as literals."""
    out, i, n = bytearray(), 0, len(data)
    a = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(a)) + 1 if n else np.zeros(0, int)
    starts = np.concatenate(([0], edges)) if n else edges
    lengths = np.diff(np.concatenate((starts, [n]))) if n else edges

    def literal(lo: int, hi: int) -> None:
        for k in range(lo, hi, 128):
            part = data[k : min(k + 128, hi)]
            out.append(len(part) - 1)
            out.extend(part)

    for s, ln in zip(starts.tolist(), lengths.tolist()):
        if ln < 3:
            continue
        literal(i, s)
        while ln:
            k = min(ln, 128)
            out.extend((257 - k, data[s]) if k > 1 else (0, data[s]))
            s, ln = s + k, ln - k
        i = s
    literal(i, n)
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while len(out) < size and i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out[:size])


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, width raised one code early."""
    out, acc, bits = bytearray(), 0, 0
    width, table, nxt = 9, {bytes((i,)): i for i in range(256)}, 258

    def put(code: int) -> None:
        nonlocal acc, bits
        acc, bits = (acc << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append((acc >> bits) & 255)
        acc &= (1 << bits) - 1

    put(256)
    w = b""
    for k in range(len(data)):
        wk = w + data[k : k + 1]
        if wk in table:
            w = wk
            continue
        put(table[w])
        table[wk] = nxt
        nxt += 1
        if nxt == 4095:
            put(256)
            width, table, nxt = 9, {bytes((i,)): i for i in range(256)}, 258
        elif nxt + 1 > (1 << width):
            width += 1
        w = data[k : k + 1]
    if w:
        put(table[w])
        nxt += 1
        if nxt + 1 > (1 << width) and width < 12:
            width += 1
    put(257)
    if bits:
        out.append((acc << (8 - bits)) & 255)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    out, table, width, prev = bytearray(), list(base), 9, b""
    acc = bits = 0
    for byte in data:
        acc, bits = (acc << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, acc = acc >> bits, acc & ((1 << bits) - 1)
        if code == 257 or len(out) >= size:
            break
        if code == 256:
            table, width, prev = list(base), 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and prev:
            entry = prev + prev[:1]
        else:
            raise ValueError("LZW code out of range")
        out += entry
        if prev:
            table.append(prev + entry[:1])
        prev = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out[:size])


def pack(data: bytes, compression: int) -> bytes:
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.compress(data, 1)
    return {NONE: bytes, LZW: lzw_encode, PACKBITS: packbits_encode}[compression](data)


def unpack(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        return data[:size]
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    if compression == LZW:
        return lzw_decode(data, size)
    if compression == PACKBITS:
        return packbits_decode(data, size)
    raise ValueError(f"compression {compression}")


# -- files ----------------------------------------------------------------------------------


def write_tiff(
    pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, strip_rows: int = 128,
    tile: tuple[int, int] | None = None, order: str = "<", description: str = "",
) -> bytes:
    """One file of 8-bit pages, each (rows, columns) or (rows, columns, samples)."""
    out = bytearray(b"II*\0" if order == "<" else b"MM\0*") + bytes(4)
    link = 4
    for image in pages:
        image = image[:, :, None] if image.ndim == 2 else image
        h, w, s = image.shape
        tw, th = tile or (w, strip_rows)
        offsets, counts = [], []
        for y in range(0, h, th):
            for x in range(0, w, tw):
                block = image[y : y + th, x : x + tw]
                if tile:
                    block = np.pad(block, ((0, th - block.shape[0]), (0, tw - block.shape[1]), (0, 0)), "edge")
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1]))
                data = pack(np.ascontiguousarray(block).tobytes(), compression)
                offsets.append(len(out))
                counts.append(len(data))
                out += data
        fields = [
            (WIDTH, "I", [w]), (HEIGHT, "I", [h]), (BITS, "H", [8] * s), (COMPRESSION, "H", [compression]),
            (PHOTOMETRIC, "H", [2 if s == 3 else 1]), (SAMPLES, "H", [s]), (PLANAR, "H", [1]), (PREDICTOR, "H", [predictor]),
        ]
        if tile:
            fields += [(TILE_WIDTH, "I", [tw]), (TILE_HEIGHT, "I", [th]), (TILE_OFFSETS, "I", offsets), (TILE_COUNTS, "I", counts)]
        else:
            fields += [(STRIP_OFFSETS, "I", offsets), (ROWS_PER_STRIP, "I", [th]), (STRIP_COUNTS, "I", counts)]
        if description:
            fields.append((DESCRIPTION, "s", description.encode() + b"\0"))
        entries = []
        for tag, kind, values in sorted(fields, key=lambda f: f[0]):
            raw = values if kind == "s" else struct.pack(f"{order}{len(values)}{kind}", *values)
            if len(raw) > 4:
                out += b"\0" * (len(out) % 2)
                at = len(out)
                out += raw
                raw = struct.pack(f"{order}I", at)
            entries.append(struct.pack(f"{order}HHI", tag, {"s": 2, "H": 3, "I": 4}[kind], len(values)) + raw.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(entries)) + b"".join(entries)
        link = len(out)
        out += bytes(4)
    return bytes(out)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """Byte order and tags of each image directory, in file order; a loop in the chain ends it."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise ValueError("no TIFF header")
    at, seen = struct.unpack_from(f"{order}I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        n, tags = struct.unpack_from(f"{order}H", data, at)[0], {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
            if kind not in FIELD:
                continue
            fmt = f"{order}{count}{FIELD[kind]}"
            where = at + 10 + 12 * k
            if struct.calcsize(fmt) > 4:
                where = struct.unpack_from(f"{order}I", data, where)[0]
            tags[tag] = struct.unpack_from(fmt, data, where)
        yield order, tags
        at = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)[0]


def read_page(data: bytes, tags: dict[int, tuple]) -> np.ndarray:
    """Samples of one page as (rows, columns, samples)."""
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    w, h, s = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    if any(b != 8 for b in tags.get(BITS, (1,))) or one(PLANAR, 1) != 1 and s > 1:
        raise ValueError("only interleaved 8-bit samples")
    tiled = TILE_OFFSETS in tags
    tw, th = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (w, min(one(ROWS_PER_STRIP, h), h))
    offsets, counts = tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_COUNTS if tiled else STRIP_COUNTS]
    image, compression, predictor = np.empty((h, w, s), np.uint8), one(COMPRESSION, 1), one(PREDICTOR, 1)
    across = -(-w // tw)
    for k, (at, size) in enumerate(zip(offsets, counts)):
        y, x = k // across * th, k % across * tw
        rows = th if tiled else min(th, h - y)
        raw = unpack(data[at : at + size], compression, rows * tw * s)
        if len(raw) != rows * tw * s:
            raise ValueError("short strip or tile")
        block = np.frombuffer(raw, np.uint8).reshape(rows, tw, s)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        image[y : y + rows, x : x + tw] = block[: h - y, : w - x]
    return image


PAGES = (
    "id long, page int, pages int, width int, height int, samples int, description string, error string, "
    "media_bytes long, media_sha256 string, data binary"
)


def _pages_of(data: bytes | None) -> Iterator[tuple]:
    """``PAGES`` without the id, one page decoded at a time."""
    if data is None:
        yield 0, 0, None, None, None, None, "null", None, None, None
        return
    stored = len(data), hashlib.sha256(data).hexdigest()
    try:
        found = [tags for _, tags in directories(data)]
        if not found:
            raise ValueError("no image directory")
    except (ValueError, struct.error) as e:
        yield 0, 0, None, None, None, None, str(e), *stored, None
        return
    for k, tags in enumerate(found):
        note = tags.get(DESCRIPTION, (b"",))[0].rstrip(b"\0").decode(errors="replace")
        try:
            image = read_page(data, tags)
            h, w, s = image.shape
            yield k, len(found), w, h, s, note, None, *stored, image.tobytes()
        except (ValueError, KeyError, TypeError, IndexError, zlib.error, struct.error) as e:
            yield k, len(found), None, None, None, note, f"{type(e).__name__}: {e}", *stored, None


def read_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, media`` batches to page batches of a few megabytes."""
    names = ["id", "page", "pages", "width", "height", "samples", "description", "error", "media_bytes", "media_sha256", "data"]
    kinds = [pa.int64(), *[pa.int32()] * 5, pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    rows, held = [], 0
    for batch in batches:
        for i, data in zip(batch.column("id"), batch.column("media")):
            for page in _pages_of(data.as_py()):
                rows.append((i.as_py(), *page))
                held += len(page[-1] or b"")
                if held > PAGE_BATCH:
                    yield flush(rows)
                    rows, held = [], 0
    if rows:
        yield flush(rows)


def tiff_pages(df: DataFrame, id_col: str = "id", data_col: str = "media") -> DataFrame:
    """One row per page of every file, in directory order: ``PAGES``.

    The pages of a file follow each other in one partition. A null or broken file gives one row
    with ``error`` set, a broken page its own such row. Repeated rows repeat. An empty table
    gives no rows.
    """
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(data_col).alias("media")).mapInArrow(read_pages, PAGES)


# -- texts as pages -------------------------------------------------------------------------


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded with 255 to a positive multiple of a row, and the unpadded length."""
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // ROW)) * ROW, b"\xff"), len(raw)


def layout_of(payload: bytes) -> dict:
    """Compression, predictor, strips or tiles and byte order of a payload, chosen by its digest, so
    that each decoder reads a share of all texts and equal texts are stored alike.

    An eighth each goes to LZW, plain samples and the old code of deflate, a quarter to PackBits,
    the rest to deflate. A quarter has tiles (of LZW, whose codec is slow, an eighth).
    """
    a, b = hashlib.sha256(payload).digest()[:2]
    kind = (LZW, PACKBITS, PACKBITS, NONE, OLD_DEFLATE, DEFLATE, DEFLATE, DEFLATE)[a % 8]
    tiled = (a >> 3) % (8 if kind == LZW else 4) == 0
    return {"compression": kind, "tile": TILE if tiled else None, "predictor": 1 + (b & 1), "order": "<>"[b >> 1 & 1]}


def write_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, text`` batches to ``id, media``."""
    for batch in cut_batches(batches, SLICE):
        media = []
        for text in batch.column("text").to_pylist():
            payload, n = payload_of(text)
            rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
            pages = [rows[k : k + PAGE_ROWS] for k in range(0, len(rows), PAGE_ROWS)]
            media.append(write_tiff(pages, strip_rows=STRIP_ROWS, description=str(n), **layout_of(payload)))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(media, pa.binary())], names=["id", "media"])


def text_tiffs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, media``: each text as an 8-bit TIFF of 576 columns, stored by ``layout_of``.

    The description of each page is the number of bytes before padding.
    """
    return id_and_text(df, id_col, text_col).mapInArrow(write_texts, "id long, media binary")


def page_features(hist: np.ndarray, steps: int, size: int, pages: int) -> str:
    """Pages, rows, mean, deviation, entropy in thousandths of a bit, share of row steps that change."""
    p = hist / max(size, 1)
    mean = float((p * np.arange(256)).sum())
    dev = float(np.sqrt((p * (np.arange(256) - mean) ** 2).sum()))
    bits = float(-(p[p > 0] * np.log2(p[p > 0])).sum())
    return f"pages={pages};rows={size // ROW};mean={mean:.3f};dev={dev:.3f};entropy={bits:.3f};steps={steps}"


def digest_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages, those of a file one after the other, to one row per file."""
    kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    sha, hist, steps, size = hashlib.sha256(), np.zeros(256, np.int64), 0, 0
    for batch in batches:
        out = []
        for row in range(batch.num_rows):
            get = lambda c: batch.column(c)[row].as_py()  # noqa: B023, E731
            if error := get("error"):
                raise ValueError(f"document {get('id')}: {error}")
            raw, page, pages = get("data"), get("page"), get("pages")
            if page == 0:
                sha, hist, steps, size = hashlib.sha256(), np.zeros(256, np.int64), 0, 0
            image = np.frombuffer(raw, np.uint8).reshape(-1, get("width"))
            sha.update(raw)
            hist += np.bincount(image.ravel(), minlength=256)
            steps += int(np.count_nonzero(image[:, 1:] != image[:, :-1]))
            size += len(raw)
            if page == pages - 1:
                out.append((get("id"), int(get("description")), size, sha.hexdigest(), zlib.crc32(raw[-32:]), get("media_bytes"), get("media_sha256"), page_features(hist, steps, size, pages)))
        cols = list(zip(*out)) if out else [()] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text as a TIFF, reads the stored bytes back page by page, and digests them.

    Result: ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature``. A null or empty text is one row of 255. Equal texts give equal
    values; repeated rows repeat; an empty table gives no rows. The three steps of ``text_tiffs``
    and ``tiff_pages`` run in one Python worker per task, a few megabytes at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return digest_pages(read_pages(write_texts(batches)))

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return id_and_text(df, id_col, text_col).mapInArrow(run, schema)
