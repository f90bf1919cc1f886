"""Token counts from distinct pre-tokens, without ids.

A SentencePiece BPE whose pieces never hold the space mark after another character merges
nothing across the start of a run of space marks. So a text splits exactly into pre-tokens (a
run of spaces and the characters up to the next run), and its count is the sum over them.

1. Texts are packed into blocks of a few megabytes: per block the distinct pre-tokens, and per
   document their frequencies.
2. The pre-tokens of all blocks meet by hash slot. Each distinct one is counted once, and every
   block's list is joined to the counts. A frequent pre-token is one entry per block, so no
   slot grows with the frequency of a word.
3. Counts go back to their block and are multiplied with the frequencies.

Lists travel packed (compressed), which keeps both shuffles far below the size of the texts.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import cut_batches, id_and_text, per_worker

BLOCK = 8 << 20  # text bytes of a block
TEXT_STEP = 4 << 20  # characters of one long text split at a time
SLOT_BYTES = 32 << 20  # text bytes per hash slot; about a million list entries
HELD = 1_500_000  # pre-tokens a task remembers within a slot
PRE_TOKEN = re.compile("[ ▁]+[^ ▁]*")


def processor(path: str):
    import sentencepiece

    return per_worker(("spm", path), lambda: sentencepiece.SentencePieceProcessor(model_file=path))


def splits_at_spaces(path: str) -> bool:
    """Whether no piece holds the space mark after another character, and one is put in front."""
    sp = processor(path)
    normal = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return not any(re.search("[^▁]▁", p) for p in normal) and sp.encode_as_pieces("a") == sp.encode_as_pieces("b a")[-1:]


def steps_of(text: str) -> Iterator[str]:
    """The text with one space in front, cut at pre-token starts into parts of bounded length."""
    text, start = " " + text, 0
    while len(text) - start > TEXT_STEP:
        cut = re.compile("(?<=[^ ▁])[ ▁]").search(text, start + TEXT_STEP)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def planes(a: np.ndarray, width: int) -> bytes:
    """Bytes of unsigned integers, lowest bytes first, compressed."""
    return zstandard.compress(np.ascontiguousarray(a.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes(), 1)


def unplanes(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(raw.T).reshape(-1).view(f"<u{width}").astype(np.int64)


def pack_block(n_docs: int, words: list[str], owners: np.ndarray, counts: np.ndarray | None = None) -> tuple[bytes, list[str]]:
    """Frequencies of the distinct words of each document: gaps between codes, then counts.

    Codes follow the frequency in the block, so gaps are small where words are common.
    ``counts`` is given where the words of a document are distinct already.
    """
    coded = pa.array(words, pa.large_string()).dictionary_encode()
    codes, vocab = coded.indices.to_numpy(), coded.dictionary
    n = max(len(vocab), 1)
    rank = np.argsort(-np.bincount(codes, counts, minlength=len(vocab)), kind="stable")
    place = np.empty(len(rank), np.int64)
    place[rank] = np.arange(len(rank))
    if counts is None:
        key, freq = np.unique(owners * n + place[codes], return_counts=True)
    else:
        order = np.argsort(place[codes])
        key, freq = place[codes][order], counts[order]
    owner, code = key // n, key % n
    gap = np.where(np.diff(owner, prepend=-1) != 0, code, np.diff(code, prepend=0))
    parts = [planes(np.bincount(owner, minlength=n_docs), 4), planes(gap, 4), planes(freq, 4)]
    return np.array([len(p) for p in parts], "<u4").tobytes() + b"".join(parts), vocab.take(pa.array(rank)).to_pylist()


def unpack_block(data: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Number of documents; owner, code and frequency of every entry."""
    ends = [12, *(12 + np.cumsum(np.frombuffer(data[:12], "<u4").astype(np.int64))).tolist()]
    sizes, gap, freq = (unplanes(data[a:b], 4) for a, b in zip(ends, ends[1:]))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    total = np.concatenate(([0], np.cumsum(gap)))
    return len(sizes), owner, total[1:] - total[np.cumsum(sizes) - sizes][owner], freq


def slot_lists(vocab: list[str], slots: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Slot, positions in the block's list, and the pre-tokens themselves."""
    blob = [w.encode() for w in vocab]
    slot = np.fromiter((zlib.crc32(w) for w in blob), np.int64, len(blob)) % slots
    order = np.argsort(slot, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(slot[order])) + 1):
        if len(part):
            words = [blob[i] for i in part]
            sizes = np.array([len(w) for w in words])
            body = planes(sizes, 4)
            yield int(slot[part[0]]), planes(np.diff(part, prepend=0), 4), len(body).to_bytes(4, "little") + body + zstandard.compress(b"".join(words), 1)


def listed(data: bytes) -> list[str]:
    n = int.from_bytes(data[:4], "little")
    ends = np.cumsum(unplanes(data[4 : 4 + n], 4)).tolist()
    body = zstandard.decompress(data[4 + n :])
    return [body[a:b].decode() for a, b in zip([0, *ends], ends)]


def block_of(texts: list[str]) -> tuple[bytes, list[str]]:
    """Packed frequencies and distinct pre-tokens; one long text is counted in steps."""
    if len(texts) == 1:
        held: Counter = Counter()
        for part in steps_of(texts[0]) if texts[0] else ():
            held.update(PRE_TOKEN.findall(part))
        return pack_block(1, list(held), np.zeros(len(held), np.int64), np.fromiter(held.values(), np.int64, len(held)))
    words, ends = [], []
    for text in texts:
        if text:
            words += PRE_TOKEN.findall(" " + text)
        ends.append(len(words))
    return pack_block(len(texts), words, np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0)))


def count_blocks(docs: DataFrame, slots: int) -> DataFrame:
    """One row per block: ids, byte sizes, packed frequencies, and the pre-tokens by hash slot."""
    lists = pa.list_(pa.struct([("slot", pa.int32()), ("places", pa.binary()), ("words", pa.binary())]))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut_batches(batches, BLOCK):
            freqs, vocab = block_of(batch.column("text").to_pylist())
            sizes = pa.compute.binary_length(batch.column("text")).cast(pa.int64()).to_pylist()
            by_slot = [{"slot": s, "places": p, "words": w} for s, p, w in slot_lists(vocab, slots)]
            cols = [pa.array([uuid.uuid4().hex]), pa.array([batch.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([freqs], pa.binary()), pa.array([by_slot], lists)]
            yield pa.RecordBatch.from_arrays(cols, names=["block", "ids", "n_bytes", "freqs", "lists"])

    return docs.mapInArrow(pack, "block string, ids array<long>, n_bytes array<long>, freqs binary, lists array<struct<slot:int, places:binary, words:binary>>")


def count_slots(blocks: DataFrame, path: str) -> DataFrame:
    """Pieces of each list entry. The lists of a slot lie in one partition, one after the other,
    so every distinct pre-token of the slot is counted once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, known, at = processor(path), {}, None
        lone = len(sp.encode("a ")) - len(sp.encode("a"))
        for batch in batches:
            out = []
            for slot, data in zip(batch.column("slot").to_pylist(), batch.column("words")):
                words = listed(data.as_py())
                if slot != at or len(known) > HELD:
                    known, at = {}, slot
                new = [w for w in words if w not in known]
                known.update(zip(new, map(len, sp.encode([w[1:] for w in new], num_threads=1))))
                known.update((w, lone) for w in new if len(w) == 1)  # nothing is left of it to encode
                out.append(planes(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), 4))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("slot"), pa.array(out, pa.binary())], names=["block", "slot", "counts"])

    lists = blocks.select("block", F.explode("lists").alias("l")).select("block", "l.slot", "l.words")
    return lists.repartition("slot").sortWithinPartitions("slot").mapInArrow(count, "block string, slot int, counts binary")


def token_counts(df: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens) of every text.

    A null or empty text has no tokens. A text longer than a block is a block of its own,
    counted in steps. Repeated rows repeat; an empty table gives no rows.
    """
    if not splits_at_spaces(path):
        raise ValueError("this vocabulary has pieces that reach over a space")
    docs = id_and_text(df, id_col, text_col)
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = settle(count_blocks(docs, max(8, -(-size // SLOT_BYTES))), "token-blocks")
    counts = count_slots(blocks, path).groupBy("block").agg(F.collect_list(F.struct("slot", "counts")).alias("counted"))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                n, owner, code, freq = unpack_block(row["freqs"])
                pieces = np.zeros(int(code.max()) + 1 if len(code) else 0, np.int64)
                places = {x["slot"]: x["places"] for x in row["lists"]}
                for x in row["counted"] or ():
                    pieces[np.cumsum(unplanes(places[x["slot"]], 4))] = unplanes(x["counts"], 4)
                tokens = np.bincount(owner, freq * pieces[code], minlength=n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(row["n_bytes"], pa.int64()), pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    places = F.transform("lists", lambda x: F.struct(x["slot"].alias("slot"), x["places"].alias("places")))
    return (
        blocks.select("block", "ids", "n_bytes", "freqs", places.alias("lists"))
        .join(counts, "block", "left")
        .select("ids", "n_bytes", "freqs", "lists", "counted")
        .mapInArrow(total, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
    )
