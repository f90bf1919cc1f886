"""Weighted word shingles of texts and their consistent samples, in numpy.

Words are runs of ASCII letters and digits or any other non-ASCII bytes, in lower case; a shingle
is five words in a row. A text of one to four words is one shingle, a text without words has none.
"""

from __future__ import annotations

import numpy as np
import zstandard

from .common import per_worker

WORDS = 5
STEP = 1 << 20  # bytes of one text hashed at a time
DF_BITS = 20  # buckets of the document frequencies
HASH_BITS = 48  # of a shingle
CHUNK = 1 << 14  # shingles sampled at a time
SAMPLES, ROWS, DEALS = 64, 8, 4  # bands of 8 samples, from 4 dealings of the 64 into 8 bands
BANDS = DEALS * SAMPLES // ROWS  # pairs of similarity 0.8 share one of 32 bands with probability 0.99
IDF_SHARE = 0.2  # of a weight that is the inverse document frequency

# Fixed odd constants of the hashes.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
PLACES = tuple(np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))
SEEDS = np.array([pow(int(PLACES[1]), 2 * k + 1, 1 << 64) for k in range(SAMPLES)], np.uint64)  # odd


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def word_bytes() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
    return table


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def make() -> tuple[np.ndarray, np.ndarray]:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        n = 1 << max(21, size.bit_length())
        up, down = np.full(n, BASE, np.uint64), np.full(n, inverse, np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)

    return per_worker(("shingles", "powers", max(21, size.bit_length())), make)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and where it starts. The hash of a byte run is a polynomial, so that of
    a word is a difference of two prefix sums."""
    b = np.frombuffer(data, np.uint8)
    inside = word_bytes()[b]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(len(b))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), starts


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, … of every (start, size), one after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and the number of words of each."""
    low = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    if len(low) > 1 or len(low[0]) <= STEP:
        hashes, starts = word_hashes(b"\n".join(low))
        bounds = np.cumsum([0, *(len(x) + 1 for x in low)])
        return hashes, np.diff(np.searchsorted(starts, bounds))
    data, table, parts, at = low[0], word_bytes(), [], 0
    while at < len(data):
        end = min(at + STEP, len(data))
        while end < len(data) and table[data[end]]:
            end += 1
        parts.append(word_hashes(data[at:end])[0])
        at = end
    hashes = np.concatenate(parts)
    return hashes, np.array([len(hashes)])


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, 48-bit hash and count of every distinct shingle, by owner and hash."""
    hashes, n = words_of(texts)
    padded = np.where(n > 0, np.maximum(n, WORDS), 0)
    w = np.zeros(int(padded.sum()), np.uint64)
    w[ranges(np.cumsum(padded) - padded, n)] = hashes
    per = np.where(n > 0, padded - WORDS + 1, 0)
    at = ranges(np.cumsum(padded) - padded, per)
    h = np.zeros(len(at), np.uint64)
    for k, place in enumerate(PLACES):
        h += w[at + k] * place
    h = mix(h) >> np.uint64(64 - HASH_BITS)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), per)
    key = np.sort((owner << np.uint64(HASH_BITS)) | h)
    first = np.flatnonzero(np.diff(key, prepend=key[:1] ^ np.uint64(1))) if len(key) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> np.uint64(HASH_BITS)).astype(np.int64), key & np.uint64((1 << HASH_BITS) - 1), counts


def df_bucket(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64((1 << DF_BITS) - 1)).astype(np.int64)


def rarity(frequency: np.ndarray, texts: int) -> np.ndarray:
    """Codes 0 to 255 of ``log(texts / frequency) / log(texts)``; a shingle in one text has 255."""
    f = np.clip(frequency, 1, max(texts, 1))
    return np.round(255 * (1 - np.log(f) / np.log(max(texts, 2)))).clip(0, 255).astype(np.uint8)


def weights(counts: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Term frequency times smoothed inverse document frequency, the latter between 1 and
    ``1 + IDF_SHARE``. What a text shares with thousands of copies is frequent and one edit is
    rare; unsmoothed, the edit would outweigh the copy."""
    return counts * (1.0 + IDF_SHARE * codes / 255.0)


def gamma_tables() -> tuple[np.ndarray, np.ndarray]:
    """r and ln c for 65,536 quantiles of Gamma(2, 1), the distribution both have."""

    def make() -> tuple[np.ndarray, np.ndarray]:
        p = (np.arange(65536) + 0.5) / 65536
        x = np.full(65536, 2.0)
        for _ in range(60):  # 1 - (1 + x) exp(-x) = p by Newton steps on a concave range
            f = 1 - (1 + x) * np.exp(-x) - p
            x = np.clip(x - f / np.maximum(x * np.exp(-x), 1e-12), x / 4, x * 2 + 1)
        return x.astype(np.float32), np.log(x).astype(np.float32)

    return per_worker(("shingles", "gamma"), make)


def consistent_samples(owner: np.ndarray, h: np.ndarray, w: np.ndarray, texts: int) -> np.ndarray:
    """Improved consistent weighted sampling: per text, ``SAMPLES`` samples (shingle, step).

    Two texts agree in a sample with the probability of their weighted Jaccard similarity. For a
    shingle of weight S: t = floor(ln S / r + b), ln a = ln c - r (t - b + 1), smallest a wins.
    """
    r_table, c_table = gamma_tables()
    out = np.full((texts, SAMPLES), np.iinfo(np.uint64).max, np.uint64)
    log_w = np.log(w).astype(np.float32)
    low = np.uint64(0xFFFF)
    for lo in range(0, len(h), CHUNK):
        own, x, lw = owner[lo : lo + CHUNK], h[lo : lo + CHUNK], log_w[lo : lo + CHUNK]
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        ids = own[starts]
        for j in range(SAMPLES):
            z = x * SEEDS[j]
            z ^= z >> np.uint64(32)
            z *= MIX[0]
            r, c = r_table.take((z >> np.uint64(48)).view(np.int64)), c_table.take(((z >> np.uint64(32)) & low).view(np.int64))
            b = ((z >> np.uint64(16)) & low).astype(np.float32)
            b *= np.float32(1 / 65536)
            t = lw / r
            t += b
            np.floor(t, out=t)
            name = (z ^ (t.astype(np.int32).astype(np.uint64) * PLACES[0])) >> np.uint64(32)
            t -= b
            t += np.float32(1)
            t *= r
            np.subtract(c, t, out=t)
            bits = t.view(np.int32)
            bits ^= (bits >> 31) & np.int32(0x7FFFFFFF)  # floats in the order of whole numbers
            order = bits.view(np.uint32) ^ np.uint32(0x80000000)
            low_of = np.minimum.reduceat((order.astype(np.uint64) << np.uint64(32)) | name, starts)
            out[ids, j] = np.minimum(out[ids, j], low_of)
    return out & np.uint64(0xFFFFFFFF)


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    deals = [np.random.default_rng(k).permutation(SAMPLES).reshape(-1, ROWS) for k in range(DEALS)]
    rows = samples[:, np.sort(np.concatenate(deals), axis=1)]
    keys = np.broadcast_to((np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * MIX[1], rows.shape[:2]).copy()
    for k in range(ROWS):
        keys = mix(keys ^ (rows[:, :, k] + PLACES[k % len(PLACES)]))
    return keys.view(np.int64)


def pack_set(h: np.ndarray, counts: np.ndarray, codes: np.ndarray) -> bytes:
    """Sorted hashes (upper 32 bits, as gaps), counts and rarity codes, compressed by byte planes."""
    short = (h >> np.uint64(HASH_BITS - 32)).astype(np.int64)
    gaps = np.diff(short, prepend=0).astype("<u4")
    raw = np.concatenate([x.astype("<u4").view(np.uint8).reshape(-1, 4).T.ravel() for x in (gaps, counts)] + [codes])
    return zstandard.compress(raw.tobytes(), 1)


def unpack_set(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and weights."""
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    n = len(raw) // 9
    gaps, counts = (np.ascontiguousarray(raw[k * 4 * n : (k + 1) * 4 * n].reshape(4, n).T).view("<u4").ravel().astype(np.int64) for k in range(2))
    return np.cumsum(gaps), weights(counts, raw[8 * n :].astype(np.float64))


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller over sum of the larger weights; hashes that share 32 bits count apart."""
    (ha, wa), (hb, wb) = a, b
    total = wa.sum() + wb.sum()
    at = np.searchsorted(hb, ha)
    at[at == len(hb)] = 0
    same = hb[at] == ha if len(hb) else np.zeros(len(ha), bool)
    shared = np.minimum(wa[same], wb[at[same]]).sum()
    return float(shared / (total - shared)) if total else 0.0
