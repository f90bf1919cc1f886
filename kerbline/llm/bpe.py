"""Byte-pair ids by prefix dynamic programming.

For every prefix of a piece exactly one token can end its encoding: the one whose boundary with
the last token of the shorter prefix no merge would have crossed. Storing that token per prefix
makes appends exact (only new positions are filled) and lets a near edit reuse the positions
before it. Pieces of a slice are visited in sorted order, so neighbours share their prefixes.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import at_rest, cut_batches, id_and_text, per_worker

KEEP = 120_000  # pieces whose ids a worker keeps between slices, some 25 MB
AT_REST = 30_000  # those met most often, which it keeps between tasks
JUDGED = 200_000  # token pairs whose fit a worker remembers during a task, some 25 MB
SLICE = 1 << 20  # text bytes encoded at a time
TEXT_STEP = 1 << 20  # pieces of one text held at a time


class PrefixTable:
    """Last tokens of the prefixes of one byte string; append and cut keep it exact."""

    def __init__(self, coder: "Coder") -> None:
        self.coder, self.data, self.last = coder, b"", []

    def cut(self, size: int) -> None:
        self.data = self.data[:size]
        del self.last[size:]

    def append(self, more: bytes) -> None:
        end = len(self.data)
        self.data = data = self.data + more
        last, suffix, judged, fits = self.last, self.coder.suffixes.get, self.coder.judged, self.coder.fits
        while end < len(data):
            end += 1
            at, found = end - 1, []
            token = suffix(data[at:end])
            while token is not None:
                if token >= 0:
                    found.append(token)
                    found.append(at)
                if not at:
                    break
                at -= 1
                token = suffix(data[at:end])
            while True:
                if not found:
                    raise ValueError("no token ends here; the vocabulary lacks a byte")
                at, token = found.pop(), found.pop()
                if not at:
                    break
                fit = judged.get(last[at - 1] << 20 | token)
                if fit is None:
                    fit = fits(last[at - 1], token)
                if fit:
                    break
            last.append(token)

    def replace(self, data: bytes) -> None:
        """Re-encode after an edit: positions before the first changed byte stay."""
        same, most = 0, min(len(data), len(self.data))
        while same < most and data[same] == self.data[same]:
            same += 1
        self.cut(same)
        self.append(data[same:])

    def ids(self) -> list[int]:
        out, end, size = [], len(self.last), self.coder.size
        while end:
            out.append(self.last[end - 1])
            end -= size[out[-1]]
        return out[::-1]


class Coder:
    """Merge knowledge of one rank file."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        self.bytes = {t: b for b, t in self.ranks.items()}
        self.size = {t: len(b) for b, t in self.ranks.items()}
        #: left and right in one number -> merged, for every cut of a token into two tokens
        self.merges = {
            l << 20 | r: t
            for b, t in self.ranks.items()
            for k in range(1, len(b))
            if (l := self.ranks.get(b[:k])) is not None and (r := self.ranks.get(b[k:])) is not None
        }
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.own: set[int] = set()  # tokens that merging their bytes gives back
        for b, t in self.ranks.items():
            steps = self.merge_steps(b)
            self.parts[t] = steps[-1][0] if steps and steps[-1][1] == t else None
            if len(b) == 1 or self.parts[t] is not None:
                self.own.add(t)
        #: every suffix of a token -> its id, -1 where it is only the end of a longer one
        self.suffixes: dict[bytes, int] = {}
        for b in self.ranks:
            for k in range(len(b)):
                self.suffixes.setdefault(b[k:], -1)
        for t in self.own:
            self.suffixes[self.bytes[t]] = t
        self.left_edges: dict[int, list] = {}
        self.right_edges: dict[int, list] = {}
        self.judged: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        """Empty store of encoded pieces: piece -> number, ids of all numbers in one pool."""
        self.known: dict[str, int] = {}
        self.pool, self.starts, self.sizes, self.uses = array("I"), array("q"), array("q"), np.zeros(0, np.int64)

    def merge_steps(self, data: bytes) -> list[tuple[tuple[int, int], int]]:
        """Lowest rank first, leftmost first among equals, until nothing merges."""
        parts, steps = [self.ranks[data[i : i + 1]] for i in range(len(data))], []
        while True:
            merged = [(self.merges.get(x << 20 | y, 1 << 60), i) for i, (x, y) in enumerate(zip(parts, parts[1:]))]
            m, i = min(merged, default=(1 << 60, 0))
            if m == 1 << 60:
                return steps
            steps.append(((parts[i], parts[i + 1]), m))
            parts[i : i + 2] = [m]

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens that stood at this end while ``token`` grew, each with the merge that ended it."""
        held = self.right_edges if side else self.left_edges
        if token not in held:
            out, t, until = [], token, 1 << 60
            while True:
                out.append((t, until))
                if self.parts[t] is None:
                    break
                t, until = self.parts[t][side], t
            held[token] = out
        return held[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether ``a`` then ``b`` survives merging: no pair of edge tokens merges first.

        Equal ranks merge from the left, so the inside of ``a`` wins a tie and that of ``b`` loses.
        """
        known = self.judged.get(a << 20 | b)
        if known is None:
            merges = self.merges
            known, right = True, self.edge(b, 0)
            for x, x_until in self.edge(a, 1):
                for y, y_until in right:
                    m = merges.get(x << 20 | y)
                    if m is not None and m < x_until and m <= y_until:
                        known = False
            if len(self.judged) > JUDGED:
                self.judged.clear()
            self.judged[a << 20 | b] = known
        return known

    def learn(self, pieces: set[str]) -> None:
        """Encode new pieces, neighbours in sorted order sharing the table of their common prefix.

        A piece that is itself a token stays whole, as in the library.
        """
        table, ranks = PrefixTable(self), self.ranks
        for piece in sorted(pieces):
            data = piece.encode()
            token = ranks.get(data)
            if token is not None:
                ids = (token,)
            else:
                table.replace(data)
                ids = table.ids()
            self.known[piece] = len(self.starts)
            self.starts.append(len(self.pool))
            self.sizes.append(len(ids))
            self.pool.extend(ids)

    def shrink(self, most: int) -> None:
        """Beyond ``most`` pieces only the half of them met most often stays."""
        if len(self.known) <= most:
            return
        names, uses = list(self.known), self.uses
        order = np.argsort(-uses[np.fromiter(self.known.values(), np.int64, len(names))], kind="stable")[: most // 2]
        kept = [(p := names[i], self.pool[self.starts[k := self.known[p]] : self.starts[k] + self.sizes[k]], int(uses[k])) for i in order.tolist()]
        self.forget()
        for p, ids, _ in kept:
            self.known[p] = len(self.starts)
            self.starts.append(len(self.pool))
            self.sizes.append(len(ids))
            self.pool.extend(ids)
        self.uses = np.array([n for _, _, n in kept], np.int64) // 2  # old uses count less than new ones

    def spread(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a list of pieces, and how many each piece has."""
        self.shrink(KEEP)
        known = self.known
        self.learn({p for p in pieces if p not in known})
        codes = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
        uses = np.bincount(codes, minlength=len(self.starts))
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        sizes = np.array(self.sizes)[codes]
        return np.array(self.pool, np.uint32)[ranges(np.array(self.starts)[codes], sizes)], sizes

    def token_bytes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        most = max(self.bytes) + 1
        sizes = np.array([self.size.get(t, 0) for t in range(most)])
        pool = np.frombuffer(b"".join(self.bytes.get(t, b"") for t in range(most)), np.uint8)
        return pool, np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes

    def decode(self, ids: np.ndarray) -> bytes:
        if not hasattr(self, "table"):
            self.table = self.token_bytes()
        pool, starts, sizes = self.table
        return pool[ranges(starts[ids], sizes[ids])].tobytes()


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, … of every (start, size), one after the other."""
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


def coder(path: str, pattern: str) -> Coder:
    return per_worker(("bpe", path, pattern), lambda: Coder(path, pattern))


def bpe_round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every text, and the text decoded from them, as digests.

    Result: ``doc_id, n_tokens, ids_sha256, decoded_sha256``. Each match of ``pattern`` is
    encoded on its own, special strings are ordinary text. A null or empty text has no ids.
    A long text is encoded in steps of ``TEXT_STEP`` pieces. Repeated rows repeat; an empty
    table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for batch in cut_batches(batches, SLICE):
            texts, rows, pieces, bounds = batch.column("text").to_pylist(), [], [], [0]
            for text in texts if len(texts) > 1 else []:
                pieces += c.pattern.findall(text)
                bounds.append(len(pieces))
            if len(texts) > 1:
                ids, sizes = c.spread(pieces)
                ends = np.concatenate(([0], np.cumsum(sizes)))
                for k in range(len(texts)):
                    own = ids[ends[bounds[k]] : ends[bounds[k + 1]]]
                    rows.append((len(own), hashlib.sha256(own.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(c.decode(own)).hexdigest()))
            else:
                rows.append(one(c, texts[0]))
            n, a, b = zip(*rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        c.judged.clear()  # an idle worker holds what later tasks gain most from, and no more
        c.shrink(AT_REST)
        c.left_edges.clear()
        c.right_edges.clear()

    def one(c: Coder, text: str) -> tuple[int, str, str]:
        n, ids_sha, text_sha, held = 0, hashlib.sha256(), hashlib.sha256(), []

        def flush() -> int:
            ids, _ = c.spread(held)
            held.clear()
            ids_sha.update(ids.astype("<u4").tobytes())
            text_sha.update(c.decode(ids))
            return len(ids)

        for m in c.pattern.finditer(text):
            held.append(m[0])
            if len(held) == TEXT_STEP:
                n += flush()
        n += flush()
        return n, ids_sha.hexdigest(), text_sha.hexdigest()

    return id_and_text(df, id_col, text_col).mapInArrow(at_rest(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
