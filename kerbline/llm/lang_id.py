"""Language by multinomial naive Bayes over hashed character n-grams.

Training counts every bigram and trigram of every training text into ``2 ** BITS`` buckets per
language. The matrix of log probabilities (languages x buckets, 256 KB per language) is the only
thing brought to the driver and broadcast; its size does not depend on the number of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import at_rest, cut_batches, per_worker

BITS = 16
CHUNK = 4096  # buckets that travel in one row of partial counts
SMOOTHING = 0.5
SLICE = 1 << 20
UNKNOWN = "und"
# Fixed odd multipliers of the n-gram hash.
FACTORS = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


def letter_table() -> np.ndarray:
    return per_worker(("language", "letters"), lambda: np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the bigrams and of the trigrams at each place, and where each text starts and ends.

    Letters are lower case, any run of other characters is one space, and a space stands before
    and after the text. A text of ``n`` such places has trigrams at the first ``n - 2`` of them.
    """
    codes = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 2 for t in texts])
    letter = letter_table()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first character after a letter stands for its run
    keep[np.concatenate(([0], ends[:-1]))] = True
    c = np.where(letter, codes, np.uint32(32))[keep]
    bounds = np.concatenate(([0], np.cumsum(keep)[ends - 1]))
    a, b, d = (c[k : len(c) - 2 + k] for k in range(3))
    mask = np.uint32((1 << BITS) - 1)

    def bucket(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint32(15))) * FACTORS[1] >> np.uint32(32 - BITS)) & mask

    return bucket(a * FACTORS[0] ^ b * FACTORS[2]), bucket(a * FACTORS[0] ^ b * FACTORS[1] + d * FACTORS[2]), bounds[:-1], bounds[1:] - 2


def lettered(batch: pa.RecordBatch) -> tuple[list[int], list[str]]:
    """Rows of the batch whose text has a letter, and those texts in lower case."""
    rows = [(k, t.lower()) for k, t in enumerate(batch.column("text").to_pylist()) if t and any(map(str.isalpha, t))]
    return [k for k, _ in rows], [t for _, t in rows]


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in code point order, their log probabilities per bucket, and their log shares.

    Rows without a language or a letter teach nothing. No rows give no languages.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        texts_of: dict[str, int] = {}
        for batch in cut_batches(batches, SLICE):
            rows, texts = lettered(batch)
            if not rows:
                continue
            langs = batch.column("lang").take(pa.array(rows)).to_pylist()
            order = sorted(range(len(rows)), key=lambda k: langs[k])  # texts of a language side by side
            two, three, starts, ends = grams([texts[k] for k in order])
            names = [langs[k] for k in order]
            first = [k for k in range(len(names)) if not k or names[k] != names[k - 1]] + [len(names)]
            owner = np.repeat(np.arange(len(names)), ends - starts)
            places = np.arange(len(owner)) + np.repeat(starts - (np.cumsum(ends - starts) - (ends - starts)), ends - starts)
            cut = np.searchsorted(owner, first)
            for k, (a, b) in enumerate(zip(first, first[1:])):
                own = places[cut[k] : cut[k + 1]]
                held = sums.setdefault(names[a], np.zeros(1 << BITS, np.int64))
                held += np.bincount(two[own], minlength=1 << BITS) + np.bincount(three[own], minlength=1 << BITS)
                texts_of[names[a]] = texts_of.get(names[a], 0) + b - a
        salt = TaskContext.get().partitionId() % 64
        for name, held in sums.items():
            chunks = held.reshape(-1, CHUNK)
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": [name] * len(chunks), "chunk": pa.array(range(len(chunks)), pa.int32()), "salt": pa.array([salt] * len(chunks), pa.int32()),
                    "texts": pa.array([texts_of[name]] * len(chunks), pa.int64()), "counts": [c.astype("<i8").tobytes() for c in chunks],
                }
            )

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CHUNK, np.int64)
        for raw in pdf["counts"]:
            total += np.frombuffer(raw, "<i8")
        return pdf.head(1)[["lang", "chunk", "salt"]].assign(texts=pdf["texts"].sum(), counts=[total.tobytes()])

    kind = "lang string, chunk int, salt int, texts long, counts binary"
    parts = df.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null and text is not null").mapInArrow(at_rest(count), kind)
    for keys in (("lang", "chunk", "salt"), ("lang", "chunk")):  # two steps, so that no task adds up all partial counts
        parts = parts.groupBy(*keys).applyInPandas(add, kind)
    rows = parts.collect()  # languages x buckets
    langs = sorted({r.lang for r in rows})
    counts, shares = np.zeros((len(langs), 1 << BITS)), np.zeros(len(langs))
    for r in rows:
        k = langs.index(r.lang)
        counts[k, r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.counts, "<i8")
        shares[k] = r.texts
    logs = np.log((counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * (1 << BITS)))
    return langs, logs.astype(np.float32), np.log(shares / max(shares.sum(), 1)) if langs else shares


def score_texts(texts: list[str], logs: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Posterior of every language (rows: texts with a letter, in lower case)."""
    two, three, starts, ends = grams(texts)
    edges = np.stack([starts, ends], axis=1).ravel()
    like = np.empty((len(texts), len(shares)))
    for k in range(len(shares)):
        each = np.append(logs[k][two] + logs[k][three].astype(np.float64), 0.0)  # the last edge lies behind the end
        like[:, k] = np.add.reduceat(each, edges)[::2] + shares[k]
    like = np.exp(like - like.max(axis=1, keepdims=True))
    return like / like.sum(axis=1, keepdims=True)


def fold(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def label(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` with ``lang_pred`` and ``score`` of every text.

    Learns from rows whose ``crc32(id as text) mod 4`` is not 2 and whose language is known; a
    row without an id teaches nothing. A null text, one without a letter, and every text where
    nothing could be learned is ``und`` with score 0. Ties go to the first language in code point
    order. Repeated rows repeat; an empty table gives no rows.
    """
    langs, logs, shares = train(df.filter(fold(id_col) != 2), text_col, lang_col)
    model = df.sparkSession.sparkContext.broadcast((langs, logs, shares))
    asked = df.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(keep)), F.col(text_col).alias("text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logs, shares = model.value
        for batch in cut_batches(batches, SLICE):
            names, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            rows, texts = lettered(batch)
            if rows and langs:
                post = score_texts(texts, logs, shares)
                best = post.argmax(axis=1)
                scores[rows] = post[np.arange(len(rows)), best]
                for k, j in zip(rows, best):
                    names[k] = langs[j]
            own = [f"c{k}" for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*map(batch.column, own), pa.array(names, pa.string()), pa.array(scores)], names=[*own, "lang_pred", "score"])

    kind = T.StructType([*asked.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return asked.mapInArrow(at_rest(predict), kind).toDF(*keep, "lang_pred", "score")


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every text; see ``label``. A null id is not held out."""
    asked = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    held = asked.withColumn("held_out", F.coalesce(fold("doc_id") == 2, F.lit(False)))
    return label(held, keep=("doc_id", "held_out"))
