"""Near duplicates by consistent weighted samples of TF-IDF shingles.

1. Document frequencies of all shingles are counted in ``2 ** 20`` hash buckets; the table of
   rarity codes (1 MB at any size of the corpus) is broadcast.
2. Equal texts fall together by digest. Each distinct text gets banded samples.
3. A band key shared by several texts is a bucket. Only texts that share one get their packed
   weighted set, in another pass over the texts that knows them by a bitmap of digests (2 MB at
   any size) and then by the digest itself. Members of a bucket are compared with a hub, not with
   each other. A bucket whose members are then all connected is done, so a group of near copies
   costs one comparison per member. A member left open is compared with those of its bucket that
   are not yet connected with it and that bounds do not rule out: the distance of both to the hub
   (weighted Jaccard distance is a metric) and the weight of shingles no other text has. So no
   pair of a bucket that reaches the similarity stays unconnected.
4. Links become classes by alternating star contraction.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, settle
from .common import at_rest, cut_batches, id_and_text
from .shingles import DF_BITS, band_keys, consistent_samples, df_bucket, pack_set, rarity, shingles, unpack_set, weighted_jaccard, weights

SIMILARITY = 0.8
SLICE = 1 << 19
DF_CHUNK = 1 << 16
MARK_BYTES = 3  # of a digest, its place in the bitmap of the texts to compare
MARK_CHUNK = 1 << 15  # bits that Spark's bitmap functions keep in a row


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents per shingle bucket, and documents with words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << DF_BITS, np.int64), 0
        for batch in cut_batches(batches, SLICE):
            owner, h, _ = shingles(batch.column("text").to_pylist())
            total += np.bincount(df_bucket(h), minlength=1 << DF_BITS)
            n += int(np.count_nonzero(np.diff(owner, prepend=-1)))
        chunks = total.reshape(-1, DF_CHUNK)
        salt = TaskContext.get().partitionId() % 64
        yield pa.RecordBatch.from_pydict(
            {
                "chunk": pa.array(range(len(chunks)), pa.int32()), "salt": pa.array([salt] * len(chunks), pa.int32()),
                "texts": pa.array([n] * len(chunks), pa.int64()), "counts": [zstandard.compress(c.astype("<i8").tobytes(), 1) for c in chunks],
            }
        )

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(DF_CHUNK, np.int64)
        for raw in pdf["counts"]:
            total += np.frombuffer(zstandard.decompress(raw), "<i8")
        return pdf.head(1)[["chunk", "salt"]].assign(texts=pdf["texts"].sum(), counts=[zstandard.compress(total.tobytes(), 1)])

    kind = "chunk int, salt int, texts long, counts binary"
    parts = docs.select("text").mapInArrow(at_rest(count), kind)
    for keys in (("chunk", "salt"), ("chunk",)):  # two steps, so that no task adds up all partial counts
        parts = parts.groupBy(*keys).applyInPandas(add, kind)
    rows, total = parts.collect(), np.zeros(1 << DF_BITS, np.int64)
    for r in rows:
        total[r.chunk * DF_CHUNK : (r.chunk + 1) * DF_CHUNK] = np.frombuffer(zstandard.decompress(r.counts), "<i8")
    return total, rows[0].texts if rows else 0


def digests(texts: list[str]) -> tuple[list[bytes], list[int]]:
    """Digest of every text, and the places of those that no text before equals."""
    keys = [hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() for t in texts]
    place: dict[bytes, int] = {}
    for k, key in enumerate(keys):
        place.setdefault(key, k)
    return keys, list(place.values())


def sketches(docs: DataFrame, codes: Broadcast) -> DataFrame:
    """``id, text_key, bands``: digest of the text and its band keys.

    Bands are null where the slice held the same text before, and for texts without words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut_batches(batches, SLICE):
            texts = batch.column("text").to_pylist()
            keys, own = digests(texts)
            owner, h, counts = shingles([texts[k] for k in own])
            samples = consistent_samples(owner, h, weights(counts, codes.value[df_bucket(h)].astype(np.float64)), len(own))
            bands, some = band_keys(samples), np.bincount(owner, minlength=len(own)) > 0
            band_col = [None] * len(texts)
            for n in np.flatnonzero(some):
                band_col[own[n]] = bands[n]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(keys, pa.binary()), pa.array(band_col, pa.list_(pa.int64()))], names=["id", "text_key", "bands"]
            )

    return docs.mapInArrow(at_rest(run), "id long, text_key binary, bands array<long>")


def marks(keys: DataFrame) -> np.ndarray:
    """Bitmap of the first ``MARK_BYTES`` bytes of all digests ``text_key``, least bit first."""
    place = F.conv(F.hex(F.substring("text_key", 1, MARK_BYTES)), 16, 10).cast("long")
    parts = keys.select((place / MARK_CHUNK).cast("long").alias("part"), (place % MARK_CHUNK).alias("bit"))
    out = np.zeros((1 << 8 * MARK_BYTES) // 8, np.uint8)
    for r in parts.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        out[r.part * MARK_CHUNK // 8 : (r.part + 1) * MARK_CHUNK // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def weighted_sets(docs: DataFrame, codes: Broadcast, keys: DataFrame) -> DataFrame:
    """``text_key, words``: packed set of each text of ``docs`` whose digest is in ``keys``.

    Texts that the bitmap rules out are neither cut into shingles nor shuffled."""
    marked = docs.sparkSession.sparkContext.broadcast(marks(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut_batches(batches, SLICE):
            texts = batch.column("text").to_pylist()
            names, own = digests(texts)
            at = np.array([int.from_bytes(names[k][:MARK_BYTES], "big") for k in own])
            own = [own[n] for n in np.flatnonzero(marked.value[at >> 3] >> (at & 7) & 1)]
            if not own:
                continue
            owner, h, counts = shingles([texts[k] for k in own])
            rare, ends = codes.value[df_bucket(h)], np.searchsorted(owner, np.arange(len(own) + 1))
            packed = [pack_set(h[a:b], counts[a:b], rare[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in own], pa.binary()), pa.array(packed, pa.binary())], names=["text_key", "words"])

    sets = docs.select("text").mapInArrow(at_rest(run), "text_key binary, words binary")
    return sets.join(keys, "text_key", "left_semi").dropDuplicates(["text_key"])


def similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, s``: weighted Jaccard similarity of every pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            out = np.empty(batch.num_rows)
            for k, (a, wa, wb) in enumerate(zip(batch.column("a").to_pylist(), batch.column("words_a"), batch.column("words_b"))):
                if a != last:
                    last, held = a, unpack_set(wa.as_py())
                out[k] = weighted_jaccard(held, unpack_set(wb.as_py()))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out)], names=["a", "b", "s"])

    joined = pairs.join(sets.select(F.col("text_key").alias("b"), F.col("words").alias("words_b")), "b").join(
        sets.select(F.col("text_key").alias("a"), F.col("words").alias("words_a")), "a"
    )
    return joined.select("a", "b", "words_a", "words_b").mapInArrow(at_rest(run), "a binary, b binary, s double")


def own_weights(sets: DataFrame) -> DataFrame:
    """``text_key, total, own``: weight of a set, and of its shingles that no other set has.

    Two sets share at most the smaller of what is not their own, which bounds their similarity
    without comparing them; an edited copy owns every shingle an edit made.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, words in zip(batch.column("text_key").to_pylist(), batch.column("words")):
                h, w = unpack_set(words.as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(h), int.from_bytes(key[:8], "big", signed=True))), pa.array(h), pa.array(w)], names=["tid", "h", "w"]
                )

    each = sets.mapInArrow(at_rest(spread), "tid long, h long, w double")
    single = each.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("tid").alias("tid"), F.max("w").alias("w")).filter("n = 1")
    own = single.groupBy("tid").agg(F.sum("w").alias("own"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("text_key").to_pylist()
            total = [float(unpack_set(words.as_py())[1].sum()) for words in batch.column("words")]
            tid = [int.from_bytes(key[:8], "big", signed=True) for key in keys]
            yield pa.RecordBatch.from_arrays([batch.column("text_key"), pa.array(tid, pa.int64()), pa.array(total, pa.float64())], names=["text_key", "tid", "total"])

    totals = sets.mapInArrow(at_rest(weigh), "text_key binary, tid long, total double")
    return totals.join(own, "tid", "left").select("text_key", "total", F.coalesce("own", F.lit(0.0)).alias("own"))


def components(links: DataFrame, made: list[DataFrame] | None = None) -> DataFrame:
    """``node, root`` for every node of ``links`` (a, b): the least node of its component.

    Alternating large-star and small-star steps; the number of rounds is logarithmic in the
    length of a chain. Each round is written before the next begins, and then the one before is
    deleted; the last is added to ``made``, which the caller deletes when it has read the result.
    """
    edges = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "links")

    def star(e: DataFrame, both: bool) -> DataFrame:
        near = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else e
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = near.join(least, "u")
        if both:  # larger neighbours point to the least one
            return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        out = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return out.unionByName(least.select("u", F.col("m").alias("v"))).filter("u > v")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(edges)
    while before[0]:
        old, edges = edges, settle(star(star(edges, True).distinct(), False).distinct(), "links")
        discard(old)
        after = mark(edges)
        if after == before:
            break
        before = after
    if made is not None:
        made.append(edges)
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def links_of(texts: DataFrame, sets: DataFrame, similarity: float, made: list[DataFrame]) -> DataFrame:
    """``a, b`` links that connect every two texts of a bucket that reach ``similarity``.

    ``texts`` has ``text_key, copies, bands, total, own``. The hub of a bucket is its text with
    most copies. Tables that the result reads are added to ``made``, the others deleted.
    """
    far = 1.0 - similarity
    rows = texts.select("text_key", "copies", "total", "own", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("copies", "text_key")).alias("hub")).filter("size > 1")
    members = settle(rows.join(shared.select("bucket", F.col("hub.text_key").alias("hub")), "bucket"), "dup-members")
    pairs = members.filter("text_key <> hub").select(F.col("hub").alias("a"), F.col("text_key").alias("b")).distinct()
    known = settle(similarities(pairs, sets), "dup-similar")
    linked = known.filter(F.col("s") >= similarity).select("a", "b")
    # members without the hub; a text that owns more than the rest allows is linked to nothing
    to_hub = known.select(F.col("a").alias("hub"), F.col("b").alias("text_key"), (1 - F.col("s")).alias("d"))
    left = members.filter(F.col("own") <= far * F.col("total") + 1e-6).join(to_hub, ["hub", "text_key"]).drop("hub")
    held: list[DataFrame] = [members]
    roots = components(linked, held).withColumnRenamed("node", "text_key")
    rest = settle(left.join(roots, "text_key", "left").withColumn("root", F.coalesce("root", "text_key")), "dup-rest")
    for t in held:
        discard(t)
    # the largest component of a bucket is settled; the others are open
    per_root = rest.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    main = per_root.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("m"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    mixed = rest.join(main.select("bucket", F.col("m.root").alias("main")), "bucket").withColumn("open", F.col("root") != F.col("main"))
    spread = mixed.filter("open").groupBy("bucket").agg(F.min("d").alias("low"), F.max("d").alias("high"))
    near = F.col("open") | F.col("d").between(F.col("low") - far - 1e-9, F.col("high") + far + 1e-9)
    columns = ("text_key", "root", "d", "total", "own", "open", "bands")
    kept = settle(mixed.join(spread, "bucket").filter(near).join(texts.select("text_key", "bands"), "text_key").select("bucket", *columns), "dup-open")
    discard(rest)
    ask = kept.filter("open").select("bucket", *(F.col(c).alias(f"o_{c}") for c in columns))
    common = F.least(F.col("total") - F.col("own"), F.col("o_total") - F.col("o_own"))
    # the pair is asked for in the first bucket both are in, and once where both are open
    place = F.array_position(F.zip_with("bands", "o_bands", lambda x, y: x == y), True)
    apart = (
        (F.col("root") != F.col("o_root"))
        & (~F.col("open") | (F.col("text_key") < F.col("o_text_key")))
        & (F.abs(F.col("d") - F.col("o_d")) <= far + 1e-9)
        & (common * (1 + similarity) + 1e-6 >= similarity * (F.col("total") + F.col("o_total")))
        & (F.element_at("bands", place.cast("int")) == F.col("bucket"))
    )
    seen = known.select("a", "b").unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b")))
    asked = kept.join(ask, "bucket").filter(apart).select(F.col("o_text_key").alias("a"), F.col("text_key").alias("b"))
    fresh = settle(similarities(asked.join(seen, ["a", "b"], "left_anti"), sets), "dup-similar")
    discard(kept)
    made += [known, fresh]
    return linked.unionByName(fresh.filter(F.col("s") >= similarity).select("a", "b"))


def near_duplicates(df: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id, class_size`` of every document: the least id among the documents linked
    to it, directly or through others, and how many they are.

    Texts are linked that are equal or whose weighted Jaccard similarity is at least
    ``similarity``. Texts without words, null texts among them, are linked to equal ones only (a
    null text counts as empty). Rows without an id take part; a class of only such rows has no
    id. Repeated rows repeat. An empty table gives no rows.
    """
    docs = id_and_text(df, id_col, text_col)
    frequency, n = document_frequencies(docs)
    codes = docs.sparkSession.sparkContext.broadcast(rarity(frequency, n))
    held = settle(sketches(docs, codes), "dup-sketches")
    per = held.groupBy("text_key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    texts = settle(per.join(held.filter("bands is not null").select("text_key", "bands").dropDuplicates(["text_key"]), "text_key", "left"), "dup-texts")
    keys_of = settle(held.select("id", "text_key"), "dup-keys")
    discard(held)
    banded = texts.filter("bands is not null").select("text_key", "copies", "bands")
    # only texts that share a bucket are ever compared
    keys = banded.select("text_key", F.explode("bands").alias("bucket"))
    shared = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("bucket")
    common = settle(keys.join(shared, "bucket", "left_semi").select("text_key").distinct(), "dup-common")
    some = settle(weighted_sets(docs, codes, common), "dup-sets")
    discard(common)
    compared = settle(banded.join(own_weights(some), "text_key"), "dup-compared")
    made: list[DataFrame] = []
    roots = settle(components(links_of(compared, some, similarity, made), made), "dup-roots")
    for t in (*made, some, compared):
        discard(t)
    member: Column = F.coalesce("root", "text_key")
    rooted = settle(texts.drop("bands").join(roots.withColumnRenamed("node", "text_key"), "text_key", "left").withColumn("root", member), "dup-rooted")
    for t in (texts, roots):
        discard(t)
    classes = rooted.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"))
    return (
        keys_of.join(rooted.join(classes, "root").select("text_key", "class_id", "class_size"), "text_key")
        .select(F.col("id").alias("doc_id"), "class_id", "class_size")
    )
