"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length in words. A source takes whole copies of all its
documents and a remainder; a bounded-knapsack dynamic program over the length counts fits the
remainder, and per length the wanted number of documents is drawn in seeded order. Only counts
are grouped by source: the largest group holds one row per distinct length, and a source with a
third of all rows is ranked in hash cells like any other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

WEIGHTS = (5, 2, 1)  # of the sources in code point order, repeating
SHARE = 1.5  # of all words
REPEATS = 2  # most copies of a document
CELLS = 512  # hash cells per source and length, a power of two
WINDOW = 4  # lengths of the longest document left to the dynamic program
SEED = 17


def word_count(text: Column) -> Column:
    """Number of runs other than space, tab, line feed, vertical tab, form feed and return; null is 0."""
    lead = F.regexp_replace(text, r"^[\x20\x09-\x0D]+", "")
    return F.coalesce(F.char_length(F.regexp_replace(lead, r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")), F.lit(0)).cast("long")


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that the words come to ``budget``, or as near
    below as the counts allow.

    The same share of every length is taken first, then one more of each in order of the fraction
    left, down to a few times the longest length. The dynamic program fills the rest: it marks
    every sum it can reach with the lengths still there and keeps the step that reached it first.
    """
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return take
    if budget >= total:
        return counts.copy()
    longest = int(lengths.max())
    spare = budget - WINDOW * longest
    if spare > 0:
        # products of counts and budget pass 2**63 at large sizes, so whole numbers of Python
        exact = [int(c) * spare for c in counts]
        take = np.array([x // total for x in exact], np.int64)
        spare -= int((take * lengths).sum())
        for k in sorted(range(len(lengths)), key=lambda k: (-(exact[k] % total), -int(lengths[k]))):
            if lengths[k] <= spare and take[k] < counts[k]:
                take[k] += 1
                spare -= int(lengths[k])
    rest = budget - int((take * lengths).sum())
    step_of = np.full(rest + 1, -1, np.int32)  # the step that reached a sum first
    reached = np.zeros(rest + 1, bool)
    reached[0] = True
    steps: list[tuple[int, int, int]] = []  # length index, documents, words
    for k in np.argsort(-lengths, kind="stable"):
        left, size = int(counts[k] - take[k]), int(lengths[k])
        left = min(left, rest // size)
        part = 1
        while left > 0 and not reached[rest]:
            n = min(part, left)
            new = reached[: rest + 1 - n * size] & ~reached[n * size :]
            at = np.flatnonzero(new) + n * size
            step_of[at] = len(steps)
            reached[at] = True
            steps.append((int(k), n, n * size))
            left, part = left - n, part * 2
        if reached[rest]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at:
        k, n, words = steps[step_of[at]]
        take[k] += n
        at -= words
    return take


def targets(sizes: DataFrame) -> DataFrame:
    """``key, source_size, target`` per source from ``key, source, size`` rows.

    Shares by weight are cut at ``REPEATS`` times the source, and the excess goes to the others by
    weight until nobody is above: the level (words per unit of weight) rises with each round.
    """
    per = sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    # numbering in code point order: by range partition, so no task holds all sources
    ranged = settle(per.repartitionByRange(F.col("source").isNull(), "source").withColumn("part", F.spark_partition_id()), "mix-sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy(F.asc_nulls_last("source"))
    place = (F.col("before") + F.row_number().over(inside) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place + 1).cast("int")).cast("double")
    weighed = settle(ranged.join(offsets, "part").select("key", "source_size", weight.alias("w")), "mix-weights")

    total, weights = weighed.agg(F.sum("source_size"), F.sum("w")).first()
    total, capped = SHARE * (total or 0), -1
    level = total / weights if weights else 0.0
    most = (REPEATS * F.col("source_size")).cast("double")
    while total:
        over = F.col("w") * level > most
        n, held, free = weighed.agg(F.count_if(over), F.sum(F.when(over, most)), F.sum(F.when(~over, F.col("w")))).first()
        if n == capped or not free:
            break
        capped, level = n, (total - (held or 0.0)) / free
    return weighed.select("key", "source_size", F.least(most, F.col("w") * level).alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", draw_col: str | None = None, seed: int = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document.

    ``taken`` counts the words of the copies taken: 0, 1 or 2 times the size. Documents without
    words take nothing. The draw is seeded by ``draw_col``, or the id. A null
    source is a source of its own, weighed last. Repeated rows are
    documents of their own with equal chances. An empty table gives no rows.
    """
    docs = settle(
        df.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("null")).alias("key"),
            word_count(F.col(text_col)).alias("size"),
            F.xxhash64(F.lit(seed), F.col(draw_col or id_col)).alias("draw"),
        ).withColumn("cell", F.shiftrightunsigned("draw", 55)),
        "mix-docs",
    )
    cells = docs.groupBy("key", "source", "size", "cell").agg(F.count(F.lit(1)).alias("n"))
    cells = settle(cells, "mix-cells")
    counts = cells.groupBy("key", "size").agg(F.sum("n").alias("n"), F.first("source").alias("source"))
    wanted = targets(cells.select("key", "source", (F.col("size") * F.col("n")).alias("size")))
    words = F.least(F.round("target").cast("long"), REPEATS * F.col("source_size"))
    plan = wanted.withColumn("words", words).withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(0))
    plan = settle(plan.withColumn("rest", F.col("words") - F.col("copies") * F.col("source_size")), "mix-plan")

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        take = fit(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), int(pdf["rest"].iloc[0]))
        return pdf[["key", "size"]].assign(take=take)

    quota = (
        counts.filter("size > 0").join(plan.select("key", "rest"), "key").select("key", "size", "n", "rest")
        .groupBy("key").applyInPandas(fitted, "key string, size long, take long")
    )
    earlier = Window.partitionBy("key", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    shares = (
        cells.join(quota, ["key", "size"], "left").join(plan.select("key", "copies", "source_size", "target"), "key")
        .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .select("key", "size", "cell", "copies", "source_size", "target", F.greatest(F.lit(0), F.coalesce("take", F.lit(0)) - F.col("before")).alias("more"))
    )
    order = Window.partitionBy("key", "size", "cell").orderBy("draw", "doc_id")
    chosen = (F.row_number().over(order) <= F.col("more")).cast("long")
    return (
        docs.drop("source").join(shares, ["key", "size", "cell"])
        .select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), ((F.col("copies") + chosen) * F.col("size")).cast("long").alias("taken"))
    )
