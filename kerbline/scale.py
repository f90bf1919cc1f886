"""Ordered numbering and running totals without a single-task sort.

``row_number()`` over a whole table, or over a key that owns a third of it, sorts that
share in one task. Here the order is first cut into buckets, each bucket is numbered on
its own, and a small table of bucket totals supplies the offsets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import settle


ROWS_PER_TASK = 1 << 19  # rows of a large table that one task of its shuffle reads


def settle_by_rows(df: DataFrame, rows: int, name: str) -> DataFrame:
    """``settle`` with a shuffle partition for every ``ROWS_PER_TASK`` of the ``rows`` it shuffles.

    A task then reads the same share at any size. The session's number counts where it is larger,
    and holds again afterwards; partitions that turn out small are merged by the engine as ever.
    """
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.shuffle.partitions")
    conf.set("spark.sql.shuffle.partitions", str(max(int(before), math.ceil(rows / ROWS_PER_TASK))))
    try:
        return settle(df, name)
    finally:
        conf.set("spark.sql.shuffle.partitions", before)


def seeded_hash(seed: int | str, *cols: str | Column) -> Column:
    """``md5(seed|a|b…)``: the seeded order used for every shuffle and pick."""
    parts = [F.lit(str(seed))]
    for c in cols:
        parts += [F.lit("|"), (F.col(c) if isinstance(c, str) else c).cast("string")]
    return F.md5(F.concat(*parts))


def hash_bucket(md5_col: Column) -> Column:
    """4,096 even buckets that keep the order of an md5 text."""
    return F.conv(F.substring(md5_col, 1, 3), 16, 10).cast("int")


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows out to all cores: for wide work on tables of few files, stated where it is used."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def _ranged(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows with ``_bkt``, a bucket number that follows ``order`` (the last column unique).

    Buckets are the range partitions of one shuffle, as many as the session's shuffle partitions.
    They are written once, so the input is evaluated once and the numbers stay what they are; the
    numbering built on them is exact wherever the cuts fall.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settle(df.repartitionByRange(parts, *order).withColumn("_bkt", F.spark_partition_id()), "ranged")


def ordered_index(
    df: DataFrame,
    order: Sequence[str],
    out: str = "idx",
    within: Sequence[str] = (),
    bucket: Column | None = None,
) -> DataFrame:
    """Number rows 1..n by ``order`` inside each ``within`` key, in parallel."""
    b = df.withColumn("_bkt", bucket) if bucket is not None else _ranged(df, order)
    keys = [*within, "_bkt"]
    before = (
        Window.partitionBy(*(within or [F.lit(0)]))
        .orderBy("_bkt")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        b.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    )
    local = Window.partitionBy(*keys).orderBy(*order)
    return (
        b.withColumn("_rn", F.row_number().over(local))
        .join(offsets, keys)
        .withColumn(out, F.col("_off") + F.col("_rn"))
        .drop("_bkt", "_rn", "_off")
    )


def running_mean(
    df: DataFrame,
    within: Sequence[str],
    order: Sequence[str],
    value: str,
    out: str = "running_mean",
    bucket: Column | None = None,
) -> DataFrame:
    """Mean of all rows up to and including each row, for keys of any size."""
    b = df.withColumn("_bkt", bucket) if bucket is not None else _ranged(df, order)
    keys = [*within, "_bkt"]
    before = (
        Window.partitionBy(*(within or [F.lit(0)]))
        .orderBy("_bkt")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        b.groupBy(*keys)
        .agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
        .select(
            *keys,
            F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"),
            F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_c0"),
        )
    )
    local = (
        Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        b.withColumn("_s1", F.sum(value).over(local))
        .withColumn("_c1", F.count(value).over(local))
        .join(offsets, keys)
        .withColumn(out, (F.col("_s0") + F.col("_s1")) / (F.col("_c0") + F.col("_c1")))
        .withColumn("n_so_far", F.col("_c0") + F.col("_c1"))
        .drop("_bkt", "_s0", "_c0", "_s1", "_c1")
    )
