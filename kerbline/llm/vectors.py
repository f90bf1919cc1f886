"""Helpers of the vector operators: integer components, Arrow matrices, totals joined back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle

LIMIT = 1 << 27  # integer components are held at this magnitude, so that a squared distance fits a long
SMALL = 1 << 53  # sums below this are exact in doubles


def finite(vector: Column) -> Column:
    """True where the vector is given and no component is null, NaN or infinite."""
    whole = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & whole


def floored(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, held to ±2**27."""

    def one(x: Column) -> Column:
        return F.floor(F.greatest(F.lit(float(-LIMIT)), F.least(F.lit(float(LIMIT)), F.lit(float(scale)) * x.cast("double")))).cast("int")

    return F.transform(vector, one)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column whose rows have one length, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def arrays(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a matrix as a list column."""
    ends = np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(m).ravel(), kind))


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of ``x`` to every row of ``c``, as longs."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * top * top * max(1, x.shape[1]) < SMALL:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)).astype(np.int64)
    a, out = x.astype(np.int64), np.empty((len(x), len(c)), np.int64)
    for k, row in enumerate(c.astype(np.int64)):
        out[:, k] = ((a - row) ** 2).sum(axis=1)
    return out


def group_sums(owner: np.ndarray, x: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of rows and componentwise sums (longs) of each group."""
    order = np.argsort(owner, kind="stable")
    n, sums = np.bincount(owner, minlength=groups), np.zeros((groups, x.shape[1]), np.int64)
    held = np.flatnonzero(n)
    if len(held):
        starts = np.concatenate(([0], np.cumsum(n)[:-1]))[held]
        sums[held] = np.add.reduceat(x[order].astype(np.int64), starts, axis=0)
    return n, sums


def summed(value: str) -> Column:
    """A sum of longs that cannot overflow, held to the range of a long."""
    return F.least(F.sum(F.col(value).cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")


def with_total(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``value`` summed over the rows of equal ``key`` (nulls together) as a new column.

    Sums are made map-side first and written, so that the optimiser knows their size. A key with
    more rows than an even share of the shuffle partitions is hot; there are fewer hot keys than
    partitions. Rows of a hot key meet a copy of its sum per salt, so they are dealt over all tasks.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    totals = settle(df.groupBy(F.col(key).alias("_key")).agg(summed(value).alias(name), F.count(F.lit(1)).alias("_n")), "totals")
    rows = totals.agg(F.sum("_n")).first()[0] or 0
    hot = [r._key for r in totals.filter(F.col("_n") * parts > rows).select("_key").collect()]

    def is_hot(c: str) -> Column:
        named = F.coalesce(F.col(c).isin([k for k in hot if k is not None]), F.lit(False))
        return named | F.col(c).isNull() if None in hot else named

    salts = F.when(is_hot("_key"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    copies = totals.select("_key", name, F.explode(salts).alias("_salt"))
    salt = F.when(is_hot(key), F.pmod(F.xxhash64(*df.columns), F.lit(parts)).cast("int")).otherwise(F.lit(0))
    dealt = df.withColumn("_row_salt", salt)
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_row_salt") == F.col("_salt"))
    return dealt.join(copies, same).drop("_key", "_salt", "_row_salt")
