"""Contiguous chunks, samples and length-grouped batches without a global sort in one task."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import scale
from ..session import settle


def seeded_sample(df: DataFrame, n: int, key: str, seed: int = 17) -> DataFrame:
    """``min(n, all)`` rows without replacement, in seeded order."""
    order = scale.seeded_hash(seed, key)
    return df.withColumn("_o", order).orderBy("_o", key).limit(n).drop("_o")


def _total(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def chunked(df: DataFrame, order: list[str], n_chunks: int) -> DataFrame:
    """Add ``chunk``: contiguous chunks of ceil(rows / n). There may be fewer than ``n_chunks``."""
    size = F.ceil(_total(df) / n_chunks)
    return scale.ordered_index(df, order, "_idx").withColumn(
        "chunk", F.floor((F.col("_idx") - 1) / size).cast("bigint")
    ).drop("_idx")


def get_chunk(df: DataFrame, order: list[str], n_chunks: int, k: int) -> DataFrame:
    """Chunk ``k``; empty when there are fewer chunks than that."""
    return chunked(df, order, n_chunks).filter(F.col("chunk") == k).drop("chunk")


def zip_by_position(left: DataFrame, left_order: list[str], right: DataFrame, right_order: list[str]) -> DataFrame:
    """Rows side by side by their position, as far as the shorter side goes."""
    a = scale.ordered_index(left, left_order, "position")
    b = scale.ordered_index(right, right_order, "position")
    return a.join(b, "position")


def length_batches(
    rows: DataFrame,
    key: str,
    length: str,
    batch_size: int,
    world_size: int = 1,
    seed: int = 17,
    within: tuple[str, ...] = (),
) -> DataFrame:
    """Seeded mega-batches of ``batch_size * world_size`` rows, longest first, split evenly.

    Adds ``mega`` (mega-batch), ``rank`` (chunk inside it) and ``slot`` (place in the chunk).
    A mega-batch that divides evenly gives each next row to the shortest chunk that has room;
    otherwise rows go round robin.
    """
    mega_size = batch_size * world_size
    shuffled = rows.withColumn("_md5", scale.seeded_hash(seed, key))
    placed = scale.ordered_index(
        shuffled, ["_md5", key], "_pos", within, bucket=scale.hash_bucket(F.col("_md5"))
    ).withColumn("mega", F.floor((F.col("_pos") - 1) / mega_size).cast("bigint"))
    by_length = Window.partitionBy(*within, "mega").orderBy(F.col(length).desc(), "_pos")
    sorted_rows = placed.withColumn("_r", F.row_number().over(by_length) - 1).drop("_md5", "_pos")
    if world_size == 1:
        return (
            sorted_rows.withColumn("rank", F.lit(0).cast("bigint"))
            .withColumn("slot", F.col("_r").cast("bigint"))
            .drop("_r")
        )

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("rank", T.LongType()), T.StructField("slot", T.LongType())])))
    def deal(batches: pd.Series) -> pd.Series:
        def one(sizes) -> list[tuple[int, int]]:
            n = len(sizes)
            if n % world_size:
                return [(r % world_size, r // world_size) for r in range(n)]
            load, filled, out = [0.0] * world_size, [0] * world_size, []
            for size in sizes:
                k = load.index(min(load))
                out.append((k, filled[k]))
                filled[k] += 1
                load[k] = float("inf") if filled[k] == n // world_size else load[k] + float(size)
            return out

        return batches.map(one)

    # a mega-batch is one row of at most batch_size * world_size entries; Python sees the lengths only
    keys = [*within, "mega"]
    cols = [c for c in sorted_rows.columns if c not in (*keys, "_r")]
    packed = sorted_rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_r", F.struct(*cols).alias("row")))).alias("_rows"))
    lengths = F.transform("_rows", lambda r: r["row"][length].cast("double"))
    dealt = packed.withColumn("_deal", deal(lengths)).select(*keys, F.explode(F.arrays_zip("_rows", "_deal")).alias("_z"))
    return dealt.select(*keys, "_z._rows.row.*", "_z._deal.rank", "_z._deal.slot")


def modality_batches(
    rows: DataFrame, key: str, signed_length: str, batch_size: int, world_size: int = 1, seed: int = 17
) -> DataFrame:
    """Image rows (positive length) and text rows (negative) batched apart.

    The last mega-batch of each kind joins one final mixed batch, sorted by key; the others
    come in seeded order. Adds ``batch_no`` and ``place`` (order inside the mega-batch). With
    one kind only, that kind is batched alone and no mixed batch is made.
    """
    mega_size = batch_size * world_size
    split = rows.withColumn("modality", F.when(F.col(signed_length) > 0, "image").otherwise("text")).withColumn(
        "_abs", F.abs(F.col(signed_length))
    )
    # where every row went is written once; the regular batches, the mixed one and the sizes read it
    dealt = settle(length_batches(split, key, "_abs", batch_size, world_size, seed, within=("modality",)), "dealt")
    last = {r.modality: r.last for r in dealt.groupBy("modality").agg(F.max("mega").alias("last")).collect()}  # two at most
    both = len(last) == 2
    is_last = F.lit(False)
    for name, mega in last.items():
        is_last = is_last | ((F.col("modality") == name) & (F.col("mega") == mega))
    whole = {name: mega + (not both) for name, mega in last.items()}  # regular mega-batches are numbered from 0
    if both:
        each = [dealt.sparkSession.range(n).select(F.lit(name).alias("modality"), F.col("id").alias("mega")) for name, n in whole.items()]
        names = each[0].unionByName(each[1]).withColumn("_bh", scale.seeded_hash(f"{seed}|batch", "modality", "mega"))
        order = ["_bh", "modality", "mega"]
        numbers = scale.ordered_index(names, order, "batch_no", bucket=scale.hash_bucket(F.col("_bh"))).select(
            "modality", "mega", (F.col("batch_no") - 1).alias("batch_no")
        )
        regular = dealt.filter(~is_last).join(numbers, ["modality", "mega"])
    else:
        regular = dealt.withColumn("batch_no", F.col("mega"))
    inside = Window.partitionBy("batch_no").orderBy("rank", "slot")
    cols = [*rows.columns, "modality", "batch_no", "place"]
    placed = regular.withColumn("place", F.row_number().over(inside) - 1).select(*cols)
    if not both:
        return placed
    mixed = dealt.filter(is_last).withColumn("batch_no", F.lit(sum(whole.values())).cast("bigint"))  # two mega-batches at most
    mixed = mixed.withColumn("place", F.row_number().over(Window.partitionBy("batch_no").orderBy(key)) - 1)
    return placed.unionByName(mixed.select(*cols))
