"""Streaming jobs over chat and vote logs, new images and scores.

Each ``…_plan`` works on a streaming or a batch DataFrame with ``ts``; ``run_available``
drains a stream into a table on shared storage and returns that table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.goals import unfinished
from ..session import scratch_path


BUCKETS = 64  # of a keyed table; a batch rewrites those its keys fall into


def run_available(
    plan: DataFrame, name: str, mode: str = "append", keys: Sequence[str] = (), out: str | None = None, state: str | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Process what is there, once, and return the table it has led to so far.

    ``out`` and ``state`` name the table and the stream's checkpoint; a call with those of an
    earlier one reads only what is new. They are fresh folders if left out. ``append`` adds rows,
    ``complete`` keeps the last result, ``update`` merges the changed rows by ``keys`` into a table
    of ``buckets`` (the same number in every call). A stream that has led to nothing yet gives an
    empty table.
    """
    spark = plan.sparkSession
    out, state = out or scratch_path(spark, name), state or scratch_path(spark, f"{name}-state")
    if mode == "update" and not keys:
        raise ValueError("update mode needs the keys that changed rows are merged by")
    writer = plan.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
        query.awaitTermination()
        return spark.read.schema(plan.schema).parquet(out)

    def step(batch: DataFrame, number: int) -> None:
        merge_batch(batch, number, out, keys if mode == "update" else (), buckets if mode == "update" else 1)

    writer.foreachBatch(step).start().awaitTermination()
    return read_versions(spark, out, plan.schema)


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``; none if it is not there."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()] if fs.exists(folder) else []


def _versions(spark: SparkSession, out: str, bucket: int) -> list[int]:
    """Versions of a bucket, oldest first."""
    return sorted(int(f.split("=")[1]) for f in _folders(spark, f"{out}/bucket={bucket}") if f.startswith("version="))


def merge_batch(batch: DataFrame, number: int, out: str, keys: Sequence[str], buckets: int) -> list[int]:
    """Write the buckets that ``batch`` touches as version ``number``; returns them.

    A bucket's new version holds the batch's rows and the earlier ones of other keys; without keys
    there is one bucket and the batch replaces it. A micro-batch that is repeated starts from the
    version before it and writes the same again. That version is kept until the next one is there,
    older ones are deleted.
    """
    spark, schema = batch.sparkSession, batch.schema
    spot = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int") if keys else F.lit(0)
    batch = batch.withColumn("bucket", spot).persist()
    try:
        touched = sorted(r.bucket for r in batch.select("bucket").distinct().collect()) if keys else [0]
        base = {b: [v for v in _versions(spark, out, b) if v < number] for b in touched}
        new = batch
        paths = [f"{out}/bucket={b}/version={v[-1]}" for b, v in base.items() if v] if keys else []
        if paths:
            earlier = spark.read.option("basePath", out).schema(_placed(schema)).parquet(*paths).drop("version")
            new = batch.unionByName(earlier.join(batch, list(keys), "left_anti"))
        new = new.withColumn("version", F.lit(number))
        if keys:
            new = new.repartition("bucket")
        writer = new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("bucket", "version").parquet(out)
    finally:
        batch.unpersist()
    for b, versions in base.items():
        for v in versions[:-1]:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/bucket={b}/version={v}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return touched


def _placed(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("version", T.IntegerType())])


def read_versions(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """The last version of every bucket."""
    buckets = [int(f.split("=")[1]) for f in _folders(spark, out) if f.startswith("bucket=")]
    paths = [f"{out}/bucket={b}/version={v[-1]}" for b in buckets if (v := _versions(spark, out, b))]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.option("basePath", out).schema(_placed(schema)).parquet(*paths).select(*schema.names)


def daily_log(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events per day and type: the counts behind the daily log files."""
    windowed = events.withWatermark("ts", late) if events.isStreaming else events
    return (
        windowed.groupBy(F.window("ts", "1 day").alias("w"), "type")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("day"), "type", "n")
    )


VOTES = ["upvote", "downvote", "flag"]


def votes_per_model(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    windowed = events.withWatermark("ts", late) if events.isStreaming else events
    return (
        windowed.filter(F.col("type").isin(VOTES))
        .groupBy(F.window("ts", width).alias("w"), "model")
        .agg(*[F.count_if(F.col("type") == v).alias(v) for v in VOTES])
        .select(F.col("w.start").alias("day"), "model", *VOTES)
    )


def chat_latency(events: DataFrame, late: str = "1 hour", accuracy: int = 10_000) -> DataFrame:
    """Seconds from start to finish of chats, per day and model."""
    windowed = events.withWatermark("ts", late) if events.isStreaming else events
    seconds = F.col("finish") - F.col("start")
    return (
        windowed.filter(F.col("type") == "chat")
        .withColumn("seconds", seconds)
        .groupBy(F.window("ts", "1 day").alias("w"), "model")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("seconds").alias("mean_s"),
            F.percentile_approx("seconds", 0.95, accuracy).alias("p95_s"),
        )
        .select(F.col("w.start").alias("day"), "model", "n", "mean_s", "p95_s")
    )


def running_scores(scores: DataFrame) -> DataFrame:
    """Mean and count per tag and metric so far; run in ``complete`` mode, or in ``update`` mode by
    tag and metric."""
    return scores.groupBy("tag", "metric").agg(
        F.sum("value").alias("total"), F.count("value").alias("n"), F.avg("value").alias("mean_value")
    )


def first_copies(events: DataFrame, content: Column, late: str = "1 day") -> DataFrame:
    """One event per content hash and day."""
    keyed = events.withColumn("content_hash", F.md5(content)).withColumn("day", F.to_date("ts"))
    if events.isStreaming:
        return keyed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["day", "content_hash"])
    return keyed.dropDuplicates(["day", "content_hash"])


def generate_incrementally(
    images: DataFrame, finished_path: str, generate: Callable[[DataFrame], DataFrame], state: str | None = None
) -> None:
    """For each batch of new images: skip the finished ones, generate and append the rest.

    With the ``state`` folder of an earlier call only new images are read.
    """
    spark = images.sparkSession

    def step(batch: DataFrame, _: int) -> None:
        try:
            done = spark.read.parquet(finished_path)
            batch = unfinished(batch, done)
        except Exception as e:  # first batch: nothing is finished yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        generate(batch).write.mode("append").parquet(finished_path)

    query = (
        images.writeStream.foreachBatch(step)
        .option("checkpointLocation", state or scratch_path(spark, "generate-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


# ---- silence of a source ------------------------------------------------------------

def silent_gaps(events: DataFrame, key: str, limit_s: float) -> DataFrame:
    """Batch form: events of a source that are followed by more than ``limit_s`` of silence.

    The next event of each source comes from time buckets, so a source that sends a third of
    all events is not sorted in one task: the last event of a bucket meets the first event of
    the source's next bucket.
    """
    t = events.select(key, "ts").withColumn("_b", F.date_trunc("hour", F.col("ts")))
    inside = Window.partitionBy(key, "_b").orderBy("ts")
    local = t.withColumn("next_ts", F.lead("ts").over(inside))
    heads = t.groupBy(key, "_b").agg(F.min("ts").alias("_first"))
    across = heads.withColumn("_next", F.lead("_first").over(Window.partitionBy(key).orderBy("_b"))).select(
        key, "_b", "_next"
    )
    joined = local.join(across, [key, "_b"]).withColumn("next_ts", F.coalesce("next_ts", "_next"))
    gap = F.unix_micros("next_ts") - F.unix_micros("ts")
    return joined.filter(gap > int(limit_s * 1_000_000)).select(
        key, F.col("ts").alias("last_seen"), "next_ts", gap.alias("gap_us")
    )


HELD_SLICES = 100_000  # (source, slice) pairs a task holds before it passes them on


def slice_ends(events: DataFrame, key: str, limit_s: float) -> DataFrame:
    """First and last event of each source and time slice that a task sees: ``(key, ts)``.

    Slices are no wider than the limit, so no silence lies inside one and the events between its
    ends can go. This runs where the events are read: a source that sends a third of them is worked
    on by all those tasks, and at most two rows per task and slice of it are shuffled.
    """
    width = max(1, int(limit_s * 1_000_000))
    rows = events.filter(F.col("ts").isNotNull()).select(key, "ts")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            us = batch.column("ts").cast(pa.int64()).to_numpy()
            part = pa.table({"k": batch.column(key), "slice": us // width, "first": us, "last": us})
            both = part if held is None else pa.concat_tables([held, part])
            held = both.group_by(["k", "slice"]).aggregate([("first", "min"), ("last", "max")]).rename_columns(["k", "slice", "first", "last"])
            if held.num_rows > HELD_SLICES:
                yield from rows_of(held, batch.schema)
                held = None
        if held is not None:
            yield from rows_of(held, batch.schema)

    def rows_of(held: pa.Table, schema: pa.Schema) -> list[pa.RecordBatch]:
        wide = held.filter(pc.greater(held["last"], held["first"]))
        ts = pa.chunked_array([*held["first"].chunks, *wide["last"].chunks], pa.int64()).cast(schema.field("ts").type)
        keys = pa.chunked_array([*held["k"].chunks, *wide["k"].chunks], held["k"].type)
        return pa.table([keys, ts], names=[key, "ts"]).to_batches()

    return rows.mapInArrow(ends, rows.schema)


def stale_sources(events: DataFrame, key: str, limit_s: float, late: str = "10 minutes") -> DataFrame:
    """Streaming form: one row per silence longer than ``limit_s``, when it is noticed.

    Tasks first keep the ends of time slices no wider than the limit (``slice_ends``), which loses
    no silence and leaves a few rows of even the busiest source. State per source is its last event
    time. A silence is reported by the timeout, or by a later event of the same source that arrives
    first. Events without a time are left out.
    """
    limit_ms = int(limit_s * 1000)
    key_type = events.schema[key].dataType.simpleString()

    def watch(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            (last,) = state.get
            out.append((k[0], pd.Timestamp(last, unit="us"), None))
            state.remove()
        else:
            parts = [pdf["ts"].to_numpy(dtype="datetime64[us]").astype("int64") for pdf in batches]
            times = np.sort(np.concatenate([[state.get[0]] if state.exists else [], *parts]).astype("int64"))
            for i in np.flatnonzero(np.diff(times) > limit_ms * 1000):
                out.append((k[0], pd.Timestamp(times[i], unit="us"), pd.Timestamp(times[i + 1], unit="us")))
            last = int(times[-1])
            state.update((last,))
            wake = max(last // 1000 + limit_ms, state.getCurrentWatermarkMs() + 1)
            state.setTimeoutTimestamp(wake)
        yield pd.DataFrame(out, columns=[key, "last_seen", "next_ts"])

    return (
        slice_ends(events, key, limit_s)
        .withWatermark("ts", late)
        .groupBy(key)
        .applyInPandasWithState(
            watch,
            f"{key} {key_type}, last_seen timestamp, next_ts timestamp",
            "last_us bigint",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )


def stream_table(spark: SparkSession, folder: str, file: str, schema) -> DataFrame:
    """A Parquet table of a folder, one file or a folder of part files, as a file stream."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{file}")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return spark.readStream.schema(schema).parquet(f"{folder}/{file}")
    return spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder)
