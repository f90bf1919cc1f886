"""Readers: images, annotations, goals, rasters, paths, records, benchmark files, logs.

Schemas are declared; what is absent is NULL. XML and JSON inputs should be converted to
Parquet once (``writers.to_parquet``): only there do filters and column choice reach the scan.
"""

from __future__ import annotations

import io
import math
import os
import re
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import geometry as G
from ..functions import text as X
from ..operators import boxes as B
from ..operators.benchmarks import last_per_key
from ..session import scratch_path, settle
from .writers import FILES_PER_TASK

IMAGE_SUFFIXES = [".png", ".jpg", ".jpeg", ".JPG"]  # fixed values, case counts
EXAMPLE_SUFFIXES = [".png", ".jpg", ".jpeg"]
PACKED_SUFFIXES = [".gz", ".bz2", ".deflate", ".snappy", ".lz4", ".zst"]  # the engine's text reader unpacks these
FILES_AT_ONCE = 32_000  # files of one plan; the driver holds them all
QUOTED = re.compile(r"[^A-Za-z0-9_\-!.~'()*,;:$&+=@\u00a0-\U0010ffff]|\s")  # in the file names of the engine's readers
MOST_MATCHES = 20_000  # most folders and files named by a pattern that are dealt to tasks


def _stem(name):
    return F.regexp_replace(name, r"\.[^.]*$", "")


@contextmanager
def _many_a_task(spark: SparkSession):
    """Plans made inside read some thousand small files a task, not 32; the driver forgets the files of earlier ones."""
    inside = {"spark.sql.files.openCostInBytes": "64k", "spark.sql.hive.manageFilesourcePartitions": "false"}
    before = {name: spark.conf.get(name) for name in inside}
    try:
        for name, value in inside.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _ends(name: str, suffixes: list[str]):
    return F.col(name).rlike(f"({'|'.join(map(re.escape, suffixes))})\\z")


def _matches(spark: SparkSession, path: str) -> list[str]:
    """What ``path`` names on the file system all tasks share; nothing for other file systems."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    found = (system.globStatus(pattern) if system.getScheme() == "file" else None) or []
    return [f.getPath().toUri().getPath() for f in found] if len(found) <= MOST_MATCHES else []


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The files an engine's reader of ``root`` takes: those in it, not hidden, not empty. A ``key=value``
    folder is a row without a name."""

    def inside(top: str) -> Iterator[tuple[str, str | None, int, int]]:
        if not os.path.isdir(top):
            facts = os.stat(top)
            yield *os.path.split(top), facts.st_size, facts.st_mtime_ns
            return
        with os.scandir(top) as entries:
            for entry in entries:
                if not entry.is_dir():
                    try:
                        yield top, entry.name, entry.stat().st_size, entry.stat().st_mtime_ns
                    except FileNotFoundError:  # a link to nothing
                        continue
                elif "=" in entry.name and not entry.name.startswith("."):
                    yield top, None, 1, 0

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        root, folder, name, length, modified = zip(*rows)
        columns = [root, folder, pa.array(name, pa.string()), pa.array([x and QUOTED.sub(lambda m: quote(m[0], safe=""), x) for x in name], pa.string())]
        columns += [pa.array(length, pa.int64()), pa.array(modified, pa.timestamp("us", "UTC"))]
        return pa.RecordBatch.from_pydict(dict(zip(("root", "folder", "filename", "quoted", "length", "modificationTime"), columns)))

    for batch in batches:
        for root in batch.column("root").to_pylist():
            rows = []
            for folder, name, size, modified in inside(root):
                n = name or ""
                hidden = n.startswith(".") or (n.startswith("_") and "=" not in n) or n.endswith("._COPYING_")
                if size == 0 or (hidden and not n.startswith(("_metadata", "_common_metadata"))):
                    continue
                rows.append((root, folder, name, size, modified // 1_000_000 * 1000))
                if len(rows) == FILES_PER_TASK:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)


def list_files(spark: SparkSession, path: str, suffixes: list[str] | None = None) -> DataFrame | None:
    """``(root, folder, filename, quoted, length, modificationTime)`` of the files of ``path``, written once.

    ``root`` is what the pattern names, a folder or a file; ``quoted`` is the name as in a URI. Tasks
    list the folders, each folder in one of them; the driver holds the roots alone. None where the
    pattern names nothing, too many roots, folders with ``key=value`` folders or another file system:
    the engine's readers must list there.
    """
    roots = _matches(spark, path)
    if not roots:
        return None
    tasks = min(len(roots), 8 * spark.sparkContext.defaultParallelism)
    dealt = spark.createDataFrame([(r,) for r in roots], "root string").repartition(tasks)
    found = dealt.mapInArrow(_list, "root string, folder string, filename string, quoted string, length bigint, modificationTime timestamp")
    if suffixes:
        found = found.filter(F.col("filename").isNull() | _ends("filename", suffixes))
    files = settle(found, "files")
    return files if files.filter("filename is null").isEmpty() else None


def with_contents(files: DataFrame) -> DataFrame:
    """Rows of ``list_files`` with the bytes as ``content``, read by tasks of ``FILES_PER_TASK`` files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, size = 0, [], 0
            for at, (folder, name) in enumerate(zip(batch.column("folder").to_pylist(), batch.column("filename").to_pylist()), 1):
                with open(f"{folder}/{name}", "rb") as f:
                    held.append(f.read())
                size += len(held[-1])
                if size >= 1 << 24 or at == batch.num_rows:  # large files leave in small batches
                    rows = batch.slice(start, at - start)
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(held, pa.binary())], [*batch.schema.names, "content"])
                    start, held, size = at, [], 0

    schema = ", ".join(f"{c} {kind}" for c, kind in files.dtypes)
    dealt = files.repartition(max(1, math.ceil(files.count() / FILES_PER_TASK)))
    return dealt.mapInArrow(read, f"{schema}, content binary")


def read_whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(file, value)``: each file as one text. Folders with packed files are left to the engine's reader."""
    files = list_files(spark, path)
    if files is None or not files.filter(_ends("filename", PACKED_SUFFIXES)).isEmpty():
        return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return with_contents(files).select(F.col("quoted").alias("file"), F.col("content").cast("string").alias("value"))


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """``file`` and the columns of ``schema`` for every ``row_tag`` element, written once.

    The driver holds the files of a plan, so the folders are read one group after the other, each of
    ``FILES_AT_ONCE`` files or one folder.
    """

    kind = StructType.fromDDL(schema)

    def load(paths: str | list[str]) -> DataFrame:
        raw = spark.read.format("xml").option("rowTag", row_tag).schema(kind).load(paths)
        return raw.select(F.col("_metadata.file_name").alias("file"), *kind.names)

    files = list_files(spark, path)
    groups = [] if files is None else file_groups(files)
    if not groups:
        return load(path)
    out = scratch_path(spark, "xml")
    with _many_a_task(spark):
        for roots in groups:
            names = [re.sub(r"([][{}*?\\])", r"\\\1", root) for root in roots]  # a name is no pattern
            load([f"file:{name}" for name in names]).write.mode("append").parquet(out)
    return spark.read.schema(StructType([StructField("file", StringType()), *kind.fields])).parquet(out)


def file_groups(files: DataFrame) -> list[list[str]]:
    """The roots of ``list_files`` rows in groups of ``FILES_AT_ONCE`` files; a larger root is a group."""
    groups: list[list[str]] = []
    held = FILES_AT_ONCE
    for root, n in sorted(files.groupBy("root").count().collect()):
        if held + n > FILES_AT_ONCE:
            groups.append([])
            held = 0
        groups[-1].append(root)
        held += n
    return groups


def list_images(spark: SparkSession, folder: str, with_content: bool = False) -> DataFrame:
    """Image files of a folder, sorted by name; bytes are read only on request.

    Without the bytes the listing is written once, as sorting reads its input twice.
    """
    files = list_files(spark, folder, IMAGE_SUFFIXES)
    kept = [_stem(F.col("filename")).alias("image_id"), "filename", "path", "length", "modificationTime", *(["content"] if with_content else [])]
    if files is not None:
        files = with_contents(files) if with_content else files
        return files.withColumn("path", F.concat(F.lit("file:"), "folder", F.lit("/"), "filename")).select(*kept).orderBy("filename")
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg,JPG}").load(folder)
    named = raw.withColumn("filename", F.element_at(F.split("path", "/"), -1)).select(*kept)
    if with_content:
        return named.orderBy("filename")
    with _many_a_task(spark):  # the files are not opened
        return settle(named, "images").orderBy("filename")


def unique_images(images: DataFrame) -> DataFrame:
    """One row per content hash."""
    return images.withColumn("content_hash", F.md5("content")).dropDuplicates(["content_hash"])


DETECTION_SCHEMA = (
    "size struct<width:double,height:double>, "
    "object array<struct<name:string,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>,score:double>>"
)


def read_detections(
    spark: SparkSession, path: str, min_score: float = -1.0, rescale: bool = True, origin: str = "stored"
) -> DataFrame:
    """Detection XML files to boxes."""
    raw = spark.read.format("xml").option("rowTag", "annotation").schema(DETECTION_SCHEMA).load(path)
    flat = raw.select(
        _stem(F.col("_metadata.file_name")).alias("image_id"),
        F.col("size.width").alias("width"),
        F.col("size.height").alias("height"),
        F.posexplode("object").alias("box_no", "o"),
    ).select(
        "image_id",
        "box_no",
        F.col("o.name").alias("label"),
        F.col("o.bndbox.xmin").alias("x_min"),
        F.col("o.bndbox.ymin").alias("y_min"),
        F.col("o.bndbox.xmax").alias("x_max"),
        F.col("o.bndbox.ymax").alias("y_max"),
        F.col("o.score").alias("score"),
        "width",
        "height",
    )
    return B.clean_boxes(flat, min_score, rescale).withColumn("origin", F.lit(origin))


def read_goal_xml(spark: SparkSession, path: str, row_tag: str = "annotation") -> DataFrame:
    raw = read_xml(spark, path, row_tag, "goal_position struct<x:double,y:double>")
    return raw.select(
        _stem(F.col("file")).alias("image_id"),
        F.lit("point").alias("label"),
        F.col("goal_position.x").alias("cx"),
        F.col("goal_position.y").alias("cy"),
    ).filter("cx is not null and cy is not null")


def read_goal_record(spark: SparkSession, path: str) -> DataFrame:
    """Goal of an earlier record: a list in one tag, or repeated tags as the writer makes them.

    The image is named by the record; only a record without a name takes that of its file.
    """
    raw = (
        spark.read.format("xml")
        .option("rowTag", "Annotation")
        .schema("filename string, goal_position_xy array<string>, goal_object_label string")
        .load(path)
    )
    one = F.from_json(F.col("goal_position_xy")[0], "array<double>")
    many = F.transform("goal_position_xy", lambda v: v.try_cast("double"))
    xy = F.when(F.size("goal_position_xy") == 1, one).otherwise(many)
    return raw.select(
        _stem(F.coalesce("filename", F.col("_metadata.file_name"))).alias("image_id"),
        F.coalesce("goal_object_label", F.lit("point")).alias("label"),
        F.get(xy, F.lit(0)).alias("cx"),
        F.get(xy, F.lit(1)).alias("cy"),
    )


def read_goal_text(spark: SparkSession, path: str) -> DataFrame:
    """First line ``cx cy`` in pixels: ``(image_id, px, py)``."""
    parts = F.split(X.first_line("value"), " ")
    return read_whole_texts(spark, path).select(
        _stem(F.col("file")).alias("image_id"),
        X.strip(parts[0]).try_cast("double").alias("px"),
        X.strip(F.get(parts, F.lit(1))).try_cast("double").alias("py"),
    )


def read_npy_rasters(spark: SparkSession, path: str) -> DataFrame:
    """Stored ``.npy`` rasters to the long form; one task per file, one file per image."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)

    def unpack(rows):
        for pdf in rows:
            for name, content in zip(pdf["name"], pdf["content"]):
                grid = np.load(io.BytesIO(content), allow_pickle=False)
                h, w = grid.shape
                for top in range(0, h, 256):  # slabs of rows keep Arrow batches small
                    part = grid[top : top + 256]
                    yy, xx = np.indices(part.shape)
                    yield pd.DataFrame(
                        {
                            "image_id": name,
                            "h": h,
                            "w": w,
                            "y": yy.ravel() + top,
                            "x": xx.ravel(),
                            "depth": part.ravel().astype(float),
                        }
                    )

    named = raw.select(_stem(F.element_at(F.split("path", "/"), -1)).alias("name"), "content")
    return named.mapInPandas(
        unpack, "image_id string, h bigint, w bigint, y bigint, x bigint, depth double"
    )


def check_raster_sizes(raster: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(good, rejects)``: a raster must have its image's size."""
    shapes = raster.groupBy("image_id", "h", "w").agg(F.count(F.lit(1)).alias("n"))
    want = sizes.select("image_id", F.col("h").alias("want_h"), F.col("w").alias("want_w"))
    rejects = (
        shapes.join(want, "image_id", "left")
        .filter(
            F.col("want_h").isNull()
            | (F.col("h") != F.col("want_h"))
            | (F.col("w") != F.col("want_w"))
            | (F.col("n") != F.col("h") * F.col("w"))
        )
        .select("image_id", "h", "w", "n", "want_h", "want_w")
    )
    return raster.join(rejects.select("image_id"), "image_id", "left_anti"), rejects


def read_stored_paths(spark: SparkSession, path: str, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(points, failed)`` of stored path files; (y, x) cells become shares of the real raster."""
    raw = (
        spark.read.option("multiLine", True)
        .schema("result string, path array<array<double>>")
        .json(path)
        .withColumn("image_id", _stem(F.col("_metadata.file_name")))
    )
    return split_stored_paths(raw, sizes)


def split_stored_paths(raw: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``raw(image_id, result, path)``: 'No' in the result marks a failure with one (0, 0) point."""
    failed = F.contains("result", F.lit("No"))
    points = (
        raw.filter(~failed)
        .select("image_id", F.posexplode("path").alias("seq", "p"))
        .join(sizes.select("image_id", "w", "h"), "image_id")
        .select("image_id", "seq", (F.col("p")[1] / F.col("w")).alias("x"), (F.col("p")[0] / F.col("h")).alias("y"))
    )
    bad = raw.filter(failed).select(
        "image_id", F.lit(0).alias("seq"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("result").alias("reason")
    )
    return points, bad


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Stripped lines with their file; use for label and name lists."""
    return spark.read.text(path).select(
        F.col("_metadata.file_name").alias("filename"), X.strip("value").alias("line")
    )


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path).select(F.col("line").alias("label")).filter("label <> ''")


def read_examples(spark: SparkSession, images: str, prompts: str) -> DataFrame:
    """Few-shot prompts: every other line of the text file beside each example image, by name.

    The rows are written once, as sorting reads its input twice. The names of the images are merged,
    as the size of their listing tells little of their number.
    """
    files = read_whole_texts(spark, prompts).select(_stem(F.col("file")).alias("image_id"), "value")
    lines = F.split(F.regexp_replace("value", r"\n$", ""), "\n")
    kept = F.transform(F.filter(lines, lambda s, i: i % 2 == 0), X.strip)
    found = list_files(spark, images, EXAMPLE_SUFFIXES)
    if found is None:
        raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg}").load(images)
        found = raw.select(F.element_at(F.split("path", "/"), -1).alias("filename"))
    shown = found.select("filename", _stem(F.col("filename")).alias("image_id"))
    rows = files.join(shown.hint("merge"), "image_id").select("filename", kept.alias("prompt_lines"))
    return settle(rows, "examples").orderBy("filename")


RECORD_TEXTS = [
    "dest_query", "dest_desc", "left_query", "left_desc", "right_query", "right_desc",
    "path_query", "path_desc", "query_before_llm", "desc_before_llm", "recommend_query", "recommend",
    "summary_query", "summary_answer",
]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Texts of earlier records; an absent tag is NULL. Folders are searched recursively."""
    schema = "filename string, " + ", ".join(f"{c} string" for c in RECORD_TEXTS)
    raw = (
        spark.read.format("xml")
        .option("rowTag", "Annotation")
        .option("recursiveFileLookup", True)
        .schema(schema)
        .load(path)
    )
    return raw.select(F.col("_metadata.file_name").alias("file"), "*").orderBy("file")


def read_truth(spark: SparkSession, path: str, row_tag: str = "annotation", degree: str = "simple") -> DataFrame:
    """Ground truth: the ``simple`` (or ``complex``) text of each field, the first match."""
    field = "struct<simple:string,complex:string>"
    raw = (
        spark.read.format("xml")
        .option("rowTag", row_tag)
        .option("recursiveFileLookup", True)
        .schema(", ".join(f"`{t}` array<{field}>" for t in ("dest", "left", "right", "path")) + ", recommend array<string>")
        .load(path)
    )
    first = lambda t: F.get(F.filter(F.transform(t, lambda s: s[degree]), lambda v: v.isNotNull()), F.lit(0))
    return raw.select(
        F.col("_metadata.file_name").alias("filename"),
        *[first(t).alias(t) for t in ("dest", "left", "right", "path")],
        F.get("recommend", F.lit(0)).alias("recommend"),
    )


def read_answer_pairs(spark: SparkSession, path: str, row_tag: str = "Annotation") -> DataFrame:
    return (
        spark.read.format("xml")
        .option("rowTag", row_tag)
        .schema("image_filename string, answer string")
        .load(path)
    )


def read_keyed_jsonl(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """JSON lines by key; within a file and across files in path order the last duplicate wins.

    The position is (file, block start, row id within the read task), which follows the text.
    """
    raw = spark.read.schema(schema).json(path).withColumn(
        "_pos",
        F.struct(
            F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
        ),
    )
    return last_per_key(raw, key, "_pos").drop("_pos")


def read_keyed_map(spark: SparkSession, path: str, value_schema: str, key: str = "id") -> DataFrame:
    """One JSON object ``{id: record}`` per file to rows."""
    raw = spark.read.text(path, wholetext=True)
    return explode_map(raw, "value", value_schema, key)


def read_result_map(spark: SparkSession, path: str, result: str = "long") -> DataFrame:
    """``question_id, result, output`` of a map written by ``write_result_map``, line by line."""
    pair = r'^( +),?("(?:[^"\\]|\\.)*"):(.*)$'
    lines = spark.read.text(path).filter(F.col("value").startswith(" "))
    part = lambda k: F.regexp_extract("value", pair, k)
    value = lambda kind: F.from_json(F.concat(F.lit('{"v":'), part(3), F.lit("}")), f"v {kind}")["v"]
    parsed = lines.select(
        F.from_json(F.concat(F.lit('{"v":'), part(2), F.lit("}")), "v string")["v"].alias("question_id"),
        (F.char_length(part(1)) == 1).alias("_first"), value(result).alias("result"), value("string").alias("output"),
    )
    return parsed.groupBy("question_id").agg(
        F.max(F.when(F.col("_first"), F.col("result"))).alias("result"), F.max(F.when(~F.col("_first"), F.col("output"))).alias("output")
    )


def explode_map(raw: DataFrame, column: str, value_schema: str, key: str = "id") -> DataFrame:
    parsed = raw.select(F.explode(F.from_json(column, f"map<string,{value_schema}>")).alias(key, "_v"))
    if value_schema.startswith("struct"):
        return parsed.select(key, "_v.*")
    return parsed.select(F.col(key), F.explode("_v").alias("member")) if value_schema.startswith("array") else parsed


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated rows under a header; a quote inside a quoted field is doubled."""
    return spark.read.options(sep="\t", header=True, multiLine=True, escape='"').schema(schema).csv(path)


def decode_images(rows: DataFrame, column: str = "image") -> DataFrame:
    return rows.withColumn("content", F.unbase64(column))


SAMPLE_SCHEMA = "id string, image string, conversations array<struct<`from`:string,value:string>>"


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Training samples (a JSON array); the conversations become ``turns``."""
    return spark.read.option("multiLine", True).schema(SAMPLE_SCHEMA).json(path)


def sample_turns(samples: DataFrame) -> DataFrame:
    return samples.select(
        F.col("id").alias("conv_id"), "image", F.posexplode("conversations").alias("turn", "c")
    ).select("conv_id", "image", F.col("turn").cast("bigint").alias("turn"), F.col("c.from").alias("role"), F.col("c.value").alias("text"))


CHAT_LOG_SCHEMA = (
    "tstamp double, type string, model string, ip string, start double, finish double, "
    "images array<string>, state struct<template_name:string,messages:array<array<string>>>"
)


def read_chat_log(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Chat and vote events with their event time; ``path`` is the log folder."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(CHAT_LOG_SCHEMA).json(path).withColumn("ts", F.timestamp_seconds("tstamp"))


def pixel_boxes(boxes: DataFrame, sizes: DataFrame) -> DataFrame:
    """Shares of the image to whole pixels."""
    out = boxes.join(sizes.select("image_id", "w", "h"), "image_id")
    for name, size in zip(B.XYXY, ("w", "h", "w", "h")):
        out = out.withColumn(name, G.truncate(F.col(name) * F.col(size)))
    return out
