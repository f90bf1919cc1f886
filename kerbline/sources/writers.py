"""Sinks: records as XML and JSON, samples, score reports, answer logs, result maps, reviews.

All writes are distributed: a folder of part files. A whole-table map is written as lines in key
order; its part files, one after the other, are one JSON object.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.evaluate import averages
from ..operators.records import training_samples

FILES_PER_TASK = 2000  # single files that one task writes


def to_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_record_xml(records: DataFrame, path: str, root: str = "Annotations", row: str = "Annotation") -> None:
    records.write.format("xml").option("rootTag", root).option("rowTag", row).mode("overwrite").save(path)


def write_files(rows: DataFrame, folder: str, nested: bool = False) -> int:
    """One file per row of ``rows(name, content)``, written by the tasks; returns their number.

    The rows are counted and dealt by name, ``FILES_PER_TASK`` to a task, so that no task grows with
    the table. ``nested`` gives each task a folder of its own below ``folder``: many tasks do not
    wait for one folder, and a reader of ``folder/*`` lists them side by side.

    ``folder`` is a URI that all executors reach (a bare path is one of the file system). A task
    that is repeated writes the same files again. Names must differ.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        if "://" in folder or folder.startswith("file:"):
            system, root = fs.FileSystem.from_uri(folder)
        else:
            system, root = fs.LocalFileSystem(), folder
        if nested:
            root = f"{root}/{TaskContext.get().partitionId()}"
        system.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                with system.open_output_stream(f"{root}/{name}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    content = F.col("content").cast("binary")
    dealt = rows.repartition(max(1, math.ceil(rows.count() / FILES_PER_TASK)), "name")
    return dealt.select("name", content.alias("content")).mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def write_record_files(records: DataFrame, folder: str, row: str = "Annotation", nested: bool = False) -> int:
    """One XML file per record, named after its image: ``a.png`` gives ``a.xml``."""
    name = F.concat(F.regexp_replace("filename", r"\.[^.]*$", ""), F.lit(".xml"))
    return write_files(records.select(name.alias("name"), F.to_xml(F.struct("*"), {"rowTag": row}).alias("content")), folder, nested)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_samples(records: DataFrame, path: str, image: str = "filename", answer: str = "summary_answer") -> None:
    write_json(training_samples(records, image, answer), path)


def write_score_report(scores: DataFrame, errors: DataFrame, folder: str) -> None:
    """``avg_scores``, ``tag_scores`` and ``errors`` under one folder."""
    to_parquet(averages(scores), f"{folder}/avg_scores")
    to_parquet(scores, f"{folder}/tag_scores")
    to_parquet(errors, f"{folder}/errors")


def write_answers(answers: DataFrame, path: str, mode: str = "append") -> None:
    write_json(answers, path, mode)


def _json_text(value: Column) -> Column:
    """One value as JSON text, null included."""
    whole = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})  # {"v":…}
    return F.substring(whole, F.lit(6), F.char_length(whole) - 6)


def result_map_lines(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """``(section, key, line)``: lines that in this order are one JSON object.

    The object holds the columns of the one-row ``summary``, then ``results`` and ``outputs``, maps
    from ``question_id`` to the columns ``result`` and ``output`` of ``rows``. Every entry is a line
    of its own, indented by one blank in ``results`` and by two in ``outputs``; all entries but the
    first of a map, the smallest key, start with a comma. No map and no list is built.
    """
    key = F.col("question_id").cast("string")
    first = rows.agg(F.min(key).alias("k")).scalar()

    def entry(section: int, value: str) -> Column:
        comma = F.when(key == first, F.lit("")).otherwise(F.lit(","))
        line = F.concat(F.lit(" " * (section // 2)), comma, _json_text(key), F.lit(":"), _json_text(F.col(value)))
        return F.struct(F.lit(section).alias("section"), key.alias("key"), line.alias("line"))

    entries = rows.select(F.explode(F.array(entry(2, "result"), entry(4, "output"))).alias("e")).select("e.*")
    facts = F.concat(*[F.concat(_json_text(F.lit(c)), F.lit(":"), _json_text(F.col(c)), F.lit(",")) for c in summary.columns], F.lit(""))
    head = F.concat(F.lit("{"), facts, F.lit('"results":{'))
    marks = F.array(
        F.struct(F.lit(1).alias("section"), head.alias("line")),
        F.struct(F.lit(3).alias("section"), F.lit('},"outputs":{').alias("line")),
        F.struct(F.lit(5).alias("section"), F.lit("}}").alias("line")),
    )
    frame = summary.select(F.explode(marks).alias("m")).select("m.section", F.lit("").alias("key"), "m.line")
    return frame.unionByName(entries)


def write_result_map(rows: DataFrame, summary: DataFrame, path: str) -> None:
    """Write ``result_map_lines`` in order: part files follow the key ranges."""
    result_map_lines(rows, summary).orderBy("section", "key").select("line").write.mode("overwrite").text(path)


def pending_reviews(candidates: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows not reviewed yet; review them and append the result."""
    return candidates.join(done.select(key), key, "left_anti")


def append_reviews(reviews: DataFrame, path: str) -> None:
    write_json(reviews, path, mode="append")


def web_rows(records: DataFrame) -> DataFrame:
    """One JSON text per review record, in display order when sorted by id."""
    return records.select(
        "id",
        F.to_json(
            F.struct(
                "id",
                "category",
                "question",
                F.struct(F.col("answer1").alias("first"), F.col("answer2").alias("second")).alias("answers"),
                F.struct(F.col("evaluation").alias("first")).alias("evaluations"),
                F.struct(F.array("score1", "score2").alias("first")).alias("scores"),
            )
        ).alias("record"),
    )


def write_web_table(records: DataFrame, path: str) -> None:
    web_rows(records).orderBy("id").select(F.col("record").alias("value")).write.mode("overwrite").text(path)
