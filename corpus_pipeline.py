"""Corpus pipeline: language, near duplicates, personal data, mixing, byte-pair ids.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept. ``run``
writes each result as Parquet in the shared folder and rereads it as the next stage's input.

Extra columns of ``documents`` are left behind at the first stage, and all stages but the last
return its own five. Where a stage attaches a decision it joins on a number given to each row,
written once, so repeated and null ids are rows of their own. Empty tables stay empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm import bpe, lang_id, mixing, near_dups, pii
from kerbline.llm.common import table
from kerbline.session import settle

ARROW_ROWS = 2000  # whole texts that Spark hands to a Python worker at a time
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def in_small_batches(spark: SparkSession) -> None:
    """Five stages share the executors, so none may hold many texts beside the workers of another.

    The setting stays: a stage's result is read after the stage returns."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def numbered(docs: DataFrame) -> DataFrame:
    return settle(docs.select(F.monotonically_increasing_id().alias("row"), *COLUMNS), "pipeline-rows")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter; where ``lang`` is null it becomes the language the classifier finds.

    What the classifier rejects for want of a letter (``und``: null and empty texts, texts without
    one) goes; a doubtful language, or none learned, is no reason to drop a document. Ties go to the
    first language in code point order. Repeated rows repeat; very long texts are read whole, in
    slices."""
    in_small_batches(spark)
    told = lang_id.label(docs, keep=COLUMNS)
    found = F.when(F.col("lang_pred") != lang_id.UNKNOWN, F.col("lang_pred"))
    kept = told.filter(found.isNotNull() | F.col("text").rlike(r"\p{L}"))
    return kept.withColumn("lang", F.coalesce("lang", found)).select(*COLUMNS)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the first in reading order.

    Texts without words are near duplicates of equal texts only; null texts count as empty."""
    in_small_batches(spark)
    rows = numbered(docs)
    first = near_dups.near_duplicates(rows, id_col="row").filter("doc_id = class_id").select(F.col("doc_id").alias("row"))
    return rows.join(first, "row", "left_semi").select(*COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the spans found replaced by their kind; ``n_chars`` counts anew."""
    clean = pii.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, twice where it takes them twice; null and empty texts have no
    words and are not taken."""
    in_small_batches(spark)
    rows = numbered(docs)
    taken = mixing.mix(rows, id_col="row", draw_col="doc_id").filter("taken > 0")
    copies = taken.select(F.col("doc_id").alias("row"), (F.col("taken") / F.col("size")).cast("int").alias("copies"))
    return rows.join(copies, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids of every text, and of the text decoded from them; a null text has no ids."""
    in_small_batches(spark)
    return bpe.bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language", language),
    ("near_duplicates", distinct_texts),
    ("personal_data", without_personal_data),
    ("mixing", mixed),
    ("byte_pairs", encoded),
]

#: No SQL expresses the classifier, the samples, the trees or the knapsack. The tests compare every
#: stage, and the rows of ``run``, with a plain Python version over a small corpus of copies, near
#: copies, three sources, nulls and repeated rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document the mix takes, a row per
    copy. An empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
