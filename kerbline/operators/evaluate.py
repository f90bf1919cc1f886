"""Records against ground truth: field pairs, errors, averages, running means, judge scores.

``truth(filename, dest, left, right, path, recommend)`` (the simple texts),
``pred(filename, dest_desc, left_desc, right_desc, path_desc, recommend)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scale
from ..functions import answers as A
from ..functions import prompt_texts as P
from ..functions import text as X
from . import inference, prompts
from .textmetrics import score_pairs


def _long(df: DataFrame, cols: list[tuple[str, str]], value: str) -> DataFrame:
    """One row per (file, tag), NULL kept."""
    cells = F.array(*[F.struct(F.lit(tag).alias("tag"), F.col(c).cast("string").alias(value)) for c, tag in cols])
    return df.select("filename", F.explode(cells).alias("_c")).select("filename", "_c.tag", f"_c.{value}")


def field_pairs(
    pred: DataFrame, truth: DataFrame, fixes: list[tuple[str, str]] = P.TRUTH_FIXES
) -> tuple[DataFrame, DataFrame]:
    """``(pairs, errors)``: five field pairs per predicted file; a missing side is an error row."""
    p = _long(pred, [(f, tag) for tag, f, _ in P.EVALUATED_FIELDS], "pred")
    t = _long(truth, [(tag, tag) for tag, _, _ in P.EVALUATED_FIELDS], "truth")
    both = p.join(t, ["filename", "tag"], "left").select(
        "filename",
        "tag",
        X.strip("pred").alias("pred"),
        X.swap_all(X.strip("truth"), fixes).alias("truth"),
    )
    reason = F.when(F.col("pred").isNull(), "pred").when(F.col("truth").isNull(), "gt")
    errors = both.filter(reason.isNotNull()).select("filename", "tag", reason.alias("missing_side"))
    pairs = both.filter(reason.isNull()).withColumn("pair_id", F.concat_ws("|", "filename", "tag"))
    return pairs, errors


def metric_scores(pairs: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """``scores(filename, tag, metric, value)``."""
    scored = score_pairs(pairs.select("pair_id", "truth", "pred"), metrics)
    return scored.join(pairs.select("pair_id", "filename", "tag"), "pair_id").select(
        "filename", "tag", "metric", "value"
    )


def averages(scores: DataFrame) -> DataFrame:
    return scores.groupBy("tag", "metric").agg(
        (F.sum("value") / F.count("value")).alias("mean_value"), F.count("value").alias("n")
    )


def running_averages(scores: DataFrame) -> DataFrame:
    """Mean per tag and metric after each file, in file order, without one task per tag."""
    return scale.running_mean(scores, ["tag", "metric"], ["filename"], "value")


def judge_requests(pairs: DataFrame, concise: bool = False, version: str = "v1") -> DataFrame:
    """Judge calls keyed by the two texts, so equal texts are judged once."""
    name = f"{version}|{'concise' if concise else 'plain'}"
    return pairs.select(
        "filename",
        "tag",
        inference.judge_key(F.col("truth"), F.col("pred"), name).alias("req_id"),
        F.lit(P.JUDGE_SYSTEM_CONCISE if concise else P.JUDGE_SYSTEM).alias("system"),
        prompts.judge_prompt(F.col("truth"), F.col("pred")).alias("prompt"),
        F.lit(None).cast("string").alias("picture"),
        X.word_count("pred").alias("word_count"),
    )


def judge_scores(requests: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(scores, errors)``: a reply without a rating is an error row."""
    rated = requests.join(answers.select("req_id", F.col("text").alias("reason")), "req_id").withColumn(
        "rating", A.rating("reason")
    )
    values = F.array(
        F.struct(F.lit("judge").alias("metric"), F.col("rating").alias("value")),
        F.struct(F.lit("word_count").alias("metric"), F.col("word_count").cast("double").alias("value")),
    )
    good = rated.filter("rating is not null").select("filename", "tag", F.explode(values).alias("_v"))
    return (
        good.select("filename", "tag", "_v.metric", "_v.value"),
        rated.filter("rating is null").select("filename", "tag", F.lit("no rating").alias("missing_side")),
    )


def keyword_requests(pairs: DataFrame) -> DataFrame:
    """Two keyword questions per pair, one for each text."""
    target = F.create_map(*[F.lit(v) for tag, _, name in P.EVALUATED_FIELDS for v in (tag, name)])
    sides = F.array(
        F.struct(F.lit("truth").alias("side"), F.col("truth").alias("text")),
        F.struct(F.lit("pred").alias("side"), F.col("pred").alias("text")),
    )
    return (
        pairs.select("pair_id", "filename", "tag", F.explode(sides).alias("s"))
        .withColumn("target", F.element_at(target, F.col("tag")))
        .select(
            "pair_id",
            "filename",
            "tag",
            F.col("s.side").alias("side"),
            F.concat_ws("|", "pair_id", "s.side").alias("req_id"),
            F.lit("").alias("system"),
            prompts.keyword_prompt(F.col("target"), F.col("s.text")).alias("prompt"),
            F.lit(None).cast("string").alias("picture"),
        )
    )


def keyword_pairs(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Keyword answers back to ``pairs`` for the text metrics."""
    joined = requests.join(answers.select("req_id", "text"), "req_id")
    return joined.groupBy("pair_id", "filename", "tag").agg(
        prompts.keywords(F.max(F.when(F.col("side") == "truth", F.col("text")))).alias("truth"),
        prompts.keywords(F.max(F.when(F.col("side") == "pred", F.col("text")))).alias("pred"),
    )
