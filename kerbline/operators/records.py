"""Answers to records: one wide row per image, reuse of earlier answers, export rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prompt_texts as P
from ..functions import text as X
from . import prompts

# Record field of each target's query and answer.
RECORD_FIELDS = {
    "D": ("dest_query", "dest_desc"),
    "L": ("left_query", "left_desc"),
    "R": ("right_query", "right_desc"),
    "P": ("path_query", "path_desc"),
    "Desc": ("query_before_llm", "desc_before_llm"),
    "Decs": ("recommend_query", "recommend"),
    "Sum": ("summary_query", "summary_answer"),
}


ANSWER_KEYS = ("image_id", "target")  # request columns that the answers carry along


def region_answers(answered: DataFrame) -> DataFrame:
    """Answers per target with the control tokens removed; ``assemble`` words the queries again.

    ``answered`` comes from ``run_requests(…, keep=ANSWER_KEYS)``.
    """
    return answered.select("image_id", "target", X.remove_tokens("text").alias("answer"), "elapsed_s")


def wide_answers(long: DataFrame) -> DataFrame:
    """Pivot over the fixed list of targets: ``a_D, …`` per image, and ``q_D, …`` if ``long`` has a
    ``query``."""
    targets = [t for t in RECORD_FIELDS]
    queries = [F.first("query").alias("q")] if "query" in long.columns else []
    wide = long.groupBy("image_id").pivot("target", targets).agg(*queries, F.first("answer").alias("a"), F.sum("elapsed_s").alias("s"))
    out = [F.col("image_id")]
    for t in targets:
        out += [*([F.col(f"{t}_q").alias(f"q_{t}")] if queries else []), F.col(f"{t}_a").alias(f"a_{t}")]
    total = sum((F.coalesce(F.col(f"{t}_s"), F.lit(0.0)) for t in targets if t != "Sum"), F.lit(0.0))
    return wide.select(*out, total.alias("inference_s"))


def decision_requests(wide: DataFrame, box_lists: DataFrame, lib: str = "region_views") -> DataFrame:
    """The walk / wait question over all five answers."""
    return decision_fan(decision_facts(wide, box_lists), lib)


def decision_facts(wide: DataFrame, box_lists: DataFrame) -> DataFrame:
    return wide.select("image_id", *[f"a_{t}" for t in P.TARGETS]).join(box_lists, "image_id", "left")


def decision_query(lib: str) -> Column:
    return prompts.decision_prompt([F.col(f"a_{t}") for t in P.TARGETS], F.lit(prompts.library(lib)[P.DECISION]))


def decision_fan(facts: DataFrame, lib: str = "region_views") -> DataFrame:
    """Requests of ``decision_facts``, made row by row."""
    return facts.select(
        "image_id",
        F.lit(P.DECISION).alias("target"),
        F.md5(F.concat_ws("|", F.col("image_id").cast("string"), F.lit(lib), F.lit(P.DECISION))).alias("req_id"),
        prompts.system_prompt(F.lit(P.DECISION), F.col("box_list")).alias("system"),
        decision_query(lib).alias("prompt"),
        F.col("image_id").cast("string").alias("picture"),
    )


SUMMARISED = ("D", "L", "R", "P", "Decs")


def summary_facts(wide: DataFrame) -> DataFrame:
    return wide.select("image_id", *[f"a_{t}" for t in SUMMARISED])


def summary_query() -> Column:
    return prompts.summary_prompt(*[F.col(f"a_{t}") for t in SUMMARISED])


def summary_requests(wide: DataFrame) -> DataFrame:
    return wide.select(
        "image_id",
        F.lit("Sum").alias("target"),
        F.md5(F.concat_ws("|", F.col("image_id").cast("string"), F.lit("Sum"))).alias("req_id"),
        F.lit(P.SUMMARY_SYSTEM).alias("system"),
        summary_query().alias("prompt"),
        F.lit(None).cast("string").alias("picture"),
    )


def complete(wide: DataFrame, targets: list[str] | None = None) -> Column:
    """No answer is NULL."""
    names = targets or list(RECORD_FIELDS)
    return F.forall(F.array(*[F.col(f"a_{t}") for t in names]), lambda a: a.isNotNull())


def assemble(
    wide: DataFrame, goals: DataFrame, sizes: DataFrame, lib: str = "region_views", asked: tuple[str, ...] = tuple(RECORD_FIELDS)
) -> DataFrame:
    """Records of complete images; ``recommend`` on one line, typed columns, no text literals.

    ``sizes(image_id, w, h[, filename])``. The queries of the ``asked`` targets are worded from the
    goal and the answers, as they were for the call; those of the others are ``q_…`` of ``wide``.

    Boxes and path points stay their own tables, keyed by image; ``attach_lists`` nests them.
    """
    full = wide.filter(complete(wide)).join(goals, "image_id").join(sizes, "image_id")

    def query_of(target: str) -> Column:
        if target == "Sum":
            return summary_query()
        return decision_query(lib) if target == P.DECISION else prompts.region_query(lib, F.lit(target))

    fields = []
    for target, (query, answer) in RECORD_FIELDS.items():
        text = F.col(f"a_{target}")
        if target == "Decs":
            text = X.swap(text, "\n", " ")
        fields += [(X.remove_tokens(query_of(target)) if target in asked else F.col(f"q_{target}")).alias(query), text.alias(answer)]
    name = F.col("filename") if "filename" in sizes.columns else F.col("image_id").cast("string")
    return full.select(
        "image_id",
        name.alias("filename"),
        F.lit("pipeline").alias("annotator"),
        F.array("w", "h", F.lit(3)).alias("size_whc"),
        F.array("cx", "cy").alias("goal_position_xy"),
        F.col("label").alias("goal_object_label"),
        *fields,
    )


def attach_lists(records: DataFrame, boxes: DataFrame, points: DataFrame) -> DataFrame:
    """Nest boxes and path into each record, which then is one file or one XML element."""
    nested_boxes = boxes.groupBy("image_id").agg(
        F.array_sort(
            F.collect_list(F.struct("box_no", "label", "x_min", "y_min", "x_max", "y_max", "score"))
        ).alias("bboxes")
    )
    nested_path = points.groupBy("image_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("path_array")
    )
    return records.join(nested_boxes, "image_id", "left").join(nested_path, "image_id", "left")


def single_turn_record(answers: DataFrame) -> DataFrame:
    """Six fields out of one answer; only the decision keeps a query."""
    parts = prompts.split_single_answer("text")
    names = ["dest_desc", "left_desc", "right_desc", "path_desc", "desc_before_llm", "recommend"]
    return answers.withColumn("_p", parts).select(
        "image_id", *[F.col("_p")[k].alias(n) for k, n in enumerate(names)]
    )


def reuse_answers(fresh: DataFrame, earlier: DataFrame, flags: dict[str, bool] | None) -> DataFrame:
    """Take the earlier answer for each flagged field, the fresh one for the others.

    No flags at all means no reuse. A flagged field that the earlier record lacks stays NULL,
    so the completeness filter drops that image.
    """
    flags = flags or {}
    out = fresh.alias("n").join(earlier.alias("o"), "image_id", "left")
    cols = [F.col("image_id")]
    for c in fresh.columns:
        if c != "image_id":
            cols.append((F.col(f"o.{c}") if flags.get(c) else F.col(f"n.{c}")).alias(c))
    return out.select(*cols)


def earlier_answers(earlier: DataFrame, images: DataFrame, targets: list[str]) -> DataFrame:
    """Answers of earlier records in the form of ``region_answers``; no time was spent on them."""
    cells = F.array(
        *[
            F.struct(F.lit(t).alias("target"), F.col(RECORD_FIELDS[t][0]).alias("query"), F.col(RECORD_FIELDS[t][1]).alias("answer"))
            for t in targets
        ]
    )
    rows = earlier.join(images.select("image_id"), "image_id", "left_semi").select("image_id", F.explode(cells).alias("c"))
    return rows.filter("c.answer is not null").select("image_id", "c.*", F.lit(0.0).alias("elapsed_s"))


def assemble_single(answers: DataFrame, goals: DataFrame, sizes: DataFrame) -> DataFrame:
    """Records of a single-turn run: six texts out of one answer, one query. A failed call leaves
    no record."""
    parts = single_turn_record(answers.select("image_id", X.remove_tokens("text").alias("text")))
    asked = answers.select("image_id", X.remove_tokens("prompt").alias("recommend_query"))
    return (
        parts.filter("recommend is not null").join(asked, "image_id").join(goals, "image_id").join(sizes, "image_id").select(
            "image_id", "filename", F.lit("pipeline").alias("annotator"), F.array("w", "h", F.lit(3)).alias("size_whc"),
            F.array("cx", "cy").alias("goal_position_xy"), F.col("label").alias("goal_object_label"),
            "dest_desc", "left_desc", "right_desc", "path_desc", "desc_before_llm", "recommend_query",
            X.swap(F.col("recommend"), "\n", " ").alias("recommend"),
        )
    )


def training_samples(records: DataFrame, image: str = "filename", answer: str = "summary_answer") -> DataFrame:
    """``id, image, conversations[]`` rows; the id ends at the first dot of the file name."""
    turn = lambda who, text: F.struct(F.lit(who).alias("from"), text.alias("value"))
    return records.select(
        F.substring_index(F.col(image), ".", 1).alias("id"),
        F.col(image).alias("image"),
        F.array(
            turn(P.EXPORT_ROLES[0], F.lit(P.EXPORT_QUESTION)), turn(P.EXPORT_ROLES[1], F.col(answer))
        ).alias("conversations"),
    )
