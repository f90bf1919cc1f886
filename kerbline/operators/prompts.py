"""Region prompts: box and destination phrases, system prompts, request fan-out, follow-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import prompt_texts as P
from ..functions import text as X
from .boxes import XYXY

_registry: dict[str, dict[str, str]] = dict(P.PROMPT_LIBRARIES)


def register_library(name: str, templates: dict[str, str]) -> None:
    """Add a prompt library: target → text with ``{destination}``."""
    missing = {*P.TARGETS, P.DECISION} - set(templates)
    if missing:
        raise ValueError(f"library {name!r} lacks {sorted(missing)}")
    _registry[name] = dict(templates)


def library(name: str) -> dict[str, str]:
    return _registry[name]


def library_table(spark: SparkSession) -> DataFrame:
    """``prompts(library, target, user_tpl)`` of all registered libraries."""
    rows = [(lib, t, text) for lib, tpl in _registry.items() for t, text in tpl.items()]
    return spark.createDataFrame(rows, "library string, target string, user_tpl string")


def box_phrase(label: Column | str = "label") -> Column:
    label = F.col(label) if isinstance(label, str) else label
    return F.concat(label, F.lit(" "), X.coordinates(*XYXY))


def box_lists(boxes: DataFrame, by: list[str]) -> DataFrame:
    """``box_list``: the phrases of one region's boxes in box order, for the prompt text."""
    phrases = boxes.select(*by, "box_no", box_phrase().alias("phrase"))
    return (
        phrases.groupBy(*by)
        .agg(F.array_sort(F.collect_list(F.struct("box_no", "phrase"))).alias("_p"))
        .select(*by, F.array_join(F.col("_p.phrase"), ", ").alias("box_list"))
    )


def destination_phrase(label: Column, coords: list[str], with_side: bool = False) -> Column:
    """``label [x, y]`` for a point or ``label [x1, y1, x2, y2]`` for a box."""
    if len(coords) not in (2, 4):
        raise ValueError("a destination has two or four coordinates")
    phrase = F.concat(label, F.lit(" "), X.coordinates(*coords))
    if with_side:
        phrase = F.concat(phrase, F.lit(" on the "), G.side_bucket(coords[0]), F.lit(" side of the image"))
    return phrase


def system_prompt(target: Column, box_list: Column, single_turn: bool = False) -> Column:
    rules = F.lit(True) if single_turn else target == P.DECISION
    joiner = "" if single_turn else " "
    base = F.concat(
        F.lit(P.SYSTEM_BASE), F.when(rules, F.lit(joiner + P.DECISION_RULES)).otherwise(F.lit(""))
    )
    boxes = F.when(
        F.length(F.coalesce(box_list, F.lit(""))) > 0,
        F.concat(F.lit(" " + P.BOXES_LEAD), box_list, F.lit(".\n")),
    ).otherwise(F.lit(""))
    return F.concat(base, boxes)


def user_prompt(lib: str, target: Column, destination: Column) -> Column:
    """Prompt of a target; an unknown target (such as ``Not``) gives NULL."""
    out = F.lit(None).cast("string")
    for name, text in library(lib).items():
        out = F.when(target == name, F.lit(text)).otherwise(out)
    return F.replace(out, F.lit("{destination}"), destination)


def region_requests(
    goals: DataFrame,
    region_boxes: DataFrame,
    all_boxes: DataFrame,
    lib: str = "region_views",
    with_side: bool = False,
) -> DataFrame:
    """Five requests per image: the targets are an array in the row, not a cross join.

    ``goals(image_id, label, cx, cy)``; ``region_boxes(image_id, region, box_no, label, …)``.
    The scene request sees all boxes.
    """
    return fan_out(region_facts(goals, region_boxes, all_boxes), lib, with_side)


def region_facts(goals: DataFrame, region_boxes: DataFrame, all_boxes: DataFrame) -> DataFrame:
    """What the five requests of an image are made of, one row per goal; all by image, so a box is
    shuffled once for its region and once for the scene."""
    phrases = region_boxes.select("image_id", F.struct("region", "box_no", box_phrase().alias("phrase")).alias("_p"))
    lists = phrases.groupBy("image_id").agg(F.array_sort(F.collect_list("_p")).alias("region_list"))
    return goals.join(lists, "image_id", "left").join(box_lists(all_boxes, ["image_id"]), "image_id", "left")


def region_query(lib: str, target: Column, with_side: bool = False) -> Column:
    """User prompt of a target from the columns of ``goals``."""
    return user_prompt(lib, target, destination_phrase(F.col("label"), ["cx", "cy"], with_side))


def fan_out(facts: DataFrame, lib: str = "region_views", with_side: bool = False, targets: list[str] = list(P.TARGETS)) -> DataFrame:
    """Requests of ``region_facts``, made row by row."""

    def listed(t: str) -> Column:
        if t == "Desc":
            return F.col("box_list")
        return F.array_join(F.transform(F.filter("region_list", lambda p: p["region"] == t), lambda p: p["phrase"]), ", ")

    each = F.array(*[F.struct(F.lit(t).alias("target"), listed(t).alias("box_list")) for t in targets])
    fan = facts.select("image_id", "label", "cx", "cy", F.explode(each).alias("_t")).select("image_id", "label", "cx", "cy", "_t.*")
    return fan.select(
        "image_id",
        "target",
        F.md5(F.concat_ws("|", F.col("image_id").cast("string"), F.lit(lib), F.col("target"))).alias("req_id"),
        system_prompt(F.col("target"), F.col("box_list")).alias("system"),
        region_query(lib, F.col("target"), with_side).alias("prompt"),
        F.concat(F.col("image_id").cast("string"), F.lit("_"), F.col("target")).alias("picture"),
    )


def single_turn_requests(goals: DataFrame, all_boxes: DataFrame) -> DataFrame:
    """One request per image that asks for all six answers."""
    return single_turn_fan(single_turn_facts(goals, all_boxes))


def single_turn_facts(goals: DataFrame, all_boxes: DataFrame) -> DataFrame:
    return goals.join(box_lists(all_boxes, ["image_id"]), "image_id", "left")


def single_turn_fan(facts: DataFrame) -> DataFrame:
    """Requests of ``single_turn_facts``, made row by row."""
    dest = destination_phrase(F.col("label"), ["cx", "cy"])
    return facts.select(
        "image_id",
        F.lit("All").alias("target"),
        F.md5(F.concat_ws("|", F.col("image_id").cast("string"), F.lit("single_turn"))).alias("req_id"),
        system_prompt(F.lit("All"), F.col("box_list"), single_turn=True).alias("system"),
        F.replace(F.lit(P.SINGLE_TURN_PROMPT), F.lit("{destination}"), dest).alias("prompt"),
        F.col("image_id").cast("string").alias("picture"),
    )


def split_single_answer(text: Column | str) -> Column:
    """Six answers out of one: the text after the first colon of each line.

    A line without a colon, or fewer than six lines, gives the whole text six times.
    """
    raw = F.col(text) if isinstance(text, str) else text
    lines = F.split(X.strip(raw), "\n")
    bad = (F.size(lines) < 6) | F.exists(lines, lambda s: ~F.contains(s, F.lit(":")))
    parts = F.transform(lines, lambda s: F.regexp_replace(s, r"^[^:]*:", ""))
    return F.when(bad, F.array_repeat(raw, 6)).otherwise(parts)


def decision_prompt(answers: list[Column], question: Column) -> Column:
    return F.concat(
        F.lit(P.DECISION_LEAD), F.concat_ws(" ", *answers), F.lit(" "), question, F.lit(P.DECISION_TAIL)
    )


def summary_prompt(dest: Column, left: Column, right: Column, path: Column, decision: Column) -> Column:
    """The scene answer is left out."""
    return F.concat(
        F.lit(P.SUMMARY_COMMAND + P.SUMMARY_LEAD), F.concat_ws(" ", dest, left, right, path, decision)
    )


def judge_prompt(truth: Column, answer: Column) -> Column:
    a, b = P.JUDGE_REFERENCE, P.JUDGE_ANSWER
    return F.concat(F.lit(a[0]), truth, F.lit(a[1]), F.lit(b[0]), answer, F.lit(b[1]))


def keyword_prompt(target: Column, description: Column) -> Column:
    q = P.KEYWORD_QUESTIONS
    ask = (
        F.when(target == "recommend", F.lit(q["recommend"]))
        .when(target == "destination", F.lit(q["destination"]))
        .otherwise(F.replace(F.lit(q["other"]), F.lit("{target}"), target))
    )
    return F.concat(F.lit(P.KEYWORD_LEAD), description, ask)


def keywords(answer: Column) -> Column:
    return F.lower(X.swap_all(answer, P.KEYWORD_FIXES))
