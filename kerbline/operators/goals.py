"""One goal point per image, from the first source that has one.

``goals(image_id, label, cx, cy, method)``
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scale
from . import raster
from .boxes import goal_candidates

FRONT_DEFAULT = (0.5, 0.75)  # fixed value: three quarters down the middle


def pick_one(candidates: DataFrame, seed: int = 17) -> DataFrame:
    """One candidate per image in seeded order; an aggregate, so a crowded image stays cheap.

    Candidates that share a ``box_no`` are told apart by their other columns.
    """
    key = scale.seeded_hash(seed, "image_id", "box_no")
    cols = [c for c in candidates.columns if c != "image_id"]
    return (
        candidates.groupBy("image_id")
        .agg(F.min(F.struct(key.alias("_key"), *cols)).alias("_p"))
        .select("image_id", *[F.col(f"_p.{c}").alias(c) for c in cols])
    )


def goals_from_pixels(points: DataFrame, sizes: DataFrame) -> DataFrame:
    """``points(image_id, px, py)`` in pixels to shares of the image."""
    return points.join(sizes, "image_id").select(
        "image_id",
        F.lit("point").alias("label"),
        (F.col("px") / F.col("w")).alias("cx"),
        (F.col("py") / F.col("h")).alias("cy"),
    )


def resolve_goals(
    images: DataFrame,
    sources: list[tuple[str, DataFrame]],
    front: DataFrame | None = None,
    circle: bool = False,
) -> DataFrame:
    """Fallback chain: each source in turn, then the depth-based front point, then the default.

    ``sources`` are ``(method, goals(image_id, label, cx, cy))`` with one row per image at most;
    ``front(image_id, cx, cy)`` is the point found ahead in the depth raster.
    """
    ranked = [
        df.select("image_id", F.lit(i).alias("_rank"), F.lit(m).alias("method"), "label", "cx", "cy")
        for i, (m, df) in enumerate(sources)
    ]
    if front is not None:
        ranked.append(
            front.filter(F.col("cx").isNotNull()).select(
                "image_id",
                F.lit(len(sources)).alias("_rank"),
                F.lit("front").alias("method"),
                F.lit("circle" if circle else "point").alias("label"),
                "cx",
                "cy",
            )
        )
    ranked.append(
        images.select(
            "image_id",
            F.lit(len(sources) + 1).alias("_rank"),
            F.lit("default").alias("method"),
            F.lit("point").alias("label"),
            F.lit(FRONT_DEFAULT[0]).alias("cx"),
            F.lit(FRONT_DEFAULT[1]).alias("cy"),
        )
    )
    every = reduce(DataFrame.unionByName, ranked)
    best = every.groupBy("image_id").agg(
        F.min_by(F.struct("label", "cx", "cy", "method"), F.col("_rank")).alias("g")
    )
    return best.join(images.select("image_id"), "image_id", "left_semi").select("image_id", "g.*")


def fill_cache(images: DataFrame, cached: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Reuse stored rows, compute only the missing images, keep both.

    The same shape serves goals and depth rasters: write the result back as the new cache.
    """
    missing = images.join(cached.select("image_id").distinct(), "image_id", "left_anti")
    return cached.join(images.select("image_id"), "image_id", "left_semi").unionByName(compute(missing))


def unfinished(images: DataFrame, finished: DataFrame, key: str = "image_id") -> DataFrame:
    return images.join(finished.select(key), key, "left_anti")


@dataclass(frozen=True)
class GoalInputs:
    """What the goal methods choose from; a method uses the tables it needs.

    ``images(image_id, filename, h, w)``, ``boxes`` as cleaned, ``depth`` in long form,
    ``wanted(label)``, ``points(image_id, px, py)`` in pixels, ``marked`` and ``records`` goals of
    annotation files and of earlier records.
    """

    images: DataFrame
    boxes: DataFrame | None = None
    depth: DataFrame | None = None
    wanted: DataFrame | None = None
    points: DataFrame | None = None
    marked: DataFrame | None = None
    records: DataFrame | None = None
    difference: float = 10.0
    crop: int = 10
    zero_base: bool = True
    max_degree: float = 0.0
    seed: int = 17


def _given(x: GoalInputs, name: str) -> DataFrame:
    table = getattr(x, name)
    if table is None:
        raise ValueError(f"this goal method needs {name}")
    return table


def detected(x: GoalInputs) -> DataFrame:
    """One seeded pick among the detections with a wanted label."""
    found = goal_candidates(_given(x, "boxes"), _given(x, "wanted"))
    return pick_one(found, x.seed).select("image_id", "label", "cx", "cy")


def annotated_points(x: GoalInputs) -> DataFrame:
    """Points of text annotations, from pixels to shares of the image."""
    return goals_from_pixels(_given(x, "points"), x.images.select("image_id", "w", "h"))


def marked_goals(x: GoalInputs) -> DataFrame:
    return _given(x, "marked").select("image_id", F.lit("point").alias("label"), "cx", "cy")


def recorded_goals(x: GoalInputs) -> DataFrame:
    """Goals of earlier records with the label they have there."""
    return _given(x, "records").select("image_id", "label", "cx", "cy")


def front_goals(x: GoalInputs) -> DataFrame:
    """The point ahead where the depth changes enough: up the centre column, or with ``max_degree``
    along a seeded bearing."""
    depth = _given(x, "depth")
    if x.max_degree:
        sizes = x.images.select("image_id", "h", "w")
        found = raster.front_point_bearing(depth, sizes, x.difference, x.max_degree, x.crop, x.zero_base, x.seed)
    else:
        found = raster.front_point(depth, x.difference, x.crop, x.zero_base)
    return found.select("image_id", F.lit("point").alias("label"), "cx", "cy")


GOAL_METHODS: dict[str, Callable[[GoalInputs], DataFrame]] = {
    "select_det": detected,
    "load_anno": annotated_points,
    "load_xml": marked_goals,
    "load_output_typed_xml": recorded_goals,
    "set_front": front_goals,
}


def register_goal_method(name: str, fn: Callable[[GoalInputs], DataFrame]) -> None:
    """A goal method maps ``GoalInputs`` to ``(image_id, label, cx, cy)``, one row an image at most."""
    GOAL_METHODS[name] = fn


def goals_by_name(x: GoalInputs, methods: Sequence[str], circle: bool = False) -> DataFrame:
    """Goals of the named methods in order of preference, then the front point, then the default."""
    sources = [(name, GOAL_METHODS[name](x)) for name in methods if name != "set_front"]
    front = GOAL_METHODS["set_front"](x) if x.depth is not None else None
    return resolve_goals(x.images, sources, front, circle)
