"""Detection boxes: cleaning, overlap with frames, label sets, unions, crops along a line.

``boxes(image_id, box_no, label, x_min, y_min, x_max, y_max, score, origin)``
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

XYXY = ("x_min", "y_min", "x_max", "y_max")


def clean_boxes(raw: DataFrame, min_score: float = -1.0, rescale: bool = True) -> DataFrame:
    """Pixel boxes with ``width, height`` to rounded shares of the image; strict score limit.

    A missing score counts as 1.
    """
    out = raw
    for name, size in zip(XYXY, ("width", "height", "width", "height")):
        share = G.clamp(F.col(name) / F.col(size), 0.0, 1.0) if rescale else F.col(name)
        out = out.withColumn(name, F.round(share, 2))
    out = out.withColumn("score", F.coalesce(F.round("score", 2), F.lit(1.0)))
    return out.filter(F.col("score") > min_score).drop("width", "height")


def overlap(a: tuple, b: tuple) -> dict[str, Column]:
    """IoU and the areas behind it for two boxes given as four columns each."""
    inter = G.intersection_area(a, b)
    area_a, area_b = G.area(*a), G.area(*b)
    union = area_a + area_b - inter
    return {
        "intersection": inter,
        "area_a": area_a,
        "area_b": area_b,
        "union_area": union,
        "iou": F.try_divide(inter, union),
    }


def inside_frame(boxes: DataFrame, frames: DataFrame, share: float = 0.5) -> DataFrame:
    """Boxes with more than ``share`` of their area in the frame ``f_x1 … f_y2`` of their image."""
    both = boxes.join(frames, "image_id")
    o = overlap(XYXY, ("f_x1", "f_y1", "f_x2", "f_y2"))
    return both.filter((o["area_a"] > 0) & (o["intersection"] / o["area_a"] > share))


def rebase(df: DataFrame, cols: tuple = XYXY, frame: tuple = ("f_x1", "f_y1", "f_x2", "f_y2")) -> DataFrame:
    """Coordinates relative to the frame, clamped to 0..1. Names alternate x, y."""
    fx1, fy1, fx2, fy2 = (F.col(c) for c in frame)
    for i, name in enumerate(cols):
        lo, size = (fx1, fx2 - fx1) if i % 2 == 0 else (fy1, fy2 - fy1)
        df = df.withColumn(name, G.clamp((F.col(name) - lo) * (F.lit(1.0) / size), 0.0, 1.0))
    return df


def drop_labels(boxes: DataFrame, labels: DataFrame) -> DataFrame:
    return boxes.join(labels.select("label"), "label", "left_anti")


def keep_labels(boxes: DataFrame, labels: DataFrame) -> DataFrame:
    return boxes.join(labels.select("label"), "label", "left_semi")


def goal_candidates(boxes: DataFrame, goal_labels: DataFrame, as_box: bool = False) -> DataFrame:
    """Boxes of goal objects; as a point, the middle of the bottom edge."""
    kept = keep_labels(boxes, goal_labels)
    if as_box:
        return kept.select("image_id", "box_no", "label", *XYXY)
    return kept.select(
        "image_id",
        "box_no",
        "label",
        ((F.col("x_min") + F.col("x_max")) / 2).alias("cx"),
        F.col("y_max").alias("cy"),
    )


def merge_sources(stored: DataFrame, truth: DataFrame, detected: DataFrame, images: DataFrame) -> DataFrame:
    """Stored and true boxes; detector boxes only for images that lack either kind of file.

    ``images(image_id, has_stored, has_truth)`` says which annotation files exist.
    """
    gaps = images.filter(~(F.col("has_stored") & F.col("has_truth"))).select("image_id")
    return (
        stored.withColumn("origin", F.lit("stored"))
        .unionByName(truth.withColumn("origin", F.lit("truth")))
        .unionByName(detected.join(gaps, "image_id", "left_semi").withColumn("origin", F.lit("detector")))
    )


def segment_points(df: DataFrame, n: int, x1="x1", y1="y1", x2="x2", y2="y2") -> DataFrame:
    """``n`` interior points on each segment, as rows ``step, px, py``."""
    dx = (F.col(x2) - F.col(x1)) / (n + 1)
    dy = (F.col(y2) - F.col(y1)) / (n + 1)
    return (
        df.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
        .withColumn("px", F.col(x1) + F.col("step") * dx)
        .withColumn("py", F.col(y1) + F.col("step") * dy)
    )


def crops_along(goals: DataFrame, ratio: float = 0.5, n: int = 1) -> DataFrame:
    """Crop rectangles from the bottom centre to the goal.

    ``goals(image_id, w, h, gx, gy)`` → one row per crop: ``step`` 0 is the start, n+1 the goal.
    """
    half_w, half_h = F.col("w") * ratio / 2.0, F.col("h") * ratio / 2.0
    sx, sy = F.col("w") / 2.0, F.col("h") - half_h
    step = F.col("step")
    pts = goals.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n + 1))))
    px = F.when(step == n + 1, F.col("gx")).otherwise(sx + step * ((F.col("gx") - sx) / (n + 1)))
    py = F.when(step == n + 1, F.col("gy")).otherwise(sy + step * ((F.col("gy") - sy) / (n + 1)))
    pts = pts.withColumn("px", px).withColumn("py", py)
    x1, x2 = G.pull_inside(F.col("px") - half_w, F.col("px") + half_w, "w")
    y1, y2 = G.pull_inside(F.col("py") - half_h, F.col("py") + half_h, "h")
    return pts.select(
        "image_id", "step", "px", "py",
        x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"),
    )
