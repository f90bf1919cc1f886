"""Region masks as runs of pixels: ``runs(image_id, region, y, x_from, x_to)``, both ends inside.

Shapes (polygons, discs, rectangles, bands) are cut into one interval per raster row. The
union per row adds +1 / -1 at interval ends and sums them, so a thousand overlapping shapes
shrink to at most one change per column before anything is sorted. The final regions come from one
sweep over the run ends of a row: shapes and the depth limit enter as runs and leave as runs.
Pixels are written out only where a pixel table is joined. A pixel belongs to a shape if its
centre is inside or on the edge.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import settle
from . import raster as R
from .boxes import XYXY
from .paths import cell_distances, segments, shortest_distances

RUN = ["image_id", "region", "y", "x_from", "x_to"]
ROWS_PER_TASK = 1 << 17  # raster rows of one task's points, each of which becomes a few runs


# ---- shapes to row intervals ---------------------------------------------------------

def _rows(df: DataFrame, top: Column, bottom: Column) -> DataFrame:
    """One row per raster row between ``top`` and ``bottom``, cut to 0..h-1."""
    lo = F.greatest(F.ceil(top), F.lit(0)).cast("bigint")
    hi = F.least(F.floor(bottom), F.col("h") - 1).cast("bigint")
    ranged = df.select("*", lo.alias("_lo"), hi.alias("_hi")).filter("_lo <= _hi")
    return ranged.withColumn("y", F.explode(F.sequence(F.col("_lo"), F.col("_hi")))).drop("_lo", "_hi")


def _clip(df: DataFrame) -> DataFrame:
    """Keep the part of each interval inside 0..w-1."""
    return (
        df.filter("x_from is not null")
        .withColumn("x_from", F.greatest(F.col("x_from"), F.lit(0)).cast("bigint"))
        .withColumn("x_to", F.least(F.col("x_to"), F.col("w") - 1).cast("bigint"))
        .filter("x_from <= x_to")
        .select(*RUN)
    )


def quad_runs(df: DataFrame, corners: list[tuple[Column, Column]]) -> DataFrame:
    """Even-odd fill of one four-cornered shape per row, edge included.

    ``df(image_id, region, h, w, …)``. The facts of the four edges are computed once per shape,
    below the split into raster rows; a row then needs one short formula per edge, which keeps
    the generated code small enough to be compiled.
    """
    if len(corners) != 4:
        raise ValueError("a quad has four corners")
    flat = df.select(
        "image_id", "region", "h", "w",
        *[c.cast("double").alias(f"_{a}{k}") for k, xy in enumerate(corners) for a, c in zip("xy", xy)],
    )
    edges = []
    for k in range(4):
        m = (k + 1) % 4
        up = F.col(f"_y{k}") <= F.col(f"_y{m}")
        edges += [
            F.when(up, F.col(f"_x{k}")).otherwise(F.col(f"_x{m}")).alias(f"_xa{k}"),
            F.when(up, F.col(f"_x{m}")).otherwise(F.col(f"_x{k}")).alias(f"_xb{k}"),
            F.least(f"_y{k}", f"_y{m}").alias(f"_ya{k}"),
            F.greatest(f"_y{k}", f"_y{m}").alias(f"_yb{k}"),
        ]
    ys = [F.col(f"_y{k}") for k in range(4)]
    rows = _rows(flat.select("image_id", "region", "h", "w", *[f"_y{k}" for k in range(4)], *edges), F.least(*ys), F.greatest(*ys))
    y = F.col("y").cast("double")
    at = []
    for k in range(4):
        xa, xb, ya, yb = (F.col(f"_{n}{k}") for n in ("xa", "xb", "ya", "yb"))
        on = F.when((ya < yb) & (ya <= y) & (y <= yb), (xa * (yb - ya) + (y - ya) * (xb - xa)) / (yb - ya))
        at.append(on.alias(f"_at{k}"))
    cut = rows.select("*", *at)
    crossings = [F.when(y < F.col(f"_yb{k}"), F.col(f"_at{k}")) for k in range(4)]
    cut = cut.withColumn("_c", F.array_sort(F.array(*crossings)))
    spans = [(F.col("_c")[0], F.col("_c")[1]), (F.col("_c")[2], F.col("_c")[3])]
    for k in range(4):
        level = (F.col(f"_ya{k}") == F.col(f"_yb{k}")) & (y == F.col(f"_ya{k}"))
        spans.append(
            (
                F.when(level, F.least(f"_xa{k}", f"_xb{k}")).otherwise(F.col(f"_at{k}")),
                F.when(level, F.greatest(f"_xa{k}", f"_xb{k}")).otherwise(F.col(f"_at{k}")),
            )
        )
    runs = F.array(*[F.struct(F.ceil(lo).alias("x_from"), F.floor(hi).alias("x_to")) for lo, hi in spans])
    return _clip(cut.select("image_id", "region", "y", "w", F.explode(runs).alias("_i")).select("*", "_i.*"))


def disc_runs(discs: DataFrame) -> DataFrame:
    """``discs(image_id, region, h, w, cx, cy, r)``: dx² + dy² ≤ r², integer centre."""
    rows = _rows(discs, F.col("cy") - F.col("r"), F.col("cy") + F.col("r"))
    dy = F.col("y") - F.col("cy")
    half = F.floor(F.sqrt((F.col("r") * F.col("r") - dy * dy).cast("double")))
    return _clip(rows.withColumn("x_from", F.col("cx") - half).withColumn("x_to", F.col("cx") + half))


def rectangle_runs(rects: DataFrame) -> DataFrame:
    """``rects(image_id, region, h, w, x1, y1, x2, y2)``, corners in any order, both included."""
    rows = _rows(rects, F.least("y1", "y2"), F.greatest("y1", "y2"))
    return _clip(rows.withColumn("x_from", F.least("x1", "x2")).withColumn("x_to", F.greatest("x1", "x2")))


def merge_runs(runs: DataFrame) -> DataFrame:
    """Union of overlapping intervals, per image, region and row."""
    ends = runs.select(
        "image_id",
        "region",
        "y",
        F.explode(
            F.array(
                F.struct(F.col("x_from").alias("x"), F.lit(1).alias("d")),
                F.struct((F.col("x_to") + 1).alias("x"), F.lit(-1).alias("d")),
            )
        ).alias("e"),
    )
    steps = ends.groupBy("image_id", "region", "y", F.col("e.x").alias("x")).agg(F.sum("e.d").alias("d"))
    line = Window.partitionBy("image_id", "region", "y").orderBy("x")
    depth = (
        steps.withColumn("cover", F.sum("d").over(line.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("before", F.col("cover") - F.col("d"))
        .filter((F.col("cover") == 0) | (F.col("before") == 0))
        .filter(F.col("d") != 0)
        .withColumn("x_next", F.lead("x").over(line))
        .filter(F.col("before") == 0)
    )
    return depth.select("image_id", "region", "y", F.col("x").alias("x_from"), (F.col("x_next") - 1).alias("x_to"))


def run_pixels(runs: DataFrame) -> DataFrame:
    """Write merged runs out as pixels."""
    return runs.select("image_id", "region", "y", F.explode(F.sequence("x_from", "x_to")).alias("x"))


def _dealt(shapes: DataFrame, parts: int | None = None) -> DataFrame:
    """Shapes dealt to tasks of their own, ahead of the split into raster rows.

    A shape is a short row that becomes hundreds of runs. Left to itself the engine merges the
    partitions of such a small table into one task, which then makes all the runs; a number named
    here stays as it is.
    """
    parts = parts or int(shapes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shapes.repartition(parts, *shapes.columns)


def _tasks(points: DataFrame) -> int:
    """Tasks for the shapes of ``points``: as many as their raster rows ask for, the session's at least."""
    rows = points.agg(F.sum("h")).first()[0] or 0
    return max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / ROWS_PER_TASK))


def _moves(points: DataFrame, parts: int | None = None) -> DataFrame:
    """The different pixel moves of each path; a dense path repeats most of them."""
    moves = segments(points, ("px", "py")).select("image_id", "h", "w", "px", "py", "next_px", "next_py").distinct()
    return _dealt(moves, parts)


# ---- the masks -----------------------------------------------------------------------

def side_masks(points: DataFrame, as_reference: bool = True) -> DataFrame:
    """The union of ``side_runs``."""
    return merge_runs(side_runs(points, as_reference))


def side_runs(points: DataFrame, as_reference: bool = True, parts: int | None = None) -> DataFrame:
    """Areas left (``L``) and right (``R``) of a path; ``points(image_id, seq, px, py, h, w)``.

    Each path segment spans a quad to the image border. The left quad names its border
    corners bottom first, so for an upward path it crosses itself; ``as_reference=False``
    orders them so that left and right mirror each other.
    """
    pairs = _moves(points, parts)
    zero, w, h = F.lit(0).cast("bigint"), F.col("w"), F.col("h")
    side = lambda r, x, ya, yb: F.struct(
        F.lit(r).alias("region"), x.alias("bx"), ya.alias("ya"), yb.alias("yb")
    )
    left = side("L", zero, h, zero) if as_reference else side("L", zero, zero, h)
    both = pairs.withColumn("_s", F.explode(F.array(left, side("R", w, zero, h)))).select("*", "_s.*")
    border = [(F.col("bx"), F.col("ya")), (F.col("bx"), F.col("yb"))]
    return quad_runs(both, [(F.col("px"), F.col("py")), (F.col("next_px"), F.col("next_py")), *border])


def circle_mask(centres: DataFrame, region: str = "C") -> DataFrame:
    """``centres(image_id, h, w, cx, cy, r)``, any number of discs per image."""
    return merge_runs(disc_runs(centres.withColumn("region", F.lit(region))))


def trapezoid_mask(goals: DataFrame, radius: int, region: str = "T") -> DataFrame:
    """From the whole top edge down to the goal row ± radius; ``goals(image_id, h, w, px, py)``."""
    x, y, zero = F.col("px"), F.col("py"), F.lit(0)
    corners = [
        (zero, zero),
        (F.col("w"), zero),
        (F.least(x + radius, F.col("w")), y),
        (F.greatest(x - radius, zero), y),
    ]
    return merge_runs(quad_runs(goals.withColumn("region", F.lit(region)), corners))


def _depth_at(points: DataFrame, raster: DataFrame) -> DataFrame:
    """Points with the depth of their pixel. A point without a depth above 0 has no metric size:
    it is left out, as are the pairs it is part of; ``points_without_depth`` lists it."""
    cells = raster.select("image_id", F.col("y").alias("py"), F.col("x").alias("px"), "depth").filter("depth > 0")
    return points.join(cells, ["image_id", "py", "px"])


def points_without_depth(points: DataFrame, raster: DataFrame) -> DataFrame:
    """Rejects of the metric masks: points whose pixel is missing or has no depth above 0."""
    cells = raster.filter("depth > 0").select("image_id", F.col("y").alias("py"), F.col("x").alias("px"))
    return points.join(cells, ["image_id", "py", "px"], "left_anti")


def goal_bands(goals: DataFrame, raster: DataFrame, half_width: float) -> DataFrame:
    """Vertical band of metric width at the goal (``B``) and a disc of the same radius (``C``).

    ``goals(image_id, h, w, px, py, fx)``; the band starts at column 0 where the radius
    reaches over the left edge.
    """
    left, right = G.metric_bounds("px", "depth", half_width, "fx", "w")
    sized = _dealt(_depth_at(goals, raster).withColumn("r", G.truncate((right - left) / 2)).select("image_id", "h", "w", "px", "py", "r"))
    band = sized.select(
        "image_id",
        "h",
        "w",
        F.lit("B").alias("region"),
        (F.col("px") - F.col("r")).alias("x1"),
        F.lit(0).alias("y1"),
        (F.col("px") + F.col("r") - 1).alias("x2"),
        (F.col("h") - 1).alias("y2"),
        "r",
    ).filter("r > 0")
    disc = sized.select(
        "image_id", "h", "w", F.lit("C").alias("region"), F.col("px").alias("cx"), F.col("py").alias("cy"), "r"
    )
    return merge_runs(rectangle_runs(band).unionByName(disc_runs(disc)))


def path_mask(points: DataFrame, raster: DataFrame, half_width: float, region: str = "P") -> DataFrame:
    """The union of ``path_runs``."""
    return merge_runs(path_runs(points, raster, half_width, region))


def path_runs(points: DataFrame, raster: DataFrame, half_width: float, region: str = "P", parts: int | None = None) -> DataFrame:
    """Area within ``half_width`` metres of the path.

    ``points(image_id, seq, px, py, h, w, fx)``. Each pair of points spans a rectangle from the
    left bound of the first to the right bound of the second; a disc closes the last point.
    """
    left, right = G.metric_bounds("px", "depth", half_width, "fx", "w")
    bounds = _depth_at(points, raster).withColumn("left_x", left).withColumn("right_x", right)
    rects = segments(
        bounds.select("image_id", "seq", "h", "w", "py", "left_x", "right_x"), ("py", "left_x", "right_x")
    ).select(
        "image_id",
        "h",
        "w",
        F.lit(region).alias("region"),
        F.col("left_x").alias("x1"),
        F.least("py", "next_py").alias("y1"),
        F.col("next_right_x").alias("x2"),
        F.greatest("py", "next_py").alias("y2"),
    ).distinct()
    last = bounds.groupBy("image_id", "h", "w").agg(
        F.max_by(F.struct("px", "py", "left_x", "right_x"), F.col("seq")).alias("p")
    )
    disc = last.select(
        "image_id",
        "h",
        "w",
        F.lit(region).alias("region"),
        F.col("p.px").alias("cx"),
        F.col("p.py").alias("cy"),
        G.truncate((F.col("p.right_x") - F.col("p.left_x")) / 2).alias("r"),
    )
    return rectangle_runs(_dealt(rects, parts)).unionByName(disc_runs(_dealt(disc, parts)))


def path_disc_mask(points: DataFrame, raster: DataFrame, radius: float, region: str = "P") -> DataFrame:
    """A disc around every path point, metric radius; ``points(…, px, py, h, w, fx, fy)``."""
    discs = _depth_at(points, raster).select(
        "image_id",
        "h",
        "w",
        F.lit(region).alias("region"),
        F.col("px").alias("cx"),
        F.col("py").alias("cy"),
        G.metric_radius("depth", radius, "fx", "fy").alias("r"),
    )
    return merge_runs(disc_runs(_dealt(discs.distinct())))


def thick_line_runs(points: DataFrame, thickness: float, region: str = "line") -> DataFrame:
    """All pixels within half the thickness of the polyline; ``points(image_id, seq, px, py, h, w)``."""
    r = thickness / 2.0
    pairs = _moves(points)
    dx, dy = F.col("next_px") - F.col("px"), F.col("next_py") - F.col("py")
    length = F.sqrt((dx * dx + dy * dy).cast("double"))
    nx, ny = -dy / length * r, dx / length * r
    px, py, qx, qy = (F.col(c) for c in ("px", "py", "next_px", "next_py"))
    body = quad_runs(
        pairs.filter(length > 0).withColumn("region", F.lit(region)),
        [(px + nx, py + ny), (qx + nx, qy + ny), (qx - nx, qy - ny), (px - nx, py - ny)],
    )
    caps = points.select(
        "image_id", "h", "w", F.lit(region).alias("region"), F.col("px").alias("cx"), F.col("py").alias("cy"),
        F.lit(r).alias("r"),
    )
    return merge_runs(body.unionByName(disc_runs(caps)))


FOUR_MOVES = [(0, 1), (1, 0), (0, -1), (-1, 0)]


def flood_masks(pixels: DataFrame, line: DataFrame, tile: int = 128) -> DataFrame:
    """Pixels joined to the top-left (``L``) / top-right (``R``) corner without crossing the line.

    ``pixels(image_id, h, w, y, x)``, ``line(image_id, y, x)``. The same tile rounds as the
    path search, with four moves and impassable line pixels.
    """
    blocked = line.select("image_id", "y", "x").distinct().withColumn("_line", F.lit(True))
    kind = pixels.schema["image_id"].dataType.simpleString()
    # both corners in one search: each image appears once per side
    sides = F.explode(F.array(F.lit("L"), F.lit("R")))
    keyed = F.concat(F.col("image_id").cast("string"), F.lit("|"), F.col("side"))
    corner = F.when(F.col("side") == "L", F.lit(0)).otherwise(F.col("w") - 1).cast("bigint")
    starts = (
        pixels.filter("y = 0 and x = 0")
        .select("image_id", "h", "w", sides.alias("side"))
        .select("*", F.lit(0).cast("bigint").alias("sy"), corner.alias("sx"))
        .join(
            blocked.select("image_id", F.col("y").alias("sy"), F.col("x").alias("sx")),
            ["image_id", "sy", "sx"],
            "left_anti",
        )
        .withColumn("image_id", keyed)
    )
    cells = (
        pixels.join(blocked, ["image_id", "y", "x"], "left")
        .select("image_id", "h", "w", "y", "x", F.when(F.col("_line").isNull(), F.lit(1.0)).alias("enter_cost"), sides.alias("side"))
        .withColumn("image_id", keyed)
    )
    reached = cell_distances(shortest_distances(cells, starts, moves=FOUR_MOVES, tile=tile))
    return reached.select(
        F.regexp_replace("image_id", r"\|[LR]$", "").cast(kind).alias("image_id"),
        F.element_at(F.split("image_id", r"\|"), -1).alias("region"),
        "y",
        "x",
    )


def limit_runs(raster: DataFrame, ref: DataFrame, nearer: bool = True) -> DataFrame:
    """Runs ``(image_id, y, x_from, x_to)`` of the pixels on the wanted side of ``ref_depth``.

    ``ref(image_id, h, w, ref_depth)``. Consecutive pixels of a row differ from their rank by the
    same number, so one sort of each raster row gives its runs.
    """
    test = F.col("depth") < F.col("ref_depth") if nearer else F.col("depth") > F.col("ref_depth")
    inside = R.attach(raster.select("image_id", "y", "x", "depth"), ref).filter(test).select("image_id", "y", "x")
    rank = F.row_number().over(Window.partitionBy("image_id", "y").orderBy("x"))
    ranked = inside.withColumn("_g", F.col("x") - rank).groupBy("image_id", "y", "_g")
    return ranked.agg(F.min("x").alias("x_from"), F.max("x").alias("x_to")).drop("_g")


def sweep_runs(
    masks: DataFrame, limits: DataFrame, regions: tuple[str, ...] = ("L", "R", "P"), cut: str = "P", copies: tuple[tuple[str, str], ...] = ()
) -> DataFrame:
    """Final regions: each mask within the limits, and outside ``cut`` unless exempt, as runs.

    ``masks`` are runs, overlapping or not, ``limits`` runs without a region. ``copies`` adds
    regions that copy another one, e.g. ``(("D", "P"),)``. Regions ``D`` and the cut itself keep
    their overlap. Ends of runs are added up per column before they are sorted; a sweep along each
    raster row then knows at every end what covers the pixels up to the next one.
    """
    marked = masks.select("image_id", "y", "x_from", "x_to", "region").unionByName(
        limits.select("image_id", "y", "x_from", "x_to", F.lit("").alias("region"))
    )
    edge = F.array(
        F.struct(F.col("x_from").alias("x"), F.lit(1).alias("d")), F.struct((F.col("x_to") + 1).alias("x"), F.lit(-1).alias("d"))
    )
    ends = marked.select("image_id", "y", "region", F.explode(edge).alias("e"))
    names = {r: f"c{k}" for k, r in enumerate((*regions, ""))}
    steps = ends.groupBy("image_id", "y", F.col("e.x").alias("x")).agg(
        *[F.sum(F.when(F.col("region") == r, F.col("e.d")).otherwise(0)).alias(c) for r, c in names.items()]
    )
    line = Window.partitionBy("image_id", "y").orderBy("x")
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    on = steps.select("image_id", "y", "x", *[(F.sum(c).over(upto) > 0).alias(c) for c in names.values()])

    def covered(new: str, old: str) -> Column:
        free = F.lit(True) if new in ("D", cut) else ~F.col(names[cut])
        return F.col(names[old]) & F.col(names[""]) & free

    wanted = [(r, r) for r in regions] + list(copies)
    kept = on.select("image_id", "y", "x", *[covered(*pair).alias(f"k{k}") for k, pair in enumerate(wanted)])
    before = [F.coalesce(F.lag(f"k{k}").over(line), F.lit(False)) for k in range(len(wanted))]
    turns = F.array(*[F.struct(F.lit(new).alias("region"), F.col(f"k{k}").alias("now"), before[k].alias("was")) for k, (new, _) in enumerate(wanted)])
    turned = kept.select("image_id", "y", "x", turns.alias("t")).select("image_id", "y", "x", F.explode("t").alias("t")).filter("t.now <> t.was")
    along = Window.partitionBy("image_id", "y", "region").orderBy("x")
    spans = turned.select("image_id", F.col("t.region").alias("region"), "y", "x", F.col("t.now").alias("now"))
    spans = spans.withColumn("x_to", F.lead("x").over(along) - 1).filter("now")
    return spans.select("image_id", "region", "y", F.col("x").alias("x_from"), "x_to")


def final_regions(
    raster: DataFrame,
    points: DataFrame,
    goals: DataFrame,
    half_width: float,
    radius: int,
    buffer: float,
    copies: tuple[tuple[str, str], ...] = (("D", "P"),),
    always_nearer: bool = False,
) -> DataFrame:
    """Runs of the regions ``L R P`` and the copies within the depth limit of the goal.

    ``points(image_id, seq, px, py, h, w, fx)``, ``goals(image_id, h, w, py, px)``. The raster is
    read twice: once for the pixels asked for (those of the path and those around the goal, kept as
    a small table), once for the depth limit.
    """
    points, goals = settle(points, "points"), goals.select("image_id", "h", "w", "py", "px")
    around = goals.select(
        "image_id", "px",
        F.explode(F.sequence(F.greatest(F.col("py") - radius, F.lit(0)), F.least(F.col("py") + radius, F.col("h")) - 1)).alias("y"),
        F.greatest(F.col("px") - radius, F.lit(0)).alias("lo"), (F.least(F.col("px") + radius, F.col("w")) - 1).alias("hi"),
    ).select("image_id", "y", F.explode(F.sequence("lo", "hi")).alias("x"), F.lit(True).alias("goal"))
    along = points.select("image_id", F.col("py").alias("y"), F.col("px").alias("x"), F.lit(False).alias("goal")).distinct()
    asked = along.unionByName(around).groupBy("image_id", "y", "x").agg(F.max("goal").alias("goal"))
    probes = settle(raster.select("image_id", "h", "w", "y", "x", "depth").join(asked, ["image_id", "y", "x"]), "probes")
    ref = probes.filter("goal").groupBy("image_id", "h", "w").agg((F.max("depth") + buffer).alias("ref_depth"))
    limits = limit_runs(raster, ref, always_nearer or buffer > 0)
    parts = _tasks(points)
    return sweep_runs(side_runs(points, parts=parts).unionByName(path_runs(points, probes, half_width, parts=parts)), limits, copies=copies)


def boxes_in_regions(boxes: DataFrame, runs: DataFrame, sizes: DataFrame, share: float = 0.1) -> DataFrame:
    """Boxes with at least ``share`` of their pixels masked, per region.

    Joined on (image, row): the overlap of a box row with a run needs no pixel list.
    """
    scaled = boxes.join(sizes.select("image_id", "w", "h"), "image_id")
    for name, share_col, size in zip(("px1", "py1", "px2", "py2"), XYXY, ("w", "h", "w", "h")):
        scaled = scaled.withColumn(name, G.truncate(F.col(share_col) * F.col(size)))
    keyed = scaled.withColumn("box_px", (F.col("px2") - F.col("px1")) * (F.col("py2") - F.col("py1"))).filter(
        (F.col("px2") > F.col("px1")) & (F.col("py2") > F.col("py1"))
    )
    lines = keyed.select(
        "image_id", "box_no", "px1", "px2", "box_px", F.explode(F.sequence(F.col("py1"), F.col("py2") - 1)).alias("y")
    )
    hit = lines.join(runs, ["image_id", "y"]).withColumn(
        "n", F.least(F.col("px2") - 1, F.col("x_to")) - F.greatest(F.col("px1"), F.col("x_from")) + 1
    )
    return (
        hit.filter("n > 0")
        .groupBy("image_id", "region", "box_no", "box_px")
        .agg(F.sum("n").alias("masked_px"))
        .filter(F.col("masked_px") / F.col("box_px") >= share)
    )


def masked_values(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """The part of a pixel table inside each region."""
    return pixels.join(mask.select("image_id", "region", "y", "x"), ["image_id", "y", "x"])
