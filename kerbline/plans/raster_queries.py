"""Depth rasters, path search and region masks on 8 x 8 rasters in whole centimetres."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import paths as P
from ..operators import raster as R
from ..operators import regions as M
from . import fixtures as D
from .registry import query

# ---- goals from depth -----------------------------------------------------------------


@query(
    "front_point_zero_base",
    f"""WITH {D.RASTER}, c AS (SELECT image_id, max(y) AS y FROM raster WHERE x = 4 AND abs(depth) >= 600 GROUP BY image_id)
    SELECT image_id, y, 4 AS x, 4/8.0::DOUBLE AS cx, y/8.0::DOUBLE AS cy FROM c""",
)
def front_point_zero_base(spark, sf):
    return R.front_point(D.raster(spark, sf), 600.0)


@query(
    "front_point_patch_base",
    f"""WITH {D.RASTER}, b AS (SELECT image_id, sum(depth)/count(*) AS base FROM raster WHERE x >= 3 AND x < 6 AND y >= 3 AND y < 7 GROUP BY image_id),
    c AS (SELECT image_id, max(y) AS y FROM raster JOIN b USING (image_id) WHERE x = 4 AND abs(depth - base) >= 400 GROUP BY image_id)
    SELECT image_id, y, 4 AS x, 4/8.0::DOUBLE AS cx, y/8.0::DOUBLE AS cy FROM c""",
)
def front_point_patch_base(spark, sf):
    return R.front_point(D.raster(spark, sf), 400.0, crop=2, zero_base=False)


@query(
    "front_point_along_bearing",
    f"""WITH {D.RASTER}, im AS (SELECT DISTINCT image_id FROM raster),
    a AS (SELECT image_id, radians(-30.0::DOUBLE + (('0x' || substr(md5('17|' || image_id), 1, 8))::BIGINT)::DOUBLE/4294967296.0::DOUBLE * 60.0::DOUBLE) AS ang FROM im),
    s AS (SELECT image_id, i AS step, 4 + i*sin(ang) AS rx, 7 - i*cos(ang) AS ry FROM a, range(17) r(i)),
    k AS (SELECT *, trunc(rx)::BIGINT AS x, trunc(ry)::BIGINT AS y FROM s WHERE rx >= 0 AND rx < 8 AND ry >= 0 AND ry < 8),
    h AS (SELECT k.*, row_number() OVER (PARTITION BY image_id ORDER BY step) AS rn FROM k JOIN raster USING (image_id, y, x) WHERE abs(depth) >= 600)
    SELECT image_id, step, y, x FROM h WHERE rn = 1""",
)
def front_point_along_bearing(spark, sf):
    images = D.raster_goals(spark, sf).select("image_id", "h", "w")
    hit = R.front_point_bearing(D.raster(spark, sf), images, 600.0, 30.0)
    return hit.select("image_id", F.col("step").cast("bigint").alias("step"), "y", "x")


def _points(spark, sf):
    return D.raster_goals(spark, sf).select("image_id", "h", "w", F.col("gy").alias("py"), F.col("gx").alias("px"))


def _mask_sql(buffer: str, test: str) -> str:
    return f"""WITH {D.RASTER}, {D.RASTER_GOALS},
    patch AS MATERIALIZED (SELECT image_id, y, unnest(range(greatest(gx - 2, 0), least(gx + 2, 8))) AS x FROM
      (SELECT image_id, gx, unnest(range(greatest(gy - 2, 0), least(gy + 2, 8))) AS y FROM rgoals)),
    ref AS MATERIALIZED (SELECT image_id, max(depth) + ({buffer}) AS ref_depth FROM patch JOIN raster USING (image_id, y, x) GROUP BY 1)
    SELECT image_id, y, x, depth {test} ref_depth AS in_depth FROM raster JOIN ref USING (image_id)"""


@query("depth_mask_nearer", _mask_sql("150", "<"))
def depth_mask_nearer(spark, sf):
    return R.depth_mask(D.raster(spark, sf), _points(spark, sf), 2, 150.0).select("image_id", "y", "x", "in_depth")


@query("depth_mask_farther", _mask_sql("-300", ">"))
def depth_mask_farther(spark, sf):
    return R.depth_mask(D.raster(spark, sf), _points(spark, sf), 2, -300.0).select("image_id", "y", "x", "in_depth")


@query("depth_mask_always_nearer", _mask_sql("-300", "<"))
def depth_mask_always_nearer(spark, sf):
    out = R.depth_mask(D.raster(spark, sf), _points(spark, sf), 2, -300.0, always_nearer=True)
    return out.select("image_id", "y", "x", "in_depth")


@query(
    "depth_summaries",
    f"""WITH {D.RASTER} SELECT image_id, min(depth) AS min_depth, max(depth) AS max_depth, sum(depth)/count(*) AS mean_depth,
      quantile_disc(depth, 0.25) AS p25, quantile_disc(depth, 0.5) AS p50, quantile_disc(depth, 0.75) AS p75 FROM raster GROUP BY image_id""",
)
def depth_summaries(spark, sf):
    return R.depth_summary(D.raster(spark, sf))


# ---- neighbourhood costs --------------------------------------------------------------

def _disc_sql(radius: str, over: str = "false", reach: int = 5) -> str:
    """Disc costs by joining every cell with the cells of its disc."""
    return f"""costs AS (
      SELECT a.image_id, a.y, a.x, any_value(a.depth) AS depth, sum((a.depth - b.depth)*(a.depth - b.depth)) AS total,
             count(*) AS n, bool_or({over}) AS blocked
      FROM raster a JOIN raster b ON a.image_id = b.image_id AND b.y BETWEEN a.y - {reach} AND a.y + {reach} AND b.x BETWEEN a.x - {reach} AND a.x + {reach}
      WHERE (a.y - b.y)*(a.y - b.y) + (a.x - b.x)*(a.x - b.x) <= ({radius})*({radius}) GROUP BY ALL)"""


_DELTA = "(a.depth - b.depth)*(a.depth - b.depth)"
_ADAPTIVE = "greatest(1, trunc(5 - 0.2::DOUBLE*(a.depth/100.0::DOUBLE)))"
_ADAPT_OVER = f"{_DELTA} > 4.0::DOUBLE*10000.0 AND (a.depth < 1000.0 OR b.depth < 1000.0)"
_ADAPT_TH = f"{_DELTA} > (4.0::DOUBLE + 4.0::DOUBLE/10.0::DOUBLE*(a.depth/100.0::DOUBLE))*10000.0"
_COST_COLS = "image_id, y, x, total, n, blocked"


@query("cell_cost_disc", f"WITH {D.RASTER}, {_disc_sql('2', reach=2)} SELECT {_COST_COLS} FROM costs")
def cell_cost_disc(spark, sf):
    return R.change_cost(D.raster(spark, sf), radius=2, per_metre=D.CM).select("image_id", "y", "x", "total", "n", "blocked")


@query("cell_cost_threshold", f"WITH {D.RASTER}, {_disc_sql('2', _DELTA + ' > 9.0*10000.0', 2)} SELECT {_COST_COLS} FROM costs")
def cell_cost_threshold(spark, sf):
    return R.change_cost(D.raster(spark, sf), radius=2, threshold=9.0, per_metre=D.CM).select(
        "image_id", "y", "x", "total", "n", "blocked"
    )


def _adaptive(spark, sf):
    return R.change_cost(
        D.raster(spark, sf), adaptive_radius=True, threshold=4.0, depth_limit=10.0, per_metre=D.CM
    )


@query("cell_cost_adaptive_radius", f"WITH {D.RASTER}, {_disc_sql(_ADAPTIVE, _ADAPT_OVER)} SELECT {_COST_COLS} FROM costs")
def cell_cost_adaptive_radius(spark, sf):
    return _adaptive(spark, sf).select("image_id", "y", "x", "total", "n", "blocked")


@query("cell_cost_adaptive_threshold", f"WITH {D.RASTER}, {_disc_sql(_ADAPTIVE, _ADAPT_TH)} SELECT {_COST_COLS} FROM costs")
def cell_cost_adaptive_threshold(spark, sf):
    return R.change_cost(
        D.raster(spark, sf), adaptive_radius=True, adaptive_threshold=4.0, per_metre=D.CM
    ).select("image_id", "y", "x", "total", "n", "blocked")


_DRAW = "((({0})*48271 + 11) % 2147483647)"
_SAMPLED = f"""WITH {D.RASTER}, near AS (
  SELECT a.image_id, a.y, a.x, (a.depth - b.depth)*(a.depth - b.depth) AS delta,
    row_number() OVER (PARTITION BY a.image_id, a.y, a.x ORDER BY b.y, b.x) - 1 AS pos,
    count(*) OVER (PARTITION BY a.image_id, a.y, a.x) AS cnt
  FROM raster a JOIN raster b ON a.image_id = b.image_id AND b.y BETWEEN a.y - 2 AND a.y + 2 AND b.x BETWEEN a.x - 2 AND a.x + 2
  WHERE (a.y - b.y)*(a.y - b.y) + (a.x - b.x)*(a.x - b.x) <= 4),
draws AS (
  SELECT image_id, y, x, k, {_DRAW.format(_DRAW.format(_DRAW.format("((image_id % 2147483647)*7919 + y*104729 + x*1299709 + k*15485863 + 17*32452843) % 2147483647")))} AS v
  FROM raster, range(10) r(k))
SELECT image_id, y, x, sum(delta) AS total, count(*) AS n, false AS blocked
FROM draws JOIN near USING (image_id, y, x) WHERE pos = v % cnt GROUP BY image_id, y, x"""


@query("cell_cost_sampled", _SAMPLED)
def cell_cost_sampled(spark, sf):
    return R.change_cost(D.raster(spark, sf), radius=2, samples=10, per_metre=D.CM).select(
        "image_id", "y", "x", "total", "n", "blocked"
    )


_MOVES = ", ".join(f"({i}, {dy}, {dx})" for i, (dy, dx) in enumerate(R.MOVES))


@query(
    "neighbour_moves_ranked",
    f"""WITH {D.RASTER}, {D.RASTER_GOALS}, mv(pos, dy, dx) AS (VALUES {_MOVES}),
    v AS (SELECT image_id, y, x, gy - y AS vy, gx - x AS vx, sqrt(((gy - y)*(gy - y) + (gx - x)*(gx - x))::DOUBLE) AS nrm FROM raster JOIN rgoals USING (image_id)),
    d AS (SELECT *, -((CASE WHEN nrm > 0 THEN vy/nrm ELSE 0 END)*dy + (CASE WHEN nrm > 0 THEN vx/nrm ELSE 0 END)*dx) AS neg_dot FROM v, mv),
    o AS (SELECT *, row_number() OVER (PARTITION BY image_id, y, x ORDER BY neg_dot, pos) - 1 AS rank FROM d)
    SELECT image_id, y, x, rank, y + dy AS ny, x + dx AS nx FROM o WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7""",
)
def neighbour_moves_ranked(spark, sf):
    goals = D.raster_goals(spark, sf).select("image_id", "h", "w", "gy", "gx")
    return R.neighbour_moves(D.raster(spark, sf), goals).select(
        "image_id", "y", "x", F.col("rank").cast("bigint").alias("rank"), "ny", "nx"
    )


@query(
    "raster_move_costs",
    f"""WITH {D.RASTER}, m AS MATERIALIZED (SELECT image_id, y, x, depth, y + k // 3 - 1 AS ny, x + k % 3 - 1 AS nx FROM (SELECT *, unnest([0, 1, 2, 3, 5, 6, 7, 8]) AS k FROM raster))
    SELECT m.image_id, m.y, m.x, ny, nx, (m.depth - b.depth)*(m.depth - b.depth) AS change2 FROM m JOIN raster b ON m.image_id = b.image_id AND b.y = ny AND b.x = nx""",
)
def raster_move_costs(spark, sf):
    return R.move_costs(D.raster(spark, sf))


@query(
    "raster_blurred_in_mask",
    f"""WITH {D.RASTER}, k(d, wt) AS (VALUES (-1, 0.25::DOUBLE), (0, 0.5::DOUBLE), (1, 0.25::DOUBLE)),
    s AS (SELECT r.image_id, r.y, r.x, any_value(r.depth) AS depth, sum(a.wt*b.wt*n.depth) AS blur FROM raster r, k a, k b, raster n
      WHERE n.image_id = r.image_id
        AND n.y = CASE WHEN r.y + a.d < 0 THEN 1 WHEN r.y + a.d > 7 THEN 6 ELSE r.y + a.d END
        AND n.x = CASE WHEN r.x + b.d < 0 THEN 1 WHEN r.x + b.d > 7 THEN 6 ELSE r.x + b.d END GROUP BY 1, 2, 3)
    SELECT image_id, y, x, (y + x) % 3 = 0 AS masked, CASE WHEN (y + x) % 3 = 0 THEN blur ELSE depth END AS value FROM s""",
)
def raster_blurred_in_mask(spark, sf):
    r = D.raster(spark, sf)
    return R.blur_inside(r, r.filter("(y + x) % 3 = 0").select("image_id", "y", "x"), strength=2)


# ---- paths ------------------------------------------------------------------------------

_STEPS = """steps AS (SELECT a.image_id, a.y AS y1, a.x AS x1, b.y AS y2, b.x AS x2, {cost} AS cost
  FROM {src} a JOIN {src} b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND (a.y, a.x) <> (b.y, b.x)
  WHERE {ok})"""
_RELAX = """dist(image_id, y, x, d) USING KEY (image_id, y, x) AS (
  SELECT image_id, 7, 4, 0.0::DOUBLE FROM rgoals
  UNION
  (SELECT s.image_id, s.y2, s.x2, min(w.d + s.cost) FROM dist w JOIN steps s ON s.image_id = w.image_id AND s.y1 = w.y AND s.x1 = w.x
     LEFT JOIN recurring.dist k ON k.image_id = s.image_id AND k.y = s.y2 AND k.x = s.x2
   WHERE w.d + s.cost < coalesce(k.d, 'infinity'::DOUBLE) GROUP BY 1, 2, 3))"""


def _search_sql(costs: str | None, cost: str, ok: str = "true") -> str:
    """Cheapest goal costs by recursion over all moves."""
    src = "raster" if costs is None else "costs"
    head = "" if costs is None else f", {costs}"
    steps = _STEPS.format(cost=cost, src=src, ok=ok)
    return f"""WITH RECURSIVE {D.RASTER}, {D.RASTER_GOALS}{head}, {steps}, {_RELAX}
    SELECT g.image_id, d.d IS NOT NULL AS res, d.d AS cost,
      CASE WHEN d.d IS NOT NULL THEN '{P.FOUND}' ELSE '{P.UNREACHABLE}' END AS reason
    FROM rgoals g LEFT JOIN dist d ON d.image_id = g.image_id AND d.y = g.gy AND d.x = g.gx"""


_MEAN = "1.0::DOUBLE + b.total/b.n/10000.0::DOUBLE"


@query("path_depth_change_cost", _search_sql(None, "1.0::DOUBLE + (a.depth - b.depth)*(a.depth - b.depth)"))
def path_depth_change_cost(spark, sf):
    """One step plus the squared depth change (here in cm²) of each move."""
    cells = D.raster(spark, sf).withColumn("enter_cost", F.lit(1.0))
    return P.plan_paths(cells, D.raster_goals(spark, sf), use_depth_change=True)[0]


@query("path_disc_cost", _search_sql(_disc_sql("2", reach=2), _MEAN))
def path_disc_cost(spark, sf):
    cells = R.cell_cost(R.change_cost(D.raster(spark, sf), radius=2, per_metre=D.CM), D.CM)
    return P.plan_paths(cells, D.raster_goals(spark, sf))[0]


@query("path_threshold_cost", _search_sql(_disc_sql("1", _DELTA + " > 20.0*10000.0", 1), _MEAN, "NOT b.blocked"))
def path_threshold_cost(spark, sf):
    """Blocked cells make some goals unreachable."""
    cells = R.cell_cost(R.change_cost(D.raster(spark, sf), radius=1, threshold=20.0, per_metre=D.CM), D.CM)
    return P.plan_paths(cells, D.raster_goals(spark, sf), towards_goal=True)[0]


@query("path_adaptive_threshold_cost", _search_sql(_disc_sql(_ADAPTIVE, _DELTA + " > (30.0::DOUBLE + 30.0::DOUBLE/10.0::DOUBLE*(a.depth/100.0::DOUBLE))*10000.0"), _MEAN, "NOT b.blocked"))
def path_adaptive_threshold_cost(spark, sf):
    cells = R.cell_cost(
        R.change_cost(D.raster(spark, sf), adaptive_radius=True, adaptive_threshold=30.0, per_metre=D.CM), D.CM
    )
    return P.plan_paths(cells, D.raster_goals(spark, sf), towards_goal=True)[0]


@query("path_sampled_cost", _search_sql(f"costs AS (WITH s AS ({_SAMPLED}) SELECT s.*, 0 AS depth FROM s)", _MEAN))
def path_sampled_cost(spark, sf):
    """Ten seeded disc cells per cell instead of the whole disc."""
    cells = R.cell_cost(R.change_cost(D.raster(spark, sf), radius=2, samples=10, per_metre=D.CM), D.CM)
    return P.plan_paths(cells, D.raster_goals(spark, sf))[0]


_PLANNED_OVER = f"{_DELTA} > 60.0::DOUBLE*10000.0 AND (a.depth < 1000.0 OR b.depth < 1000.0)"


def planned(spark, sf):
    """The active planner on the fixture: adaptive radius, threshold below a depth limit."""
    costs = R.change_cost(
        D.raster(spark, sf), adaptive_radius=True, threshold=60.0, depth_limit=10.0, per_metre=D.CM
    )
    return R.cell_cost(costs, D.CM)


@query("path_planned_results", _search_sql(_disc_sql(_ADAPTIVE, _PLANNED_OVER), _MEAN, "NOT b.blocked"))
def path_planned_results(spark, sf):
    return P.plan_paths(planned(spark, sf), D.raster_goals(spark, sf), towards_goal=True)[0]


@query(
    "path_planned_points_cost",
    f"""WITH q AS ({_search_sql(_disc_sql(_ADAPTIVE, _PLANNED_OVER), _MEAN, "NOT b.blocked")})
    SELECT image_id, round(cost, 6) AS cost, true AS starts_at_start, true AS adjacent FROM q WHERE res""",
)
def path_planned_points_cost(spark, sf):
    """Cost summed along the returned cells equals the cheapest cost; steps touch each other."""
    cells = planned(spark, sf)
    points = P.plan_paths(cells, D.raster_goals(spark, sf), towards_goal=True, keep_raw_start=False)[1]
    costed = points.join(cells.select("image_id", "y", "x", "enter_cost"), ["image_id", "y", "x"])
    moves = P.segments(points, ("y", "x"))
    far = moves.groupBy("image_id").agg(
        F.max(F.greatest(F.abs(F.col("y") - F.col("next_y")), F.abs(F.col("x") - F.col("next_x")))).alias("stride")
    )
    return (
        costed.groupBy("image_id")
        .agg(
            F.round(F.sum(F.when(F.col("seq") > 0, F.col("enter_cost")).otherwise(0.0)), 6).alias("cost"),
            F.max((F.col("seq") == 0) & (F.col("y") == 7) & (F.col("x") == 4)).alias("starts_at_start"),
        )
        .join(far, "image_id", "left")
        .select("image_id", "cost", "starts_at_start", (F.coalesce("stride", F.lit(1)) == 1).alias("adjacent"))
    )


@query(
    "path_search_ends",
    f"""WITH {D.SIZES} SELECT image_id, greatest(1, least(h, h - 2)) AS sy, greatest(1, least(w//2, w - 2)) AS sx,
      greatest(1, least(trunc(0.75*h)::BIGINT, h - 2)) AS gy, greatest(1, least(trunc((image_id % 9)/8.0::DOUBLE*w)::BIGINT, w - 2)) AS gx, h AS raw_sy FROM sizes""",
)
def path_search_ends(spark, sf):
    goals = D.sizes(spark, sf).selectExpr("image_id", "h", "w", "(image_id % 9) / 8.0D as cx", "0.75D as cy")
    return P.search_ends(goals).select("image_id", "sy", "sx", "gy", "gx", "raw_sy")


_PRESET = f"{_DELTA} > 1.0::DOUBLE*10000.0 AND (a.depth < 1000.0 OR b.depth < 1000.0)"


@query(
    "path_depth_planner",
    f"""WITH q AS ({_search_sql(_disc_sql(_ADAPTIVE, _PRESET), _MEAN, "NOT b.blocked").replace("SELECT image_id, 7, 4, 0.0::DOUBLE FROM rgoals", "SELECT image_id, 6, 4, 0.0::DOUBLE FROM rgoals").replace("vec_id % 4 AS gy, (vec_id*5) % 8 AS gx", "greatest(1, vec_id % 4) AS gy, greatest(1, least((vec_id*5) % 8, 6)) AS gx")})
    SELECT image_id, res, reason, CASE WHEN res THEN 1.0 END::DOUBLE AS first_ny, CASE WHEN res THEN 0.5 END::DOUBLE AS first_nx FROM q""",
)
def path_depth_planner(spark, sf):
    """The planner with its own settings: clamped ends, 1 m² limit below 10 m, raw start first."""
    goals = D.raster_goals(spark, sf).select("image_id", "h", "w", "cx", "cy")
    results, points = P.plan_depth_paths(D.raster(spark, sf), goals, per_metre=D.CM)
    first = points.filter("seq = 0").select("image_id", F.col("ny").alias("first_ny"), F.col("nx").alias("first_nx"))
    return results.drop("cost").join(first, "image_id", "left")


@query(
    "path_straight_line",
    f"""WITH {D.RASTER_GOALS}, {D.raster_paths_sql(20)} SELECT image_id, seq::BIGINT AS seq, x, y, px, py FROM pts""",
)
def path_straight_line(spark, sf):
    return D.raster_paths(spark, sf, 20).select("image_id", F.col("seq").cast("bigint").alias("seq"), "x", "y", "px", "py")


@query(
    "path_centre_line",
    f"""WITH {D.SIZES} SELECT image_id, (i - (2*h)//3) AS seq, (w//2)/w::DOUBLE AS x, i/h::DOUBLE AS y
    FROM sizes, range(0, 1500) r(i) WHERE i >= (2*h)//3 AND i < h""",
)
def path_centre_line(spark, sf):
    return P.centre_line(D.sizes(spark, sf))


@query(
    "path_densified_points",
    f"""WITH RECURSIVE {D.RASTER_GOALS}, {D.raster_paths_sql(6)},
    g(i, r, k) AS (SELECT 0, 0, greatest(2, ceil(20/6.0::DOUBLE)::INT) UNION ALL
      SELECT i + 1, r + k - 1, greatest(2, ceil((20 - (r + k - 1))/(6 - (i + 1))::DOUBLE)::INT) FROM g WHERE i < 4),
    p AS (SELECT a.image_id, r + j AS seq, a.x + j*((b.x - a.x)/k) AS x, a.y + j*((b.y - a.y)/k) AS y
      FROM g JOIN pts a ON a.seq = g.i JOIN pts b ON b.image_id = a.image_id AND b.seq = a.seq + 1, range(0, 20) t(j) WHERE j < k - 1
      UNION ALL SELECT image_id, (SELECT max(r + k - 1) FROM g), x, y FROM pts WHERE seq = 5)
    SELECT image_id, seq::BIGINT AS seq, x, y FROM p""",
)
def path_densified_points(spark, sf):
    """One pass over six points asked to become twenty: every step is cut into its share."""
    pts = D.raster_paths(spark, sf, 6).select("image_id", "seq", "x", "y")
    return P.densify_pass(pts, 20).select("image_id", F.col("seq").cast("bigint").alias("seq"), "x", "y")


@query(
    "path_densified_counts",
    f"""WITH {D.RASTER_GOALS}, {D.raster_paths_sql(6)},
    c AS (SELECT image_id, count(*) AS n FROM pts GROUP BY image_id) SELECT image_id, greatest(n, 20) AS n_points, true AS ends_kept FROM c""",
)
def path_densified_counts(spark, sf):
    """Six points asked to become twenty: 16 after one pass, 18 after two, then no share can grow
    and the longest steps are halved."""
    pts = D.raster_paths(spark, sf, 6).select("image_id", F.col("seq"), "x", "y")
    dense = P.densify(pts, 20)
    ends = pts.filter("seq = 5").select("image_id", F.col("x").alias("ex"), F.col("y").alias("ey"))
    last = dense.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n_points"), F.max_by(F.struct("x", "y"), F.col("seq")).alias("e")
    )
    return last.join(ends, "image_id").select(
        "image_id", "n_points", ((F.col("e.x") == F.col("ex")) & (F.col("e.y") == F.col("ey"))).alias("ends_kept")
    )


@query(
    "path_source_choice",
    f"""WITH {D.RASTER_GOALS} SELECT CASE WHEN image_id % 3 = 0 THEN 'stored' WHEN image_id % 3 = 1 THEN 'planned' ELSE 'line' END AS origin,
      sum(CASE WHEN image_id % 3 = 0 THEN 2 WHEN image_id % 3 = 1 THEN 3 ELSE 6 END)::BIGINT AS n FROM rgoals GROUP BY 1""",
)
def path_source_choice(spark, sf):
    line = D.raster_paths(spark, sf, 6).select("image_id", "seq", "x", "y")
    stored = line.filter("image_id % 3 = 0 and seq < 2")
    plan = line.filter("image_id % 3 <= 1 and seq < 3")
    chosen = P.choose_paths(D.raster_goals(spark, sf), stored, plan, line)
    return chosen.groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


@query(
    "path_smoothed_bounds",
    f"""WITH {D.RASTER_GOALS}, {D.raster_paths_sql(20)}
    SELECT a.image_id, a.seq::BIGINT AS seq, trunc(sum(greatest(b.px - 2, 0))/5.0::DOUBLE)::BIGINT AS left_x, trunc(sum(least(b.px + 3, 7))/5.0::DOUBLE)::BIGINT AS right_x
    FROM pts a JOIN pts b ON a.image_id = b.image_id AND b.seq BETWEEN a.seq - 2 AND a.seq + 2 GROUP BY 1, 2""",
)
def path_smoothed_bounds(spark, sf):
    pts = D.raster_paths(spark, sf, 20).selectExpr(
        "image_id", "seq", "greatest(px - 2, 0) as left_x", "least(px + 3, 7) as right_x"
    )
    return P.smoothed_bounds(pts).withColumn("seq", F.col("seq").cast("bigint"))


# ---- region masks -----------------------------------------------------------------------

def _path_points(spark, sf, n=6):
    return D.raster_paths(spark, sf, n).select(
        "image_id", "seq", "px", "py", F.lit(8).cast("bigint").alias("h"), F.lit(8).cast("bigint").alias("w"),
        F.lit(4.8).alias("fx"), F.lit(4.0).alias("fy"),
    )


def _inside_sql(corners: list[tuple[str, str]]) -> str:
    """Even-odd test of pixel (x, y), edges included, for corner expressions."""
    odd, edge = [], []
    for (xa, ya), (xb, yb) in zip(corners, corners[1:] + corners[:1]):
        odd.append(f"(CASE WHEN ({ya} <= y) <> ({yb} <= y) AND x < {xa} + (y - {ya})*({xb} - {xa})/nullif({yb} - {ya}, 0)::DOUBLE THEN 1 ELSE 0 END)")
        edge.append(
            f"(({xb} - {xa})*(y - {ya}) = ({yb} - {ya})*(x - {xa}) AND x BETWEEN least({xa}, {xb}) AND greatest({xa}, {xb}) AND y BETWEEN least({ya}, {yb}) AND greatest({ya}, {yb}))"
        )
    return f"(({' + '.join(odd)}) % 2 = 1 OR {' OR '.join(edge)})"


_PIXELS = "px8 AS (SELECT yy AS y, xx AS x FROM range(8) a(yy), range(8) b(xx))"


def _sides_sql(mirrored: bool) -> str:
    low, high = ("0", "8"), ("0", "0")
    left = [("ax", "ay"), ("bx", "by_"), *((high, low) if mirrored else (low, high))]
    right = [("ax", "ay"), ("bx", "by_"), ("8", "0"), ("8", "8")]
    return f"""WITH {D.RASTER_GOALS}, {D.raster_paths_sql(6)}, {_PIXELS},
    seg AS (SELECT a.image_id, a.px AS ax, a.py AS ay, b.px AS bx, b.py AS by_ FROM pts a JOIN pts b ON a.image_id = b.image_id AND b.seq = a.seq + 1)
    SELECT DISTINCT image_id, 'L' AS region, y, x FROM seg, px8 WHERE {_inside_sql(left)}
    UNION ALL SELECT DISTINCT image_id, 'R', y, x FROM seg, px8 WHERE {_inside_sql(right)}"""


@query("mask_sides", _sides_sql(False))
def mask_sides(spark, sf):
    return M.run_pixels(M.side_masks(_path_points(spark, sf)))


@query("mask_sides_mirrored", _sides_sql(True))
def mask_sides_mirrored(spark, sf):
    return M.run_pixels(M.side_masks(_path_points(spark, sf), as_reference=False))


@query(
    "mask_circles",
    f"""WITH {D.RASTER_GOALS}, {_PIXELS} SELECT DISTINCT image_id, 'C' AS region, y, x FROM rgoals, px8
    WHERE (y - gy)*(y - gy) + (x - gx)*(x - gx) <= 4 OR (y - 7)*(y - 7) + (x - 4)*(x - 4) <= 1""",
)
def mask_circles(spark, sf):
    g = D.raster_goals(spark, sf)
    centres = g.selectExpr("image_id", "h", "w", "gx as cx", "gy as cy", "2L as r").unionByName(
        g.selectExpr("image_id", "h", "w", "sx as cx", "sy as cy", "1L as r")
    )
    return M.run_pixels(M.circle_mask(centres))


@query(
    "mask_trapezoid",
    f"""WITH {D.RASTER_GOALS}, {_PIXELS}, g AS (SELECT *, least(gx + 2, 8) AS rx, greatest(gx - 2, 0) AS lx FROM rgoals)
    SELECT image_id, 'T' AS region, y, x FROM g, px8 WHERE {_inside_sql([("0", "0"), ("8", "0"), ("rx", "gy"), ("lx", "gy")])}""",
)
def mask_trapezoid(spark, sf):
    return M.run_pixels(M.trapezoid_mask(_points(spark, sf), 2))


_BOUNDS = "greatest({x} - trunc(1.0/depth*{f})::BIGINT, 0) AS lx, least({x} + trunc(1.0/depth*{f})::BIGINT, 7) AS rx"


@query(
    "mask_goal_bands",
    f"""WITH {D.RASTER}, {D.RASTER_GOALS}, {_PIXELS}, b AS (
      SELECT g.image_id, gx, gy, {_BOUNDS.format(x="gx", f="2000.0::DOUBLE")} FROM rgoals g JOIN raster r ON r.image_id = g.image_id AND r.y = gy AND r.x = gx WHERE depth > 0),
    s AS (SELECT *, trunc((rx - lx)/2.0::DOUBLE)::BIGINT AS r FROM b)
    SELECT image_id, 'B' AS region, y, x FROM s, px8 WHERE x >= gx - r AND x < gx + r
    UNION ALL SELECT image_id, 'C', y, x FROM s, px8 WHERE (y - gy)*(y - gy) + (x - gx)*(x - gx) <= r*r""",
)
def mask_goal_bands(spark, sf):
    goals = _points(spark, sf).withColumn("fx", F.lit(2000.0))
    return M.run_pixels(M.goal_bands(goals, D.raster(spark, sf), 1.0))


_PATH_MASK = f"""bd AS (
  SELECT p.image_id, seq, p.px, p.py, {_BOUNDS.format(x="p.px", f="1000.0::DOUBLE")} FROM pts p
  JOIN raster r ON r.image_id = p.image_id AND r.y = p.py AND r.x = p.px WHERE depth > 0),
lastp AS (SELECT image_id, max(seq) AS seq FROM bd GROUP BY image_id),
pmask AS (
  SELECT DISTINCT image_id, y, x FROM (
    SELECT a.image_id, y, x FROM bd a JOIN bd b ON a.image_id = b.image_id AND b.seq = a.seq + 1, px8
    WHERE y BETWEEN least(a.py, b.py) AND greatest(a.py, b.py) AND x BETWEEN least(a.lx, b.rx) AND greatest(a.lx, b.rx)
    UNION ALL
    SELECT l.image_id, y, x FROM lastp l JOIN bd b ON b.image_id = l.image_id AND b.seq = l.seq, px8
    WHERE (y - py)*(y - py) + (x - px)*(x - px) <= trunc((rx - lx)/2.0::DOUBLE)*trunc((rx - lx)/2.0::DOUBLE)))"""


def _path_mask(spark, sf):
    pts = _path_points(spark, sf).withColumn("fx", F.lit(1000.0))
    return M.path_mask(pts, D.raster(spark, sf), 1.0)


@query(
    "mask_path",
    f"WITH {D.RASTER}, {D.RASTER_GOALS}, {D.raster_paths_sql(6)}, {_PIXELS}, {_PATH_MASK} SELECT image_id, 'P' AS region, y, x FROM pmask",
)
def mask_path(spark, sf):
    return M.run_pixels(_path_mask(spark, sf))


@query(
    "mask_points_without_depth",
    f"WITH {D.RASTER}, {D.RASTER_GOALS}, {D.raster_paths_sql(6)} SELECT p.image_id, seq::BIGINT AS seq, px, py FROM pts p JOIN raster r ON r.image_id = p.image_id AND r.y = py AND r.x = px WHERE depth <= 0",
)
def mask_points_without_depth(spark, sf):
    """Path points that no metric mask can size."""
    out = M.points_without_depth(_path_points(spark, sf), D.raster(spark, sf))
    return out.select("image_id", F.col("seq").cast("bigint").alias("seq"), "px", "py")


@query(
    "mask_path_discs",
    f"""WITH {D.RASTER}, {D.RASTER_GOALS}, {D.raster_paths_sql(6)}, {_PIXELS},
    d AS (SELECT p.image_id, px, py, trunc(1.0/depth*((1000.0::DOUBLE + 800.0::DOUBLE)/2))::BIGINT AS r FROM pts p JOIN raster r ON r.image_id = p.image_id AND r.y = py AND r.x = px WHERE depth > 0)
    SELECT DISTINCT image_id, 'P' AS region, y, x FROM d, px8 WHERE (y - py)*(y - py) + (x - px)*(x - px) <= r*r""",
)
def mask_path_discs(spark, sf):
    pts = _path_points(spark, sf).withColumn("fx", F.lit(1000.0)).withColumn("fy", F.lit(800.0))
    return M.run_pixels(M.path_disc_mask(pts, D.raster(spark, sf), 1.0))


_LINE_PX = """linepx AS (SELECT DISTINCT p.image_id, px8.y, px8.x FROM pts p JOIN px8 ON (px8.y - py)*(px8.y - py) + (px8.x - px)*(px8.x - px) <= 1
  UNION SELECT DISTINCT a.image_id, px8.y, px8.x FROM pts a JOIN pts b ON a.image_id = b.image_id AND b.seq = a.seq + 1 AND (a.px, a.py) <> (b.px, b.py), px8
  WHERE ((px8.x - a.px)*(b.px - a.px) + (px8.y - a.py)*(b.py - a.py)) BETWEEN 0 AND (b.px - a.px)*(b.px - a.px) + (b.py - a.py)*(b.py - a.py)
    AND ((b.px - a.px)*(px8.y - a.py) - (b.py - a.py)*(px8.x - a.px))*((b.px - a.px)*(px8.y - a.py) - (b.py - a.py)*(px8.x - a.px))
        <= (b.px - a.px)*(b.px - a.px) + (b.py - a.py)*(b.py - a.py))"""


def _line_pixels(spark, sf):
    return M.run_pixels(M.thick_line_runs(_path_points(spark, sf), 2.0))


@query("mask_thick_line", f"WITH {D.RASTER_GOALS}, {D.raster_paths_sql(6)}, {_PIXELS}, {_LINE_PX} SELECT image_id, 'line' AS region, y, x FROM linepx")
def mask_thick_line(spark, sf):
    return _line_pixels(spark, sf)


def _flood(region: str, x0: int) -> str:
    return f"""reach_{region}(image_id, y, x) AS (
      SELECT image_id, y, x FROM openpx WHERE y = 0 AND x = {x0}
      UNION SELECT o.image_id, o.y, o.x FROM reach_{region} r JOIN openpx o ON o.image_id = r.image_id AND abs(o.y - r.y) + abs(o.x - r.x) = 1)"""


@query(
    "mask_flood_sides",
    f"""WITH RECURSIVE {D.RASTER_GOALS}, {D.raster_paths_sql(6)}, {_PIXELS}, {_LINE_PX},
    openpx AS (SELECT g.image_id, y, x FROM rgoals g, px8 WHERE (g.image_id, y, x) NOT IN (SELECT image_id, y, x FROM linepx)),
    {_flood("l", 0)}, {_flood("r", 7)}
    SELECT image_id, 'L' AS region, y, x FROM reach_l UNION ALL SELECT image_id, 'R', y, x FROM reach_r""",
)
def mask_flood_sides(spark, sf):
    return M.flood_masks(D.raster(spark, sf).select("image_id", "h", "w", "y", "x"), _line_pixels(spark, sf))


_LEFT = _inside_sql([("ax", "ay"), ("bx", "by_"), ("0", "8"), ("0", "0")])
_RIGHT = _inside_sql([("ax", "ay"), ("bx", "by_"), ("8", "0"), ("8", "8")])
_REGIONS = f"""{D.RASTER}, {D.RASTER_GOALS}, {D.raster_paths_sql(6)}, {_PIXELS}, {_PATH_MASK},
seg AS (SELECT a.image_id, a.px AS ax, a.py AS ay, b.px AS bx, b.py AS by_ FROM pts a JOIN pts b ON a.image_id = b.image_id AND b.seq = a.seq + 1),
sides AS (SELECT DISTINCT image_id, 'L' AS region, y, x FROM seg, px8 WHERE {_LEFT} UNION ALL SELECT DISTINCT image_id, 'R', y, x FROM seg, px8 WHERE {_RIGHT}),
ref AS (SELECT r.image_id, max(depth) + 150 AS ref_depth FROM raster r JOIN rgoals g USING (image_id)
  WHERE y >= greatest(gy - 2, 0) AND y < least(gy + 2, 8) AND x >= greatest(gx - 2, 0) AND x < least(gx + 2, 8) GROUP BY 1),
near AS (SELECT image_id, y, x FROM raster JOIN ref USING (image_id) WHERE depth < ref_depth),
regions AS (
  SELECT s.* FROM sides s SEMI JOIN near USING (image_id, y, x) ANTI JOIN pmask USING (image_id, y, x)
  UNION ALL SELECT image_id, 'P', y, x FROM pmask SEMI JOIN near USING (image_id, y, x)
  UNION ALL SELECT image_id, 'D', y, x FROM pmask SEMI JOIN near USING (image_id, y, x))"""


def region_runs(spark, sf):
    points = _path_points(spark, sf).withColumn("fx", F.lit(1000.0))
    return M.final_regions(D.raster(spark, sf), points, _points(spark, sf), 1.0, 2, 150.0)


def final_regions(spark, sf):
    return M.run_pixels(region_runs(spark, sf))


@query("mask_final_regions", f"WITH {_REGIONS} SELECT image_id, region, y, x FROM regions")
def mask_final_regions(spark, sf):
    return final_regions(spark, sf)


@query(
    "mask_region_values",
    f"""WITH {_REGIONS} SELECT image_id, region, count(*) AS n, sum(depth)::BIGINT AS total FROM regions JOIN raster USING (image_id, y, x) GROUP BY 1, 2""",
)
def mask_region_values(spark, sf):
    kept = M.masked_values(D.raster(spark, sf), final_regions(spark, sf))
    return kept.groupBy("image_id", "region").agg(
        F.count(F.lit(1)).alias("n"), F.sum("depth").cast("bigint").alias("total")
    )


@query(
    "mask_box_share",
    f"""WITH {_REGIONS}, {D.BOXES},
    sb AS (SELECT DISTINCT image_id, box_no, x_min, y_min, x_max, y_max, trunc(x_min*8)::BIGINT AS px1, trunc(y_min*8)::BIGINT AS py1, trunc(x_max*8)::BIGINT AS px2, trunc(y_max*8)::BIGINT AS py2
           FROM boxes SEMI JOIN rgoals USING (image_id)),
    kb AS (SELECT *, (px2 - px1)*(py2 - py1) AS area FROM sb WHERE px2 > px1 AND py2 > py1)
    SELECT image_id, region, box_no, any_value(area) AS box_px, count(*) AS masked_px FROM kb JOIN regions USING (image_id)
    WHERE y >= py1 AND y < py2 AND x >= px1 AND x < px2 GROUP BY image_id, region, box_no, x_min, y_min, x_max, y_max HAVING count(*)/any_value(area)::DOUBLE >= 0.1""",
)
def mask_box_share(spark, sf):
    g = D.raster_goals(spark, sf).select("image_id", "h", "w")
    b = D.boxes_of(spark, sf, g).dropDuplicates(["image_id", "box_no", *M.XYXY])
    return M.boxes_in_regions(b, region_runs(spark, sf), g, 0.1)
