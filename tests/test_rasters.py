"""Tiles, searches and masks against direct computation; tiles far smaller than the rasters."""

from __future__ import annotations

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.operators import paths as P
from kerbline.operators import raster as R
from kerbline.operators import regions as M

SHAPES = {1: (13, 11), 2: (5, 17), 3: (4, 4)}


@pytest.fixture(scope="module")
def grids():
    rng = np.random.default_rng(3)
    return {i: rng.integers(0, 900, shape).astype(float) for i, shape in SHAPES.items()}


@pytest.fixture(scope="module")
def raster(spark, grids):
    rows = [(i, *g.shape, y, x, float(g[y, x])) for i, g in grids.items() for y in range(g.shape[0]) for x in range(g.shape[1])]
    return spark.createDataFrame(rows, "image_id long, h long, w long, y long, x long, depth double").cache()


def disc(grid, radius_of, cap=np.inf, limit=np.inf):
    h, w = grid.shape
    out = {}
    for y in range(h):
        for x in range(w):
            r = radius_of(grid[y, x])
            total, n, blocked = 0.0, 0, False
            for yy in range(max(0, y - 5), min(h, y + 6)):
                for xx in range(max(0, x - 5), min(w, x + 6)):
                    if (yy - y) ** 2 + (xx - x) ** 2 <= r * r:
                        d = (grid[y, x] - grid[yy, xx]) ** 2
                        total, n = total + d, n + 1
                        blocked |= d > cap and (grid[y, x] < limit or grid[yy, xx] < limit)
            out[y, x] = (total, n, blocked)
    return out


@pytest.mark.parametrize("adaptive", [False, True])
def test_costs_do_not_depend_on_tiles(raster, grids, adaptive):
    kwargs = dict(adaptive_radius=True, threshold=16.0, depth_limit=4.0) if adaptive else dict(radius=3)
    got = {
        (r.image_id, r.y, r.x): (r.total, r.n, r.blocked)
        for r in R.change_cost(raster, per_metre=100.0, tile=4, **kwargs).collect()
    }
    for i, g in grids.items():
        if adaptive:
            want = disc(g, lambda d: max(1, int(5 - 0.2 * (d / 100.0))), 160000.0, 400.0)
        else:
            want = disc(g, lambda d: 3)
        assert {k[1:]: v for k, v in got.items() if k[0] == i} == want


def test_blur_does_not_depend_on_tiles(raster, grids):
    k = np.array(R.blur_kernel(7))
    got = {(r.image_id, r.y, r.x): r.blurred for r in R.blurred(raster, k.tolist(), tile=4).collect()}
    for i, g in grids.items():
        pad = np.pad(g, 3, mode="reflect")
        across = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), 1, pad)
        want = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), 0, across)
        for y in range(g.shape[0]):
            for x in range(g.shape[1]):
                assert got[i, y, x] == pytest.approx(want[y, x])


def dijkstra(enter, start, depth=None):
    h, w = enter.shape
    dist, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        d, (y, x) = heapq.heappop(heap)
        if d > dist[y, x]:
            continue
        for dy, dx in R.MOVES:
            ny, nx = y + dy, x + dx
            if 0 <= ny < h and 0 <= nx < w and not np.isnan(enter[ny, nx]):
                step = enter[ny, nx] + (0 if depth is None else (depth[y, x] - depth[ny, nx]) ** 2)
                if d + step < dist.get((ny, nx), np.inf):
                    dist[ny, nx] = d + step
                    heapq.heappush(heap, (d + step, (ny, nx)))
    return dist


@pytest.mark.parametrize("use_depth", [False, True])
def test_search_over_many_tiles(spark, raster, grids, use_depth):
    """Walls with gaps force paths back and forth over tile borders."""
    wall = (F.col("y") % 4 == 2) & (F.col("x") != F.when(F.col("y") % 8 == 2, 0).otherwise(F.col("w") - 1))
    cells = raster.withColumn(
        "enter_cost", F.when(~wall | (F.col("y") == 0), F.lit(1.0) + F.floor(F.col("depth") / 100))
    )
    ends = spark.createDataFrame(
        [(i, *g.shape, g.shape[0] - 1, g.shape[1] // 2, 0, 0) for i, g in grids.items()],
        "image_id long, h long, w long, sy long, sx long, gy long, gx long",
    )
    state = P.shortest_distances(cells, ends, use_depth, tile=3)
    got = {(r.image_id, r.y, r.x): r.dist for r in P.cell_distances(state).collect()}
    walk = P.trace_back(state, ends, use_depth, towards_goal=True, tile=3).collect()
    for i, g in grids.items():
        h, w = g.shape
        enter = 1.0 + np.floor(g / 100)
        for y in range(1, h):
            if y % 4 == 2:
                gap = 0 if y % 8 == 2 else w - 1
                enter[y, [x for x in range(w) if x != gap]] = np.nan
        want = dijkstra(enter, (h - 1, w // 2), g if use_depth else None)
        assert {k[1:]: v for k, v in got.items() if k[0] == i} == want
        path = sorted((r.back, r.y, r.x, r.cost) for r in walk if r.image_id == i)
        assert path[0][1:3] == (0, 0) and path[-1][1:3] == (h - 1, w // 2)
        assert [p[0] for p in path] == list(range(len(path)))
        for (_, y1, x1, c1), (_, y2, x2, c2) in zip(path, path[1:]):
            assert max(abs(y1 - y2), abs(x1 - x2)) == 1
            step = enter[y1, x1] + ((g[y1, x1] - g[y2, x2]) ** 2 if use_depth else 0)
            assert c1 == c2 + step


def test_a_round_reads_only_groups_with_mail(spark, monkeypatch):
    """One image settles in its first tile, another one's path crosses all of its tiles."""
    monkeypatch.setattr(P, "GROUP_TILES", 1)
    monkeypatch.setattr(P, "GROUP_SIDE", 1)
    rows = [(1, 2, 2, y, x, 1.0) for y in range(2) for x in range(2)]
    rows += [(2, 4, 24, y, x, 1.0) for y in range(4) for x in range(24)]
    cells = spark.createDataFrame(rows, "image_id long, h long, w long, y long, x long, enter_cost double")
    ends = spark.createDataFrame([(1, 2, 2, 0, 0, 1, 1), (2, 4, 24, 0, 0, 3, 23)], "image_id long, h long, w long, sy long, sx long, gy long, gx long")
    log: list = []
    state = P.shortest_distances(cells, ends, tile=4, rounds_log=log)
    assert state.groups == 7 and len(log) >= 5
    assert all(len(r["groups"]) <= 3 and r["tiles"] <= 3 for r in log)  # a wave front, never all tiles
    assert {(r.y, r.x): r.dist for r in P.cell_distances(state).collect() if r.image_id == 2} == {(y, x): float(max(y, x)) for y in range(4) for x in range(24)}
    one = state.costs.filter("image_id = 1").select("image_id", "ty", "tx", "grp")
    near = P._touched(state.costs, one, state.groups)
    grp = one.first().grp
    scan = [line for line in near._jdf.queryExecution().explainString(near.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).splitlines() if "PartitionFilters" in line]
    assert any(f"= {grp}" in line or f"IN ({grp})" in line for line in scan), scan
    read = {r.f.rsplit("/", 2)[1] for r in state.costs.filter(F.expr(f"grp in ({grp})")).select(F.input_file_name().alias("f")).collect()}
    assert read == {f"grp={grp}"}


def test_a_lost_walk_is_a_status_row(spark, raster):
    cells = raster.withColumn("enter_cost", F.lit(1.0))
    sizes = [tuple(r) for r in raster.select("image_id", "h", "w").distinct().collect()]
    ends = spark.createDataFrame(
        [(i, h, w, h - 1, 0, 0, w - 1, h, 0) for i, h, w in sizes],
        "image_id long, h long, w long, sy long, sx long, gy long, gx long, raw_sy long, raw_sx long",
    )
    state = P.shortest_distances(cells, ends, tile=64)
    bad = sizes[0][0]

    def spoil(pdfs):
        for pdf in pdfs:
            for k, r in pdf.iterrows():
                if r.image_id == bad:
                    pdf.at[k, "dist"] = (np.frombuffer(r["dist"], np.float64) * 1.5 + 0.25).tobytes()
            yield pdf

    broken = state._replace(dists=state.dists.mapInPandas(spoil, state.dists.schema))
    results, points = P.path_results(P.trace_back(broken, ends, tile=64), ends)
    got = {r.image_id: (r.res, r.reason) for r in results.collect()}
    assert got.pop(bad) == (False, P.UNSETTLED) and set(got.values()) == {(True, P.FOUND)}
    assert bad not in {r.image_id for r in points.select("image_id").distinct().collect()}


def test_unreachable_goal(spark, raster):
    cells = raster.filter("image_id = 3").withColumn("enter_cost", F.when(F.col("y") != 1, F.lit(1.0)))
    ends = spark.createDataFrame(
        [(3, 4, 4, 3, 2, 0, 0, 4, 2)],
        "image_id long, h long, w long, sy long, sx long, gy long, gx long, raw_sy long, raw_sx long",
    )
    results, points = P.plan_paths(cells, ends, tile=2)
    row = results.first()
    assert (row.res, row.reason, row.cost) == (False, P.UNREACHABLE, None)
    assert points.count() == 0


def test_planner_keeps_the_raw_start(spark, raster):
    goals = spark.createDataFrame([(1, 13, 11, 0.5, 0.1)], "image_id long, h long, w long, cx double, cy double")
    results, points = P.plan_depth_paths(raster.filter("image_id = 1"), goals, per_metre=1000.0)
    assert results.first().res
    first = points.orderBy("seq").take(2)
    assert (first[0].y, first[0].ny) == (13, 1.0)  # below the raster, not clamped
    assert (first[1].y, first[1].x) == (11, 5)


def test_flood_and_line_over_tiles(spark):
    rows = [(1, 9, 9, y, x) for y in range(9) for x in range(9)]
    pixels = spark.createDataFrame(rows, "image_id long, h long, w long, y long, x long")
    line = spark.createDataFrame([(1, y, 4) for y in range(9)], "image_id long, y long, x long")
    got = {(r.region, r.y, r.x) for r in M.flood_masks(pixels, line, tile=2).collect()}
    want = {("L", y, x) for y in range(9) for x in range(4)} | {("R", y, x) for y in range(9) for x in range(5, 9)}
    assert got == want


def test_runs_of_many_overlapping_shapes(spark):
    """A crowded row collapses to its union."""
    rects = spark.range(2000).selectExpr(
        "1L as image_id", "'P' as region", "4L as h", "100L as w", "id % 90 as x1", "0L as y1", "id % 90 + 5 as x2", "3L as y2"
    )
    runs = M.merge_runs(M.rectangle_runs(rects)).orderBy("y").collect()
    assert [(r.y, r.x_from, r.x_to) for r in runs] == [(y, 0, 94) for y in range(4)]


def test_regions_never_overlap_the_path(spark, sf):
    from kerbline.plans.raster_queries import final_regions

    regions = final_regions(spark, sf)
    p = regions.filter("region = 'P'").select("image_id", "y", "x")
    assert regions.filter("region in ('L', 'R')").join(p, ["image_id", "y", "x"]).count() == 0


def test_band_is_clamped_at_the_left_edge(spark):
    """A radius larger than the column gives a band from column 0, not an empty one."""
    goals = spark.createDataFrame([(1, 2, 8, 1, 1, 10.0)], "image_id long, h long, w long, py long, px long, fx double")
    raster = spark.createDataFrame([(1, 2, 8, 1, 1, 2.0)], "image_id long, h long, w long, y long, x long, depth double")
    band = M.goal_bands(goals, raster, 1.0).filter("region = 'B'").orderBy("y").collect()
    assert [(r.y, r.x_from, r.x_to) for r in band] == [(0, 0, 3), (1, 0, 3)]
