"""Path geometry and cheapest paths over depth rasters.

The search runs on all images at once. A raster is held as one row per tile: the entry cost
of each cell and the best distance so far, both with a one-cell frame. A round improves each
tile on its own until it is stable and then sends the changed cells on its rim to the
neighbour tiles. The search ends when no tile sends anything, and the number of rounds follows
the tiles a path crosses, not its length in pixels.

Costs and distances are tables partitioned by tile group (blocks of neighbouring tiles of an
image). A round names the groups that got mail and reads the files of those alone; of these it
shuffles only the tiles that got mail. Groups whose images are settled are not read again. Walking
back from the goals reads the same way.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..session import cut_lineage, discard, scratch_path, settle
from .raster import MOVES, TileGrid, attach, cell_cost, change_cost, pack_tiles

SEARCH_TILE = 128
GROUP_TILES = 512  # tiles of a group on average, some 200 MB of costs and distances
GROUP_SIDE = 16  # a group is made of blocks of this many tiles each way, so one huge image has many
NAMED_GROUPS = 10_000  # most groups that a round lists; with more of them active it reads all

# Result texts.
FOUND = "Path is planned successfully."
UNREACHABLE = "No path found - goal is unreachable with the given threshold."

UNSETTLED = "No path found - distances are not settled."
KEYS = ["image_id", "ty", "tx"]


# ---- polylines -----------------------------------------------------------------------

def straight_line(df: DataFrame, n: int, x1="x1", y1="y1", x2="x2", y2="y2") -> DataFrame:
    """``n`` evenly spaced points, both ends included, as rows ``seq, x, y``."""
    i = F.col("seq")
    return (
        df.withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        .withColumn("x", F.when(i == n - 1, F.col(x2)).otherwise(F.col(x1) + i * ((F.col(x2) - F.col(x1)) / (n - 1))))
        .withColumn("y", F.when(i == n - 1, F.col(y2)).otherwise(F.col(y1) + i * ((F.col(y2) - F.col(y1)) / (n - 1))))
    )


def centre_line(sizes: DataFrame) -> DataFrame:
    """Vertical centre line from two thirds of the height to the bottom row."""
    first = F.floor(F.col("h") * 2 / 3)
    return (
        sizes.withColumn("_y", F.explode(F.sequence(first, F.col("h") - 1)))
        .withColumn("seq", F.col("_y") - first)
        .select(
            "image_id",
            "seq",
            (F.floor(F.col("w") / 2) / F.col("w")).alias("x"),
            (F.col("_y") / F.col("h")).alias("y"),
        )
    )


def pixel_path(points: DataFrame, sizes: DataFrame) -> DataFrame:
    """Normalised ``(x, y)`` to raster columns and rows ``(px, py)``, kept inside."""
    return points.join(sizes.select("image_id", "w", "h"), "image_id").withColumn(
        "px", G.project("x", "w")
    ).withColumn("py", G.project("y", "h"))


def segments(points: DataFrame, cols: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Consecutive pairs: each point with its successor (``next_…``).

    ``seq`` counts without repeats, so a point meets its successor under the key (image, seq): as
    itself and, one number earlier, as the next one. One grouping spreads one endless path over
    all tasks, which a window per image would not, and reads the points once, which a join of the
    points with themselves would not.
    """
    own = F.struct(*[c for c in points.columns if c not in ("image_id", "seq")])
    after = F.struct(*cols)
    no_own, no_after = (F.lit(None).cast(points.select(x.alias("s")).schema["s"].dataType) for x in (own, after))
    seq = points.schema["seq"].dataType
    both = F.array(
        F.struct(F.col("seq").alias("seq"), own.alias("own"), no_after.alias("after")),
        F.struct((F.col("seq") - 1).cast(seq).alias("seq"), no_own.alias("own"), after.alias("after")),
    )
    met = points.select("image_id", F.explode(both).alias("b")).groupBy("image_id", F.col("b.seq").alias("seq")).agg(
        F.first("b.own", ignorenulls=True).alias("own"), F.first("b.after", ignorenulls=True).alias("after")
    )
    pairs = met.filter(F.col("own").isNotNull() & F.col("after").isNotNull())
    kept = [c if c in ("image_id", "seq") else f"own.{c}" for c in points.columns]
    return pairs.select(*kept, *[F.col(f"after.{c}").alias(f"next_{c}") for c in cols])


def densify(points: DataFrame, n: int) -> DataFrame:
    """Insert points until a path has at least ``n``; ``points(image_id, seq, x, y)``.

    One pass hands every segment its share of the missing points. Where no share can grow any
    more, the longest segments are halved, so every pass adds points until ``n`` is reached. A
    path of one point has no segment and stays as it is.
    """
    current = points.select("image_id", "seq", "x", "y")
    while True:
        grown = cut_lineage(densify_pass(current, n))
        count = lambda df, name: df.groupBy("image_id").agg(F.count(F.lit(1)).alias(name))
        sizes = count(current, "a").join(count(grown, "b"), "image_id").filter((F.col("b") < n) & (F.col("b") > 1))
        stalled = cut_lineage(sizes.filter("a = b").select("image_id", (n - F.col("b")).alias("missing")))
        current = cut_lineage(_halve_longest(grown, stalled))
        if sizes.isEmpty():
            return current


def _halve_longest(points: DataFrame, stalled: DataFrame) -> DataFrame:
    """Midpoints in the ``missing`` longest segments of the stalled paths, numbered anew.

    A stalled path has fewer than the wanted points, so ranking its segments is bounded.
    """
    pairs = segments(points.join(stalled.select("image_id"), "image_id", "left_semi")).join(stalled, "image_id")
    step = (F.col("next_x") - F.col("x")) ** 2 + (F.col("next_y") - F.col("y")) ** 2
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(step.desc(), "seq"))
    middle = pairs.withColumn("rank", rank).filter("rank <= missing").select(
        "image_id", (F.col("seq") + 0.5).alias("at"), ((F.col("x") + F.col("next_x")) / 2).alias("x"), ((F.col("y") + F.col("next_y")) / 2).alias("y")
    )
    kept = points.join(stalled, "image_id", "left_anti").select("image_id", F.col("seq").cast("int").alias("seq"), "x", "y")
    split = points.join(stalled.select("image_id"), "image_id", "left_semi").select("image_id", F.col("seq").cast("double").alias("at"), "x", "y").unionByName(middle)
    number = (F.row_number().over(Window.partitionBy("image_id").orderBy("at")) - 1).cast("int")
    return kept.unionByName(split.select("image_id", number.alias("seq"), "x", "y"))


def densify_pass(points: DataFrame, n: int) -> DataFrame:
    """Every step of a path that is too short cut into its share of the missing points."""
    count = points.groupBy("image_id").agg(F.count(F.lit(1)).alias("m"))
    # number of points already placed before each segment: r(i+1) = r(i) + share(i) - 1
    share = lambda r, m, i: F.greatest(F.lit(2), F.ceil((n - r) / (m - i)).cast("int"))
    plan = count.filter((F.col("m") < n) & (F.col("m") > 1)).select(
        "image_id",
        F.posexplode(
            F.aggregate(
                F.sequence(F.lit(0), (F.col("m") - 2).cast("int")),
                F.struct(F.lit(0).alias("r"), F.array().cast("array<struct<r:int,k:int>>").alias("out")),
                lambda acc, i: F.struct(
                    (acc["r"] + share(acc["r"], F.col("m"), i) - 1).cast("int").alias("r"),
                    F.concat(
                        acc["out"],
                        F.array(F.struct(acc["r"].alias("r"), share(acc["r"], F.col("m"), i).alias("k"))),
                    ).alias("out"),
                ),
                lambda acc: acc["out"],
            )
        ).alias("seq", "s"),
    )
    pairs = segments(points).join(plan, ["image_id", "seq"])
    i, k = F.col("i"), F.col("s.k")
    inner = pairs.withColumn("i", F.explode(F.sequence(F.lit(0), k - 2))).select(
        "image_id",
        (F.col("s.r") + i).cast("int").alias("seq"),
        (F.col("x") + i * ((F.col("next_x") - F.col("x")) / k)).alias("x"),
        (F.col("y") + i * ((F.col("next_y") - F.col("y")) / k)).alias("y"),
    )
    ends = plan.groupBy("image_id").agg(
        F.max(F.col("s.r") + F.col("s.k") - 1).cast("int").alias("end"), (F.max("seq") + 1).alias("last")
    )
    tail = (
        points.withColumn("last", F.col("seq"))
        .join(ends, ["image_id", "last"])
        .select("image_id", F.col("end").alias("seq"), "x", "y")
    )
    kept = points.join(plan.select("image_id").distinct(), "image_id", "left_anti").select(
        "image_id", F.col("seq").cast("int").alias("seq"), "x", "y"
    )
    return inner.unionByName(tail).unionByName(kept)


def choose_paths(images: DataFrame, stored: DataFrame, planned: DataFrame, line: DataFrame) -> DataFrame:
    """Stored path, else planned path, else the straight line; ``origin`` says which.

    Each input is ``(image_id, seq, x, y)``.
    """
    taken = stored.select("image_id").distinct()
    rest = images.select("image_id").join(taken, "image_id", "left_anti")
    have_plan = planned.select("image_id").distinct().join(rest, "image_id", "left_semi")
    need_line = rest.join(have_plan, "image_id", "left_anti")
    pick = lambda df, ids, name: df.join(ids, "image_id", "left_semi").select(
        "image_id", "seq", "x", "y", F.lit(name).alias("origin")
    )
    return (
        pick(stored, images.select("image_id"), "stored")
        .unionByName(pick(planned, have_plan, "planned"))
        .unionByName(pick(line, need_line, "line"))
    )


# ---- cheapest paths ------------------------------------------------------------------

def search_ends(goals: DataFrame, margin: int = 1) -> DataFrame:
    """Start and goal cells: ``goals(image_id, h, w, cx, cy)`` → ``sy, sx, gy, gx`` and the raw start."""
    raw_y, raw_x = F.col("h"), G.truncate(F.lit(0.5) * F.col("w"))
    return goals.select(
        "image_id",
        "h",
        "w",
        raw_y.cast("bigint").alias("raw_sy"),
        raw_x.alias("raw_sx"),
        G.within_margin(raw_y, "h", margin).cast("bigint").alias("sy"),
        G.within_margin(raw_x, "w", margin).cast("bigint").alias("sx"),
        G.within_margin(G.truncate(F.col("cy") * F.col("h")), "h", margin).cast("bigint").alias("gy"),
        G.within_margin(G.truncate(F.col("cx") * F.col("w")), "w", margin).cast("bigint").alias("gx"),
    )


def _improve(enter: np.ndarray, depth: np.ndarray | None, dist: np.ndarray, moves) -> np.ndarray:
    """Lower the inner distances until no move improves one; the frame stays as it is."""
    inner = (slice(1, -1), slice(1, -1))
    h, w = dist.shape[0] - 2, dist.shape[1] - 2
    views = [(slice(1 - dy, 1 - dy + h), slice(1 - dx, 1 - dx + w)) for dy, dx in moves]
    rises = [0.0 if depth is None else depth[v] - depth[inner] for v in views]
    steps = [enter[inner] + rise * rise for rise in rises]
    while True:
        before = dist[inner].copy()
        best = before
        for v, step in zip(views, steps):
            best = np.fmin(best, dist[v] + step)
        if not (best < before).any():
            return dist
        dist[inner] = best


_STATE_FIELDS = "y0 bigint, x0 bigint, nh int, nw int, enter binary, depth binary, dist binary"


def _grid(blob: bytes, nh: int, nw: int) -> np.ndarray:
    return np.frombuffer(blob, dtype=np.float64).reshape(nh + 2, nw + 2).copy()


def _rim(nh: int, nw: int) -> np.ndarray:
    edge = np.zeros((nh, nw), dtype=bool)
    edge[0, :] = edge[-1, :] = edge[:, 0] = edge[:, -1] = True
    return edge


class Tiles(NamedTuple):
    """Search result: costs and distances per tile, both partitioned by ``grp`` of ``groups``."""

    costs: DataFrame
    dists: DataFrame
    groups: int


def tile_groups(images: DataFrame, tile: int) -> int:
    """Number of tile groups for ``images(h, w)``."""
    n = images.agg(F.sum(F.ceil(F.col("h") / tile) * F.ceil(F.col("w") / tile))).first()[0]
    return max(1, math.ceil((n or 0) / GROUP_TILES))


def _with_group(df: DataFrame, groups: int) -> DataFrame:
    block = [F.floor(F.col(c) / GROUP_SIDE) for c in ("ty", "tx")]
    return df.withColumn("grp", F.pmod(F.xxhash64("image_id", *block), F.lit(groups)).cast("int"))


def _by_group(df: DataFrame, path: str) -> DataFrame:
    """Write tiles partitioned by their group, one file a group."""
    df.repartition("grp").write.partitionBy("grp").parquet(path)
    rest = [f for f in df.schema.fields if f.name != "grp"]
    return df.sparkSession.read.schema(T.StructType([*rest, T.StructField("grp", T.IntegerType())])).parquet(path)


def _touched(table: DataFrame, keys: DataFrame, groups: int) -> DataFrame:
    """The tiles of ``table`` named by ``keys(image_id, ty, tx, grp)``; other groups are not read.

    The driver learns the group numbers only. ``keys`` is a written table, so that the optimiser
    knows its size: a small one is broadcast and untouched tiles of a group are not shuffled.
    """
    active = [r.grp for r in keys.select("grp").distinct().limit(NAMED_GROUPS + 1).collect()]
    if len(active) <= min(NAMED_GROUPS, groups - 1):
        table = table.filter(F.expr(f"grp in ({', '.join(map(str, sorted(active)))})") if active else F.lit(False))
    return table.join(keys, [*KEYS, "grp"], "left_semi")


def shortest_distances(
    cells: DataFrame,
    starts: DataFrame,
    use_depth_change: bool = False,
    moves: list[tuple[int, int]] = MOVES,
    tile: int = SEARCH_TILE,
    rounds_log: list[dict] | None = None,
) -> Tiles:
    """Tile tables with the distance of every cell from its image's start.

    ``cells(image_id, h, w, y, x, enter_cost[, depth])``: NULL cost means impassable;
    ``starts(image_id, h, w, sy, sx)``. With ``use_depth_change`` a move also costs the
    squared depth difference. ``rounds_log`` receives the groups and the number of tiles of each
    round.
    """
    id_type = cells.schema["image_id"].dataType.simpleString()

    def first_tile(row) -> tuple:
        g = TileGrid(row, tile)
        nh, nw = len(g.rows), len(g.cols)

        def framed(values) -> np.ndarray:
            full = np.pad(g.fill(values), 1, constant_values=np.nan)
            return full[g.core[0].start : g.core[0].stop + 2, g.core[1].start : g.core[1].stop + 2].copy()

        enter = framed(row.enter_cost)
        depth = framed(row.depth) if use_depth_change else None
        dist = np.full(enter.shape, np.inf)
        y0, x0 = int(g.rows[0]), int(g.cols[0])
        sy, sx = int(row.sy) - y0 + 1, int(row.sx) - x0 + 1
        here = 1 <= sy <= nh and 1 <= sx <= nw
        if here:
            dist[sy, sx] = 0.0
            dist = _improve(enter, depth, dist, moves)
        blobs = (enter.tobytes(), depth.tobytes() if depth is not None else None, dist.tobytes())
        return (row.image_id, row.ty, row.tx, row.h, row.w, y0, x0, nh, nw, *blobs, here)

    names = ["image_id", "ty", "tx", "h", "w", "y0", "x0", "nh", "nw", "enter", "depth", "dist", "changed"]

    def first_pass(batches):
        for pdf in batches:
            yield pd.DataFrame([first_tile(row) for row in pdf.itertuples(index=False)], columns=names)

    head = f"image_id {id_type}, ty int, tx int, h bigint, w bigint, {_STATE_FIELDS}"
    keep = ["image_id", "h", "w", "y", "x", "enter_cost", *(["depth"] if use_depth_change else [])]
    spark, groups = cells.sparkSession, tile_groups(starts, tile)
    placed = attach(cells.select(*keep), starts.select("image_id", "h", "w", "sy", "sx"))
    values = ("enter_cost", "depth") if use_depth_change else ("enter_cost",)
    packed = pack_tiles(placed, 1, tile, values, keep=("sy", "sx")).mapInPandas(first_pass, head + ", changed boolean")
    state = _by_group(_with_group(packed, groups), scratch_path(spark, "tiles"))

    def send(rows):
        """Rim cells of changed tiles, once per neighbour tile that frames them."""
        for pdf in rows:
            out = []
            for r in pdf.itertuples(index=False):
                inner = _grid(r.dist, r.nh, r.nw)[1:-1, 1:-1]
                y, x = np.nonzero(_rim(r.nh, r.nw) & np.isfinite(inner))
                gy, gx, d = y + r.y0, x + r.x0, inner[y, x]
                parts = []
                for dy, dx in ((u, v) for u in (-1, 0, 1) for v in (-1, 0, 1)):
                    ny, nx = gy + dy, gx + dx
                    fits = (ny >= 0) & (ny < r.h) & (nx >= 0) & (nx < r.w)
                    fits &= (ny // tile != r.ty) | (nx // tile != r.tx)
                    parts.append(np.stack([ny // tile, nx // tile, gy, gx, np.arange(len(gy))], axis=1)[fits])
                ty, tx, y, x, i = np.unique(np.concatenate(parts), axis=0).T
                out.append(pd.DataFrame({"image_id": r.image_id, "ty": ty, "tx": tx, "y": y, "x": x, "d": d[i]}))
            yield pd.concat(out, ignore_index=True) if out else pd.DataFrame({k: [] for k in ("image_id", "ty", "tx", "y", "x", "d")})

    def receive(rows):
        """Tiles with their mail: the new distances, whether any fell, and whether one on the rim did."""
        for pdf in rows:
            dists, better, flags = [], [], []
            for r in pdf.itertuples(index=False):
                dist = _grid(r.dist, r.nh, r.nw)
                y, x, d = (np.array([m[k] for m in r.inbox]) for k in ("y", "x", "d"))
                before = dist.copy()
                np.minimum.at(dist, (y - r.y0 + 1, x - r.x0 + 1), d)
                moved = bool((dist < before).any())
                changed = False
                if moved:
                    old = dist[1:-1, 1:-1].copy()
                    depth = _grid(r.depth, r.nh, r.nw) if use_depth_change else None
                    dist = _improve(_grid(r.enter, r.nh, r.nw), depth, dist, moves)
                    changed = bool((dist[1:-1, 1:-1] < old)[_rim(r.nh, r.nw)].any())
                dists.append(dist.tobytes())
                better.append(moved)
                flags.append(changed)
            yield pdf.drop(columns=["inbox", "enter", "depth"]).assign(dist=dists, better=better, changed=flags)

    several = (F.col("h") > tile) | (F.col("w") > tile)
    geometry = [*KEYS, "h", "w", "y0", "x0", "nh", "nw", "grp"]
    versions = state.select(*geometry, "dist").withColumn("round", F.lit(0))
    moving = state.filter(F.col("changed") & several).select(*geometry, "dist")
    log, last, done = scratch_path(spark, "distances"), F.max_by("dist", "round").alias("dist"), []
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in moving.schema.fields[:-1])
    while not moving.isEmpty():
        inbox = F.collect_list(F.struct("y", "x", "d")).alias("inbox")  # at most the rims around one tile
        sent = moving.mapInPandas(send, f"image_id {id_type}, ty int, tx int, y bigint, x bigint, d double")
        mail = settle(_with_group(sent.groupBy(*KEYS).agg(inbox), groups), "mail")
        keys = settle(mail.select(*KEYS, "grp"), "mail-keys")
        now = _touched(versions, keys, groups).groupBy(*geometry).agg(last)
        tiles = mail.drop("grp").join(now, KEYS).join(_touched(state.select(*KEYS, "grp", "enter", "depth"), keys, groups).drop("grp"), KEYS)
        got = settle(tiles.select(*geometry, "enter", "depth", "dist", "inbox").mapInPandas(receive, f"{kind}, dist binary, better boolean, changed boolean"), "round")
        if rounds_log is not None:
            rounds_log.append({"groups": sorted(r.grp for r in keys.select("grp").distinct().collect()), "tiles": got.count()})
        newer = _by_group(got.filter("better").select(*geometry, "dist"), f"{log}/round={len(done) + 1}")
        versions = state.select(*geometry, "dist").withColumn("round", F.lit(0)).unionByName(
            spark.read.schema(T.StructType([*newer.schema.fields, T.StructField("round", T.IntegerType())])).parquet(log)
        )
        moving = got.filter("changed").select(*geometry, "dist")
        done.append((mail, keys, got))
        if len(done) > 1:  # the tiles of the round before are read no more
            for table in done[-2]:
                discard(table)
    costs = state.select(*geometry, "enter", "depth")
    if not done:
        return Tiles(costs, state.select(*geometry, "dist"), groups)
    settled = _by_group(versions.groupBy(*geometry).agg(last), scratch_path(spark, "settled"))
    for table in (*done[-1], newer):
        discard(table)
    return Tiles(costs, settled, groups)


def cell_distances(state: Tiles) -> DataFrame:
    """Long form ``(image_id, y, x, dist)``; unreachable cells are left out."""
    id_type = state.dists.schema["image_id"].dataType.simpleString()

    def unpack(rows):
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                inner = _grid(r.dist, r.nh, r.nw)[1:-1, 1:-1]
                yy, xx = np.nonzero(np.isfinite(inner))
                yield pd.DataFrame(
                    {"image_id": r.image_id, "y": yy + r.y0, "x": xx + r.x0, "dist": inner[yy, xx]}
                )

    return state.dists.select("image_id", "y0", "x0", "nh", "nw", "dist").mapInPandas(
        unpack, f"image_id {id_type}, y bigint, x bigint, dist double"
    )


def trace_back(
    state: Tiles,
    ends: DataFrame,
    use_depth_change: bool = False,
    towards_goal: bool = False,
    moves: list[tuple[int, int]] = MOVES,
    tile: int = SEARCH_TILE,
) -> DataFrame:
    """Walk from each goal to its start, tile by tile: ``(image_id, back, y, x, cost, lost)``.

    ``back`` counts from the goal. Among equally cheap predecessors the first move in the
    fixed order wins, or with ``towards_goal`` the one whose move points best at the goal. A walk
    that finds no predecessor ends in a row with ``lost``; other images go on. A leg reads the
    tile groups its walks stand in.
    """
    id_type = state.costs.schema["image_id"].dataType.simpleString()
    cell_at = F.floor(F.col("y") / tile).cast("int"), F.floor(F.col("x") / tile).cast("int")

    def walk(rows):
        for pdf in rows:
            out = {k: [] for k in ("image_id", "back", "y", "x", "cost", "live", "gy", "gx", "lost")}
            for r in pdf.itertuples(index=False):
                dist, enter = _grid(r.dist, r.nh, r.nw), _grid(r.enter, r.nh, r.nw)
                depth = _grid(r.depth, r.nh, r.nw) if use_depth_change else None
                y, x, back = int(r.y - r.y0 + 1), int(r.x - r.x0 + 1), int(r.back)
                if not np.isfinite(dist[y, x]):
                    continue
                while True:
                    inside = 1 <= y <= r.nh and 1 <= x <= r.nw
                    stop = not inside or dist[y, x] == 0.0
                    values = (r.image_id, back, y + r.y0 - 1, x + r.x0 - 1, dist[y, x], not inside, r.gy, r.gx, False)
                    for k, v in zip(out, values):
                        out[k].append(v)
                    if stop:
                        break
                    order = moves
                    if towards_goal:
                        vy, vx = r.gy - (y + r.y0 - 1), r.gx - (x + r.x0 - 1)
                        order = sorted(moves, key=lambda m: -(vy * m[0] + vx * m[1]))
                    for dy, dx in order:
                        step = enter[y, x]
                        if depth is not None:
                            rise = depth[y - dy, x - dx] - depth[y, x]
                            step = step + rise * rise
                        if dist[y - dy, x - dx] + step == dist[y, x]:
                            y, x = y - dy, x - dx
                            break
                    else:
                        out["lost"][-1] = True
                        break
                    back += 1
            yield pd.DataFrame(out)

    schema = (
        f"image_id {id_type}, back bigint, y bigint, x bigint, cost double, live boolean, gy bigint, gx bigint, lost boolean"
    )
    tokens = ends.select(
        "image_id", F.lit(0).cast("bigint").alias("back"), F.col("gy").alias("y"), F.col("gx").alias("x"), "gy", "gx"
    )
    walked = None
    while True:
        here = _with_group(tokens.withColumn("ty", cell_at[0]).withColumn("tx", cell_at[1]), state.groups)
        keys = settle(here.select(*KEYS, "grp").distinct(), "walk-keys")
        near = [_touched(t.drop("h", "w"), keys, state.groups).drop("grp") for t in (state.costs, state.dists.select(*KEYS, "grp", "dist"))]
        leg = cut_lineage(here.drop("grp").join(near[0], KEYS).join(near[1], KEYS).mapInPandas(walk, schema))
        discard(keys)
        done = leg.filter(~F.col("live"))
        walked = done if walked is None else walked.unionByName(done)
        tokens = leg.filter("live").select("image_id", "back", "y", "x", "gy", "gx")
        if tokens.isEmpty():
            return walked.select("image_id", "back", "y", "x", "cost", "lost")


def plan_paths(
    cells: DataFrame,
    ends: DataFrame,
    use_depth_change: bool = False,
    towards_goal: bool = False,
    keep_raw_start: bool = True,
    tile: int = SEARCH_TILE,
) -> tuple[DataFrame, DataFrame]:
    """``(results, points)``: one result row per image, and the cells of each found path.

    An image whose walk is lost has a result row that says so and no points. ``ends`` comes from ``search_ends`` (or has ``sy, sx, gy, gx``). With ``keep_raw_start``
    the start before clamping comes first, so its ``ny`` can be 1.0.
    """
    state = shortest_distances(cells, ends, use_depth_change, tile=tile)
    return path_results(trace_back(state, ends, use_depth_change, towards_goal, tile=tile), ends, keep_raw_start)


def path_results(back: DataFrame, ends: DataFrame, keep_raw_start: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(results, points)`` of walked paths; see ``plan_paths``."""
    lost = back.filter("lost").select("image_id")
    goal = back.filter("back = 0").select("image_id", "cost").join(lost.withColumn("_lost", F.lit(True)), "image_id", "left")
    found = F.col("cost").isNotNull() & F.col("_lost").isNull()
    results = ends.join(goal, "image_id", "left").select(
        "image_id",
        found.alias("res"),
        F.when(found, FOUND).when(F.col("_lost"), UNSETTLED).otherwise(UNREACHABLE).alias("reason"),
        F.when(found, F.col("cost")).alias("cost"),
    )
    back = back.join(lost, "image_id", "left_anti")
    length = back.groupBy("image_id").agg(F.max("back").alias("n"))
    shift = 1 if keep_raw_start else 0
    points = (
        back.join(length, "image_id")
        .join(ends.select("image_id", "h", "w"), "image_id")
        .select("image_id", (F.col("n") - F.col("back") + shift).alias("seq"), "y", "x", "h", "w")
    )
    if keep_raw_start:
        raw = ends.join(length, "image_id", "left_semi").select(
            "image_id",
            F.lit(0).cast("bigint").alias("seq"),
            F.col("raw_sy").alias("y"),
            F.col("raw_sx").alias("x"),
            "h",
            "w",
        )
        points = raw.unionByName(points)
    points = points.select(
        "image_id", "seq", "y", "x", (F.col("x") / F.col("w")).alias("nx"), (F.col("y") / F.col("h")).alias("ny")
    )
    return results, points


# Settings of the depth planner (m², m).
PLANNER_THRESHOLD = 1.0
PLANNER_DEPTH_LIMIT = 10.0


def plan_depth_paths(
    raster: DataFrame, goals: DataFrame, per_metre: float = 1.0, samples: int | None = None, seed: int = 17
) -> tuple[DataFrame, DataFrame]:
    """From the bottom centre to the goal of each raster; ``goals(image_id, h, w, cx, cy)``.

    Adaptive disc costs, whole discs by default (``samples`` draws cells instead), and the
    exact cheapest path under them.
    """
    costs = change_cost(
        raster, adaptive_radius=True, threshold=PLANNER_THRESHOLD, depth_limit=PLANNER_DEPTH_LIMIT,
        samples=samples, per_metre=per_metre, seed=seed,
    )
    return plan_paths(cell_cost(costs, per_metre), search_ends(goals), towards_goal=True)


PLANNERS: dict[str, Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]] = {"depth_lpp": plan_depth_paths}


def register_planner(name: str, fn: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]) -> None:
    """A planner maps ``(raster, goals)`` to ``(results, points)``."""
    PLANNERS[name] = fn


def smoothed_bounds(bounds: DataFrame, width: int = 5) -> DataFrame:
    """Moving sum over neighbouring path points divided by ``width`` even at the ends, truncated.

    ``bounds(image_id, seq, left_x, right_x)``. Neighbours come from an exploded equi-join, not
    from a window per image.
    """
    half = width // 2
    near = bounds.withColumn("_d", F.explode(F.sequence(F.lit(-half), F.lit(half)))).select(
        "image_id", (F.col("seq") + F.col("_d")).alias("seq"), "left_x", "right_x"
    )
    sums = near.groupBy("image_id", "seq").agg(F.sum("left_x").alias("l"), F.sum("right_x").alias("r"))
    return bounds.select("image_id", "seq").join(sums, ["image_id", "seq"]).select(
        "image_id",
        "seq",
        G.truncate(F.col("l") / width).alias("left_x"),
        G.truncate(F.col("r") / width).alias("right_x"),
    )
