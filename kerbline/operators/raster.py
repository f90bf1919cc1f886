"""Depth rasters in long form: ``raster(image_id, h, w, y, x, depth)``.

Every pixel row carries the raster size, so bounds need no join. Per-image facts reach the
pixels through ``attach``, which joins on (image, tile): one huge image is spread over its
tiles. Neighbourhood costs are computed per tile with a halo, so a task never holds more
than one tile and pixels are not multiplied by the size of the disc.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import scale

TILE = 64

# The eight moves, in the order that breaks ties.
MOVES = [(0, 1), (1, 0), (0, -1), (-1, 0), (1, 1), (-1, -1), (1, -1), (-1, 1)]


def tile_of(c: str, tile: int = TILE) -> Column:
    return F.floor(F.col(c) / tile).cast("int")


def attach(raster: DataFrame, facts: DataFrame, tile: int = TILE) -> DataFrame:
    """Join per-image ``facts(image_id, h, w, …)`` to pixels on (image, tile)."""
    last = lambda c: F.floor((F.col(c) - 1) / tile).cast("int")
    spread = (
        facts.withColumn("_ty", F.explode(F.sequence(F.lit(0), last("h"))))
        .withColumn("_tx", F.explode(F.sequence(F.lit(0), last("w"))))
        .drop("h", "w")
    )
    return (
        raster.withColumn("_ty", tile_of("y", tile))
        .withColumn("_tx", tile_of("x", tile))
        .join(spread, ["image_id", "_ty", "_tx"])
        .drop("_ty", "_tx")
    )


def patch_mean(raster: DataFrame, crop: int) -> DataFrame:
    """Mean depth of a patch around the bottom centre, last row excluded."""
    centre = F.floor(F.col("w") / 2)
    half = crop // 2
    inside = (
        (F.col("x") >= F.greatest(centre - half, F.lit(0)))
        & (F.col("x") < F.least(centre + half + 1, F.col("w")))
        & (F.col("y") >= F.greatest(F.col("h") - 1 - 2 * crop, F.lit(0)))
        & (F.col("y") < F.col("h") - 1)
    )
    return (
        raster.filter(inside)
        .groupBy("image_id", "h", "w")
        .agg((F.sum("depth") / F.count("depth")).alias("base"))
    )


def _with_base(raster: DataFrame, pixels: DataFrame, crop: int, zero_base: bool) -> DataFrame:
    if zero_base:
        return pixels.withColumn("base", F.lit(0.0))
    return attach(pixels, patch_mean(raster, crop))


def front_point(raster: DataFrame, difference: float, crop: int = 10, zero_base: bool = True) -> DataFrame:
    """Lowest pixel of the centre column whose depth differs enough from the base."""
    column = raster.filter(F.col("x") == F.floor(F.col("w") / 2))
    hit = _with_base(raster, column, crop, zero_base).filter(
        F.abs(F.col("depth") - F.col("base")) >= difference
    )
    best = hit.groupBy("image_id", "h", "w").agg(F.max("y").alias("y"))
    return best.select(
        "image_id",
        "y",
        F.floor(F.col("w") / 2).alias("x"),
        (F.floor(F.col("w") / 2) / F.col("w")).alias("cx"),
        (F.col("y") / F.col("h")).alias("cy"),
    )


def bearing(seed: int, max_degree: float) -> Column:
    """Seeded angle in ±max_degree, in radians."""
    u = F.conv(F.substring(scale.seeded_hash(seed, "image_id"), 1, 8), 16, 10).cast("double") / float(2**32)
    return F.radians(F.lit(-max_degree) + u * (2.0 * max_degree))


def front_point_bearing(
    raster: DataFrame,
    images: DataFrame,
    difference: float,
    max_degree: float,
    crop: int = 10,
    zero_base: bool = True,
    seed: int = 17,
) -> DataFrame:
    """First pixel along a seeded ray from the bottom centre; ``images(image_id, h, w)``."""
    steps = (
        images.withColumn("_a", bearing(seed, max_degree))
        .withColumn("step", F.explode(F.sequence(F.lit(0), (F.col("h") + F.col("w")).cast("int"))))
        .withColumn("rx", F.floor(F.col("w") / 2) + F.col("step") * F.sin("_a"))
        .withColumn("ry", (F.col("h") - 1) - F.col("step") * F.cos("_a"))
        .filter((F.col("rx") >= 0) & (F.col("rx") < F.col("w")) & (F.col("ry") >= 0) & (F.col("ry") < F.col("h")))
        .select(
            "image_id",
            "step",
            "rx",
            "ry",
            F.col("rx").cast("bigint").alias("x"),
            F.col("ry").cast("bigint").alias("y"),
        )
    )
    pixels = raster.join(steps, ["image_id", "y", "x"])
    hit = _with_base(raster, pixels, crop, zero_base).filter(
        F.abs(F.col("depth") - F.col("base")) >= difference
    )
    best = hit.groupBy("image_id", "h", "w").agg(
        F.min_by(F.struct("step", "y", "x", "rx", "ry"), F.col("step")).alias("p")
    )
    return best.select(
        "image_id",
        "p.step",
        "p.y",
        "p.x",
        (F.col("p.rx") / F.col("w")).alias("cx"),
        (F.col("p.ry") / F.col("h")).alias("cy"),
    )


def depth_mask(
    raster: DataFrame, points: DataFrame, radius: int, buffer: float, always_nearer: bool = False
) -> DataFrame:
    """Add ``in_depth``: nearer than the deepest pixel around the point plus the buffer.

    ``points(image_id, h, w, py, px)``. A buffer of zero or less keeps the farther side
    instead, unless ``always_nearer``.
    """
    lo_y, hi_y = F.greatest(F.col("py") - radius, F.lit(0)), F.least(F.col("py") + radius, F.col("h"))
    lo_x, hi_x = F.greatest(F.col("px") - radius, F.lit(0)), F.least(F.col("px") + radius, F.col("w"))
    roi = (F.col("y") >= lo_y) & (F.col("y") < hi_y) & (F.col("x") >= lo_x) & (F.col("x") < hi_x)
    ref = (
        attach(raster, points)
        .filter(roi)
        .groupBy("image_id", "h", "w")
        .agg((F.max("depth") + buffer).alias("ref_depth"))
    )
    nearer = always_nearer or buffer > 0
    test = F.col("depth") < F.col("ref_depth") if nearer else F.col("depth") > F.col("ref_depth")
    return attach(raster, ref).withColumn("in_depth", test)


def squared_change(a: Column, b: Column) -> Column:
    return (a - b) * (a - b)


# ---- neighbourhood costs -------------------------------------------------------------

def with_halo(raster: DataFrame, halo: int, tile: int) -> DataFrame:
    """Each pixel once per tile that needs it: its own and those whose halo it lies in."""
    lo = lambda c: F.floor(F.greatest(F.col(c) - halo, F.lit(0)) / tile).cast("int")
    hi = lambda c, s: F.floor(F.least(F.col(c) + halo, F.col(s) - 1) / tile).cast("int")
    return raster.withColumn("ty", F.explode(F.sequence(lo("y"), hi("y", "h")))).withColumn(
        "tx", F.explode(F.sequence(lo("x"), hi("x", "w")))
    )


def pack_tiles(
    raster: DataFrame, halo: int, tile: int, values: tuple[str, ...] = ("depth",), keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per tile: ``image_id, ty, tx, h, w, ys, xs`` and an array per value column.

    A row is bounded by the tile and its halo. NULL values become NaN. ``keep`` are columns
    that are constant per image.
    """
    keys = ["image_id", "ty", "tx"]
    parts = int(raster.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = [F.collect_list(F.coalesce(F.col(v).cast("double"), F.lit(float("nan")))).alias(v) for v in values]
    return (
        with_halo(raster, halo, tile)
        .repartition(parts, *keys)
        .groupBy(*keys)
        .agg(
            *[F.first(c).alias(c) for c in ("h", "w", *keep)],
            F.collect_list(F.col("y").cast("int")).alias("ys"),
            F.collect_list(F.col("x").cast("int")).alias("xs"),
            *lists,
        )
    )


class TileGrid:
    """A packed tile as arrays: NaN where there is no pixel, ``core`` for its own cells."""

    def __init__(self, row, tile: int):
        self.ys, self.xs = np.asarray(row.ys), np.asarray(row.xs)
        self.oy, self.ox = int(self.ys.min()), int(self.xs.min())
        self.shape = (int(self.ys.max()) - self.oy + 1, int(self.xs.max()) - self.ox + 1)
        y0, x0 = int(row.ty) * tile, int(row.tx) * tile
        self.core = (
            slice(max(y0 - self.oy, 0), min(y0 + tile - self.oy, self.shape[0])),
            slice(max(x0 - self.ox, 0), min(x0 + tile - self.ox, self.shape[1])),
        )
        self.rows = np.arange(self.core[0].start, self.core[0].stop) + self.oy
        self.cols = np.arange(self.core[1].start, self.core[1].stop) + self.ox

    def fill(self, values) -> np.ndarray:
        grid = np.full(self.shape, np.nan)
        grid[self.ys - self.oy, self.xs - self.ox] = values
        return grid

    def table(self, row, here: np.ndarray, **columns: np.ndarray) -> pd.DataFrame:
        """Core pixels in long form with more columns of the same shape."""
        yy, xx = np.nonzero(~np.isnan(here))
        out = {"image_id": row.image_id, "h": row.h, "w": row.w, "y": self.rows[yy], "x": self.cols[xx]}
        return pd.DataFrame(out | {"depth": here[yy, xx]} | {k: v[yy, xx] for k, v in columns.items()})


def _draws(key: int, ys: np.ndarray, xs: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Seeded integer per cell and draw; plain modular arithmetic, the same in any engine."""
    m = 2147483647
    v = (key % m * 7919 + ys * 104729 + xs * 1299709 + k * 15485863 + seed * 32452843) % m
    for _ in range(3):
        v = (v * 48271 + 11) % m
    return v


def change_cost(
    raster: DataFrame,
    radius: int = 5,
    adaptive_radius: bool = False,
    threshold: float | None = None,
    depth_limit: float | None = None,
    adaptive_threshold: float | None = None,
    samples: int | None = None,
    per_metre: float = 1.0,
    seed: int = 17,
    tile: int = TILE,
) -> DataFrame:
    """Mean squared depth change around each cell, as ``total, n`` and ``blocked``.

    Whole disc by default; ``samples`` draws that many disc cells with a seed instead.
    ``adaptive_radius``: 5 cells near, 1 cell from 20 m on. ``threshold`` (m²) blocks a cell
    with a larger change, only where either depth is below ``depth_limit`` if that is given.
    ``adaptive_threshold`` grows the limit with depth. ``per_metre``: raster units per metre.
    """
    reach = 5 if adaptive_radius else radius
    offsets = [
        (dy, dx)
        for dy in range(-reach, reach + 1)
        for dx in range(-reach, reach + 1)
        if dy * dy + dx * dx <= reach * reach
    ]
    unit2 = per_metre * per_metre
    limit = float("inf") if depth_limit is None else depth_limit * per_metre

    def tile_costs(row) -> pd.DataFrame:
        g = TileGrid(row, tile)
        grid, core = g.fill(row.depth), g.core
        here = grid[core]
        ring = np.pad(grid, reach, constant_values=np.nan)
        radii = np.full(here.shape, reach, dtype=float)
        if adaptive_radius:
            radii = np.maximum(1, np.trunc(5 - (5 - 1) / 20 * (here / per_metre)))
        cap = np.full(here.shape, np.inf)
        if threshold is not None:
            cap[:] = threshold * unit2
        if adaptive_threshold is not None:
            cap = (adaptive_threshold + adaptive_threshold / 10.0 * (here / per_metre)) * unit2
        limited = np.isfinite(cap).any()

        def change(dy: int, dx: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            top, left = core[0].start + reach + dy, core[1].start + reach + dx
            there = ring[top : top + here.shape[0], left : left + here.shape[1]]
            ok = ~np.isnan(there) & (dy * dy + dx * dx <= radii * radii)
            rise = np.where(ok, here - there, 0.0)
            delta = rise * rise
            over = ok & (delta > cap) & ((here < limit) | (there < limit)) if limited else np.zeros_like(ok)
            return ok, delta, over

        total = np.zeros(here.shape)
        n = np.zeros(here.shape, dtype=np.int64)
        blocked = np.zeros(here.shape, dtype=bool)
        if samples is None:
            for dy, dx in offsets:
                ok, delta, over = change(dy, dx)
                total += delta
                n += ok
                blocked |= over
        else:
            layers = [change(dy, dx) for dy, dx in offsets]
            ok, delta, over = (np.stack(part) for part in zip(*layers))
            rank = np.cumsum(ok, axis=0)
            for k in range(samples):
                pick = _draws(int(row.key), g.rows[:, None], g.cols[None, :], k, seed) % rank[-1]
                chosen = ok & (rank == pick + 1)
                total += (delta * chosen).sum(axis=0)
                blocked |= (over & chosen).any(axis=0)
            n[:] = samples
        return g.table(row, here, total=total, n=n, blocked=blocked)

    def costs(batches):
        for pdf in batches:
            yield pd.concat([tile_costs(row) for row in pdf.itertuples(index=False)])

    id_type = raster.schema["image_id"].dataType
    key = F.col("image_id").cast("bigint") if isinstance(id_type, T.IntegralType) else F.crc32("image_id")
    schema = (
        f"image_id {id_type.simpleString()}, h bigint, w bigint, y bigint, x bigint, depth double, "
        "total double, n bigint, blocked boolean"
    )
    return pack_tiles(raster.withColumn("key", key), reach, tile, keep=("key",)).mapInPandas(costs, schema)


def cell_cost(costs: DataFrame, per_metre: float = 1.0) -> DataFrame:
    """``enter_cost``: one step plus the mean change in m²; NULL where the cell is blocked."""
    mean = F.col("total") / F.col("n") / (per_metre * per_metre)
    return costs.withColumn("enter_cost", F.when(~F.col("blocked"), F.lit(1.0) + mean))


def move_costs(raster: DataFrame) -> DataFrame:
    """All moves between neighbouring cells with their squared depth change.

    For inspection and small rasters: it writes eight rows per cell. The path search computes
    the same values inside its tiles.
    """
    moves = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in MOVES])
    out = (
        raster.withColumn("m", F.explode(moves))
        .select(
            "image_id", "y", "x", "h", "w", "depth",
            (F.col("y") + F.col("m.dy")).alias("ny"),
            (F.col("x") + F.col("m.dx")).alias("nx"),
        )
        .filter("ny >= 0 and ny < h and nx >= 0 and nx < w")
    )
    there = raster.select("image_id", F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("depth").alias("next_depth"))
    return out.join(there, ["image_id", "ny", "nx"]).select(
        "image_id", "y", "x", "ny", "nx", squared_change(F.col("depth"), F.col("next_depth")).alias("change2")
    )


def neighbour_moves(raster: DataFrame, goals: DataFrame) -> DataFrame:
    """The moves out of each cell, best aligned with the goal first (``rank`` 0…).

    ``goals(image_id, h, w, gy, gx)``. Ranking eight moves happens inside the row.
    """
    near = attach(raster, goals).withColumns({"_vy": F.col("gy") - F.col("y"), "_vx": F.col("gx") - F.col("x")})
    vy, vx, norm = F.col("_vy"), F.col("_vx"), F.col("_norm")
    near = near.withColumn("_norm", F.sqrt((vy * vy + vx * vx).cast("double")))
    near = near.withColumns(
        {"_uy": F.when(norm > 0, vy / norm).otherwise(0.0), "_ux": F.when(norm > 0, vx / norm).otherwise(0.0)}
    )
    uy, ux = F.col("_uy"), F.col("_ux")
    moves = F.array(
        *[
            F.struct(
                (-(uy * dy + ux * dx)).alias("neg_dot"),
                F.lit(i).alias("pos"),
                F.lit(dy).alias("dy"),
                F.lit(dx).alias("dx"),
            )
            for i, (dy, dx) in enumerate(MOVES)
        ]
    )
    return (
        near.select("image_id", "h", "w", "y", "x", F.posexplode(F.array_sort(moves)).alias("rank", "m"))
        .withColumn("ny", F.col("y") + F.col("m.dy"))
        .withColumn("nx", F.col("x") + F.col("m.dx"))
        .filter(
            (F.col("ny") >= 0) & (F.col("ny") < F.col("h")) & (F.col("nx") >= 0) & (F.col("nx") < F.col("w"))
        )
        .drop("m")
    )


def depth_summary(raster: DataFrame, accuracy: int = 10_000) -> DataFrame:
    q = F.percentile_approx("depth", [0.25, 0.5, 0.75], accuracy)
    return (
        raster.groupBy("image_id")
        .agg(
            F.min("depth").alias("min_depth"),
            F.max("depth").alias("max_depth"),
            (F.sum("depth") / F.count("depth")).alias("mean_depth"),
            q.alias("_q"),
        )
        .select(
            "image_id",
            "min_depth",
            "max_depth",
            "mean_depth",
            F.col("_q")[0].alias("p25"),
            F.col("_q")[1].alias("p50"),
            F.col("_q")[2].alias("p75"),
        )
    )


# The small smoothing kernels used when no sigma is given.
SMALL_KERNELS = {
    1: [1.0],
    3: [0.25, 0.5, 0.25],
    5: [0.0625, 0.25, 0.375, 0.25, 0.0625],
    7: [0.03125, 0.109375, 0.21875, 0.28125, 0.21875, 0.109375, 0.03125],
}


def blur_kernel(strength: int) -> list[float]:
    """One-dimensional Gaussian weights; an even strength is raised to the next odd one."""
    size = strength + 1 if strength % 2 == 0 else strength
    if size in SMALL_KERNELS:
        return SMALL_KERNELS[size]
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    raw = np.exp(-((np.arange(size) - (size - 1) / 2) ** 2) / (2 * sigma * sigma))
    return (raw / raw.sum()).tolist()


def blurred(raster: DataFrame, kernel: list[float], tile: int = TILE) -> DataFrame:
    """Add ``blurred``: kernel over rows and columns, edges mirrored without the edge pixel."""
    weights = np.asarray(kernel, dtype=float)
    if len(weights) % 2 == 0:
        raise ValueError("the kernel needs an odd length")
    reach = len(weights) // 2

    def tile_blur(row) -> pd.DataFrame:
        g = TileGrid(row, tile)
        grid = g.fill(row.depth)

        def lines(at: np.ndarray, origin: int, size: int) -> list[np.ndarray]:
            period = max(2 * (size - 1), 1)
            out = []
            for d in range(-reach, reach + 1):
                i = np.abs(at + d) % period
                out.append(np.where(i >= size, period - i, i) - origin)
            return out

        rows, cols = lines(g.rows, g.oy, int(row.h)), lines(g.cols, g.ox, int(row.w))
        across = sum(k * grid[:, c] for k, c in zip(weights, cols))
        return g.table(row, grid[g.core], blurred=sum(k * across[r, :] for k, r in zip(weights, rows)))

    def blur(batches):
        for pdf in batches:
            yield pd.concat([tile_blur(row) for row in pdf.itertuples(index=False)])

    kind = raster.schema["image_id"].dataType.simpleString()
    schema = f"image_id {kind}, h bigint, w bigint, y bigint, x bigint, depth double, blurred double"
    return pack_tiles(raster, reach, tile).mapInPandas(blur, schema)


def blur_inside(raster: DataFrame, mask: DataFrame, strength: int = 15, tile: int = TILE) -> DataFrame:
    """Blurred values inside ``mask(image_id, y, x)``, raw values elsewhere (``value``)."""
    soft = blurred(raster, blur_kernel(strength), tile)
    marked = mask.select("image_id", "y", "x").distinct().withColumn("_in", F.lit(True))
    return soft.join(marked, ["image_id", "y", "x"], "left").select(
        "image_id",
        "y",
        "x",
        F.col("_in").isNotNull().alias("masked"),
        F.when(F.col("_in").isNotNull(), F.col("blurred")).otherwise(F.col("depth")).alias("value"),
    )
