"""Image-size jobs: tile manifests, padding, crop grids, expected image tokens.

Input ``sizes(image_id, w, h)``. Only geometry: pixels stay with the model runtime.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G


def with_best_resolution(sizes: DataFrame, candidates: list[tuple[int, int]]) -> DataFrame:
    best = G.best_resolution("w", "h", candidates)
    return (
        sizes.withColumn("_b", best)
        .withColumn("best_w", F.col("_b.w"))
        .withColumn("best_h", F.col("_b.h"))
        .drop("_b")
    )


def patch_boxes(df: DataFrame, patch: int, w="w", h="h") -> DataFrame:
    """Row-major tiles; the last ones may reach over the edge."""
    cols = F.floor((F.col(w) + patch - 1) / patch)
    rows = F.floor((F.col(h) + patch - 1) / patch)
    return (
        df.withColumn("_n", cols)
        .withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), rows - 1)))
        .withColumn("_j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
        .withColumn("patch_no", F.col("_i") * F.col("_n") + F.col("_j"))
        .withColumn("x1", F.col("_j") * patch)
        .withColumn("y1", F.col("_i") * patch)
        .withColumn("x2", F.col("x1") + patch)
        .withColumn("y2", F.col("y1") + patch)
        .drop("_n", "_i", "_j")
    )


def grid_shape(sizes: DataFrame, candidates: list[tuple[int, int]], patch: int) -> DataFrame:
    best = with_best_resolution(sizes, candidates)
    return best.withColumn("grid_w", F.floor(F.col("best_w") / patch)).withColumn(
        "grid_h", F.floor(F.col("best_h") / patch)
    )


def tile_manifest(sizes: DataFrame, candidates: list[tuple[int, int]], patch: int) -> DataFrame:
    """Thumbnail (tile 0, the whole image) and the tiles of the padded best resolution."""
    best = with_best_resolution(sizes, candidates)
    for name, col in G.padded_resize("w", "h", "best_w", "best_h").items():
        best = best.withColumn(name, col)
    tiles = patch_boxes(best, patch, "best_w", "best_h").withColumn("tile", F.col("patch_no") + 1)
    thumb = (
        best.withColumn("tile", F.lit(0).cast("bigint"))
        .withColumn("x1", F.lit(0).cast("bigint"))
        .withColumn("y1", F.lit(0).cast("bigint"))
        .withColumn("x2", F.col("w").cast("bigint"))
        .withColumn("y2", F.col("h").cast("bigint"))
    )
    return tiles.drop("patch_no").unionByName(thumb)


def processed_sizes(sizes: DataFrame, mode: str, candidates: list[tuple[int, int]], patch: int) -> DataFrame:
    """Pictures handed to the encoder per image, by aspect mode ``pad``, ``anyres`` or plain."""
    if mode == "anyres":
        return tile_manifest(sizes, candidates, patch)
    if mode == "pad":
        out = sizes
        for name, col in G.square_canvas("w", "h").items():
            out = out.withColumn(name, col)
        return out
    return sizes


def expected_tokens(
    sizes: DataFrame,
    candidates: list[tuple[int, int]],
    image_size: int,
    side_patches: int,
    merge: str = "flat",
) -> DataFrame:
    """Image tokens each row will take.

    ``flat``: every picture adds its patches. ``spatial``: thumbnail + tile patches.
    ``spatial_unpad``: the padding is cut off and every row of the rest gets a newline token.
    """
    df = grid_shape(sizes, candidates, image_size)
    per_tile = side_patches * side_patches
    tiles = F.col("grid_w") * F.col("grid_h")
    if merge in ("flat", "spatial"):
        tokens = (tiles + 1) * per_tile
    elif merge == "spatial_unpad":
        win = G.unpadded_window("w", "h", F.col("grid_w") * side_patches, F.col("grid_h") * side_patches)
        tokens = F.lit(per_tile) + win["out_h"] * (win["out_w"] + 1)
    else:
        raise ValueError(f"unknown merge type {merge!r}")
    return df.withColumn("image_tokens", tokens.cast("bigint"))
