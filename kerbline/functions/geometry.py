"""Box, point, camera and image-size formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CIN = Column | str


def _c(x: CIN) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clamp(n: CIN, lo, hi) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.greatest(lo, F.least(_c(n), hi))


def truncate(n: CIN) -> Column:
    """Towards zero, as an integer."""
    return _c(n).cast("bigint")


def area(x1: CIN, y1: CIN, x2: CIN, y2: CIN) -> Column:
    return (_c(x2) - _c(x1)) * (_c(y2) - _c(y1))


def intersection_area(a: tuple, b: tuple) -> Column:
    """Shared area of two boxes given as four columns each; touching or apart gives 0."""
    left, top = F.greatest(_c(a[0]), _c(b[0])), F.greatest(_c(a[1]), _c(b[1]))
    right, bottom = F.least(_c(a[2]), _c(b[2])), F.least(_c(a[3]), _c(b[3]))
    return F.when((right < left) | (bottom < top), F.lit(0)).otherwise((right - left) * (bottom - top))


def side_bucket(cx: CIN) -> Column:
    cx = _c(cx)
    return F.when(cx < 0.33, "left").when(cx > 0.66, "right").otherwise("center")


def project(fraction: CIN, size: CIN) -> Column:
    """Normalised coordinate to a pixel inside the raster."""
    return clamp(truncate(_c(fraction) * _c(size)), 0, _c(size) - 1)


def within_margin(v: CIN, size: CIN, margin: int = 0) -> Column:
    return clamp(v, margin, _c(size) - 1 - margin)


def focal_from_fov(size: CIN, fov_degrees: CIN) -> Column:
    return (_c(size) / 2) / F.tan(F.radians(_c(fov_degrees)) / 2)


# Marker in the file name, fx and fy as a share of width and height,
# and the correction of each camera. The first marker found wins.
CAMERA_RATIOS = [
    ("MP_", 0.6285861494594773, 1.1174864879279598, 1.5 * 3.0 / 2.5),
    ("ZED", 0.5553062574145965, 0.9813052527525753, 1.5 * 3.0 / 1.5),
    ("_R", 0.49078759599228894, 0.7024368112553278, 1.5 * 3.0 / 1.0),
    ("_GOPR", 0.4830019884684673, 0.5517242397258202, 2.0 * 3.0 / 1.5),
]
CAMERA_DEFAULT_RATIO = 0.6 * 3


def camera_ratios(filename: CIN) -> tuple[Column, Column, Column, Column]:
    """(fx, fy, cx, cy) as shares of the image size."""
    fx = fy = None
    for marker, rx, ry, fix in CAMERA_RATIOS:
        hit = _c(filename).contains(marker)
        fx = F.when(hit, rx * fix) if fx is None else fx.when(hit, rx * fix)
        fy = F.when(hit, ry * fix) if fy is None else fy.when(hit, ry * fix)
    return (
        fx.otherwise(CAMERA_DEFAULT_RATIO),
        fy.otherwise(CAMERA_DEFAULT_RATIO),
        F.lit(0.5),
        F.lit(0.5),
    )


def metric_bounds(x: CIN, depth: CIN, half_width_m, fx: CIN, width: CIN) -> tuple[Column, Column]:
    """Pixel columns that lie ``half_width_m`` left and right of ``x`` at this depth; null at depth 0."""
    half = truncate(F.try_divide(F.lit(half_width_m), _c(depth)) * _c(fx))
    return F.greatest(_c(x) - half, F.lit(0)), F.least(_c(x) + half, _c(width) - 1)


def metric_radius(depth: CIN, radius_m, fx: CIN, fy: CIN) -> Column:
    return truncate(F.try_divide(F.lit(radius_m), _c(depth)) * ((_c(fx) + _c(fy)) / 2))


def pull_inside(x1: CIN, x2: CIN, size: CIN) -> tuple[Column, Column]:
    """Shift an interval back into 0..size, keeping its length."""
    a, b, s = _c(x1), _c(x2), _c(size)
    length = b - a
    lo = F.when(a < 0, F.lit(0.0)).when(b > s, s - length).otherwise(a)
    hi = F.when(a < 0, length).when(b > s, s).otherwise(b)
    return lo, hi


# ---- image sizing -------------------------------------------------------------------

def _fit(w: Column, h: Column, tw, th) -> dict[str, Column]:
    scale = F.least(tw / w, th / h)
    eff = F.least(truncate(w * scale) * truncate(h * scale), w * h)
    return {"effective": eff, "waste": tw * th - eff}


def best_resolution(w: CIN, h: CIN, candidates: list[tuple[int, int]]) -> Column:
    """struct(w, h): most effective pixels, then least waste, then first in the list."""
    w, h = _c(w), _c(h)
    options = []
    for pos, (tw, th) in enumerate(candidates):
        fit = _fit(w, h, F.lit(tw), F.lit(th))
        options.append(
            F.struct(
                (-fit["effective"]).alias("o1"),
                fit["waste"].alias("o2"),
                F.lit(pos).alias("o3"),
                F.lit(tw).alias("w"),
                F.lit(th).alias("h"),
            )
        )
    best = F.array_min(F.array(*options))
    return F.struct(best["w"].alias("w"), best["h"].alias("h"))


def padded_resize(w: CIN, h: CIN, tw: CIN, th: CIN) -> dict[str, Column]:
    """New size with the aspect ratio kept, and where it is pasted in the target."""
    w, h, tw, th = _c(w), _c(h), _c(tw), _c(th)
    sw, sh = tw / w, th / h
    new_w = F.when(sw < sh, tw).otherwise(F.least(F.ceil(w * sh), tw))
    new_h = F.when(sw < sh, F.least(F.ceil(h * sw), th)).otherwise(th)
    return {
        "new_w": new_w,
        "new_h": new_h,
        "paste_x": F.floor((tw - new_w) / 2),
        "paste_y": F.floor((th - new_h) / 2),
    }


def unpadded_window(w: CIN, h: CIN, cur_w: CIN, cur_h: CIN) -> dict[str, Column]:
    """The part of a padded raster that holds the picture: x/y offsets and size."""
    w, h, cw, ch = _c(w), _c(h), _c(cur_w), _c(cur_h)
    wide = (w / h) > (cw / ch)
    pad_y = F.floor((ch - truncate(h * (cw / w))) / 2)
    pad_x = F.floor((cw - truncate(w * (ch / h))) / 2)
    pad_x, pad_y = F.when(wide, F.lit(0)).otherwise(pad_x), F.when(wide, pad_y).otherwise(F.lit(0))
    return {"pad_x": pad_x, "pad_y": pad_y, "out_w": cw - 2 * pad_x, "out_h": ch - 2 * pad_y}


def square_canvas(w: CIN, h: CIN) -> dict[str, Column]:
    w, h = _c(w), _c(h)
    side = F.greatest(w, h)
    return {
        "side": side,
        "paste_x": F.floor((side - w) / 2),
        "paste_y": F.floor((side - h) / 2),
    }


def served_size(w: CIN, h: CIN, mode: CIN, max_len: int = 1344, min_len: int = 672) -> dict[str, Column]:
    """Image size after Pad / Default / Crop / Resize and the cap on the longest side."""
    w, h, mode = _c(w), _c(h), _c(mode)
    side = F.greatest(w, h)
    w1 = F.when(mode == "Pad", side).when(mode == "Resize", 336).when(mode.isin("Default", "Crop"), w)
    h1 = F.when(mode == "Pad", side).when(mode == "Resize", 336).when(mode.isin("Default", "Crop"), h)
    long, short = F.greatest(w1, h1), F.least(w1, h1)
    aspect = long / short
    short2 = truncate(F.least(F.lit(max_len) / aspect, F.lit(min_len), short))
    long2 = truncate(short2 * aspect)
    capped = long > max_len
    return {
        "out_w": F.when(capped, F.when(h1 > w1, short2).otherwise(long2)).otherwise(w1),
        "out_h": F.when(capped, F.when(h1 > w1, long2).otherwise(short2)).otherwise(h1),
    }
