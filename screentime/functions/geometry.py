"""Box geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bigint_mod(value: Column, modulus: int) -> Column:
    return (value % F.lit(modulus)).cast("bigint")


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two corner boxes; 0 when they do not overlap."""
    zero = F.lit(0.0)
    iw = F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    ih = F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    inter = iw * ih
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return F.when(inter <= 0, zero).otherwise(F.coalesce(F.try_divide(inter, union), zero))


def trunc_int(value: Column) -> Column:
    """Truncation toward zero, as a bigint."""
    return value.cast("bigint")


def expand(x1: Column, y1: Column, x2: Column, y2: Column, frac: float, w: float, h: float) -> list[Column]:
    """Grow an integer box by a truncated fraction per side and clip it to the frame."""
    px, py = trunc_int((x2 - x1) * F.lit(frac)), trunc_int((y2 - y1) * F.lit(frac))
    return [
        F.greatest(F.lit(0), x1 - px), F.greatest(F.lit(0), y1 - py),
        F.least(F.lit(int(w)), x2 + px), F.least(F.lit(int(h)), y2 + py),
    ]


def expand_min_size(
    x1: Column, y1: Column, x2: Column, y2: Column, frac: float, min_px: int, w: float, h: float
) -> list[Column]:
    """Grow, enforce a minimum side around the floored centre, then clip."""
    px, py = trunc_int((x2 - x1) * F.lit(frac)), trunc_int((y2 - y1) * F.lit(frac))
    half = min_px // 2

    def side(lo: Column, hi: Column) -> tuple[Column, Column]:
        mid = F.floor((lo + hi) / 2).cast("bigint")
        short = (hi - lo) < min_px
        return F.when(short, mid - half).otherwise(lo), F.when(short, mid + half).otherwise(hi)

    ax, bx = side(x1 - px, x2 + px)
    ay, by = side(y1 - py, y2 + py)
    return [
        F.greatest(F.lit(0), ax), F.greatest(F.lit(0), ay),
        F.least(F.lit(int(w)), bx), F.least(F.lit(int(h)), by),
    ]


def normalised_box(x: Column, y: Column, bw: Column, bh: Column, w: Column, h: Column) -> list[Column]:
    """Top-left pixel box to centre form in frame fractions."""
    return [(x + bw / 2) / w, (y + bh / 2) / h, bw / w, bh / h]
