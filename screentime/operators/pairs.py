"""Candidate pairs of boxes that share a frame.

A frame normally holds a few dozen boxes, so an equi-join on the frame key meets
a bounded number of rows, and so does the list of a frame's boxes (:func:`by_frame`). Frames with more boxes than ``dense_limit`` are joined
on the frame key and a grid cell instead, each pair reported in one cell only. The
cells of a pair are as wide as its larger window (within a factor of four), so small
boxes that pile up in one place meet in small cells.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screentime.operators.scans import dealt

DENSE_LIMIT = 256
CELL = 120.0
#: Cells of one level are this many times as wide as those of the next finer one; levels below and above ``CELL``.
LEVEL_STEP, FINER, COARSER = 4, 3, 2

_L = ["__l1", "__l2", "__l3", "__l4"]
_R = ["__r1", "__r2", "__r3", "__r4"]


def _cells(df: DataFrame, window: list[str], cell: float, left: bool) -> DataFrame:
    """Rows of a side under the cells where they may meet the other side.

    A window's own level is the first whose cells are at least its size. It stands there
    (``own``) and, as the smaller window of a pair, in the cells of every coarser level.
    Meeting 0 is of left own with any right windows, meeting 1 of smaller left with right
    own windows: two windows smaller than a cell never meet in it.
    """
    size = F.greatest(F.col(window[2]) - F.col(window[0]), F.col(window[3]) - F.col(window[1]), F.lit(0.0))
    step = F.lit(float(LEVEL_STEP))
    finest = cell / LEVEL_STEP**FINER
    own = F.least(F.lit(FINER + COARSER), F.greatest(F.lit(0), F.ceil(F.log(size / finest) / F.log(step)).cast("int")))
    placed = df.withColumn("__own", own).withColumn("__level", F.explode(F.sequence("__own", F.lit(FINER + COARSER))))
    placed = placed.withColumn("__cell", F.lit(finest) * F.pow(step, F.col("__level")))

    def span(lo: str, hi: str) -> Column:
        return F.sequence(F.floor(F.col(lo) / F.col("__cell")), F.floor(F.col(hi) / F.col("__cell")))

    is_own = F.col("__own") == F.col("__level")
    meeting = F.when(is_own, F.array(F.lit(0))).otherwise(F.array(F.lit(1))) if left else F.when(is_own, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    placed = placed.withColumn("__meeting", F.explode(meeting)).withColumn("__gx", F.explode(span(window[0], window[2])))
    placed = placed.withColumn("__gy", F.explode(span(window[1], window[3]))).drop("__own")
    return placed if left else placed.drop("__cell")


def _met(left: DataFrame, right: DataFrame, frame: list[str], cell: float) -> DataFrame:
    """Pairs of windows that stand in one cell, before they are compared."""
    return _cells(left, _L, cell, True).join(_cells(right, _R, cell, False), [*frame, "__level", "__meeting", "__gx", "__gy"])


def by_frame(left: DataFrame, right: DataFrame, frame: list[str], dense_limit: int = DENSE_LIMIT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Left rows of plain frames with ``__near``, the list of their frame's right rows (structs without the frame);
    and the left and the right rows of crowded frames.

    Both sides are dealt by frame in one exchange, and what follows in plain frames stays in its tasks. All
    three results need a row whole, so they read the same exchange. Left rows without a frame have an empty
    list and are not dealt. The hash stands for the frame there, as joins and windows compare a double in
    another form than the one it was dealt by.
    """
    nowhere = reduce(or_, [F.col(c).isNull() for c in frame])
    whole = lambda df: F.struct(*[c for c in df.columns if c not in frame])
    none = lambda df: F.lit(None).cast(df.select(whole(df).alias("r")).schema["r"].dataType)
    both = left.filter(~nowhere).select(*frame, whole(left).alias("__left"), none(right).alias("__right")).unionByName(
        right.filter(~nowhere).select(*frame, none(left).alias("__left"), whole(right).alias("__right"))
    ).select(F.xxhash64(*frame).alias("__frame"), "*")
    here = Window.partitionBy("__frame", *frame)
    rows = dealt(both, "__frame").select("*", F.count("__right").over(here).alias("__n"), F.count("__left").over(here).alias("__m"))
    # frames without a left row make nothing
    plain = rows.filter((F.col("__n") <= dense_limit) & (F.col("__m") > 0)).withColumn("__near", F.collect_list("__right").over(here))
    plain = plain.filter("__left IS NOT NULL").select(*frame, "__left.*", "__near")
    lost = left.filter(nowhere).withColumn("__near", F.array().cast(plain.schema["__near"].dataType))
    crowded = rows.filter((F.col("__n") > dense_limit) & (F.col("__m") > 0))
    return (
        plain.unionByName(lost),
        crowded.filter("__left IS NOT NULL").select(*frame, "__left.*"),
        crowded.filter("__right IS NOT NULL").select(*frame, "__right.*"),
    )


def box_counts(boxes: DataFrame, frame: list[str]) -> DataFrame:
    return boxes.groupBy(*frame).agg(F.count(F.lit(1)).alias("__n"))


def window_pairs(
    left: DataFrame,
    right: DataFrame,
    frame: list[str],
    left_window: list[Column],
    right_window: list[Column],
    dense_limit: int = DENSE_LIMIT,
    cell: float = CELL,
) -> DataFrame:
    """Rows of both sides whose search windows (x1, y1, x2, y2) touch in one frame."""
    a = left.select("*", *[c.alias(n) for c, n in zip(left_window, _L)])
    b = right.select("*", *[c.alias(n) for c, n in zip(right_window, _R)])
    counts = box_counts(right, frame)
    tagged = b.join(counts, frame)
    sparse = a.join(tagged.filter(F.col("__n") <= dense_limit).drop("__n"), frame).filter(touching([F.col(c) for c in _L], [F.col(c) for c in _R]))
    crowded = counts.filter(F.col("__n") > dense_limit).select(*frame)
    columns = [*left.columns, *[c for c in right.columns if c not in frame]]
    dense = crowded_window_pairs(
        a.join(crowded, frame, "left_semi"), tagged.filter(F.col("__n") > dense_limit).drop("__n"), frame, cell
    )
    return sparse.select(*columns).unionByName(dense.select(*columns))


def touching(a: list[Column], b: list[Column]) -> Column:
    """Whether two windows (x1, y1, x2, y2) touch."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def crowded_window_pairs(a: DataFrame, b: DataFrame, frame: list[str], cell: float = CELL) -> DataFrame:
    """Pairs of crowded frames whose windows touch, met in grid cells; the windows stand in ``_L`` and ``_R``."""
    touch = touching([F.col(c) for c in _L], [F.col(c) for c in _R])
    corner = (F.floor(F.greatest(F.col(_L[0]), F.col(_R[0])) / F.col("__cell")) == F.col("__gx")) & (
        F.floor(F.greatest(F.col(_L[1]), F.col(_R[1])) / F.col("__cell")) == F.col("__gy")
    )
    return _met(a, b, frame, cell).filter(touch & corner)


def crowded_nearest_pairs(
    left: DataFrame, right: DataFrame, frame: list[str], left_point: list[Column], right_point: list[Column], cell: float = CELL
) -> DataFrame:
    """Pairs of crowded frames that are sure to include the nearest right point of every left point.

    Occupied cells are compared first, a number bounded by the frame area; a cell stays when
    its closest possible distance does not exceed the best worst-case distance of any
    occupied cell.
    """

    def placed(df: DataFrame, point: list[Column], x: str, y: str) -> DataFrame:
        return df.select("*", F.floor(point[0] / cell).alias(x), F.floor(point[1] / cell).alias(y))

    a, b = placed(left, left_point, "__ax", "__ay"), placed(right, right_point, "__bx", "__by")
    cell_pairs = a.select(*frame, "__ax", "__ay").distinct().join(b.select(*frame, "__bx", "__by").distinct(), frame)
    dx, dy = F.abs(F.col("__ax") - F.col("__bx")), F.abs(F.col("__ay") - F.col("__by"))
    zero = F.lit(0).cast("bigint")
    near_x, near_y = F.greatest(dx - 1, zero), F.greatest(dy - 1, zero)
    scored = cell_pairs.select(
        "*", (near_x * near_x + near_y * near_y).alias("__near"), ((dx + 1) * (dx + 1) + (dy + 1) * (dy + 1)).alias("__far")
    )
    bound = scored.groupBy(*frame, "__ax", "__ay").agg(F.min("__far").alias("__bound"))
    keep = scored.join(bound, [*frame, "__ax", "__ay"]).filter("__near <= __bound").select(*frame, "__ax", "__ay", "__bx", "__by")
    columns = [*left.columns, *[c for c in right.columns if c not in frame]]
    return a.join(keep, [*frame, "__ax", "__ay"]).join(b, [*frame, "__bx", "__by"]).select(*columns)
