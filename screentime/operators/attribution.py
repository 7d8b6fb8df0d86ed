"""Detections attached to players, teams, kit slots and dimension rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screentime.functions import geometry as G
from screentime.functions import text as T
from screentime.functions import visibility as V
from screentime.operators.pairs import _L, _R, DENSE_LIMIT, by_frame, crowded_nearest_pairs, crowded_window_pairs, touching, window_pairs
from screentime.operators.scans import CHUNK_SECONDS, fill_forward

FRAME = ["video_id", "t"]
BOX = ("x1", "y1", "x2", "y2")

# Owner reach, vote threshold, keypoint cut-off, kit slots.
OWNER_REACH = 1.2
MIN_VOTES = 2.0
KEYPOINT_CONF = 0.3
ZONES = (
    ("chest-center", "Chest Centre"),
    ("chest-l", "Chest Upper L"),
    ("chest-r", "Chest Upper R"),
    ("shoulder-l", "Shoulder L"),
    ("shoulder-r", "Shoulder R"),
    ("sleeve-l", "Sleeve L"),
    ("sleeve-r", "Sleeve R"),
    ("abdomen", "Abdomen"),
    ("back-top", "Back Top"),
    ("back-center", "Back Centre"),
    ("back-lower", "Back Lower"),
    ("shorts-front-l", "Shorts Front L"),
    ("shorts-front-r", "Shorts Front R"),
    ("shorts-back", "Shorts Back"),
    ("shorts-leg-l", "Shorts Leg L"),
    ("shorts-leg-r", "Shorts Leg R"),
    ("sock-l", "Sock L"),
    ("sock-r", "Sock R"),
)

# The order in which the slots of a pose are laid out.
BUILD_ORDER = (
    "shoulder-l", "shoulder-r", "back-top", "back-center", "back-lower", "shorts-back", "chest-l", "chest-r", "chest-center",
    "abdomen", "sleeve-l", "sleeve-r", "shorts-front-l", "shorts-leg-l", "sock-l", "shorts-front-r", "shorts-leg-r", "sock-r",
)


def _prefixed(persons: DataFrame, extra: list[str]) -> DataFrame:
    return persons.select(*FRAME, "person_id", *[F.col(c).alias(f"p_{c}") for c in BOX], *extra)


def _p(*names: str) -> list[Column]:
    return [F.col(f"p_{n}") for n in names]


def _pick(logos: DataFrame, pairs: DataFrame, keys: list[str], rank: list[Column], payload: list[str]) -> DataFrame:
    """Best candidate per logo; logos without one keep nulls.

    Every logo enters the aggregate once without a candidate, so no join back to
    the logo table is needed.
    """
    best = F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank)], *payload)
    found = pairs.select(*keys, best.alias("c"))
    blank = logos.select(*keys, F.lit(None).cast(found.schema["c"].dataType).alias("c"))
    picked = found.unionByName(blank).groupBy(*keys).agg(
        F.min("c").alias("c"), F.count_if(F.col("c").isNull()).cast("int").alias("rows")
    )
    # Logo rows that agree in every key are all returned.
    copies = F.explode(F.array_repeat(F.lit(1), F.col("rows")))
    return picked.select("*", copies).select(*keys, *[F.col(f"c.{c}").alias(c) for c in payload])


def _framed(logos: DataFrame, persons: DataFrame, keys: list[str], carry: Iterable[str], dense_limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Logos and persons by frame; the person columns of ``carry`` go along as ``p_...``.

    Two operators that are given the same keys and carry the same columns of the same tables read one exchange.
    """
    points = logos.select(*dict.fromkeys([*keys, "cx", "cy"]))
    side = _prefixed(persons, [F.col(c).alias(f"p_{c}") for c in sorted({*carry} - {*BOX})])
    return by_frame(points, side, FRAME, dense_limit)


def _nearest(choice: Callable[[Callable[[str], Column]], Column]) -> Column:
    """The least choice among the persons of a logo's frame."""
    return F.array_min(F.transform("__near", lambda p: choice(p.__getitem__)))


def assign_owner(
    logos: DataFrame, persons: DataFrame, keys: list[str], dense_limit: int = DENSE_LIMIT, carry: Iterable[str] = ()
) -> DataFrame:
    """Owner per logo: the smallest containing person box, else the nearest centre
    within reach of the person's own diagonal, else none. ``keys`` identify a logo
    row and include video and time; ties go to the lower person id. ``carry`` names more
    columns that the exchange of the persons is to hold, see :func:`_framed`."""
    told = ["person_id", "team", "vote_mass"]
    plain, crowd, theirs = _framed(logos, persons, keys, [*carry, "team", "vote_mass"], dense_limit)
    cx, cy = F.col("cx"), F.col("cy")

    def window(p: Callable[[str], Column]) -> list[Column]:
        x1, y1, x2, y2 = (p(f"p_{c}") for c in BOX)
        px, py, reach = (x1 + x2) / 2, (y1 + y2) / 2, F.hypot(x2 - x1, y2 - y1) * OWNER_REACH
        return [px - reach, py - reach, px + reach, py + reach]

    def judged(p: Callable[[str], Column]) -> tuple[Column, Column]:
        """Whether a person may own the logo, and its rank with what is told of it."""
        x1, y1, x2, y2 = (p(f"p_{c}") for c in BOX)
        inside = (x1 <= cx) & (cx <= x2) & (y1 <= cy) & (cy <= y2)
        dist = F.hypot(cx - (x1 + x2) / 2, cy - (y1 + y2) / 2)
        reach = F.hypot(x2 - x1, y2 - y1) * OWNER_REACH
        rank = [F.when(inside, 0).otherwise(1), F.when(inside, V.box_area(x1, y1, x2, y2)).otherwise(dist), p("person_id")]
        return inside | (dist < reach), F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank)], p("p_team").alias("team"), p("p_vote_mass").alias("vote_mass"))

    def choice(p: Callable[[str], Column]) -> Column:
        allowed, rank = judged(p)
        return F.when(touching([cx, cy, cx, cy], window(p)) & allowed, rank)

    alone = plain.select(*keys, _nearest(choice).alias("c")).select(*keys, F.col("c.r2").alias("person_id"), "c.team", "c.vote_mass")
    a = crowd.select("*", *[c.alias(n) for c, n in zip((cx, cy, cx, cy), _L)])
    b = theirs.select("*", *[c.alias(n) for c, n in zip(window(F.col), _R)])
    allowed, rank = judged(F.col)
    pairs = crowded_window_pairs(a, b, FRAME).filter(allowed).withColumns({"team": F.col("p_team"), "vote_mass": F.col("p_vote_mass")})
    return alone.unionByName(_pick(crowd, pairs, keys, [rank[f"r{i}"] for i in range(3)], told))


def team_verdict(
    owned: DataFrame, min_votes: float = MIN_VOTES, keep_unknown: bool = True, keep_unassigned: bool = False
) -> DataFrame:
    """Adds ``keep``: target owner, or an owner without enough votes, or policy for none."""
    keep = (
        F.when(F.col("person_id").isNull(), F.lit(keep_unassigned))
        .when(F.col("team") == "target", F.lit(True))
        .when(F.col("vote_mass") < min_votes, F.lit(keep_unknown))
        .otherwise(F.lit(False))
    )
    return owned.withColumn("keep", keep)


def team_filter_stats(verdicts: DataFrame) -> DataFrame:
    kept, n = F.count_if("keep"), F.count(F.lit(1))
    return verdicts.groupBy("video_id").agg(
        kept.alias("kept"), (n - kept).alias("dropped"), F.round((n - kept) / n, 3).alias("drop_rate")
    )


def zone_person_pick(
    logos: DataFrame, persons: DataFrame, keys: list[str], dense_limit: int = DENSE_LIMIT, carry: Iterable[str] = (), with_rows: bool = False
) -> DataFrame:
    """Person per logo by (not inside, squared centre distance), without a distance cap.

    With ``with_rows`` a logo meets the rows of that person in its frame, as in a left join: the box and the columns
    ``carry`` come as ``p_...``, null where there is nobody.
    """
    plain, crowd, theirs = _framed(logos, persons, keys, carry, dense_limit)
    cx, cy = F.col("cx"), F.col("cy")

    def rank(p: Callable[[str], Column]) -> list[Column]:
        x1, y1, x2, y2 = (p(f"p_{c}") for c in BOX)
        px, py = (x1 + x2) / 2, (y1 + y2) / 2
        inside = (x1 <= cx) & (cx <= x2) & (y1 <= cy) & (cy <= y2)
        return [F.when(inside, 0).otherwise(1), (cx - px) * (cx - px) + (cy - py) * (cy - py), p("person_id")]

    best = _nearest(lambda p: F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank(p))]))
    alone = plain.select(*keys, best["r2"].alias("person_id"), "__near")
    x1, y1, x2, y2 = _p(*BOX)
    near = crowded_nearest_pairs(crowd, theirs, FRAME, [cx, cy], [(x1 + x2) / 2, (y1 + y2) / 2])
    # In other frames the list holds every person.
    holding = crowded_window_pairs(
        crowd.select("*", *[c.alias(n) for c, n in zip((cx, cy, cx, cy), _L)]), theirs.select("*", *[c.alias(n) for c, n in zip((x1, y1, x2, y2), _R)]), FRAME
    ).select(*near.columns)
    many = _pick(crowd, near.unionByName(holding), keys, rank(F.col), ["person_id"])
    if not with_rows:
        return alone.drop("__near").unionByName(many)
    # whoever is picked stands in the list, so its id is told by its rows
    rows = alone.select(*keys, F.inline_outer(F.filter("__near", lambda p: p["person_id"] == F.col("person_id"))))
    return rows.unionByName(many.join(theirs, [*FRAME, "person_id"], "left").select(*rows.columns))


def _first(*choices: np.ndarray) -> np.ndarray:
    """First present value per row; NaN stands for a missing coordinate."""
    out = choices[0]
    for c in choices[1:]:
        out = np.where(np.isnan(out), c, out)
    return out


def _slot_points(kp) -> dict[str, np.ndarray]:
    """Slot name to an (n, 2) array of points, rows of NaN where a slot has no anchor.

    ``kp(i)`` gives keypoint ``i`` as (n, 2); arithmetic with a missing one is NaN,
    which is the rule that such a slot is left out.
    """
    l_sho, r_sho, l_hip, r_hip = kp(5), kp(6), kp(11), kp(12)

    def by_x(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        swap = (p[:, :1] > q[:, :1])
        return np.where(swap, q, _first(p, q)), np.where(swap, p, _first(q, p))

    s_l, s_r = by_x(l_sho, r_sho)
    h_l, h_r = by_x(l_hip, r_hip)
    s_m, h_m = (s_l + s_r) / 2, (h_l + h_r) / 2
    face = np.isnan(_first(kp(0), kp(1), kp(2))[:, :1])
    back = face & ~np.isnan(l_sho[:, :1]) & ~np.isnan(r_sho[:, :1])
    spine = lambda f: s_m + (h_m - s_m) * f
    axis = spine(0.5)[:, :1]
    front_only, back_only = (lambda p: np.where(back, np.nan, p)), (lambda p: np.where(back, p, np.nan))

    def sided(first: np.ndarray, second: np.ndarray, defaults: str) -> dict[str, np.ndarray]:
        """Both limbs by side of the torso axis, else by their default; the first limb wins."""
        on_left = [np.where(np.isnan(axis), d == "l", p[:, :1] <= axis) for p, d in zip((first, second), defaults)]
        return {
            "l": _first(*[np.where(o, p, np.nan) for o, p in zip(on_left, (first, second))]),
            "r": _first(*[np.where(o, np.nan, p) for o, p in zip(on_left, (first, second))]),
        }

    arm = sided((l_sho + kp(7)) / 2, (r_sho + kp(8)) / 2, "ll")
    leg = sided((h_l + kp(13)) / 2, (h_r + kp(14)) / 2, "lr")
    calf = sided((kp(13) + kp(15)) / 2, (kp(14) + kp(16)) / 2, "lr")
    return {
        "chest-center": front_only(spine(0.42)),
        "chest-l": front_only(s_l + (h_l - s_l) * 0.28), "chest-r": front_only(s_r + (h_r - s_r) * 0.28),
        "shoulder-l": s_l, "shoulder-r": s_r, "sleeve-l": arm["l"], "sleeve-r": arm["r"],
        "abdomen": front_only(spine(0.75)),
        "back-top": back_only(spine(0.18)), "back-center": back_only(spine(0.45)), "back-lower": back_only(spine(0.75)),
        "shorts-front-l": front_only(leg["l"]), "shorts-front-r": front_only(leg["r"]),
        "shorts-back": back_only(spine(1.05)),
        "shorts-leg-l": back_only(leg["l"]), "shorts-leg-r": back_only(leg["r"]),
        "sock-l": calf["l"], "sock-r": calf["r"],
    }


def zone_anchors(persons: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``anchors``: an array of (zone_no, zone, x, y) for the slots the keypoints allow.

    Columns named in ``carry`` go along; rows without keypoints have no anchors.

    The rules form a deep graph of shared points, which the optimizer would inline
    into every slot; they run on whole Arrow batches instead, row by row independent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([z for z, _ in ZONES])
        for batch in batches:
            points = batch.column("keypoints")
            starts = points.offsets.to_numpy()
            sizes, starts = np.diff(starts), starts[:-1]
            values = [points.values.field(f).to_numpy(zero_copy_only=False).astype(float) for f in ("x", "y", "c")]

            def keypoint(i: int, starts=starts, sizes=sizes, values=values) -> np.ndarray:
                out = np.full((len(starts), 2), np.nan)
                have = sizes > i
                at = starts[have] + i
                seen = values[2][at] >= KEYPOINT_CONF
                out[have] = np.where(seen[:, None], np.stack([values[0][at], values[1][at]], axis=1), np.nan)
                return out

            placed = _slot_points(keypoint)
            grid = np.stack([placed[z] for z, _ in ZONES], axis=1)
            known = ~np.isnan(grid).any(axis=2)
            zone_no = np.nonzero(known)[1].astype(np.int32)
            offsets = np.concatenate([[0], np.cumsum(known.sum(axis=1))]).astype(np.int32)
            entry = pa.StructArray.from_arrays(
                [pa.array(zone_no), names.take(pa.array(zone_no)), pa.array(grid[known][:, 0]), pa.array(grid[known][:, 1])],
                names=["zone_no", "zone", "x", "y"],
            )
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keys), pa.ListArray.from_arrays(pa.array(offsets), entry)], names=[*keys, "anchors"]
            )

    keys = list(dict.fromkeys((*FRAME, "person_id", *carry)))
    fields = ", ".join(f"{c} {persons.schema[c].dataType.simpleString()}" for c in keys)
    return persons.select(*keys, "keypoints").mapInArrow(
        run, f"{fields}, anchors array<struct<zone_no:int,zone:string,x:double,y:double>>"
    )


def zone_assign(picked: DataFrame, anchored: DataFrame) -> DataFrame:
    """Nearest slot of the picked person; null when that person has no anchors.

    ``picked`` has cx, cy and person_id, ``anchored`` has person_id and anchors. At
    equal distance the slot that comes first in ``BUILD_ORDER`` is taken.
    """
    rows = picked.join(anchored.select(*FRAME, "person_id", "anchors"), [*FRAME, "person_id"], "left")
    return nearest_slot(rows).select(*picked.columns, "zone")


def zone_assign_poses(picked: DataFrame, poses: DataFrame) -> DataFrame:
    """:func:`zone_assign` straight from poses: keypoints join the picked rows once and anchors are laid out there."""
    posed = picked.join(poses.select(*FRAME, "person_id", "keypoints"), [*FRAME, "person_id"], "left")
    return nearest_slot(zone_anchors(posed, tuple(picked.columns))).select(*picked.columns, "zone")


def nearest_slot(rows: DataFrame) -> DataFrame:
    """Adds ``zone``: the slot of ``anchors`` nearest to (cx, cy)."""
    order = F.array(*[F.lit(z) for z in BUILD_ORDER])

    def measured(e: Column) -> Column:
        d = (F.col("cx") - e["x"]) * (F.col("cx") - e["x"]) + (F.col("cy") - e["y"]) * (F.col("cy") - e["y"])
        return F.struct(d.alias("d"), F.array_position(order, e["zone"]).alias("rank"), e["zone"].alias("zone"))

    best = F.array_min(F.transform("anchors", measured))
    return rows.withColumn("zone", best["zone"])


def zone_share(assigned: DataFrame, keys: list[str], groups: DataFrame | None = None) -> DataFrame:
    """Share of attributed weight for all 18 slots per key; keys of ``groups`` without a logo get zeros."""
    weight = F.sum(F.greatest(F.col("visibility"), F.lit(float("1e-6"))))
    per_zone = assigned.groupBy(*keys, "zone").agg(weight.alias("weight"))
    # At most one entry per slot and one for unassigned rows.
    found = per_zone.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct(F.coalesce("zone", F.lit("")), "weight"))).alias("m"),
        F.sum(F.when(F.col("zone").isNotNull(), F.col("weight"))).alias("total"),
    )
    if groups is not None:
        found = groups.select(*keys).distinct().join(found, keys, "left")
    slots = F.array(*[F.struct(F.lit(i).alias("zone_no"), F.lit(z).alias("zone"), F.lit(n).alias("name")) for i, (z, n) in enumerate(ZONES)])
    share = F.try_divide(F.try_element_at("m", F.col("s.zone")), F.col("total")) * 100.0
    return found.select("*", F.explode(slots).alias("s")).select(*keys, "s.*", F.coalesce(share, F.lit(0.0)).alias("percentage"))


def isolated_boxes(boxes: DataFrame, key: str, max_iou: float = 0.25, dense_limit: int = DENSE_LIMIT) -> DataFrame:
    """Boxes whose overlap with every other box of the frame stays at or below the limit."""
    mine = [F.col(c) for c in BOX]
    other = boxes.select(*FRAME, F.col(key).alias("p_key"), *[F.col(c).alias(f"p_{c}") for c in BOX])
    pairs = window_pairs(boxes.select(*FRAME, key, *BOX), other, FRAME, mine, _p(*BOX), dense_limit=dense_limit)
    clash = pairs.filter((F.col(key) != F.col("p_key")) & (G.iou(tuple(mine), tuple(_p(*BOX))) > max_iou)).select(*FRAME, key).distinct()
    return boxes.join(clash, [*FRAME, key], "left_anti")


def mask_pose_match(
    masks: DataFrame, poses: DataFrame, mask_key: str, min_iou: float = 0.2, dense_limit: int = DENSE_LIMIT
) -> DataFrame:
    """Best overlapping pose per mask above the limit; ties by pose id, no match dropped."""
    mine = [F.col(c) for c in BOX]
    side = _prefixed(poses, [])
    pairs = window_pairs(masks.select(*FRAME, mask_key, *BOX), side, FRAME, mine, _p(*BOX), dense_limit=dense_limit)
    scored = pairs.withColumn("iou", G.iou(tuple(mine), tuple(_p(*BOX)))).filter(F.col("iou") > min_iou)
    best = scored.groupBy(*FRAME, mask_key).agg(
        F.min(F.struct((-F.round("iou", 9)).alias("neg"), "person_id", "iou")).alias("b")
    )
    return best.select(*FRAME, mask_key, "b.person_id", "b.iou")


def box_overlaps(left: DataFrame, right: DataFrame, left_key: str, dense_limit: int = DENSE_LIMIT) -> DataFrame:
    """IoU of every overlapping box pair of two box tables in one frame."""
    mine = [F.col(c) for c in BOX]
    side = _prefixed(right, [])
    pairs = window_pairs(left.select(*FRAME, left_key, *BOX), side, FRAME, mine, _p(*BOX), dense_limit=dense_limit)
    return pairs.withColumn("iou", G.iou(tuple(mine), tuple(_p(*BOX)))).filter("iou > 0").select(*FRAME, left_key, "person_id", "iou")


def brand_dim_join(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Display names from the fixed exceptions and a name table, else title case."""
    fixed = [F.lit(v) for pair in T.DISPLAY_NAMES.items() for v in pair]
    return rows.join(names.withColumnRenamed("brand_name", "__given"), "brand_key", "left").select(
        *rows.columns,
        F.coalesce("__given", F.try_element_at(F.create_map(*fixed), F.col("brand_key")), T.title_name(F.col("brand_key"))).alias("brand_name"),
    )


def unlabeled_frames(frames: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    return frames.join(labels.select(key), key, "left_anti")


def labelled_images(labels: DataFrame, images: DataFrame, key: str) -> DataFrame:
    return labels.join(images.select(key), key, "left_semi")


def skipped_labels(labels: DataFrame, images: DataFrame, key: str) -> DataFrame:
    return labels.join(images.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("skipped"))


def burst_best_frame(centres: DataFrame, frames: DataFrame, window: int) -> DataFrame:
    """Sharpest frame within ``window`` frames of each centre.

    Frames are binned by the window width; a centre looks at its own bin and both
    neighbours, so the range condition runs on an equi-join.
    """
    bins = F.array(*[F.floor(F.col("centre_idx") / window).cast("bigint") + d for d in (-1, 0, 1)])
    left = centres.select("video_id", "centre_idx", F.explode(bins).alias("bin"))
    right = frames.select("video_id", "frame_idx", "sharp", F.floor(F.col("frame_idx") / window).cast("bigint").alias("bin"))
    near = left.join(right, ["video_id", "bin"]).filter(F.abs(F.col("frame_idx") - F.col("centre_idx")) <= window)
    return near.groupBy("video_id", "centre_idx").agg(
        F.min(F.struct((-F.round("sharp", 9)).alias("neg"), "frame_idx")).alias("b")
    ).select("video_id", "centre_idx", F.col("b.frame_idx").alias("best_idx"), (-F.col("b.neg")).alias("sharp"))


def asof_team_label(
    detections: DataFrame, labels: DataFrame, keys: list[str], tolerance: float, chunk: float = CHUNK_SECONDS
) -> DataFrame:
    """Latest label at or before each detection's time, null when older than the tolerance."""
    value = F.struct(F.col("t").alias("label_t"), F.col("label"))
    marks = labels.select(*keys, "t", F.lit(0).alias("side"), F.lit(None).cast("string").alias("det_id"), value.alias("v"))
    hits = detections.select(*keys, "t", F.lit(1).alias("side"), "det_id", F.lit(None).cast(marks.schema["v"].dataType).alias("v"))
    filled = fill_forward(marks.unionByName(hits), keys, ["t", "side"], ["v"], chunk=chunk)
    fresh = F.col("t") - F.col("v.label_t") <= tolerance
    return filled.filter("side = 1").select(*keys, "t", "det_id", F.when(fresh, F.col("v.label")).alias("label"))
