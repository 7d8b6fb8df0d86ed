"""Owners, kit zones and frame pairs, with crowded frames forced to the grid path."""

import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from screentime.operators import attribution as A
from screentime.operators import pairs as P

LOGO = "video_id bigint, t double, det_id string, cx double, cy double, x1 double, y1 double, x2 double, y2 double"
PERSON = "video_id bigint, t double, person_id string, x1 double, y1 double, x2 double, y2 double, team string, vote_mass double"
KEYS = ["video_id", "t", "det_id"]


def logos(spark, points):
    return spark.createDataFrame([(1, 0.0, f"d{i:03d}", x, y, x - 5, y - 5, x + 5, y + 5) for i, (x, y) in enumerate(points)], LOGO)


def persons(spark, boxes):
    return spark.createDataFrame([(1, 0.0, f"p{i:03d}", *map(float, b), "target", 3.0) for i, b in enumerate(boxes)], PERSON)


def scene(seed, n_logo=60, n_person=40):
    rng = random.Random(seed)
    points = [(rng.uniform(0, 1920), rng.uniform(0, 1080)) for _ in range(n_logo)]
    boxes = []
    for _ in range(n_person):
        x, y, w, h = rng.uniform(0, 1900), rng.uniform(0, 1000), rng.uniform(5, 200), rng.uniform(10, 300)
        boxes.append((x, y, x + w, y + h))
    return points, boxes


def plain_owner(p, boxes):
    held = [(((b[2] - b[0]) * (b[3] - b[1])), i) for i, b in enumerate(boxes) if b[0] <= p[0] <= b[2] and b[1] <= p[1] <= b[3]]
    if held:
        return min(held)[1]
    near = []
    for i, b in enumerate(boxes):
        d = math.hypot(p[0] - (b[0] + b[2]) / 2, p[1] - (b[1] + b[3]) / 2)
        if d < 1.2 * math.hypot(b[2] - b[0], b[3] - b[1]):
            near.append((d, i))
    return min(near)[1] if near else None


def plain_pick(p, boxes):
    return min(
        range(len(boxes)),
        key=lambda i: (not (boxes[i][0] <= p[0] <= boxes[i][2] and boxes[i][1] <= p[1] <= boxes[i][3]),
                       (p[0] - (boxes[i][0] + boxes[i][2]) / 2) ** 2 + (p[1] - (boxes[i][1] + boxes[i][3]) / 2) ** 2),
    )


def test_owner_facts(spark):
    nested = persons(spark, [(0, 0, 400, 600), (100, 100, 200, 300)])
    assert A.assign_owner(logos(spark, [(150.0, 200.0)]), nested, KEYS).first().person_id == "p001"
    assert A.assign_owner(logos(spark, [(900.0, 900.0)]), persons(spark, [(0, 0, 50, 100)]), KEYS).first().person_id is None
    assert A.assign_owner(logos(spark, [(170.0, 160.0)]), persons(spark, [(100, 100, 160, 220)]), KEYS).first().person_id == "p000"


@pytest.mark.parametrize("limit", [1, 256])
@pytest.mark.parametrize("seed", [1, 2])
def test_owner_and_pick_equal_the_plain_loop(spark, seed, limit):
    points, boxes = scene(seed)
    left, right = logos(spark, points), persons(spark, boxes)
    owner = {r.det_id: r.person_id for r in A.assign_owner(left, right, KEYS, dense_limit=limit).collect()}
    want = [plain_owner(p, boxes) for p in points]
    assert owner == {f"d{i:03d}": None if w is None else f"p{w:03d}" for i, w in enumerate(want)}
    pick = {r.det_id: r.person_id for r in A.zone_person_pick(left, right, KEYS, dense_limit=limit).collect()}
    assert pick == {f"d{i:03d}": f"p{plain_pick(p, boxes):03d}" for i, p in enumerate(points)}


def plain_iou(a, b):
    iw, ih = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if iw <= 0 or ih <= 0:
        return 0.0
    return iw * ih / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - iw * ih)


@pytest.mark.parametrize("limit", [1, 256])
def test_isolated_and_overlaps(spark, limit):
    _, boxes = scene(3, 0, 60)
    df = persons(spark, boxes)
    got = sorted(r.person_id for r in A.isolated_boxes(df, "person_id", dense_limit=limit).collect())
    want = [f"p{i:03d}" for i, a in enumerate(boxes) if all(i == j or plain_iou(a, b) <= 0.25 for j, b in enumerate(boxes))]
    assert got == want
    left = df.select("video_id", "t", F.col("person_id").alias("det_id"), "x1", "y1", "x2", "y2")
    pairs = {(r.det_id, r.person_id): r.iou for r in A.box_overlaps(left, df, "det_id", dense_limit=limit).collect()}
    full = {(f"p{i:03d}", f"p{j:03d}"): plain_iou(a, b) for i, a in enumerate(boxes) for j, b in enumerate(boxes)}
    assert pairs == pytest.approx({k: v for k, v in full.items() if v > 0})


def test_grid_reports_a_pair_once(spark):
    big = persons(spark, [(0, 0, 1900, 1000)])
    left = logos(spark, [(500.0, 500.0)])
    win = [F.lit(0.0), F.lit(0.0), F.lit(1000.0), F.lit(900.0)]
    right = big.select("video_id", "t", "person_id", *[F.col(c).alias(f"p_{c}") for c in A.BOX])
    got = P.window_pairs(left, right, A.FRAME, win, [F.col(f"p_{c}") for c in A.BOX], dense_limit=0)
    assert got.count() == 1


def test_verdict_policy(spark):
    df = spark.createDataFrame(
        [(1, "p", "target", 0.0), (1, "p", "other", 1.0), (1, "p", "other", 2.0), (1, None, None, None)],
        "video_id bigint, person_id string, team string, vote_mass double",
    )
    assert sorted(r.keep for r in A.team_verdict(df).collect()) == [False, False, True, True]
    assert tuple(A.team_filter_stats(A.team_verdict(df)).first()) == (1, 2, 2, 0.5)
    assert sum(r.keep for r in A.team_verdict(df, keep_unassigned=True).collect()) == 3
    assert sum(r.keep for r in A.team_verdict(df, keep_unknown=False).collect()) == 1


POSE = [(500, 130), (490, 120), (510, 120), (480, 125), (520, 125), (450, 220), (550, 220), (430, 330), (570, 330), (420, 420), (580, 420),
        (460, 480), (540, 480), (460, 650), (540, 650), (460, 820), (540, 820)]


def pose(spark, hide=()):
    points = [(float(x), float(y), 0.0 if i in hide else 0.9) for i, (x, y) in enumerate(POSE)]
    schema = "video_id bigint, t double, person_id string, x1 double, y1 double, x2 double, y2 double, keypoints array<struct<x:double,y:double,c:double>>"
    return spark.createDataFrame([(1, 0.0, "p", 400.0, 80.0, 600.0, 880.0, points)], schema)


def zones_of(spark, hide=()):
    return {a.zone: (a.x, a.y) for a in A.zone_anchors(pose(spark, hide)).first().anchors}


def test_front_and_back_slots(spark):
    front, back = zones_of(spark), zones_of(spark, hide=(0, 1, 2, 3, 4))
    assert {"chest-center", "chest-l", "chest-r", "abdomen", "shorts-front-l"} <= set(front) and "back-top" not in front
    assert {"back-top", "back-center", "back-lower", "shorts-back", "shorts-leg-l"} <= set(back) and "chest-center" not in back
    assert front["chest-center"] == pytest.approx((500.0, 220 + 260 * 0.42))
    assert front["sleeve-l"] == (440.0, 275.0) and front["sleeve-r"] == (560.0, 275.0)


def test_missing_keypoints(spark):
    assert zones_of(spark, hide=range(17)) == {}
    lone = zones_of(spark, hide=(6,))
    assert lone["shoulder-l"] == lone["shoulder-r"] == (450.0, 220.0)
    no_hips = zones_of(spark, hide=(11, 12))
    assert set(no_hips) == {"shoulder-l", "shoulder-r", "sleeve-l", "sock-l", "sock-r"}


@pytest.mark.parametrize(("point", "zone"), [((470.0, 300.0), "chest-l"), ((500.0, 330.0), "chest-center")])
def test_zone_share_is_all_on_one_slot(spark, point, zone):
    left = logos(spark, [point]).withColumn("visibility", F.lit(0.3))
    anchored = A.zone_anchors(pose(spark))
    picked = A.zone_person_pick(left, pose(spark), [*KEYS, "cx", "cy", "visibility"])
    share = {r.zone: r.percentage for r in A.zone_share(A.zone_assign(picked, anchored), ["video_id"]).collect()}
    assert len(share) == 18 and share[zone] == 100.0 and sum(share.values()) == 100.0


def test_burst_and_asof(spark):
    frames = spark.createDataFrame([(1, i, float(i % 7)) for i in range(40)], "video_id bigint, frame_idx bigint, sharp double")
    centres = spark.createDataFrame([(1, 3), (1, 20)], "video_id bigint, centre_idx bigint")
    assert rows(A.burst_best_frame(centres, frames, 3).select("centre_idx", "best_idx"), "centre_idx") == [(3, 6), (20, 20)]
    labels = spark.createDataFrame([(1, 0.0, "a"), (1, 10.0, "b")], "video_id bigint, t double, label string")
    hits = spark.createDataFrame([(1, 0.0, "x"), (1, 0.4, "y"), (1, 9.0, "z"), (1, 10.5, "w")], "video_id bigint, t double, det_id string")
    for chunk in (900.0, 1.0):
        got = rows(A.asof_team_label(hits, labels, ["video_id"], 1.0, chunk=chunk).select("t", "label"), "t")
        assert got == [(0.0, "a"), (0.4, "a"), (9.0, None), (10.5, "b")]


def test_boxes_piled_up_in_one_cell_meet_few_others(spark):
    """10,000 small boxes within 120 pixels and some large ones over them: candidates follow the pairs that touch."""
    rows = [(1, 0.0, i, 2.0 * (i % 50), 0.55 * (i // 50), 2.0 * (i % 50) + 1.5, 0.55 * (i // 50) + 0.5) for i in range(10_000)]
    rows += [(1, 0.0, 10_000 + i, 10.0 * i, 0.0, 10.0 * i + 200, 200.0) for i in range(5)]
    df = spark.createDataFrame(rows, "video_id int, t double, person_id int, x1 double, y1 double, x2 double, y2 double")
    right = df.select(*A.FRAME, F.col("person_id").alias("p_key"), *[F.col(c).alias(f"p_{c}") for c in A.BOX])
    a = df.select("*", *[F.col(c).alias(n) for c, n in zip(A.BOX, P._L)])
    b = right.select("*", *[F.col(f"p_{c}").alias(n) for c, n in zip(A.BOX, P._R)])
    met = P._met(a, b, A.FRAME, P.CELL).count()
    pairs = P.window_pairs(df, right, A.FRAME, [F.col(c) for c in A.BOX], [F.col(f"p_{c}") for c in A.BOX])
    found = pairs.count()
    assert pairs.distinct().count() == found > 10_000
    assert met < 12 * found and met < 2_000_000  # one grid of 120 pixels: 10^8
    assert A.isolated_boxes(df.where("person_id < 10000"), "person_id").count() == 10_000


def test_slots_from_poses_equal_slots_from_anchors(spark):
    kp = [(float(10 * i), float(7 * i), 0.9) for i in range(17)]
    poses = spark.createDataFrame([(1, 0.0, 1, kp), (1, 0.0, 2, None), (1, 1.0, 1, kp[:6])], "video_id int, t double, person_id int, keypoints array<struct<x:double,y:double,c:double>>")
    picked = spark.createDataFrame(
        [(1, 0.0, f"a{i}", 12.0 * i, 9.0 * i, p) for i, p in enumerate([1, 1, 2, None, 7])] + [(1, 1.0, "b", 50.0, 35.0, 1)],
        "video_id int, t double, det_id string, cx double, cy double, person_id int",
    )
    one = A.zone_assign(picked, A.zone_anchors(poses)).collect()
    two = A.zone_assign_poses(picked, poses).collect()
    assert sorted(one, key=str) == sorted(two, key=str) and len(two) == 6 and {r.zone is None for r in two} == {True, False}


ODD_LOGOS = [(1, 0.0, "a", 12.0, 9.0), (1, 0.0, "a", 12.0, 9.0), (1, -0.0, "b", 90.0, 40.0), (1, None, "c", 1.0, 1.0), (None, 0.0, "d", 1.0, 1.0),
             (1, float("nan"), "e", 5.0, 5.0), (2, 0.0, "f", 5.0, 5.0), (1, 0.0, "g", None, 5.0)]


def odd_frames(spark):
    """Rows that come twice, frames with nulls, two zeros, no number or nobody; a person told twice with other keypoints."""
    kp = lambda d: [(10.0 * i + d, 7.0 * i, 0.9) for i in range(17)]
    boxes = [(1, 0.0, "p", 0.0, 0.0, 40.0, 40.0, kp(0)), (1, 0.0, "p", 0.0, 0.0, 40.0, 40.0, kp(90)), (1, 0.0, "q", 80.0, 20.0, 99.0, 60.0, None),
             (1, 0.0, None, 500.0, 500.0, 510.0, 510.0, kp(0)), (1, None, "r", 0.0, 0.0, 9.0, 9.0, kp(0)), (None, 0.0, "s", 0.0, 0.0, 9.0, 9.0, kp(0)),
             (1, float("nan"), "t", 0.0, 0.0, 9.0, 9.0, kp(5)), (1, 0.0, "u", None, 0.0, 9.0, 9.0, kp(0))]
    keypoints = "keypoints array<struct<x:double,y:double,c:double>>"
    poses = spark.createDataFrame(boxes, f"video_id int, t double, person_id string, x1 double, y1 double, x2 double, y2 double, {keypoints}")
    return spark.createDataFrame(ODD_LOGOS, "video_id bigint, t double, det_id string, cx double, cy double"), poses


@pytest.mark.parametrize("limit", [1, 256])
def test_rows_of_the_picked_person_are_those_of_a_join(spark, limit):
    left, poses = odd_frames(spark)
    keys = [*KEYS, "cx", "cy"]
    picked = A.zone_person_pick(left, poses, keys, dense_limit=limit)
    assert sorted((r.det_id, r.person_id) for r in picked.collect() if r.det_id != "g") == [
        ("a", "p"), ("a", "p"), ("b", "q"), ("c", None), ("d", None), ("e", "t"), ("f", None)]
    posed = A.zone_person_pick(left, poses, keys, dense_limit=limit, carry=["keypoints"], with_rows=True)
    points = posed.select(*keys, "person_id", F.col("p_keypoints").alias("keypoints"))
    got = A.nearest_slot(A.zone_anchors(points, tuple(keys))).select(*picked.columns, "zone").collect()
    told = lambda found: sorted(str((r.video_id, r.t and r.t + 0.0, r.det_id, r.person_id, r.zone)) for r in found)
    assert told(got) == told(A.zone_assign_poses(picked, poses).collect()) and sum(r.det_id == "a" for r in got) == 4


def test_frames_are_exchanged_once(spark):
    """Picks and owners of the same tables read one exchange, of plain and of crowded frames; before, each side went through several."""
    left, poses = odd_frames(spark)
    people, keys = poses.withColumns({"team": F.lit("target"), "vote_mass": F.lit(3.0)}), [*KEYS, "cx", "cy"]
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        picked = A.zone_person_pick(left, people, keys, carry=["team", "vote_mass"], with_rows=True)
        owned = A.assign_owner(left, people, keys)
        both = picked.select("det_id", "person_id").union(owned.select("det_id", "person_id"))
        text = both._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert text.count("- Exchange hashpartitioning(__frame") == 1 and text.count("ReusedExchange") >= 4
    assert both.count() == 2 * len(ODD_LOGOS) + 2
