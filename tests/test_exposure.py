"""Visibility, segments, pricing and timeline on small inputs."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from screentime.functions import visibility as V
from screentime.operators import exposure as X

DET = "video_id bigint, brand_key string, track_id bigint, t double, visibility double"


def dets(spark, times, track=1, vis=0.5, brand="bartercard"):
    return spark.createDataFrame([(1, brand, track, float(t), vis) for t in times], DET)


def segs(spark, df, **kw):
    return X.segments(X.exposure_runs(df, **kw))


def score(spark, boxes):
    df = spark.createDataFrame(
        [(i, (a + c) / 2, (b + d) / 2, float(c - a), float(d - b), conf, 1000.0, 1000.0) for i, (a, b, c, d, conf) in enumerate(boxes)],
        "i int, cx double, cy double, w double, h double, conf double, frame_w double, frame_h double",
    )
    return [r.visibility for r in X.score_detections(df).orderBy("i").collect()]


def test_visibility_orders_boxes(spark):
    centre, corner, small, big, high, low = score(spark, [
        (450, 450, 550, 550, 0.9), (0, 0, 100, 100, 0.9), (480, 480, 520, 520, 0.9), (300, 300, 700, 700, 0.9),
        (450, 450, 550, 550, 0.9), (450, 450, 550, 550, 0.2),
    ])
    assert all(0 <= v <= 1 for v in (centre, corner, small, big, high, low))
    assert centre > corner and big > small and high > low


def test_zero_size_frame_scores_zero(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0, 0.9, 0.0, 0.0)], "cx double, cy double, w double, h double, conf double, frame_w double, frame_h double")
    assert X.score_detections(df).first().visibility == 0.0


def test_rotated_box_lowers_score(spark):
    got = spark.range(1).select(
        V.obb_penalty(F.lit(50.0), F.lit(100.0)).alias("half"), V.obb_penalty(F.lit(None).cast("double"), F.lit(100.0)).alias("none"),
        V.obb_penalty(F.lit(1.0), F.lit(0.0)).alias("empty"),
    ).first()
    assert tuple(got) == (0.5, 1.0, 1.0)


@pytest.mark.parametrize("chunk", [900.0, 2.0, 0.5])
@pytest.mark.parametrize(
    ("times", "spans"),
    [
        ([0, 0.5, 1, 1.5, 2, 2.5], [(0.0, 3.0, 1.0)]),
        ([0, 0.5, 1, 5, 5.5, 6], [(0.0, 1.5, 1.0), (5.0, 6.5, 1.0)]),
        ([i * 0.5 for i in range(16)], [(0.0, 8.0, 1.2)]),
        ([3], [(3.0, 3.5, 0.5)]),
        ([0, 1.25, 2.5], [(0.0, 3.0, 1.0)]),
        ([0, 1.5], [(0.0, 0.5, 0.5), (1.5, 2.0, 0.5)]),
    ],
)
def test_segments_split_on_gaps(spark, times, spans, chunk):
    got = rows(segs(spark, dets(spark, times), chunk=chunk).select("start_t", "end_t", "duration_weight"), "start_t")
    assert got == spans


def test_floor_is_strict(spark):
    assert segs(spark, dets(spark, [0, 0.5], vis=0.001)).count() == 0
    assert segs(spark, dets(spark, [0, 0.5], vis=0.02)).count() == 0


def test_two_tracks_are_two_segments_of_one_brand(spark):
    df = dets(spark, [0, 0.5, 1, 1.5], 1).union(dets(spark, [0, 0.5, 1, 1.5], 2))
    brand = rows(X.brand_exposure(segs(spark, df)).select("segment_count", "total_exposure_s", "longest_segment_s"))
    assert brand == [(2, 4.0, 2.0)]
    merged = rows(X.merged_intervals(segs(spark, df), X.BRAND).select("start_t", "end_t"))
    assert merged == [(0.0, 2.0)]


def test_empty_input(spark):
    empty = dets(spark, [])
    assert X.brand_exposure(segs(spark, empty)).count() == 0
    assert X.timeline_intervals(empty).count() == 0


def plain_runs(times, gap):
    out = []
    for t in sorted(set(times)):
        if out and t - out[-1][1] <= gap:
            out[-1][1] = t
        else:
            out.append([t, t])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("seed", range(4))
def test_runs_do_not_depend_on_chunks_or_partitions(spark, seed):
    rng = random.Random(seed)
    times = [rng.randrange(400) * 0.5 for _ in range(250)]
    want = plain_runs(times, 1.25)
    for chunk, parts in ((900.0, 1), (7.0, 7), (1.0, 3)):
        got = rows(X.exposure_runs(dets(spark, times).repartition(parts), chunk=chunk).select("start_t", "last_t"), "start_t")
        assert got == want


@pytest.mark.parametrize("seed", range(4))
def test_long_intervals_merge_over_chunks(spark, seed):
    rng = random.Random(seed)
    spans = [(s, s + rng.choice([1, 2, 30])) for s in (rng.randrange(200) for _ in range(25))]
    want = []
    for s, e in sorted(spans):
        if want and s <= want[-1][1]:
            want[-1][1] = max(want[-1][1], e)
        else:
            want.append([s, e])
    df = spark.createDataFrame([(1, float(s), float(e)) for s, e in spans], "video_id bigint, start_t double, end_t double")
    got = rows(X.merged_intervals(df, ["video_id"], chunk=5.0).select("start_t", "end_t"), "start_t")
    assert got == [tuple(map(float, w)) for w in want]


def test_placement_labels_and_price(spark):
    labels = ["Live Broadcast TV", " live stream ", "Highlight", "social media clip", "Radio", None]
    df = spark.createDataFrame([(x,) for x in labels], "l string")
    assert [r[0] for r in df.select(V.placement_multiplier(F.col("l"))).collect()] == [1.0, 0.85, 1.4, 0.7, 1.0, 1.0]
    value = spark.range(1).select(V.emv(F.lit(10.0), F.lit(20.0), F.lit(1_000_000), F.lit(1.0))).first()[0]
    assert value == pytest.approx(200_000.0)


def test_category_multipliers(spark):
    hits = spark.createDataFrame(
        [(1, "a", 0.0), (1, "b", 0.0), (1, "c", 5.0), (1, "d", 1.0), (2, "a", 1.0)], "video_id bigint, brand_key string, t double"
    )
    cats = spark.createDataFrame([("a", "bank"), ("b", "bank"), ("c", "bank"), ("d", "beer")], "brand_key string, category string")
    got = {(r.video_id, r.brand_key): r.category_multiplier for r in X.category_multipliers(hits, cats).collect()}
    assert got == {(1, "a"): 0.8, (1, "b"): 0.8, (1, "c"): 1.0, (1, "d"): 1.25, (2, "a"): 1.25}


def test_prime_time_splits_segments(spark):
    seg = spark.createDataFrame([(1, "a", 1, 50.0, 2000.0, 0.5, 1.2)], "video_id bigint, brand_key string, track_id bigint, start_t double, end_t double, avg_visibility double, duration_weight double")
    clock = spark.createDataFrame([(1, 100.0, 3000.0)], "video_id bigint, kickoff_s double, whistle_s double")
    got = rows(X.prime_time_split(seg, clock).select("phase", "start_t", "end_t", "prime_multiplier"), "start_t")
    assert got == [("pre", 50.0, 100.0, 0.7), ("opening", 100.0, 1000.0, 1.3), ("middle", 1000.0, 2000.0, 1.0)]
    short = spark.createDataFrame([(1, 100.0, 600.0)], "video_id bigint, kickoff_s double, whistle_s double")
    assert [r[0] for r in rows(X.prime_time_split(seg, short).select("phase", "start_t"), "start_t")] == ["pre", "opening", "post"]


def test_cumulative_matches_plain_sum(spark):
    spans = [(0.0, 12.0, 0.5), (4.0, 6.0, 0.25), (10.0, 10.5, 1.0)]
    df = spark.createDataFrame([(1, "a", *s) for s in spans], "video_id bigint, brand_key string, start_t double, end_t double, avg_visibility double")
    lengths = spark.createDataFrame([(1, 20.0)], "video_id bigint, duration_s double")
    got = dict(rows(X.cumulative_exposure(df, lengths, step=5.0).select("t", "cumulative"), "t"))
    want = {t: sum(max(0.0, min(e, t) - s) * v for s, e, v in spans if s < t) for t in (0.0, 5.0, 10.0, 15.0, 20.0)}
    assert got == pytest.approx(want)


def test_one_hot_key(spark):
    """A third of the rows on one key, most at the same times: the result is whole."""
    hot = dets(spark, [i % 50 * 0.5 for i in range(20000)], brand="hot")
    rest = dets(spark, [i * 2.0 for i in range(200)], brand="cold")
    got = {r.brand_key: r.segment_count for r in X.brand_exposure(segs(spark, hot.union(rest), chunk=5.0)).collect()}
    assert got == {"hot": 1, "cold": 200}
    assert X.exposure_runs(hot).first().hits == 20000
