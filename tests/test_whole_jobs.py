"""Whole jobs, and plans that do not grow in one task."""

import datetime as dt

from screentime.catalog.evaluation import phash_near_pairs
from screentime.catalog.portfolio import brand_match_emv
from screentime.operators import exposure as X
from screentime.operators import frames as FO
from screentime.operators import report as R
from screentime.sources import files as FL
from screentime.streaming import ops as O
from screentime.streaming import run as RUN
from screentime.tables import Tables

LINES = """l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_shipdate timestamp, l_quantity double, l_extendedprice double,
    l_tax double, l_discount double"""


def tables(spark, path, lines, brands=1, videos=1):
    """A data folder: lines as (order, line, part, video), parts with a brand each, videos."""
    rows = [(o, n, p, v, dt.datetime(2024, 1, 1), 50.0, 1000.0, 0.0, 0.05) for o, n, p, v in lines]
    spark.createDataFrame(rows, LINES).write.parquet(f"{path}/lineitem.parquet")
    parts = [(p, f"Brand#{p}", "type") for p in range(1, brands + 1)]
    spark.createDataFrame(parts, "p_partkey bigint, p_brand string, p_type string").write.parquet(f"{path}/part.parquet")
    sellers = [(v, f"S{v}", 1, 100.0) for v in range(1, videos + 1)]
    spark.createDataFrame(sellers, "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{path}/supplier.parquet")
    return Tables(spark, str(path))


def test_hash_pairs_are_told_across_videos(spark, tmp_path):
    # one frame each of two videos: the same base hash, the hit counts 1 and 501 differ in one bit
    lines = [(40, 1, 1, v) for v, hits in ((1, 1), (2, 501)) for _ in range(hits)]
    got = phash_near_pairs(tables(spark, tmp_path, lines)).collect()
    assert [(sorted((r.video_id, r.video_id_b)), r.n_a, r.n_b, r.distance) for r in got] == [([1, 2], 1, 1, 1)]


def test_every_brand_meets_every_match(spark, tmp_path):
    # seven brands in the first of two matches, at the frame's centre; the second match shows one of them
    lines = [(10, 1, p, 1) for p in range(22, 29)] + [(10, 2, 22, 2)]
    got = {(r.video_id, r.brand_key) for r in brand_match_emv(tables(spark, tmp_path, lines, brands=28, videos=2)).collect()}
    shown = {b for _, b in got}
    assert len(shown) == 7 and got == {(v, b) for v in (1, 2) for b in shown}


def plan(df):
    return df._jdf.queryExecution().toString()


def test_keys_of_one_bucket_are_spaced_apart(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(v, b, base + dt.timedelta(seconds=t)) for v, b, t in [(1, "a", 0), (1, "a", 1), (1, "a", 2), (2, "a", 1), (None, "a", 5), (None, "a", 6), (1, None, 5), (9, "end", 9000)]]
    arrivals = [spark.createDataFrame(part, "video_id bigint, brand_key string, ts timestamp").coalesce(1) for part in (rows[:5], rows[5:])]
    with RUN.rocksdb(spark):
        kept = RUN.run_append_arrivals(arrivals, lambda s: O.spaced(s, ["video_id", "brand_key"], 2.0, "60 seconds", buckets=1), "bucket")
        got = {(r.video_id, r.brand_key, (r.ts - base).total_seconds()) for r in kept.collect()}
    assert got - {(9, "end", 9000.0)} == {(1, "a", 0.0), (1, "a", 2.0), (2, "a", 1.0), (None, "a", 5.0), (1, None, 5.0)}


def test_label_texts_are_read_by_name_without_a_listing(spark, tmp_path):
    path = str(tmp_path / "labels")
    rows = spark.createDataFrame([("a b", "x/y", "0 1"), ("c", "val", "")], "image string, split string, label_text string")
    FL.write_labels(rows, path)
    back = FL.read_labels(spark, path)
    assert {tuple(r) for r in back.collect()} == {("a b", "x/y", "0 1"), ("c", "val", "")}
    assert back.inputFiles() and all("/images/" in f for f in back.inputFiles())


def test_frame_plans_are_spread_before_they_are_listed(spark):
    videos = spark.createDataFrame([(1, 40, 1.0), (1, 40, 1.0), (1, 10, 1.0), (2, 3, 25.0), (3, 0, 25.0)], "video_id bigint, frame_count bigint, fps double").coalesce(1)
    got = FO.uniform_plus_dense(videos, 3, 7)
    want = {(1, f) for f in (0, 19, 39, 7, 14, 21, 28, 35, 4, 9)} | {(2, f) for f in (0, 1, 2)} | {(3, 0), (3, -1)}
    found = [tuple(r) for r in got.collect()]
    assert set(found) == want and len(found) == len(want)
    assert "REPARTITION_BY_NUM" in plan(got)


def test_points_are_dealt_to_a_given_number_of_tasks(spark):
    hits = spark.createDataFrame([(1, "a", 0, 0.5, 0.9)], "video_id bigint, brand_key string, track_id bigint, t double, visibility double")
    runs = X.exposure_runs(hits)
    ocr = spark.createDataFrame([(1, "s", 0.0, "d", 0.1, 0.5, 0.5, 0.9)], "video_id bigint, sponsor string, time_s double, det_id string, area_pct double, cx double, cy double, ocr_conf double")
    for df, exchanges in ((runs, 3), (X.merged_intervals(X.segments(runs), X.BRAND), 6), (X.timeline_intervals(hits), 3), (R.exposure_report(ocr, ["video_id", "sponsor"]), 3)):
        physical = plan(df).split("Physical Plan")[1]
        assert physical.count("REPARTITION_BY_NUM") >= exchanges and runs.count() == 1
