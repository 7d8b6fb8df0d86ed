"""Streamed spacing over out-of-order arrivals; frame plans as table functions."""

import datetime as dt

import pytest
from conftest import rows

from pyspark.sql import functions as F

from screentime.functions.sql import register_functions
from screentime.operators import dataset as D
from screentime.operators import frames as FO
from screentime.operators import scans as SC
from screentime.operators import selection as S
from screentime.streaming import ops as O
from screentime.streaming import run as RUN

BASE = dt.datetime(2024, 1, 1)


def hits(spark, values):
    data = [(v, b, BASE + dt.timedelta(seconds=t) if t is not None else None) for v, b, t in values]
    return spark.createDataFrame(data, "video_id bigint, brand_key string, ts timestamp").coalesce(1)


def test_spacing_over_three_arrivals_equals_the_batch_operator(spark):
    # times within 30 s of the newest may come in any order; the last row closes the stream
    first = [(1, "a", t) for t in (0, 9, 1.5, 4, 3.999, 2, 8)] + [(2, "a", 0.0), (1, "b", 7.0)]
    second = [(1, "a", t) for t in (5, 11, 30, 10, 10, 29.5)] + [(1, "b", 7.0), (2, "a", 1.999)]
    third = [(1, "a", t) for t in (31, 33, 34.9, 500)] + [(2, "a", 36), (None, "a", 40), (3, None, 41)]
    arrivals = [hits(spark, part) for part in (first, second, third, [(9, "end", 5000.0)])]
    with RUN.rocksdb(spark):
        kept = RUN.run_append_arrivals(arrivals, lambda s: O.spaced(s, ["video_id", "brand_key"], 2.0, "60 seconds"), "spacing")
        got = {(r.video_id, r.brand_key, (r.ts - BASE).total_seconds()) for r in kept.collect()}
    points = spark.createDataFrame([(v, b, float(t)) for v, b, t in first + second + third if v and b], "video_id bigint, brand_key string, t double")
    want = {tuple(r) for r in S.temporal_dedup(points, ["video_id", "brand_key"], 2.0).collect()}
    assert {g for g in got if g[0] and g[1]} == want and len(want) > 8
    assert {g[2] for g in got if not (g[0] and g[1])} == {40.0, 41.0}


def test_spacing_drops_late_rows_and_forgets(spark):
    # the second arrival lies behind the watermark (100 - 5 s) and is dropped; 102 meets a state long expired
    arrivals = [hits(spark, [(1, "a", 0.0), (1, "a", 100.0)]), hits(spark, [(1, "a", 50.0)]), hits(spark, [(1, "a", 101.9), (1, "a", 102.0), (9, "end", 900.0)])]
    with RUN.rocksdb(spark):
        kept = RUN.run_append_arrivals(arrivals, lambda s: O.spaced(s, ["video_id", "brand_key"], 2.0, "5 seconds"), "late-spacing")
        assert sorted((r.ts - BASE).total_seconds() for r in kept.where("video_id = 1").collect()) == [0.0, 100.0, 102.0]


def test_table_functions_equal_the_operators(spark):
    videos = spark.createDataFrame(
        [(1, 1000, 25.0), (2, 0, 25.0), (3, 7, 0.0), (4, None, 25.0), (5, 90_000, None), (6, 1, 60.0)], "video_id bigint, frame_count bigint, fps double"
    )
    register_functions(spark)
    full = videos.where("frame_count > 0 AND fps IS NOT NULL")
    plain = lambda df: {tuple(r) for r in df.collect()}
    via = lambda call: plain(spark.sql(f"SELECT video_id, frame_idx FROM {{v}}, LATERAL {call}", v=videos))
    assert via("st_stride_plan(frame_count, fps, 2D)") == plain(FO.stride_plan(full, 2.0))
    assert via("st_head_plan(frame_count, fps, 10D, 5D)") == plain(FO.head_plan(full, 10.0, 5.0))
    assert via("st_interior_plan(frame_count, 30L)") == plain(FO.interior_plan(videos.where("frame_count > 0"), 30))
    assert via("st_interior_plan(frame_count, 1L)") == plain(FO.interior_plan(videos.where("frame_count > 0"), 1))
    assert via("st_stride_plan(frame_count, CAST(NULL AS DOUBLE), 2D)") == set()
    joined = spark.sql("SELECT video_id, count(*) AS n FROM {v}, LATERAL st_stride_plan(frame_count, fps, 0.1D) GROUP BY ALL", v=videos)
    assert rows(joined, "video_id") == [(1, 4), (3, 7), (6, 1)]


def test_slices_stay_near_the_mean_whatever_the_values(spark):
    n = 1_000_000
    values = spark.range(n).select(F.floor(F.col("id") / n).alias("k"), F.when(F.col("id") == 0, 1e12).otherwise(F.col("id") / n).alias("x"))
    sizes = [r["count"] for r in SC.sliced(values, ["k"], ["x"], 4096).groupBy("slice").count().collect()]
    assert len(sizes) > 200 and max(sizes) < 2 * sum(sizes) / len(sizes)
    points = SC.exact_percentiles(values, ["k"], "x", {"p25": 0.25, "p100": 1.0}).first()
    assert points.p25 == pytest.approx((1 + 0.25 * (n - 1)) / n) and points.p100 == 1e12


def test_numbering_of_one_hot_value(spark):
    # a third of the rows hold the key "hot" and one value: the ties split it
    rows_ = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 100)).alias("k"), F.lit(0.5).alias("x"), "id"
    )
    cut = SC.sliced(rows_, ["k"], ["x", "id"], 500)
    sizes = {r.k: r for r in cut.groupBy("k", "slice").count().groupBy("k").agg(F.max("count").alias("most"), F.count("*").alias("slices")).collect()}
    assert sizes["hot"].slices == 20 and sizes["hot"].most < 1000 and sizes["k1"].slices == 1
    numbered = SC.ranked(rows_.join(spark.createDataFrame([("hot",)], "k string"), "k"), ["k"], "x", ["id"], "rn")
    assert numbered.filter(F.col("rn") != F.col("id") / 3 + 1).count() == 0 and numbered.count() == 10_000


def test_global_numbering_with_nulls_ties_and_empty_tables(spark):
    names = spark.createDataFrame([(f"n{i * 7919 % 5000:05d}",) for i in range(5000)] + [(None,), ("n00001",)], "name string")
    ids = D.class_ids(names, "name")
    assert ids.filter(F.col("name") != F.format_string("n%05d", "class_id")).count() == 0 and ids.count() == 5000
    assert D.class_ids(names.where("false"), "name").count() == 0
    few = spark.createDataFrame([(1, None), (2, 5.0), (3, 5.0), (4, float("nan"))], "i int, x double")
    assert rows(SC.ranked(few, [], "x", ["i"], "rn").select("i", "rn"), "i") == [(1, 1), (2, 2), (3, 3), (4, 4)]
