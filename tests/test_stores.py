"""Label files, versioned analyses and the full analysis document."""

import datetime as dt
import json
import os
import re

import pytest

from screentime.catalog import files as catalog
from screentime.operators import exposure as X
from screentime.sources import files as FL
from screentime.sources import store
from screentime.tables import Tables


def labels(spark, rows):
    return spark.createDataFrame(rows, "image string, split string, label_text string").repartition(3)


def test_label_files_round_trip(spark, tmp_path):
    rows = [("a", "train", "0 0.1 0.2 0.3 0.4\n1 0.5 0.5 0.1 0.1"), ("b", "train", ""), ("c d%é+.x", "val", None), ("e/f", "val", "2 0 0 0 0")]
    path = str(tmp_path / "out")
    FL.write_labels(labels(spark, rows), path)
    got = {(r.image, r.split): r.label_text for r in FL.read_labels(spark, path).collect()}
    assert got == {(i, s): t or "" for i, s, t in rows}
    assert sorted(os.listdir(path)) == ["_SUCCESS", "train", "val"] and sorted(os.listdir(f"{path}/train/labels")) == ["a.txt", "b.txt"]
    with pytest.raises(Exception, match="exists"):
        FL.write_labels(labels(spark, rows), path)


def test_label_files_of_a_failed_job_do_not_show(spark, tmp_path):
    path = str(tmp_path / "bad")
    with pytest.raises(Exception, match="without image or split"):
        FL.write_labels(labels(spark, [(str(i), "train", "x") for i in range(50)] + [(None, "train", "x")]), path)
    left = os.listdir(path) if os.path.isdir(path) else []
    assert "train" not in left and "_SUCCESS" not in left
    FL.write_labels(labels(spark, [("1", "train", "x"), ("1", "train", "x")]), path)
    assert FL.read_labels(spark, path).count() == 1
    assert os.listdir(f"{path}/train/labels") == ["1.txt"]


def documents(spark, rows):
    return spark.createDataFrame(rows, "video_id bigint, document string, preview_key string")


def document(name, emv, logos, when):
    return json.dumps({"eventName": name, "videoName": "v.mp4", "videoDurationSeconds": 10.5, "analyzedAt": when, "logos": [{}] * logos, "totalEmvUsd": emv})


def test_a_second_version_takes_the_place_of_the_first(spark, tmp_path):
    path = str(tmp_path / "store")
    first = [(1, document("a", 5.0, 2, "2024-05-01T10:00:00Z"), None), (2, document("b", 7.0, 0, "2024-05-02T10:00:00.5Z"), "p/2")]
    second = [(1, document("a2", 6.5, 3, "2024-06-01T00:00:00Z"), "p/1"), (3, "{}", None)]
    store.write_analyses(documents(spark, first), path, 1)
    store.write_analyses(documents(spark, second), path, 2)
    store.write_analyses(documents(spark, second), path, 2)  # a repeated write
    rows = store.newest_first(store.read_analyses(spark, path), "analyzed_at").collect()
    assert [(r.video_id, r.version, r.event_name, r.total_emv_usd, r.logo_count, r.preview_key) for r in rows] == [
        (1, 2, "a2", 6.5, 3, "p/1"), (2, 1, "b", 7.0, 0, "p/2"), (3, 2, "", 0.0, 0, None),
    ]
    assert json.loads(rows[0].result_json)["eventName"] == "a2"
    assert spark.read.parquet(path).count() == 4
    one = store.get_analysis(spark, path, 1).collect()
    assert [(r.video_id, r.version) for r in one] == [(1, 2)] and not store.get_analysis(spark, path, 9).collect()


def test_document_with_filter_groups_and_flags(spark):
    meta = spark.createDataFrame(
        [(1, "e", "v", 10.0, 5, "Radio", 22.0, 1.0, 3, dt.datetime(2024, 1, 2, 3, 4, 5), "p", None), (2, "f", "w", 1.0, 5, None, 22.0, 1.0, 0, None, None, "b")],
        "video_id bigint, event_name string, video_name string, duration_s double, audience_size bigint, placement_type string, cpm_base double, "
        "placement_multiplier double, frames_analyzed bigint, analyzed_at timestamp, preview_key string, bodyseg_key string",
    )
    none = spark.createDataFrame([], "video_id bigint, brand_key string, brand_name string, total_emv_usd double, total_quality_s double, avg_visibility double, "
                                 "quality_exposure_s double, total_exposure_s double, segment_count bigint, longest_segment_s double, emv_usd double, start_t double, "
                                 "end_t double, duration_weight double, zone_no int, zone string, name string, percentage double")
    totals = none.select("video_id", "total_emv_usd", "total_quality_s", "avg_visibility")
    brands = none.select("video_id", "brand_key", "brand_name", "avg_visibility", "quality_exposure_s", "total_exposure_s", "segment_count", "longest_segment_s", "emv_usd")
    teams = spark.createDataFrame([(1, 2, 1)], "video_id bigint, kept bigint, dropped bigint")
    parts = spark.createDataFrame([(2, {"Head": 12.5})], "video_id bigint, groups map<string,double>")
    made = store.analysis_document(meta, totals, brands, none, none, none, teams, parts)
    one, two = (json.loads(r.document) for r in made.orderBy("video_id").collect())
    assert one["analyzedAt"] == "2024-01-02T03:04:05Z" and "analyzedAt" not in two
    assert one["teamFilter"] == {"enabled": True, "kept": 2, "dropped": 1, "dropRate": 0.333}
    assert two["teamFilter"] == {"enabled": True, "kept": 0, "dropped": 0, "dropRate": 0.0}
    assert (one["bodysegGroups"], two["bodysegGroups"]) == ({}, {"Head": 12.5})
    assert (one["previewAvailable"], one["bodysegAvailable"], two["previewAvailable"], two["bodysegAvailable"]) == (True, False, False, True)
    plain = json.loads(store.analysis_document(meta.drop("analyzed_at", "preview_key", "bodyseg_key"), totals, brands, none, none, none).first().document)
    assert "teamFilter" not in plain and plain["bodysegAvailable"] is False and plain["bodysegGroups"] == {}


def test_columns_nobody_asks_for_stay_unread(spark, tmp_path):
    path = str(tmp_path / "narrow")
    store.write_analyses(documents(spark, [(1, document("a", 5.0, 2, "2024-05-01T10:00:00Z"), None)]), path, 1)
    store.write_analyses(documents(spark, [(1, document("b", 6.0, 1, "2024-06-01T10:00:00Z"), None)]), path, 2)
    names = store.read_analyses(spark, path).select("video_id", "event_name")
    assert "result_json" not in names._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in names.collect()] == [(1, "b")]


def test_segments_meet_their_brand_as_in_a_join(spark):
    """A key that is null meets nothing, a brand that comes twice has its segments twice, segments without a brand are left out."""
    meta = spark.createDataFrame(
        [(1, "e", "v", 10.0, 5, "Radio", 22.0, 1.0, 3)],
        "video_id bigint, event_name string, video_name string, duration_s double, audience_size bigint, placement_type string, cpm_base double, "
        "placement_multiplier double, frames_analyzed bigint",
    )
    brands = spark.createDataFrame(
        [(1, "a", "A", 5.0), (1, "a", "A", 5.0), (1, "b", "B", 9.0), (1, None, "N", 1.0)], "video_id bigint, brand_key string, brand_name string, quality_exposure_s double"
    ).selectExpr("*", "0.5D avg_visibility", "1.0D total_exposure_s", "2L segment_count", "1.0D longest_segment_s", "3.0D emv_usd")
    segs = spark.createDataFrame(
        [(1, "a", 2.0, 3.0), (1, "a", 0.0, 1.0), (1, "c", 0.0, 1.0), (1, None, 4.0, 5.0), (None, "a", 6.0, 7.0)], "video_id bigint, brand_key string, start_t double, end_t double"
    ).selectExpr("*", "0.25D avg_visibility", "1.0D duration_weight")
    zones = spark.createDataFrame([], "video_id bigint, zone_no int, zone string, name string, percentage double")
    made = store.analysis_document(meta, X.analysis_totals(brands), brands, segs, zones, segs.limit(0))
    logos = json.loads(made.first().document)["logos"]
    assert [(x["id"], x["name"], x.get("class"), [p["startTime"] for p in x.get("segments", [])]) for x in logos] == [
        ("logo-0", "B", "b", []), ("logo-1", "A", "a", [0.0, 2.0]), ("logo-2", "A", "a", [0.0, 2.0]), ("logo-3", "N", None, [])]
    assert "segments" not in logos[0] and list(logos[1]) == [
        "id", "name", "class", "segments", "totalExposureSeconds", "qualityExposureSeconds", "avgVisibilityScore", "segmentCount", "longestSegmentSeconds", "emvUsd"]


def test_documents_join_parts_once_and_build_segments_once(spark, tmp_path):
    """Before, each of the plan's parts joined lineitem with part again, and segments were built for the brands and for their lists."""
    days = [dt.datetime(2024, 1, 1 + i % 9) for i in range(60)]
    line = [(i // 7 + 6, i % 3 + 25, i % 2 + 1, i % 7 + 1, 10.0 + i % 5, 100.0, 0.05, 0.01, d) for i, d in enumerate(days)]
    tables = {
        "lineitem": (line, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                           "l_tax double, l_shipdate timestamp"),
        "part": ([(25, "n1", "Brand#1", "T"), (26, "n2", "Brand#2", "T"), (27, "n3", None, "T")], "p_partkey bigint, p_name string, p_brand string, p_type string"),
        "supplier": ([(1, "S1", 1, 5.0), (2, "S2", 2, 5.0), (3, "S3", 3, 5.0)], "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = catalog.documents(Tables(spark, str(tmp_path)))
        text = made._jdf.queryExecution().executedPlan().toString()
        found = {r.video_id: json.loads(r.document) for r in made.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert "p_partkey" not in text
    assert len(re.findall(r"- Exchange hashpartitioning\(video_id#\d+L, brand_key#\d+, track_id#\d+L, t#", text)) == 1
    assert len(re.findall(r"- Exchange hashpartitioning\(__frame", text)) == 1
    assert sorted(found) == [1, 2] and all(d["logos"] and sum(z["percentage"] for z in d["bodyZones"]) > 99 for d in found.values())
    assert all(x["segmentCount"] == len(x["segments"]) for d in found.values() for x in d["logos"] if "class" in x)
