"""Files, streams, evaluation, splits and portfolio edge cases."""

import datetime as dt
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from screentime.operators import dataset as D
from screentime.operators import evaluation as E
from screentime.operators import frames as FO
from screentime.operators import portfolio as P
from screentime.session import scratch_path
from screentime.sources import files as FL
from screentime.streaming import ops as O
from screentime.streaming import run as RUN

HEADER = "time_s,sponsor,text,ocr_conf,fuzzy,area_pct,cx,cy,bbox"


def test_detection_file_forms(spark, tmp_path):
    good, empty, bad = tmp_path / "a.csv", tmp_path / "b.csv", tmp_path / "c.csv"
    good.write_text(HEADER + '\n4.0,AON,AN,0.956,80,0.031,0.612,0.371,"1159,391,1191,411"\n')
    empty.write_text("no detections\n")
    bad.write_text(HEADER.replace("sponsor", "brand") + "\n4.0,AON,AN,0.956,80,0.031,0.612,0.371,x\n")
    row = FL.read_detections_csv(spark, str(good)).first()
    assert (row.sponsor, row.fuzzy, row.bbox) == ("AON", 80, "1159,391,1191,411")
    for order in ("0-empty.csv", "z-empty.csv"):
        folder = tmp_path / order.replace(".", "-")
        folder.mkdir()
        (folder / "b-good.csv").write_text(good.read_text())
        (folder / order).write_text("no detections\n")
        mixed = FL.read_detections_csv(spark, str(folder))
        assert mixed.count() == 1 and [r.sponsor for r in mixed.collect()] == ["AON"]
    none = FL.read_detections_csv(spark, str(empty))
    assert none.count() == 0 and none.columns == HEADER.split(",")
    with pytest.raises(Exception, match="(?i)header|schema"):
        FL.read_detections_csv(spark, str(bad)).collect()


def test_coco_document(spark, tmp_path):
    doc = {
        "images": [{"id": 1, "file_name": "clip_01_a.jpg", "width": 100, "height": 50}, {"id": 2, "file_name": "b.jpg", "width": 10, "height": 10}],
        "annotations": [{"id": 7, "image_id": 1, "category_id": 3, "bbox": [10, 5, 20, 10]}],
        "categories": [{"id": 3, "name": "aon"}],
    }
    path = tmp_path / "coco.json"
    path.write_text(json.dumps(doc, indent=1))
    images, ann, cats = FL.read_coco(spark, str(path))
    assert cats.first().name == "aon"
    lines = dict(rows(D.yolo_lines(D.annotations_by_image(images, ann)), "image_id"))
    assert lines == {1: "3 0.200000 0.200000 0.200000 0.200000", 2: ""}


def test_binary_catalog_filters(spark, tmp_path):
    for name, size in (("a.MP4", 10), ("b.mov", 5000), ("c.txt", 1)):
        (tmp_path / name).write_bytes(b"x" * size)
    got = FL.read_binary_catalog(spark, str(tmp_path), [".mp4", ".mov"], 100).collect()
    assert [r.path.rsplit("/", 1)[1] for r in got] == ["a.MP4"]


EVENT = "event_id bigint, ts timestamp, track_id bigint, brand_key string, value double"
T0 = dt.datetime(2024, 1, 1)


def stream_of(spark, batches):
    """Files read one per trigger, in order."""
    import os
    import time

    path = scratch_path(spark, "in")
    for i, items in enumerate(batches):
        df = spark.createDataFrame([(n, T0 + dt.timedelta(seconds=s), 1, "a", 1.0) for n, s in items], EVENT)
        df.coalesce(1).write.mode("append").json(f"{path}/part={i}")
        stamp = time.time() - 1000 + i * 10
        for name in os.listdir(f"{path}/part={i}"):
            os.utime(f"{path}/part={i}/{name}", (stamp, stamp))
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(path)


def test_late_rows_are_dropped_behind_the_watermark(spark):
    # A batch drops rows by the watermark of the batch before it.
    src = stream_of(spark, [[(1, 0), (2, 600)], [(5, 601)], [(3, 30)], [(4, 595)]])
    out = RUN.run_update(O.windowed_exposure(src, "1 minute", None, "10 seconds"), "late", ["brand_key", "window_start"])
    got = {r.window_start: r.hits for r in out.collect()}
    # The first minute closed at 590 s, so row 3 is late; row 4 still counts.
    assert got == {T0: 1, T0 + dt.timedelta(seconds=600): 2, T0 + dt.timedelta(seconds=540): 1}


def test_session_gap_is_inclusive(spark):
    df = spark.createDataFrame([(i, T0 + dt.timedelta(seconds=s), 1, "a", 1.0) for i, s in enumerate([0, 10, 20, 31])], EVENT)
    assert [r.hits for r in O.exposure_sessions(df, "10 seconds", "1 second").orderBy("start_ts").collect()] == [3, 1]


def test_resent_rows_are_dropped_across_batches(spark):
    src = stream_of(spark, [[(1, 0), (2, 5)], [(1, 0), (3, 6)]])
    out = RUN.run_append(O.dedup(src, ["event_id"], "1 hour"), "dedup")
    assert sorted(r.event_id for r in out.collect()) == [1, 2, 3]


def batches_of(spark, schema, batches):
    """A stream that reads one row set per trigger, in order."""
    import os
    import time

    path = scratch_path(spark, "batches")
    for i, items in enumerate(batches):
        spark.createDataFrame(items, schema).coalesce(1).write.json(f"{path}/part={i}")
        for name in os.listdir(f"{path}/part={i}"):
            os.utime(f"{path}/part={i}/{name}", (time.time() - 1000 + i * 10,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(path)


def at(second):
    return T0 + dt.timedelta(seconds=second)


VOTES = "video_id bigint, track_id bigint, ts timestamp, team string, weight double"


def test_votes_out_of_order_over_three_batches(spark):
    votes = [(0, "other", 1.0), (1, "target", 1.0), (2, "target", 0.5), (3, "someone", 9.0), (4, "other", 0.75)]
    rows = [(1, 1, at(s), team, w) for s, team, w in votes]
    order = [[rows[2], rows[0]], [rows[4], rows[1]], [rows[3]], [(9, 9, at(9000), "other", 1.0)]]
    make = lambda: O.team_votes(batches_of(spark, VOTES, order), ["target", "other"])
    got = RUN.run_stateful(make, spark, "votes_out").filter("video_id = 1").orderBy("ts").collect()
    assert [(r.ts, r.label) for r in got] == [(at(i), label) for i, label in enumerate(["other", "other", "target", "target", "target"])]
    assert got[-1].mass == 3.25


def test_votes_behind_the_watermark_are_dropped(spark):
    order = [[(1, 1, at(0), "other", 1.0)], [(1, 1, at(600), "target", 9.0)], [(1, 1, at(601), "target", 1.0)], [(1, 1, at(1), "other", 50.0)], [(9, 9, at(9000), "other", 1.0)]]
    make = lambda: O.team_votes(batches_of(spark, VOTES, order), ["target", "other"])
    got = RUN.run_stateful(make, spark, "votes_late").filter("video_id = 1").orderBy("ts").collect()
    assert [(r.ts, r.label) for r in got] == [(at(0), "other"), (at(600), "target"), (at(601), "target")]


def test_coast_out_of_order_equals_the_batch_operator(spark):
    from screentime.operators import team as TM

    schema = "video_id bigint, track_id bigint, frame_idx bigint, ts timestamp"
    rows = [(1, k, i, at(i)) for k, i in ((1, 0), (1, 3), (1, 30), (2, 4), (2, 5), (2, 5), (1, 2))]
    order = [[rows[2], rows[3]], [rows[1], rows[4], rows[5]], [rows[0], rows[6]], [(9, 9, 0, at(9000))]]
    got = RUN.run_stateful(lambda: O.track_coast(batches_of(spark, schema, order), frame_ms=1000), spark, "coast_out").filter("video_id = 1")
    boxes = spark.createDataFrame(rows, schema).select("video_id", "track_id", "frame_idx").distinct()
    want = TM.track_coast(boxes, hold=8)
    key = ["video_id", "track_id", "frame_idx", "drawn_idx", "held"]
    assert rows_of(got, key) == rows_of(want, key)


def rows_of(df, columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_owner_stream_tells_unowned_logos(spark):
    logo, person = "video_id bigint, ts timestamp, det_id string, cx double, cy double", "video_id bigint, ts timestamp, person_id string, x1 double, y1 double, x2 double, y2 double"
    logos = [(1, at(0), "in", 5.0, 5.0), (1, at(1), "near", 12.0, 5.0), (1, at(1), "far", 900.0, 5.0), (9, at(9000), "", 0.0, 0.0)]
    persons = [(1, at(0), "small", 0.0, 0.0, 10.0, 10.0), (1, at(0), "big", 0.0, 0.0, 99.0, 99.0), (1, at(1), "small", 0.0, 0.0, 10.0, 10.0), (9, at(9000), "", 0.0, 0.0, 1.0, 1.0)]
    out = O.logo_owners(batches_of(spark, logo, [logos[2:3], logos[:2], logos[3:]]), batches_of(spark, person, [persons[2:3], persons[:2], persons[3:]]), "1 minute")
    got = RUN.run_append(out, "owners").filter("video_id = 1")
    assert {r.det_id: r.person_id for r in got.collect()} == {"in": "small", "near": "small", "far": None}


def test_progress_counts_brands_over_batches(spark):
    rows = [[(1, at(0), 1, "a", 1.0), (2, at(1), 1, "b", 0.0)], [(3, at(2), 1, "c", 1.0), (4, at(3), 1, "a", 0.0)]]
    table = RUN.progress_table(batches_of(spark, EVENT, rows), "progress", "brand_key", {"hits": F.count(F.lit(1)), "kept": F.count_if(F.col("value") >= 1)})
    got = table.agg(F.count_distinct("brand_key").alias("brands"), F.sum("hits").alias("hits"), F.sum("kept").alias("kept")).first()
    assert tuple(got) == (3, 4, 2)


def test_auc_counts_pairs(spark):
    data = [(0.1, 0), (0.4, 0), (0.4, 1), (0.35, 1), (0.8, 1), (0.8, 0)]
    pairs = [(p, n) for p, a in data if a for n, b in data if not b]
    want = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in pairs) / len(pairs)
    df = spark.createDataFrame([("m", *d) for d in data], "method string, score double, label int")
    assert E.roc_auc(df, ["method"]).first().auc == pytest.approx(want)
    assert E.roc_auc(df.filter("label = 1"), ["method"]).first().auc == 0.5
    assert tuple(E.pr_at_threshold(df, ["method"], 0.4).first())[1:] == pytest.approx((0.5, 2 / 3))
    assert E.best_f1_threshold(df.filter("label = 0"), ["method"]).first().f1 == 0.0


def test_split_keeps_clips_whole(spark):
    images = spark.createDataFrame([(i, f"clip_{i % 9}") for i in range(90)], "image_id bigint, clip string")
    ann = spark.createDataFrame([(i, i % 4) for i in range(90)], "image_id bigint, class_id int")
    split = D.group_aware_split(images, ann, seeds=20)
    assert split.count() == 9 and split.select("seed").distinct().count() == 1
    assert D.split_overlap(split, "clip").count() == 0
    assert split.filter("split = 'val'").count() == 2


RESULT = "video_id bigint, brand_key string, emv_usd double, total_exposure_s double, quality_exposure_s double, avg_visibility double, segment_count bigint"


def test_portfolio_edges(spark):
    res = spark.createDataFrame([(1, "a", 10.0, 4.0, 2.0, 0.5, 2), (2, "a", 10.0, 0.0, 0.0, 0.9, 1), (1, "b", 5.0, 1.0, 1.0, 0.2, 1)], RESULT)
    matches = spark.createDataFrame([(1, dt.date(2024, 1, 1), 60.0), (2, dt.date(2024, 1, 2), 30.0), (3, dt.date(2024, 1, 3), 10.0)], "video_id bigint, match_date date, duration_s double")
    port = {r.brand_key: r for r in P.brand_portfolio(res).collect()}
    assert (port["a"].visibility, port["a"].match_count) == (0.5, 2)
    wide = P.heatmap_wide(P.heatmap(res, matches), [1, 2, 3])
    assert rows(wide, "brand_key") == [("a", 10.0, 10.0, 0.0), ("b", 5.0, 0.0, 0.0)]
    assert rows(P.top8_plus_other(P.brand_portfolio(res), 1), "brand_key") == [("Other", 5.0), ("a", 20.0)]
    assert P.top8_plus_other(P.brand_portfolio(res), 8).count() == 2
    assert sum(r.sov for r in P.share_of_voice(P.brand_portfolio(res), P.brand_portfolio(res)).collect()) == pytest.approx(1.0)
    assert [r.brand_key for r in P.brands_in_all_matches(res, matches.filter("video_id < 3")).collect()] == ["a"]
    order = matches.select("video_id", F.col("video_id").alias("position"))
    assert rows(P.best_matches(res.withColumn("total_exposure_s", F.lit(1.0)), order), "brand_key")[0] == ("a", 2, 2)
    empty = res.filter("false")
    assert P.portfolio_kpis(empty, matches).first().footage_s == 100.0


def test_gates_in_order(spark):
    cols = "grass_ratio double, crowd_score double, n_persons int, n_target int, max_target_h double, torso_sharp double"
    data = [(0.1, 0.9, 0, 0, 0.0, 0.0), (0.5, 0.9, 0, 0, 0.0, 0.0), (0.5, 0.5, 1, 0, 0.0, 0.0), (0.5, 0.5, 2, 0, 0.0, 0.0), (0.5, 0.5, 2, 1, 0.1, 9.0), (0.2, 0.5, 2, 1, 0.2, 20.0), (0.5, 0.5, 2, 1, 0.2, 9.0), (0.5, 0.5, 2, 1, 0.2, 15.0)]
    df = spark.createDataFrame(data, cols)
    from screentime.functions.frames import gate_reason

    assert [r[0] for r in df.select(gate_reason()).collect()] == ["grass_ratio", "crowd", "n_persons", "no_target_player", "max_tgt_h", "ok", "ok", "ok"]
    assert FO.passing_frames(df).count() == 1
