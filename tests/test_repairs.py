"""Values that the synthetic tables do not hold."""

import json

from pyspark.sql import functions as F

from screentime.functions import text as T
from screentime.functions import vector as V
from screentime.functions.sql import register_functions
from screentime.operators import attribution as A
from screentime.operators import exposure as X
from screentime.operators import selection as S
from screentime.operators import team
from screentime.sources import store


def test_title_case_after_digits_and_signs(spark):
    df = spark.createDataFrame([("7up",), ("o'neil-fc",), ("em_two",), ("",), (None,), ("élan",)], "k string")
    assert [r[0] for r in df.select(T.title_name(F.col("k"))).collect()] == ["7Up", "O'Neil Fc", "Em Two", "", None, "Élan"]


def test_frames_without_hash_only_keep_their_distance(spark):
    big = (1 << 62) + 1
    rows = [
        ("v", 1, 9.0, 0.0, [big, 0, 0, 0], 0.5), ("v", 2, 8.0, 10.0, None, 0.5), ("v", 3, 7.0, 11.0, None, 0.5), ("v", 4, 6.0, 20.0, [big, 0, 0, 0], 0.5),
        ("v", 5, 5.0, 30.0, [~big, -1, -1, -1], 0.5),
    ]
    frames = spark.createDataFrame(rows, "video_id string, frame_idx bigint, composite double, time_s double, phash array<bigint>, max_target_h double")
    assert [r.frame_idx for r in S.diverse_topk(frames, 10).orderBy("frame_idx").collect()] == [1, 2, 5]


def test_unit_vectors_of_many_numbers(spark):
    df = spark.range(20).select(F.transform(F.sequence(F.lit(1), F.lit(512)), lambda x: (x * (F.col("id") + 1)).cast("double")).alias("a"))
    for (u,) in df.select(V.unit(F.col("a"))).collect():
        assert abs(sum(x * x for x in u) - 1) < 1e-6
    one = spark.range(1).select(V.softmax(F.array(F.lit(1.0), F.lit(2.0))).alias("s"), V.unit(F.lit(None).cast("array<double>")).alias("n")).first()
    assert abs(sum(one.s) - 1) < 1e-6 and one.n is None


BRANDS = "video_id bigint, brand_key string, quality_exposure_s double, avg_visibility double"


def test_video_without_metadata_is_priced_with_defaults(spark):
    brands = spark.createDataFrame([(1, "a", 10.0, 0.5), (2, "a", 10.0, 0.5), (3, "a", 10.0, 0.5)], BRANDS)
    meta = spark.createDataFrame(
        [(1, 20.0, 1000, "Highlight"), (3, None, 1000, None), (4, 20.0, 1000, "Radio")],
        "video_id bigint, cpm_base double, audience_size bigint, placement_type string",
    )
    priced = X.price_brands(brands, meta)
    assert {r.video_id: round(r.emv_usd, 6) for r in priced.collect()} == {1: 280.0, 2: 0.0, 3: 220.0}
    totals = {r.video_id: (r.brand_count, r.total_emv_usd, r.avg_visibility) for r in X.analysis_totals(priced, meta).collect()}
    assert totals.keys() == {1, 3, 4} and totals[4] == (0, 0.0, 0.0)


def test_segments_without_clock_or_duration_stay(spark):
    seg = spark.createDataFrame(
        [(1, "a", 1, 2.0, 12.0, 0.5, 1.0)],
        "video_id bigint, brand_key string, track_id bigint, start_t double, end_t double, avg_visibility double, duration_weight double",
    )
    clock = spark.createDataFrame([], "video_id bigint, kickoff_s double, whistle_s double")
    pieces = X.prime_time_split(seg, clock)
    assert [(r.start_t, r.end_t, r.phase, r.prime_multiplier) for r in pieces.collect()] == [(2.0, 12.0, None, 1.0)]
    lengths = spark.createDataFrame([], "video_id bigint, duration_s double")
    grid = X.cumulative_exposure(seg, lengths, step=5.0)
    assert {r.t: r.cumulative for r in grid.collect()} == {0.0: 0.0, 5.0: 1.5, 10.0: 4.0, 15.0: 5.0}


def test_coast_of_a_video_without_last_frame(spark):
    boxes = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "video_id bigint, track_id bigint, frame_idx bigint")
    end = spark.createDataFrame([(1, 2)], "video_id bigint, last_idx bigint")
    drawn = team.track_coast(boxes, last_frame=end).groupBy("video_id").count()
    assert {r.video_id: r["count"] for r in drawn.collect()} == {1: 3, 2: 9}


def test_all_slots_of_a_video_without_logos(spark):
    assigned = spark.createDataFrame([(1, "sock-l", 0.5)], "video_id bigint, zone string, visibility double")
    share = A.zone_share(assigned, ["video_id"], spark.range(1, 3).select(F.col("id").alias("video_id"))).collect()
    assert len(share) == 36
    assert {(r.video_id, r.zone): r.percentage for r in share if r.percentage} == {(1, "sock-l"): 100.0}


def test_equal_distance_takes_the_slot_laid_out_first(spark):
    picked = spark.createDataFrame([(1, 0.0, "p", 5.0, 0.0)], "video_id bigint, t double, person_id string, cx double, cy double")
    anchored = spark.createDataFrame(
        [(1, 0.0, "p", [(0, "chest-center", 4.0, 0.0), (1, "chest-l", 6.0, 0.0)])],
        "video_id bigint, t double, person_id string, anchors array<struct<zone_no:int,zone:string,x:double,y:double>>",
    )
    assert A.zone_assign(picked, anchored).first().zone == "chest-l"


def test_document_of_a_video_without_brands(spark):
    meta = spark.createDataFrame(
        [(7, "e", "v", 10.0, 5, "Radio", 22.0, 1.0, None)],
        "video_id bigint, event_name string, video_name string, duration_s double, audience_size bigint, placement_type string, "
        "cpm_base double, placement_multiplier double, frames_analyzed bigint",
    )
    none = spark.createDataFrame([], BRANDS)
    priced = none.select(
        "*", *[F.lit(0.0).alias(c) for c in ("emv_usd", "total_exposure_s", "longest_segment_s")], F.lit(0).alias("segment_count"), F.lit("").alias("brand_name")
    )
    zones = spark.createDataFrame([], "video_id bigint, zone_no int, zone string, name string, percentage double")
    spans = spark.createDataFrame([], "video_id bigint, brand_key string, start_t double, end_t double")
    segs = spans.select("*", F.lit(0.5).alias("avg_visibility"), F.lit(1.0).alias("duration_weight"))
    doc = json.loads(store.analysis_document(meta, X.analysis_totals(priced), priced, segs, zones, spans).first().document)
    assert doc["logos"] == doc["bodyZones"] == doc["detectionTimeline"] == []
    assert doc["totalEmvUsd"] == 0 and doc["metadata"]["framesAnalyzed"] == 0


def test_labels_of_a_chunk_with_many_rows(spark):
    live = spark.range(45_000).select(
        F.lit(1).alias("video_id"), F.lit(1).alias("track_id"), (F.col("id") / 50.0).alias("t"),
        F.when(F.col("id") < 20_000, 1.0).otherwise(2.0).alias("cum_a"), F.when(F.col("id") < 30_000, 1.0).otherwise(3.0).alias("cum_b"),
    )
    shown = team.hysteresis_labels(live, ["a", "b"]).groupBy("label").count()
    assert {r.label: r["count"] for r in shown.collect()} == {"a": 30_000, "b": 15_000}


def test_sql_functions_of_nulls_and_odd_frames(spark):
    register_functions(spark)
    assert spark.sql("SELECT st_visibility(NULL, 1, 1, 1, 1, 10, 10) AS v").first().v is None
    assert spark.sql("SELECT st_visibility(0, 0, 5, 5, 1, 0, 0) AS v").first().v == 0.0
    got = spark.sql("SELECT st_placement(' Highlight ') AS a, st_placement(NULL) AS b, st_emv(10, 20, 1000, 'Radio') AS c").first()
    assert (got.a, got.b, got.c) == (1.4, 1.0, 200.0)


def test_despaced_key_wins_over_the_whole_part(spark):
    from screentime.operators import report

    texts = spark.createDataFrame([("floor toni",), ("floortonic",), ("",), (None,)], "text string")
    names = spark.createDataFrame([("floor tonic", "FLOOR TONIC"), ("floor toric", "FLOOR TORIC")], "key string, sponsor string")
    got = {r.text: (r.sponsor, r.fuzzy) for r in report.match_sponsors(texts, names).collect()}
    # spaced 95.24 counts as 95; despaced 90 stays behind it
    assert got == {"floor toni": ("FLOOR TONIC", 95), "floortonic": ("FLOOR TONIC", 100)}
    # 88.9 on both sides: the despaced key is above 88
    same = spark.createDataFrame([("abcdx",)], "text string")
    keys = spark.createDataFrame([("abcd", "B"), ("bcdx", "A"), ("a bcd", "C")], "key string, sponsor string")
    assert report.match_sponsors(same, keys).first().sponsor == "B"


def test_ratio_of_nulls_and_long_texts(spark):
    from screentime.functions import text

    rows = spark.createDataFrame([("ab" * 400, "ba" * 400), (None, "a"), ("", ""), ("a", "")], "a string, b string")
    got = [r[0] for r in rows.select(text.indel_ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [100.0 * 799 / 800, None, 100.0, 0.0]


def test_voting_advances_on_logo_frames_only(spark):
    from screentime.plans import analysis

    schema = "video_id bigint, t double, person_id string, track_id bigint, team_pred string, margin double, quality double, team string"
    people = spark.createDataFrame(
        [
            (1, 0.0, "a", 5, "other", 0.75, 9.0, "x"),  # no logo here: not counted
            (1, 1.0, "a", 5, "target", 0.75, 1.0, "x"),
            (1, 2.0, "a", 5, None, None, None, "x"),
            (1, 2.0, "b", -1, "target", 0.75, 1.0, "x"),
            (1, 2.0, "c", None, None, 0.0, 0.0, "x"),
            (1, 3.0, "a", 5, "other", 0.75, 1.2, "x"),
            (1, 4.0, "a", 5, "other", 0.75, 0.2, "x"),
        ],
        schema,
    )
    logos = spark.createDataFrame([(1, t) for t in (1.0, 2.0, 3.0, 4.0, 4.0)], "video_id bigint, t double")
    got = sorted((r.t, r.person_id, r.team, round(r.vote_mass, 6)) for r in analysis.label_persons(people, logos).collect())
    assert got == [
        (1.0, "a", "target", 1.0), (2.0, "a", "target", 1.0), (2.0, "b", "target", 0.0), (2.0, "c", "other", 0.0),
        (3.0, "a", "target", 2.2), (4.0, "a", "other", 2.4),
    ]


def test_analysis_classifies_persons_from_features(spark):
    from screentime.plans import analysis

    refs = spark.createDataFrame([("target", [1.0, 0.0], [1.0, 0.0]), ("other", [0.0, 1.0], [0.0, 1.0])], "team string, embedding array<double>, color array<double>")
    box = "x1 double, y1 double, x2 double, y2 double"
    people = spark.createDataFrame(
        [(1, 0.0, "p", 1, 1.0, [1.0, 0.0], [1.0, 0.0], 0.0, 0.0, 100.0, 100.0), (1, 0.0, "q", 2, 9.0, [0.0, 1.0], [0.0, 1.0], 500.0, 0.0, 600.0, 100.0)],
        f"video_id bigint, t double, person_id string, track_id bigint, quality double, embedding array<double>, color array<double>, {box}",
    )
    logo = "video_id bigint, t double, det_id string, brand_key string, track_id bigint, cx double, cy double, w double, h double, conf double"
    logos = spark.createDataFrame([(1, 0.0, "l", "kept", 0, 50.0, 50.0, 40.0, 20.0, 0.9), (1, 0.0, "m", "gone", 0, 550.0, 50.0, 40.0, 20.0, 0.9)], logo)
    logos = logos.withColumns({"frame_w": F.lit(1920.0), "frame_h": F.lit(1080.0)})
    kept = analysis.keep_team(
        logos, analysis.label_persons(analysis.VO.classify(people, refs, 0.6, 0.4), logos), ["video_id", "t", "det_id"], analysis.Settings()
    )
    assert [r.brand_key for r in kept.collect()] == ["kept"]
