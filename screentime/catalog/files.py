"""Round trips through the exchange files, over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from screentime.catalog import ORACLES, query
from screentime.catalog import attribution as AQ
from screentime.catalog import bodyparts as body
from screentime.catalog import core, report
from screentime.functions.visibility import placement_multiplier
from screentime.operators import attribution as A
from screentime.operators import bodyparts as B
from screentime.operators import exposure as X
from screentime.operators import frames as FO
from screentime.operators import report as R
from screentime.session import scratch_path, stored
from screentime.sources import files as FL
from screentime.sources import store
from screentime.tables import with_views


@query("read_detections_csv", with_views("ocr") + """
SELECT sponsor, count(*) AS n, round(sum(area_pct), 4) AS area, CAST(sum(fuzzy) AS BIGINT) AS fuzzy FROM v_ocr GROUP BY 1""")
def read_detections_csv(t):
    path = scratch_path(t.spark, "detections")
    rows = t.ocr().withColumn("bbox", F.concat_ws(",", *[F.lit(i) for i in (1, 2, 3, 4)]))
    FL.write_csv(rows.select("time_s", "sponsor", "text", "ocr_conf", "fuzzy", "area_pct", "cx", "cy", "bbox"), path)
    back = FL.read_detections_csv(t.spark, path)
    return back.groupBy("sponsor").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("area_pct"), 4).alias("area"), F.sum("fuzzy").alias("fuzzy"))


@query("read_frame_scores_csv", with_views("frame") + """
SELECT frame_idx AS idx, count(*) AS n, CAST(sum(n_target) AS BIGINT) AS n_target, round(sum(sharp), 4) AS sharp FROM v_frame GROUP BY 1""")
def read_frame_scores_csv(t):
    path = scratch_path(t.spark, "scores")
    rows = FO.with_composite(t.frames()).select(
        F.concat_ws("_", "video_id", "frame_idx").alias("saved_as"), F.col("frame_idx").alias("idx"), "time_s", "sharp", "n_target",
        "max_target_h", "is_closeup", "grass_ratio", "crowd_score",
    )
    FL.write_csv(rows, path)
    return FL.read_frame_scores_csv(t.spark, path).groupBy("idx").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_target").alias("n_target"), F.round(F.sum("sharp"), 4).alias("sharp")
    )


def candidates(t):
    box = F.array(F.array(*[F.lit(i).cast("bigint") for i in (0, 0, 10, 20)]))
    return FO.with_composite(t.frames()).select(
        "frame_idx", "time_s", "composite", "sharp", "n_target", (F.col("n_persons") - F.col("n_target")).alias("n_other"), "avg_target_h",
        "max_target_h", "is_closeup", "crowd_score", "grass_ratio", box.alias("target_boxes"), box.alias("other_boxes"),
        F.lpad(F.hex(F.col("phash")[0]), 16, "0").alias("phash"), F.col("video_id").cast("string").alias("source_video"),
    )


@query("read_frame_scores_json", with_views("frame") + """
SELECT CAST(video_id AS VARCHAR) AS source_video, count(*) AS n, CAST(sum(n_target) AS BIGINT) AS n_target FROM v_frame GROUP BY 1""")
def read_frame_scores_json(t):
    path = scratch_path(t.spark, "candidates")
    rows = candidates(t)
    rows.write.json(path)
    return candidate_counts(FL.read_frame_scores_json(t.spark, path, lines=True))


def candidate_counts(rows):
    return rows.groupBy("source_video").agg(F.count(F.lit(1)).alias("n"), F.sum("n_target").alias("n_target"))


@query("read_frame_scores_lists", ORACLES["read_frame_scores_json"])
def read_frame_scores_lists(t):
    # One file per video with one list, as the frame selector caches its candidates.
    path = scratch_path(t.spark, "candidate-lists")
    lists = candidates(t).groupBy("source_video").agg(F.to_json(F.collect_list(F.struct("*"))).alias("value"))
    lists.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return candidate_counts(FL.read_frame_scores_json(t.spark, path))


@query("read_coco", """
SELECT CAST(l_linenumber AS BIGINT) AS class_id, 'class_' || l_linenumber AS name, count(*) AS n, sum(l_quantity * 4) AS width,
       (SELECT count(*) FROM (SELECT o_orderkey FROM orders UNION SELECT l_orderkey FROM lineitem) i) AS images FROM lineitem GROUP BY 1, 2""")
def read_coco(t):
    # One document per image: no task ever builds a document of the whole set.
    path = scratch_path(t.spark, "coco")
    images, ann = AQ.coco(t)
    boxes = ann.groupBy("image_id").agg(F.collect_list(F.struct(
        F.lit(0).cast("bigint").alias("id"), "image_id", F.col("class_id").alias("category_id"), F.array("x", "y", "bw", "bh").alias("bbox")
    )).alias("anns"))
    docs = images.join(boxes, "image_id", "full").select(
        F.array(F.struct(F.col("image_id").alias("id"), F.concat(F.lit("clip_"), F.col("image_id").cast("string"), F.lit(".jpg")).alias("file_name"),
                         F.lit(1920).alias("width"), F.lit(1080).alias("height"))).alias("images"),
        F.coalesce("anns", F.array().cast(boxes.schema["anns"].dataType)).alias("annotations"),
        F.transform(F.sequence(F.lit(1).cast("bigint"), F.lit(7).cast("bigint")), lambda i: F.struct(
            i.alias("id"), F.concat(F.lit("class_"), i.cast("string")).alias("name"))).alias("categories"),
    )
    docs.write.json(path)
    images, ann, cats = FL.read_coco(t.spark, path, lines=True)
    per_class = ann.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"), F.sum("bw").alias("width"))
    return per_class.join(cats.distinct(), "class_id").crossJoin(images.agg(F.count_distinct("image_id").alias("images")))


@query("read_label_csv", "SELECT CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS label, count(*) AS n FROM labels GROUP BY 1")
def read_label_csv(t):
    path = scratch_path(t.spark, "labels")
    rows = t.raw("labels").select(
        F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")).alias("filename"), F.lit("x").alias("path"),
        F.when(F.col("quality") == 1, " good").otherwise("bad ").alias("label"),
    )
    FL.write_csv(rows, path)
    return FL.read_label_csv(t.spark, path).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


_EVEN = "round_even({0} * {1}, 0) / {1} AS {0}"


@query("write_report_csv", with_views("ocr", extra=report._BEST + ",\n" + report._REPORT) + f"""
SELECT video_id, sponsor, {_EVEN.format("total_seconds", "10.0")}, n_appearances, n_frames, {_EVEN.format("peak_area_pct", "1000.0")},
       {_EVEN.format("first_seen_s", "10.0")}, {_EVEN.format("last_seen_s", "10.0")} FROM v_report""")
def write_report_csv(t):
    path = scratch_path(t.spark, "report")
    rep = R.exposure_report(t.ocr(), report.SCOPE)
    FL.write_report_csv(rep, path)
    back = t.spark.read.csv(path, header=True, schema="video_id bigint, sponsor string, total_seconds double, n_appearances bigint, n_frames bigint, "
                            "avg_area_pct double, peak_area_pct double, area_seconds double, avg_cx double, avg_cy double, avg_ocr_conf double, "
                            "first_seen_s double, last_seen_s double")
    return back.select("video_id", "sponsor", "total_seconds", "n_appearances", "n_frames", "peak_area_pct", "first_seen_s", "last_seen_s")


@query("write_brand_csv", with_views("priced") + """
SELECT brand_key AS class, count(*) AS n, CAST(sum(segment_count) AS BIGINT) AS segments, round(sum(total_exposure_s), 1) AS seconds FROM v_priced GROUP BY 1""")
def write_brand_csv(t):
    path = scratch_path(t.spark, "brands")
    FL.write_csv(FL.brand_export(core.priced(t).withColumn("brand_name", F.col("brand_key"))), path)
    back = t.spark.read.csv(path, header=True, schema="brand string, class string, total_exposure_seconds double, quality_exposure_seconds double, "
                            "avg_visibility_score double, segment_count bigint, longest_segment_seconds double, emv_usd double")
    return back.groupBy("class").agg(
        F.count(F.lit(1)).alias("n"), F.sum("segment_count").alias("segments"), F.round(F.sum("total_exposure_seconds"), 1).alias("seconds")
    )


@query("write_pricing_csv", ORACLES["pricing_join"])
def write_pricing_csv(t):
    # Half of the columns come back from the full table, half from the summary.
    full_path, exec_path = scratch_path(t.spark, "pricing"), scratch_path(t.spark, "summary")
    priced = R.emv_gbp(report.agg(t))
    full = R.full_price_table(priced, R.price_recommendation(priced, ["video_id"]), ["video_id"])
    FL.write_pricing_csv(full, full_path, exec_path)
    exec_schema = StructType([full.schema[c] for c in ("video_id", *R.EXEC_COLUMNS)])
    table, summary = t.spark.read.csv(full_path, header=True, schema=full.schema), t.spark.read.csv(exec_path, header=True, schema=exec_schema)
    both = table.select(*report.SCOPE, "screen_time_s", "screen_time_pct", "fair_price_season_gbp").join(
        summary.select(*report.SCOPE, "eff_area_sec", "emv_gbp", "fair_price_match_gbp"), report.SCOPE
    )
    return both.select(*report.SCOPE, "screen_time_s", "screen_time_pct", "eff_area_sec", "emv_gbp", "fair_price_match_gbp", "fair_price_season_gbp")


def documents(t, light: bool = False):
    """Documents of all matches; light ones without zones and timelines."""
    if not light:
        t = t.keeping_hits()
    priced = core.priced(t)
    frames = t.detections().select("video_id", "t").distinct().groupBy("video_id").agg(F.count(F.lit(1)).alias("frames_analyzed"))
    matches = t.matches().select("video_id", "duration_s", (F.col("match_date").cast("timestamp") + F.expr("INTERVAL 1.5 SECONDS")).alias("analyzed_at"))
    meta = (
        t.meta().join(matches, "video_id").join(frames, "video_id", "left")
        .withColumn("placement_multiplier", placement_multiplier(F.col("placement_type")))
        .withColumn("preview_key", F.when(F.col("video_id") % 3 == 0, F.concat(F.lit("previews/"), F.col("video_id").cast("string"))))
    )
    zones, spans = A.zone_share(AQ.assigned(t, beside_verdicts=True), ["video_id"], t.meta()), X.timeline_intervals(t.detections())
    teams, parts = A.team_filter_stats(AQ.verdicts(t, beside_zones=True)), B.bodypart_group8(body.pixels(t), ["video_id"])
    if light:
        zones, spans, teams, parts = zones.limit(0), spans.limit(0), None, None
    return store.analysis_document(
        meta, X.analysis_totals(priced), priced.withColumn("brand_name", F.col("brand_key")), core.segs(t), zones, spans, teams, parts
    ).join(meta.select("video_id", "preview_key"), "video_id")


@query("write_analysis_store", with_views("priced", "match") + """
SELECT m.video_id, m.event_name, m.video_name, m.duration_s AS video_duration_s, coalesce(round_even(sum(emv_usd), 2), 0) AS total_emv_usd,
       count(brand_key) AS logo_count, CAST(2 AS BIGINT) AS version, epoch_us(CAST(m.match_date AS TIMESTAMP)) + 1500000 AS analyzed_at
FROM v_match m LEFT JOIN v_priced p ON p.video_id = m.video_id GROUP BY 1, 2, 3, 4, m.match_date""")
def write_analysis_store(t):
    # The first version knows no brands; the second one of the same ids takes its place.
    path = scratch_path(t.spark, "analyses")
    full = stored(documents(t, light=True), "documents")
    first = full.withColumn("document", F.regexp_replace("document", r'"totalEmvUsd":[^,]*', '"totalEmvUsd":-1'))
    store.write_analyses(first, path, 1)
    store.write_analyses(full, path, 2)
    rows = store.newest_first(store.read_analyses(t.spark, path), "analyzed_at")
    return rows.select("video_id", "event_name", "video_name", "video_duration_s", "total_emv_usd", "logo_count", "version", F.unix_micros("analyzed_at").alias("analyzed_at"))


@query("analysis_document", with_views("priced", "match", "det") + """
SELECT m.video_id, m.event_name, count(brand_key) AS logos, CAST(coalesce(sum(segment_count), 0) AS BIGINT) AS segments, 18 AS zones,
       coalesce(round_even(sum(emv_usd), 2), 0) AS total_emv,
       (SELECT count(DISTINCT t) FROM v_det d WHERE d.video_id = m.video_id) AS frames, arg_min(brand_key, (round(-quality_exposure_s, 9), brand_key)) AS first_logo
FROM v_match m LEFT JOIN v_priced p ON p.video_id = m.video_id GROUP BY 1, 2""")
def analysis_document(t):
    docs = documents(t)
    field = lambda path: F.get_json_object("document", path)
    logos = F.from_json(field("$.logos"), "array<struct<class:string,segmentCount:bigint>>")
    zones = F.from_json(field("$.bodyZones"), "array<struct<id:string>>")
    count = F.aggregate(logos, F.lit(0).cast("bigint"), lambda acc, x: acc + x["segmentCount"])
    return docs.select(
        "video_id", field("$.eventName").alias("event_name"), F.size(logos).cast("bigint").alias("logos"), count.alias("segments"),
        F.size(zones).alias("zones"), field("$.totalEmvUsd").cast("double").alias("total_emv"),
        field("$.metadata.framesAnalyzed").cast("bigint").alias("frames"), logos[0]["class"].alias("first_logo"),
    )


_NUMBERS = "n1 n2 n3 n4 n5 n6 n7 n8".split()


def _row(part: str, source: str, *numbers: str, name: str = "''", no: str = "0") -> str:
    shown = [f"CAST({numbers[i]} AS DOUBLE) AS {n}" if i < len(numbers) else f"CAST(NULL AS DOUBLE) AS {n}" for i, n in enumerate(_NUMBERS)]
    return f"SELECT video_id, '{part}' AS part, {name} AS name, CAST({no} AS BIGINT) AS no, {', '.join(shown)} FROM {source}"


_e = "round_even({}, {})".format
_FLAT = "\nUNION ALL ".join((
    _row("document", f"""(SELECT m.video_id, m.event_name, m.duration_s, a.audience_size, a.cpm_base, CASE lower(trim(a.placement_type)) WHEN 'live broadcast tv' THEN 1.0
      WHEN 'live stream' THEN 0.85 WHEN 'highlight clip' THEN 1.4 WHEN 'social media' THEN 0.7 ELSE 1.0 END AS mult,
      (SELECT count(DISTINCT t) FROM v_det d WHERE d.video_id = m.video_id) AS frames, coalesce({_e("sum(emv_usd)", 2)}, 0) AS emv,
      coalesce({_e("sum(quality_exposure_s)", 2)}, 0) AS quality, coalesce({_e("round(avg(avg_visibility), 9)", 2)}, 0) AS vis
      FROM v_match m JOIN v_meta a ON a.video_id = m.video_id LEFT JOIN v_priced p ON p.video_id = m.video_id GROUP BY ALL) x""",
         "duration_s", "audience_size", "cpm_base", "mult", "frames", "emv", "quality", "vis", name="event_name"),
    _row("logo", "(SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY round(quality_exposure_s, 9) DESC, brand_key) - 1 AS no FROM v_priced) x",
         _e("total_exposure_s", 1), _e("quality_exposure_s", 2), _e("round(avg_visibility, 9)", 2), "segment_count", _e("longest_segment_s", 1), _e("emv_usd", 2), name="brand_key", no="no"),
    _row("segment", "v_seg", _e("start_t", 2), _e("end_t", 2), _e("avg_visibility", 3), "duration_weight", name="brand_key"),
    _row("zone", "v_share", _e("percentage", 1), name="zone"),
    _row("interval", "v_span", _e("start_t", 2), _e("end_t", 2), name="brand_key"),
    _row("team", "v_match LEFT JOIN v_team USING (video_id)", "coalesce(kept, 0)", "coalesce(dropped, 0)", "coalesce(round_even(dropped / CAST(kept + dropped AS DOUBLE), 3), 0)"),
    _row("bodypart", "q JOIN v_match USING (video_id)", _e("pct", 1), name="body_part"),
    _row("flags", "v_match", "CASE WHEN video_id % 3 = 0 THEN 1 ELSE 0 END", "0", "epoch_us(CAST(match_date AS TIMESTAMP)) + 1500000"),
))


@query("analysis_document_flat", with_views("priced", "match", "det", "logo", "person", "vis", extra=AQ._OWNER + ",\n" + AQ._ZONE + f""",
v_w AS (SELECT z.video_id, z.zone, sum(greatest(v.visibility, 1e-6)) AS wt FROM v_zone z JOIN v_vis v ON z.video_id = v.video_id AND z.det_id = v.det_id GROUP BY 1, 2),
v_share AS (SELECT g.video_id, g.zone, coalesce(w.wt / s.total * 100, 0) AS percentage
  FROM (SELECT * FROM (SELECT video_id FROM v_match) d CROSS JOIN (SELECT unnest([{", ".join(f"'{z}'" for z, _ in A.ZONES)}]) AS zone) n) g
  LEFT JOIN v_w w ON w.video_id = g.video_id AND w.zone = g.zone LEFT JOIN (SELECT video_id, sum(wt) AS total FROM v_w GROUP BY 1) s ON s.video_id = g.video_id),
v_span AS ({core._SPAN}),
v_team AS (SELECT video_id, count(*) FILTER (WHERE keep) AS kept, count(*) FILTER (WHERE NOT keep) AS dropped FROM v_verdict GROUP BY 1),
{body._cte(B.COARSE_GROUPS).strip().removeprefix("WITH ")}
""") + _FLAT)
def analysis_document_flat(t):
    """Every number of the documents, one row per entry of each list."""
    schema = """eventName string, videoDurationSeconds double, analyzedAt string, metadata struct<audienceSize double, cpmBase double, placementMultiplier double, framesAnalyzed double>,
      logos array<struct<class string, segments array<struct<startTime double, endTime double, avgVisibility double, durationWeight double>>,
        totalExposureSeconds double, qualityExposureSeconds double, avgVisibilityScore double, segmentCount double, longestSegmentSeconds double, emvUsd double>>,
      bodyZones array<struct<id string, percentage double>>, detectionTimeline array<struct<class string, intervals array<struct<start double, `end` double>>>>,
      totalEmvUsd double, totalQualityExposureSeconds double, avgVisibilityScore double, previewAvailable boolean, bodysegAvailable boolean,
      bodysegGroups map<string, double>, teamFilter struct<kept double, dropped double, dropRate double>"""
    d = documents(t).select("video_id", F.from_json("document", schema).alias("d"))

    def entry(part, *numbers, name=F.lit(""), no=F.lit(0)):
        padded = [*numbers, *[F.lit(None)] * (len(_NUMBERS) - len(numbers))]
        return F.struct(F.lit(part).alias("part"), name.alias("name"), no.cast("bigint").alias("no"), *[v.cast("double").alias(n) for v, n in zip(padded, _NUMBERS)])

    f = lambda path: F.col(f"d.{path}")
    rows = F.concat(
        F.array(
            entry("document", f("videoDurationSeconds"), f("metadata.audienceSize"), f("metadata.cpmBase"), f("metadata.placementMultiplier"),
                  f("metadata.framesAnalyzed"), f("totalEmvUsd"), f("totalQualityExposureSeconds"), f("avgVisibilityScore"), name=f("eventName")),
            entry("team", f("teamFilter.kept"), f("teamFilter.dropped"), f("teamFilter.dropRate")),
            entry("flags", f("previewAvailable"), f("bodysegAvailable"), F.unix_micros(f("analyzedAt").cast("timestamp"))),
        ),
        F.transform(f("logos"), lambda x, i: entry(
            "logo", x["totalExposureSeconds"], x["qualityExposureSeconds"], x["avgVisibilityScore"], x["segmentCount"], x["longestSegmentSeconds"], x["emvUsd"], name=x["class"], no=i)),
        F.flatten(F.transform(f("logos"), lambda x: F.transform(x["segments"], lambda s: entry(
            "segment", s["startTime"], s["endTime"], s["avgVisibility"], s["durationWeight"], name=x["class"])))),
        F.transform(f("bodyZones"), lambda x: entry("zone", x["percentage"], name=x["id"])),
        F.flatten(F.transform(f("detectionTimeline"), lambda x: F.transform(x["intervals"], lambda s: entry("interval", s["start"], s["end"], name=x["class"])))),
        F.transform(F.map_entries(f("bodysegGroups")), lambda x: entry("bodypart", x["value"], name=x["key"])),
    )
    return d.select("video_id", F.inline(rows))
