"""Exposure report and price list from OCR rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from screentime.catalog import query
from screentime.operators import report as R
from screentime.tables import with_views

SCOPE = ["video_id", "sponsor"]


def r(col, digits=6):
    return F.round(col, digits).alias(col)


@query("drop_blank_sponsor", with_views("ocr") + """
SELECT det_id, video_id, sponsor FROM (SELECT det_id, video_id, CASE line_no WHEN 1 THEN '' WHEN 2 THEN NULL ELSE sponsor END AS sponsor FROM v_ocr) x
WHERE sponsor IS NOT NULL AND sponsor <> ''""")
def drop_blank_sponsor(t):
    blanked = F.when(F.col("line_no") == 1, "").when(F.col("line_no") == 2, None).otherwise(F.col("sponsor"))
    return R.drop_blank_sponsor(t.ocr().withColumn("sponsor", blanked)).select("det_id", "video_id", "sponsor")


_BEST = """v_best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, sponsor, time_s ORDER BY area_pct DESC, det_id) AS rn FROM v_ocr) x WHERE rn = 1)"""


@query("best_per_frame", with_views("ocr", extra=_BEST) + """
SELECT video_id, sponsor, time_s, det_id, area_pct, ocr_conf FROM v_best""")
def best_per_frame(t):
    return R.best_per_frame(t.ocr(), [*SCOPE, "time_s"], ["ocr_conf"])


@query("appearance_runs", with_views("ocr", extra="v_hit AS (SELECT DISTINCT video_id, sponsor, time_s FROM v_ocr)") + """
SELECT video_id, sponsor, CAST(sum(opens) AS BIGINT) AS n_appearances FROM (
  SELECT *, CASE WHEN time_s - lag(time_s) OVER (PARTITION BY video_id, sponsor ORDER BY time_s) <= 2 THEN 0 ELSE 1 END AS opens FROM v_hit) x GROUP BY 1, 2""")
def appearance_runs(t):
    from screentime.operators.scans import dealt, merge_runs

    times = dealt(t.ocr().select(*SCOPE, "time_s"), *SCOPE, "time_s").distinct()
    points = times.select(*SCOPE, F.col("time_s").alias("a"), F.col("time_s").alias("b"))
    return merge_runs(points, SCOPE, "a", "b", 2.0).groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("n_appearances"))


_REPORT = """v_report AS (
  SELECT video_id, sponsor, CAST(count(*) AS DOUBLE) AS total_seconds, CAST(sum(opens) AS BIGINT) AS n_appearances, count(*) AS n_frames,
         avg(area_pct) AS avg_area_pct, max(area_pct) AS peak_area_pct, sum(area_pct) AS area_seconds, avg(cx) AS avg_cx, avg(cy) AS avg_cy,
         avg(ocr_conf) AS avg_ocr_conf, min(time_s) AS first_seen_s, max(time_s) AS last_seen_s
  FROM (SELECT *, CASE WHEN time_s - lag(time_s) OVER (PARTITION BY video_id, sponsor ORDER BY time_s) <= 2 THEN 0 ELSE 1 END AS opens FROM v_best) x GROUP BY 1, 2)"""


@query("exposure_report", with_views("ocr", extra=_BEST + ",\n" + _REPORT) + """
SELECT video_id, sponsor, total_seconds, n_appearances, n_frames, round(avg_area_pct, 12) AS avg_area_pct, peak_area_pct, round(area_seconds, 6) AS area_seconds,
       round(avg_cx, 12) AS avg_cx, round(avg_cy, 12) AS avg_cy, round(avg_ocr_conf, 12) AS avg_ocr_conf, first_seen_s, last_seen_s FROM v_report""")
def exposure_report(t):
    rep = R.exposure_report(t.ocr(), SCOPE)
    fine = {"avg_area_pct", "avg_cx", "avg_cy", "avg_ocr_conf"}
    return rep.select(*[r(c, 12) if c in fine else r(c, 6) if c == "area_seconds" else F.col(c) for c in rep.columns])


@query("pct_of_match", with_views("ocr") + """
SELECT video_id, sponsor, count(DISTINCT time_s) * 100.0 / 40.0 AS pct_of_match FROM v_ocr GROUP BY 1, 2""")
def pct_of_match(t):
    return R.pct_of_match(R.exposure_report(t.ocr(), SCOPE), F.lit(40.0)).select(*SCOPE, "pct_of_match")


_PRICE = """v_per AS (
  SELECT video_id, sponsor, count(*) AS n_detections, CAST(count(*) AS DOUBLE) AS screen_time_s,
    round_even((sum(f)) * 10000, 0) / 10000 AS raw_area_sec, round_even((sum(qi)) * 10000, 0) / 10000 AS eff_area_sec, avg(qi) AS mean_qi, avg(area_pct) AS mean_area_pct, max(area_pct) AS peak_area_pct,
    avg(pos) AS mean_pos, avg(cl) AS mean_clarity, avg(ocr_conf) AS mean_ocr_conf, min(time_s) AS first_seen_s, max(time_s) AS last_seen_s
  FROM (SELECT *, f * pos * cl AS qi FROM (
    SELECT *, area_pct / 100 AS f, exp(-0.5 * ((cx - 0.5) ** 2 + (cy - 0.5) ** 2) / 0.16) AS pos, least(1.0, area_pct / 100 / 0.003) AS cl FROM v_ocr) a) b GROUP BY 1, 2),
v_price AS (SELECT p.*, d + 1.0 AS video_duration_s, round_even((screen_time_s / (d + 1.0) * 100) * 10, 0) / 10 AS screen_time_pct,
    round_even((eff_area_sec * 45.0) * 100, 0) / 100 AS emv_gbp, round_even((raw_area_sec * 45.0) * 100, 0) / 100 AS emv_raw_gbp
  FROM v_per p JOIN (SELECT video_id AS v, max(time_s) AS d FROM v_ocr GROUP BY 1) m ON p.video_id = m.v)"""


def agg(t):
    return R.pricing_agg(t.ocr(), ["video_id"])


@query("pricing_agg", with_views("ocr", extra=_PRICE) + """
SELECT video_id, sponsor, n_detections, screen_time_s, raw_area_sec, eff_area_sec, round_even((mean_qi) * 10000, 0) / 10000 AS mean_qi, round_even((mean_pos) * 10000, 0) / 10000 AS mean_pos,
       round_even((mean_clarity) * 10000, 0) / 10000 AS mean_clarity, round_even((peak_area_pct) * 10000, 0) / 10000 AS peak_area_pct, first_seen_s, last_seen_s, screen_time_pct FROM v_price""")
def pricing_agg(t):
    return agg(t).select(
        *SCOPE, "n_detections", "screen_time_s", "raw_area_sec", "eff_area_sec", "mean_qi", "mean_pos", "mean_clarity",
        "peak_area_pct", "first_seen_s", "last_seen_s", "screen_time_pct",
    )


@query("video_duration_infer", with_views("ocr") + """
SELECT video_id, max(time_s) + 1.0 AS video_duration_s FROM v_ocr GROUP BY 1""")
def video_duration_infer(t):
    return R.video_duration(t.ocr(), ["video_id"], 1.0)


@query("cpes", """
SELECT s_suppkey AS video_id, round(18.0 * (250.0 + s_nationkey) / 30.0 * 0.3, 6) AS cpes FROM supplier""")
def cpes(t):
    per_second = F.lit(R.CPM_GBP) * (F.lit(R.VIEWERS_K) + F.col("s_nationkey")) / 30.0 * F.lit(R.DISCOUNT)
    return t.raw("supplier").select(F.col("s_suppkey").alias("video_id"), F.round(per_second, 6).alias("cpes"))


@query("emv_gbp", with_views("ocr", extra=_PRICE) + """
SELECT video_id, sponsor, emv_gbp, emv_raw_gbp, round_even(((1 - emv_gbp / nullif(emv_raw_gbp, 0)) * 100) * 10, 0) / 10 AS quality_disc_pct FROM v_price""")
def emv_gbp(t):
    return R.emv_gbp(agg(t)).select(*SCOPE, "emv_gbp", "emv_raw_gbp", "quality_disc_pct")


_FAIR = "round_even((emv_gbp * 0.75) * 100, 0) / 100"


@query("price_recommendation", with_views("ocr", extra=_PRICE) + """
SELECT video_id, sponsor, screen_time_s, emv_gbp, fair AS fair_price_match_gbp, round_even(fair * 27, 0) AS fair_price_season_gbp,
       round_even((emv_gbp / nullif(fair, 0)) * 100, 0) / 100 AS sponsor_roi_x FROM (SELECT *, """ + _FAIR + """ AS fair FROM v_price) p""")
def price_recommendation(t):
    return R.price_recommendation(R.emv_gbp(agg(t)), ["video_id"])


@query("sensitivity", with_views("ocr", extra=_PRICE) + """
SELECT scenario, CAST(viewers_k AS DOUBLE) AS viewers_k, CAST(discount AS DOUBLE) AS discount, round(18.0 * viewers_k / 30 * discount, 6) AS cpes,
       round((SELECT sum(eff_area_sec) FROM v_price) * (18.0 * viewers_k / 30 * discount), 6) AS total_emv_gbp
FROM (VALUES ('Live TV (Sky Sports)', 250, 0.30), ('Highlights (YouTube)', 500, 0.10), ('Social clip (<1 min)', 1500, 0.08), ('Match recording (OTT)', 80, 0.30)) s(scenario, viewers_k, discount)""")
def sensitivity(t):
    s = R.sensitivity(agg(t))
    return s.select("scenario", "viewers_k", "discount", r("cpes"), r("total_emv_gbp"))


@query("pricing_join", with_views("ocr", extra=_PRICE) + """
SELECT video_id, sponsor, screen_time_s, screen_time_pct, eff_area_sec, emv_gbp, fair AS fair_price_match_gbp, round_even(fair * 27, 0) AS fair_price_season_gbp
FROM (SELECT *, """ + _FAIR + """ AS fair FROM v_price) p""")
def pricing_join(t):
    priced = R.emv_gbp(agg(t))
    full = R.full_price_table(priced, R.price_recommendation(priced, ["video_id"]), ["video_id"])
    return full.select(
        *SCOPE, "screen_time_s", "screen_time_pct", "eff_area_sec", "emv_gbp", "fair_price_match_gbp", "fair_price_season_gbp"
    )


@query("audit_counts", with_views("ocr") + "SELECT sponsor, count(*) AS n FROM v_ocr GROUP BY 1")
def audit_counts(t):
    return R.audit_counts(t.ocr())


@query("audit_lowest_confidence", with_views("ocr") + """
SELECT video_id, det_id, sponsor, ocr_conf FROM v_ocr ORDER BY ocr_conf, video_id, det_id LIMIT 10""")
def audit_lowest_confidence(t):
    return R.lowest_confidence(t.ocr()).select("video_id", "det_id", "sponsor", "ocr_conf")


@query("distinct_brands", with_views("ocr") + """
SELECT count(DISTINCT sponsor) AS sponsors, count(DISTINCT (video_id, time_s)) AS frames, count(*) AS detections FROM v_ocr""")
def distinct_brands(t):
    # One pre-aggregation to distinct frames keeps the counts free of a row expansion.
    frames = t.ocr().groupBy("sponsor", "video_id", "time_s").agg(F.count(F.lit(1)).alias("n"))
    sponsors = frames.groupBy("sponsor").agg(F.sum("n").alias("n")).agg(
        F.count(F.lit(1)).alias("sponsors"), F.sum("n").alias("detections")
    )
    sampled = frames.select("video_id", "time_s").distinct().agg(F.count(F.lit(1)).alias("frames"))
    return sponsors.crossJoin(sampled).select("sponsors", "frames", "detections")


@query("distinct_brands_approx", with_views("ocr") + """
SELECT count(DISTINCT sponsor) AS sponsors, count(DISTINCT (video_id, time_s)) AS frames, true AS sponsors_near, true AS frames_near FROM v_ocr""")
def distinct_brands_approx(t):
    # Estimates next to the exact counts: inside three standard errors of five percent.
    near = t.ocr().agg(
        F.approx_count_distinct("sponsor", 0.05).alias("s"), F.approx_count_distinct(F.struct("video_id", "time_s"), 0.05).alias("f")
    )
    inside = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 0.15 * F.col(b)
    both = distinct_brands(t).crossJoin(near)
    return both.select("sponsors", "frames", inside("s", "sponsors").alias("sponsors_near"), inside("f", "frames").alias("frames_near"))


@query("sampled_frames", with_views("det") + "SELECT video_id, count(DISTINCT t) AS sampled_frames FROM v_det GROUP BY 1")
def sampled_frames(t):
    hits = t.detections().select("video_id", "t").distinct()
    return hits.groupBy("video_id").agg(F.count(F.lit(1)).alias("sampled_frames"))


@query("minmax_heatmap", with_views("ocr", extra="""
v_m AS (SELECT sponsor, avg(area_pct) AS a, avg(ocr_conf) AS b FROM v_ocr GROUP BY 1)""") + """
SELECT sponsor, round(CASE WHEN max(a) OVER () > min(a) OVER () THEN (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) ELSE 0 END, 6) AS mean_area_pct,
       round(CASE WHEN max(b) OVER () > min(b) OVER () THEN (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) ELSE 0 END, 6) AS mean_ocr_conf FROM v_m""")
def minmax_heatmap(t):
    from screentime.operators.portfolio import minmax_heatmap as scale

    means = t.ocr().groupBy("sponsor").agg(F.avg("area_pct").alias("mean_area_pct"), F.avg("ocr_conf").alias("mean_ocr_conf"))
    return scale(means, ["mean_area_pct", "mean_ocr_conf"]).select("sponsor", r("mean_area_pct"), r("mean_ocr_conf"))


@query("union_sources", with_views("ocr") + """
SELECT video_id, source, count(*) AS n, round(sum(area_pct), 6) AS area FROM (
  SELECT video_id, area_pct, 'jersey' AS source FROM v_ocr WHERE line_no <= 4 UNION ALL SELECT video_id, area_pct, 'board' FROM v_ocr WHERE line_no > 4) u GROUP BY 1, 2""")
def union_sources(t):
    from screentime.operators.dataset import union_sources as unite

    ocr = t.ocr()
    both = unite(ocr.filter("line_no <= 4"), ocr.filter("line_no > 4"))
    return both.groupBy("video_id", "source").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("area_pct"), 6).alias("area"))


@query("best_per_class_export", with_views("ocr") + """
SELECT video_id, time_s, sponsor, det_id, ocr_conf FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id, time_s, sponsor ORDER BY ocr_conf DESC, det_id) AS rn FROM v_ocr WHERE ocr_conf >= CAST(0.88 AS DOUBLE) AND fuzzy >= 90) x WHERE rn = 1""")
def best_per_class_export(t):
    from screentime.operators.dataset import best_per_class

    return best_per_class(t.ocr()).select("video_id", "time_s", "sponsor", "det_id", "ocr_conf")


@query("class_ids", with_views("ocr") + """
SELECT sponsor, row_number() OVER (ORDER BY sponsor) - 1 AS class_id FROM (SELECT DISTINCT sponsor FROM v_ocr) s""")
def class_ids(t):
    from screentime.operators.dataset import class_ids as number

    return number(t.ocr(), "sponsor")
