"""Visibility, segments, brand exposure and media value."""

from __future__ import annotations

from pyspark.sql import functions as F

from screentime.catalog import query
from screentime.functions.sql import register_functions
from screentime.operators import exposure as X
from screentime.tables import Tables, with_views


def r(col: str, digits: int = 6):
    return F.round(col, digits).alias(col)


def scored(t: Tables):
    return X.score_detections(t.detections())


def runs(t: Tables):
    return X.exposure_runs(scored(t))


def segs(t: Tables):
    return X.segments(runs(t))


def brands(t: Tables):
    return X.brand_exposure(segs(t))


def priced(t: Tables):
    return X.price_brands(brands(t), t.meta())


@query("visibility_score", with_views("vis") + """
SELECT det_id, video_id, round(visibility, 6) AS visibility FROM v_vis""")
def visibility_score(t):
    return scored(t).select("det_id", "video_id", r("visibility"))


@query("visible_filter", with_views("vis") + """
SELECT det_id, video_id, round(visibility, 6) AS visibility FROM v_vis WHERE visibility > 0.02""")
def visible_filter(t):
    return X.visible(scored(t)).select("det_id", "video_id", r("visibility"))


@query("exposure_runs", with_views("run") + """
SELECT video_id, brand_key, track_id, start_t, last_t, hits, round(vis_sum, 6) AS vis_sum FROM v_run""")
def exposure_runs(t):
    return runs(t).select(*X.TRACK, "start_t", "last_t", "hits", r("vis_sum"))


@query("segment_stats", with_views("seg") + """
SELECT video_id, brand_key, track_id, start_t, end_t, duration_s, duration_weight,
       round(avg_visibility, 6) AS avg_visibility, round(quality_s, 6) AS quality_s FROM v_seg""")
def segment_stats(t):
    return segs(t).select(*X.TRACK, "start_t", "end_t", "duration_s", "duration_weight", r("avg_visibility"), r("quality_s"))


@query("brand_exposure", with_views("brand") + """
SELECT video_id, brand_key, total_exposure_s, round(quality_exposure_s, 6) AS quality_exposure_s,
       round(avg_visibility, 6) AS avg_visibility, segment_count, longest_segment_s FROM v_brand""")
def brand_exposure(t):
    return brands(t).select(*X.BRAND, "total_exposure_s", r("quality_exposure_s"), r("avg_visibility"), "segment_count", "longest_segment_s")


@query("emv", with_views("priced") + """
SELECT video_id, brand_key, total_exposure_s, round(quality_exposure_s, 6) AS quality_exposure_s,
       segment_count, round(emv_usd, 2) AS emv_usd FROM v_priced""")
def emv(t):
    return priced(t).select(*X.BRAND, "total_exposure_s", r("quality_exposure_s"), "segment_count", r("emv_usd", 2))


@query("analysis_totals", with_views("priced") + """
SELECT m.video_id, coalesce(round(sum(emv_usd), 2), 0) AS total_emv_usd, coalesce(round(sum(quality_exposure_s), 6), 0) AS total_quality_s,
       coalesce(round(avg(avg_visibility), 6), 0) AS avg_visibility, count(brand_key) AS brand_count
FROM v_meta m LEFT JOIN v_priced p ON p.video_id = m.video_id GROUP BY 1""")
def analysis_totals(t):
    return X.analysis_totals(priced(t), t.meta()).select("video_id", r("total_emv_usd", 2), r("total_quality_s"), r("avg_visibility"), "brand_count")


_SPAN = """SELECT video_id, brand_key, min(t) AS start_t, max(t) + 0.5 AS end_t FROM (
  SELECT *, sum(opens) OVER (PARTITION BY video_id, brand_key ORDER BY t) AS run_no FROM (
    SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY video_id, brand_key ORDER BY t) <= 1.0 THEN 0 ELSE 1 END AS opens
    FROM (SELECT DISTINCT video_id, brand_key, t FROM v_det) d) a) b
GROUP BY video_id, brand_key, run_no"""


@query("timeline_intervals", with_views("det") + _SPAN)
def timeline_intervals(t):
    return X.timeline_intervals(t.detections())


@query("interval_merge_overlap", with_views("seg") + """
SELECT video_id, brand_key, min(start_t) AS start_t, max(end_t) AS end_t FROM (
  SELECT *, sum(opens) OVER (PARTITION BY video_id, brand_key ORDER BY start_t) AS run_no FROM (
    SELECT *, CASE WHEN start_t <= max(end_t) OVER (PARTITION BY video_id, brand_key ORDER BY start_t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
              THEN 0 ELSE 1 END AS opens
    FROM (SELECT video_id, brand_key, start_t, max(end_t) AS end_t FROM v_seg GROUP BY 1, 2, 3) s) a) b
GROUP BY video_id, brand_key, run_no""")
def interval_merge_overlap(t):
    return X.merged_intervals(segs(t), X.BRAND)


@query("brand_raw_classes", with_views("det") + """
SELECT video_id, brand_key, array_to_string(list_sort(list(DISTINCT brand_key || CASE WHEN track_id = 0 THEN '_home' ELSE '_away' END)), ',') AS raw_classes
FROM v_det GROUP BY 1, 2""")
def brand_raw_classes(t):
    raw = F.concat("brand_key", F.when(F.col("track_id") == 0, "_home").otherwise("_away"))
    return X.raw_classes(t.detections().withColumn("raw_name", raw)).withColumn("raw_classes", F.array_join("raw_classes", ","))


@query("category_multiplier", with_views("det", extra="""
v_hit AS (SELECT DISTINCT video_id, category, brand_key || '/' || category AS brand_key, t FROM v_det)""") + """
SELECT h.video_id, h.category, h.brand_key, n AS brands_in_category,
       CASE WHEN max(c.t) IS NOT NULL THEN 0.8 WHEN n = 1 THEN 1.25 ELSE 1.0 END AS category_multiplier
FROM v_hit h
JOIN (SELECT video_id, category, count(DISTINCT brand_key) AS n FROM v_hit GROUP BY 1, 2) s
  ON h.video_id = s.video_id AND h.category = s.category
LEFT JOIN (SELECT video_id, category, t FROM v_hit GROUP BY 1, 2, 3 HAVING count(*) > 1) c
  ON h.video_id = c.video_id AND h.category = c.category AND h.t = c.t
GROUP BY 1, 2, 3, 4""")
def category_multiplier(t):
    # A brand spans several part types, so brand and type together act as the brand here.
    hits = t.detections().withColumn("brand_key", F.concat_ws("/", "brand_key", "category"))
    categories = hits.select("brand_key", "category").distinct()
    return X.category_multipliers(hits.drop("category"), categories)


_CLOCK = "kickoff_s, whistle_s"


@query("prime_time_multiplier", with_views("seg", extra="""
v_zone AS (
  SELECT s.*, p.* FROM v_seg s, (VALUES ('pre', 0, 3, 0.7), ('opening', 3, 6, 1.3), ('middle', 6, 14, 1.0), ('closing', 14, 17, 1.3), ('post', 17, 1000000000, 0.7)) p(phase, lo, hi, mult)),
v_piece AS (
  SELECT video_id, brand_key, track_id, phase, avg_visibility, duration_weight, CAST(mult AS DOUBLE) AS mult,
         CASE WHEN phase = 'pre' THEN start_t ELSE greatest(start_t, lo) END AS start_t, least(end_t, hi) AS end_t
  FROM v_zone)""") + """
SELECT video_id, brand_key, track_id, phase, mult AS prime_multiplier, CAST(start_t AS DOUBLE) AS start_t, CAST(end_t AS DOUBLE) AS end_t
FROM v_piece WHERE end_t > start_t""")
def prime_time_multiplier(t):
    clock = t.meta().select("video_id", F.lit(3.0).alias("kickoff_s"), F.lit(17.0).alias("whistle_s"))
    pieces = X.prime_time_split(segs(t), clock, edge_seconds=3.0)
    return pieces.select(*X.TRACK, "phase", "prime_multiplier", "start_t", "end_t")


@query("emv_multiplied", with_views("priced", "seg", "det", extra="""
v_hit AS (SELECT DISTINCT video_id, brand_key, substr(brand_key, 7, 1) AS category, t FROM v_det),
v_size AS (SELECT video_id, category, count(DISTINCT brand_key) AS n FROM v_hit GROUP BY 1, 2),
v_shared AS (SELECT video_id, category, t FROM v_hit GROUP BY 1, 2, 3 HAVING count(*) > 1),
v_cat AS (
  SELECT h.video_id, h.brand_key, CASE WHEN max(c.t) IS NOT NULL THEN 0.8 WHEN max(n) = 1 THEN 1.25 ELSE 1.0 END AS category_multiplier
  FROM v_hit h JOIN v_size s ON h.video_id = s.video_id AND h.category = s.category
  LEFT JOIN v_shared c ON h.video_id = c.video_id AND h.category = c.category AND h.t = c.t GROUP BY 1, 2),
v_part AS (
  SELECT video_id, brand_key, avg_visibility * duration_weight * greatest(least(end_t, hi) - greatest(start_t, lo), 0) AS q, mult
  FROM v_seg, (VALUES (-1000000000, 3, 0.7), (3, 6, 1.3), (6, 14, 1.0), (14, 17, 1.3), (17, 1000000000, 0.7)) p(lo, hi, mult)),
v_prime AS (SELECT video_id, brand_key, sum(q * mult) / sum(q) AS prime_multiplier FROM v_part GROUP BY 1, 2)""") + """
SELECT p.video_id, p.brand_key, CAST(c.category_multiplier AS DOUBLE) AS category_multiplier,
       round(CAST(m.prime_multiplier AS DOUBLE), 6) AS prime_multiplier,
       round(CAST(p.emv_usd * c.category_multiplier * m.prime_multiplier AS DOUBLE), 2) AS emv_usd
FROM v_priced p JOIN v_cat c ON p.video_id = c.video_id AND p.brand_key = c.brand_key
JOIN v_prime m ON p.video_id = m.video_id AND p.brand_key = m.brand_key""")
def emv_multiplied(t):
    # The first digit of a brand stands for its category.
    dets = t.detections()
    categories = dets.select("brand_key", F.substring("brand_key", 7, 1).alias("category")).distinct()
    clock = t.meta().select("video_id", F.lit(3.0).alias("kickoff_s"), F.lit(17.0).alias("whistle_s"))
    spans = segs(t)
    factors = X.category_multipliers(dets.drop("category"), categories).select(*X.BRAND, "category_multiplier").join(
        X.prime_multipliers(X.prime_time_split(spans, clock, edge_seconds=3.0)), X.BRAND
    )
    worth = X.price_brands(X.brand_exposure(spans), t.meta(), factors).join(factors, X.BRAND)
    return worth.select(*X.BRAND, "category_multiplier", r("prime_multiplier"), r("emv_usd", 2))


@query("sql_visibility", with_views("vis") + "SELECT det_id, video_id, round(visibility, 6) AS visibility FROM v_vis")
def sql_visibility(t):
    register_functions(t.spark)
    return t.spark.sql(
        "SELECT det_id, video_id, round(st_visibility(cx, cy, w, h, conf, frame_w, frame_h), 6) AS visibility FROM {hits}", hits=t.detections()
    )


@query("sql_emv", with_views("priced") + "SELECT video_id, brand_key, round(emv_usd, 2) AS emv_usd FROM v_priced")
def sql_emv(t):
    register_functions(t.spark)
    return t.spark.sql(
        """SELECT video_id, brand_key, round(st_emv(quality_exposure_s, cpm_base, audience_size, placement_type), 2) AS emv_usd
           FROM {brands} JOIN {meta} USING (video_id)""",
        brands=brands(t), meta=t.meta(),
    )


@query("segment_lookup", with_views("det", "seg") + """
SELECT d.det_id, d.video_id, d.brand_key, d.track_id, s.start_t, s.end_t
FROM v_det d JOIN v_seg s ON d.video_id = s.video_id AND d.brand_key = s.brand_key AND d.track_id = s.track_id
 AND d.t >= s.start_t AND d.t < s.end_t""")
def segment_lookup(t):
    return X.segment_lookup(t.detections(), segs(t), X.TRACK).select("det_id", *X.TRACK, "start_t", "end_t")


@query("cumulative_exposure", with_views("seg") + """
SELECT g.video_id, g.brand_key, CAST(g.t AS DOUBLE) AS t,
       round(coalesce(sum(greatest(0, least(end_t, g.t) - start_t) * avg_visibility) FILTER (WHERE start_t < g.t), 0), 6) AS cumulative
FROM (SELECT * FROM (SELECT DISTINCT video_id, brand_key FROM v_seg) b, (SELECT unnest(range(0, 5)) * 5.0 AS t) x) g
JOIN v_seg s ON s.video_id = g.video_id AND s.brand_key = g.brand_key
GROUP BY 1, 2, 3""")
def cumulative_exposure(t):
    durations = t.meta().select("video_id", F.lit(20.0).alias("duration_s"))
    return X.cumulative_exposure(segs(t), durations, step=5.0).withColumn("cumulative", F.round("cumulative", 6))


@query("scene_merge", """
WITH s AS (
  SELECT l_suppkey AS video_id, (l_orderkey % 1000) * 4.0 AS start_t, max(l_quantity) / 50.0 AS max_person_h,
         (l_orderkey % 1000) * 4.0 + 0.5 + max(l_linenumber) AS end_t
  FROM lineitem GROUP BY 1, 2 , l_orderkey % 1000 HAVING max(l_quantity) / 50.0 >= 0.5),
a AS (SELECT *, CASE WHEN start_t - max(end_t) OVER (PARTITION BY video_id ORDER BY start_t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 1.5 THEN 0 ELSE 1 END AS opens FROM s),
b AS (SELECT *, sum(opens) OVER (PARTITION BY video_id ORDER BY start_t) AS run_no FROM a)
SELECT video_id, CAST(min(start_t) AS DOUBLE) AS start_t, CAST(max(end_t) AS DOUBLE) AS end_t, max(max_person_h) AS max_person_h
FROM b GROUP BY video_id, run_no HAVING max(end_t) - min(start_t) >= 2.0""")
def scene_merge(t):
    slot = (F.col("l_orderkey") % 1000) * 4.0
    scenes = t.raw("lineitem").groupBy(F.col("l_suppkey").alias("video_id"), slot.alias("start_t")).agg(
        (F.max("l_quantity") / 50.0).alias("max_person_h"), F.max("l_linenumber").alias("n")
    ).select(
        "video_id", "start_t", (F.col("start_t") + 0.5 + F.col("n")).alias("end_t"), "max_person_h",
        (F.col("max_person_h") >= 0.5).alias("is_closeup"),
    )
    return X.scene_merge(scenes)


@query("brand_rank_ids", with_views("brand") + """
SELECT video_id, brand_key, 'logo-' || (row_number() OVER (PARTITION BY video_id ORDER BY round(quality_exposure_s, 9) DESC, brand_key) - 1) AS logo_id FROM v_brand""")
def brand_rank_ids(t):
    from screentime.operators.portfolio import brand_rank_ids as rank

    return rank(brands(t)).select(*X.BRAND, "logo_id")
