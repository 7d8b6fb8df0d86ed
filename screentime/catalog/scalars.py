"""Row-level projections, scalar maths and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from screentime.catalog import query
from screentime.functions import frames as FR
from screentime.functions import geometry as G
from screentime.functions import visibility as V
from screentime.functions.sql import register_functions
from screentime.operators import exposure as X
from screentime.operators import frames as FO
from screentime.tables import with_views

KEY = ["det_id", "video_id"]


def r(col, name, digits=6):
    return F.round(col, digits).alias(name)


def corners(t):
    return [F.col(c) for c in ("x1", "y1", "x2", "y2")]


@query("bbox_geometry", with_views("box") + """
SELECT det_id, video_id, (x1 + x2) / 2 AS mid_x, (y1 + y2) / 2 AS mid_y,
       greatest(0.0, x2 - x1) * greatest(0.0, y2 - y1) AS area FROM v_box""")
def bbox_geometry(t):
    x1, y1, x2, y2 = corners(t)
    return t.boxes().select(*KEY, ((x1 + x2) / 2).alias("mid_x"), ((y1 + y2) / 2).alias("mid_y"), V.box_area(x1, y1, x2, y2).alias("area"))


@query("size_score", with_views("vis") + """
SELECT det_id, video_id, round(sqrt(least(1.0, area / greatest(1.0, frame_w * frame_h))), 6) AS size_score FROM v_vis""")
def size_score(t):
    return X.score_detections(t.detections()).select(*KEY, r(V.size_score(F.col("area"), F.col("frame_w"), F.col("frame_h")), "size_score"))


@query("position_score", with_views("det") + """
SELECT det_id, video_id, round(exp(-((cx - 960) ** 2 + (cy - 540) ** 2) / (576.0 * 576.0)), 6) AS position_score FROM v_det""")
def position_score(t):
    score = V.position_score(F.col("cx"), F.col("cy"), F.col("frame_w"), F.col("frame_h"))
    return t.detections().select(*KEY, r(score, "position_score"))


@query("obb_penalty", with_views("vis") + """
SELECT det_id, video_id, round(CASE WHEN line_no = 7 THEN 1.0 ELSE least(1.0, area * (0.4 + 0.1 * line_no) / nullif(area, 0)) END, 6) AS penalty,
       round(CASE WHEN line_no = 7 THEN visibility ELSE visibility * least(1.0, 0.4 + 0.1 * line_no) END, 6) AS visibility FROM v_vis""")
def obb_penalty(t):
    area = F.col("w") * F.col("h")
    rotated = F.when(F.col("line_no") != 7, area * (F.col("line_no") * 0.1 + 0.4))
    rows = X.score_detections(t.detections().withColumn("obb_area", rotated))
    return rows.select(*KEY, r(V.obb_penalty(F.col("obb_area"), F.col("area")), "penalty"), r("visibility", "visibility"))


@query("quality_index", with_views("ocr") + """
SELECT det_id, video_id, round(area_pct / 100 * exp(-0.5 * ((cx - 0.5) ** 2 + (cy - 0.5) ** 2) / 0.16)
       * least(1.0, area_pct / 100 / 0.003), 9) AS quality_index FROM v_ocr""")
def quality_index(t):
    frac = F.col("area_pct") / 100.0
    qi = frac * V.normalised_position(F.col("cx"), F.col("cy")) * V.clarity(frac)
    return t.ocr().select(*KEY, r(qi, "quality_index", 9))


@query("ocr_conf_filter", with_views("ocr") + """
SELECT det_id, video_id, text, ocr_conf FROM v_ocr WHERE ocr_conf >= 0.55 AND length(trim(text)) >= 2""")
def ocr_conf_filter(t):
    from screentime.operators.report import readable

    return readable(t.ocr()).select(*KEY, "text", "ocr_conf")


_IBOX = """v_ibox AS (SELECT det_id, video_id, CAST(trunc(x1) AS BIGINT) AS x1, CAST(trunc(y1) AS BIGINT) AS y1,
  CAST(trunc(x2) AS BIGINT) AS x2, CAST(trunc(y2) AS BIGINT) AS y2 FROM v_box)"""


def int_boxes(t):
    return t.boxes().select(*KEY, *[G.trunc_int(F.col(c)).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("expand_bbox", with_views("box", extra=_IBOX) + """
SELECT det_id, video_id, greatest(0, x1 - px) AS ex1, greatest(0, y1 - py) AS ey1, least(1920, x2 + px) AS ex2, least(1080, y2 + py) AS ey2
FROM (SELECT *, CAST(trunc((x2 - x1) * CAST(0.15 AS DOUBLE)) AS BIGINT) AS px, CAST(trunc((y2 - y1) * CAST(0.15 AS DOUBLE)) AS BIGINT) AS py FROM v_ibox) b""")
def expand_bbox(t):
    out = G.expand(*corners(t), 0.15, 1920, 1080)
    return int_boxes(t).select(*KEY, *[c.alias(n) for c, n in zip(out, ("ex1", "ey1", "ex2", "ey2"))])


@query("expand_for_annotation", with_views("box", extra=_IBOX + """,
v_grow AS (SELECT det_id, video_id, x1 - px AS x1, y1 - py AS y1, x2 + px AS x2, y2 + py AS y2 FROM (
  SELECT *, CAST(trunc((x2 - x1) * CAST(0.25 AS DOUBLE)) AS BIGINT) AS px, CAST(trunc((y2 - y1) * CAST(0.25 AS DOUBLE)) AS BIGINT) AS py FROM v_ibox) b)""") + """
SELECT det_id, video_id,
  greatest(0, CASE WHEN x2 - x1 < 100 THEN CAST(floor((x1 + x2) / 2.0) AS BIGINT) - 50 ELSE x1 END) AS ex1,
  greatest(0, CASE WHEN y2 - y1 < 100 THEN CAST(floor((y1 + y2) / 2.0) AS BIGINT) - 50 ELSE y1 END) AS ey1,
  least(1920, CASE WHEN x2 - x1 < 100 THEN CAST(floor((x1 + x2) / 2.0) AS BIGINT) + 50 ELSE x2 END) AS ex2,
  least(1080, CASE WHEN y2 - y1 < 100 THEN CAST(floor((y1 + y2) / 2.0) AS BIGINT) + 50 ELSE y2 END) AS ey2 FROM v_grow""")
def expand_for_annotation(t):
    out = G.expand_min_size(*corners(t), 0.25, 100, 1920, 1080)
    return int_boxes(t).select(*KEY, *[c.alias(n) for c, n in zip(out, ("ex1", "ey1", "ex2", "ey2"))])


@query("polygon_to_bbox", with_views("box") + """
SELECT det_id, video_id, CAST(trunc(least(x1, x2 - 3.5, x2, x1 + 2.25)) AS BIGINT) AS bx1, CAST(trunc(least(y1 + 1.5, y1, y2, y2 - 0.75)) AS BIGINT) AS by1,
       CAST(trunc(greatest(x1, x2 - 3.5, x2, x1 + 2.25)) AS BIGINT) AS bx2, CAST(trunc(greatest(y1 + 1.5, y1, y2, y2 - 0.75)) AS BIGINT) AS by2 FROM v_box""")
def polygon_to_bbox(t):
    x1, y1, x2, y2 = corners(t)
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    poly = F.array(point(x1, y1 + 1.5), point(x2 - 3.5, y1), point(x2, y2), point(x1 + 2.25, y2 - 0.75))
    xs, ys = F.transform("poly", lambda p: p["x"]), F.transform("poly", lambda p: p["y"])
    return t.boxes().withColumn("poly", poly).select(
        *KEY, G.trunc_int(F.array_min(xs)).alias("bx1"), G.trunc_int(F.array_min(ys)).alias("by1"),
        G.trunc_int(F.array_max(xs)).alias("bx2"), G.trunc_int(F.array_max(ys)).alias("by2"),
    )


@query("ocr_area_center", with_views("box", extra=_IBOX) + """
SELECT det_id, video_id, round((x2 - x1) * (y2 - y1) / 2073600.0 * 100, 9) AS area_pct,
       round((x1 + x2) / 2.0 / 1920, 9) AS ncx, round((y1 + y2) / 2.0 / 1080, 9) AS ncy FROM v_ibox""")
def ocr_area_center(t):
    x1, y1, x2, y2 = corners(t)
    return int_boxes(t).select(
        *KEY, r((x2 - x1) * (y2 - y1) / F.lit(1920.0 * 1080.0) * 100, "area_pct", 9),
        r((x1 + x2) / 2.0 / 1920.0, "ncx", 9), r((y1 + y2) / 2.0 / 1080.0, "ncy", 9),
    )


@query("coco_to_yolo", with_views("box") + """
SELECT det_id, video_id, round((x1 + w / 2) / frame_w, 9) AS ycx, round((y1 + h / 2) / frame_h, 9) AS ycy,
       round(w / frame_w, 9) AS yw, round(h / frame_h, 9) AS yh FROM v_box""")
def coco_to_yolo(t):
    out = G.normalised_box(F.col("x1"), F.col("y1"), F.col("w"), F.col("h"), F.col("frame_w"), F.col("frame_h"))
    return t.boxes().select(*KEY, *[r(c, n, 9) for c, n in zip(out, ("ycx", "ycy", "yw", "yh"))])


@query("torso_roi", with_views("box", extra=_IBOX) + """
SELECT det_id, video_id, greatest(0, y1 + CAST(trunc(CAST(0.10 AS DOUBLE) * (y2 - y1)) AS BIGINT)) AS ty1,
       least(1080, y1 + CAST(trunc(CAST(0.75 AS DOUBLE) * (y2 - y1)) AS BIGINT)) AS ty2 FROM v_ibox""")
def torso_roi(t):
    _, y1, _, y2 = corners(t)
    return int_boxes(t).select(
        *KEY, F.greatest(F.lit(0), y1 + G.trunc_int((y2 - y1) * F.lit(0.10))).alias("ty1"),
        F.least(F.lit(1080), y1 + G.trunc_int((y2 - y1) * F.lit(0.75))).alias("ty2"),
    )


@query("person_height_filter", with_views("person") + """
SELECT person_id, video_id, y2 - y1 AS height FROM v_person WHERE y2 - y1 >= 1080 * CAST(0.12 AS DOUBLE)""")
def person_height_filter(t):
    height = F.col("y2") - F.col("y1")
    return t.persons().filter(height >= F.lit(1080 * 0.12)).select("person_id", "video_id", height.alias("height"))


@query("frame_sample", with_views("video") + """
SELECT video_id, frame_idx, t FROM (
  SELECT l_suppkey AS video_id, l_orderkey AS frame_idx, round_even(l_orderkey / fps, 3) AS t, greatest(1, CAST(round_even(fps / 2.0, 0) AS BIGINT)) AS step
  FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) l JOIN v_video ON l_suppkey = video_id) f
WHERE frame_idx % step = 0""")
def frame_sample(t):
    frames = t.raw("lineitem").select(F.col("l_suppkey").alias("video_id"), F.col("l_orderkey").alias("frame_idx")).distinct()
    return FO.frame_sample(frames.join(t.videos(), "video_id"), 2.0).select("video_id", "frame_idx", "t")


@query("expected_sample_count", with_views("video") + """
SELECT video_id, greatest(1, CAST(floor(frame_count / greatest(1, round_even(fps / 2.0, 0))) AS BIGINT)) AS expected FROM v_video""")
def expected_sample_count(t):
    step = FR.sample_step(F.col("fps"), 2.0)
    return t.videos().select("video_id", FR.expected_samples(F.col("frame_count"), step).alias("expected"))


_PLANS = with_views("video") + """
SELECT video_id, 'stride' AS plan, unnest(range(0, frame_count, greatest(1, CAST(round_even(fps / CAST(0.1 AS DOUBLE), 0) AS BIGINT)))) AS frame_idx FROM v_video
UNION ALL
SELECT video_id, 'even', CAST(trunc(i * ((hi - lo) / CAST(299 AS DOUBLE)) + lo) AS BIGINT) FROM (
  SELECT video_id, CAST(trunc(frame_count * CAST(0.05 AS DOUBLE)) AS BIGINT) AS lo, CAST(trunc(frame_count * CAST(0.95 AS DOUBLE)) AS BIGINT) AS hi FROM v_video) v, range(0, 300) g(i)
UNION ALL
SELECT video_id, 'head', unnest(range(0, least(frame_count, CAST(trunc(fps * 60) AS BIGINT)), greatest(1, CAST(round_even(fps, 0) AS BIGINT)))) FROM v_video"""


@query("frame_index_plan", _PLANS)
def frame_index_plan(t):
    v = t.videos()
    tag = lambda df, name: df.select("video_id", F.lit(name).alias("plan"), "frame_idx")
    return (
        tag(FO.stride_plan(v, 0.1), "stride").union(tag(FO.interior_plan(v, 300), "even")).union(tag(FO.head_plan(v, 60.0, 1.0), "head"))
    )


@query("sql_frame_plan", _PLANS)
def sql_frame_plan(t):
    register_functions(t.spark)
    return t.spark.sql(
        """SELECT video_id, 'stride' AS plan, frame_idx FROM {videos}, LATERAL st_stride_plan(frame_count, fps, 0.1D)
           UNION ALL SELECT video_id, 'even', frame_idx FROM {videos}, LATERAL st_interior_plan(frame_count, 300L)
           UNION ALL SELECT video_id, 'head', frame_idx FROM {videos}, LATERAL st_head_plan(frame_count, fps, 60D, 1D)""",
        videos=t.videos(),
    )


@query("uniform_plus_dense_index", with_views("video") + """
SELECT DISTINCT video_id, frame_idx FROM (
  SELECT video_id, CAST(trunc(i * ((frame_count - 1) / CAST(499 AS DOUBLE))) AS BIGINT) AS frame_idx FROM v_video, range(0, 500) g(i)
  UNION ALL SELECT video_id, unnest(range(0, least(frame_count, CAST(trunc(fps * 120) AS BIGINT)), 15)) FROM v_video) u""")
def uniform_plus_dense_index(t):
    return FO.uniform_plus_dense(t.videos(), 500, 15)


@query("adaptive_sample_fps", with_views("video") + """
SELECT video_id, CASE WHEN duration_s < 1200 THEN 2.0 WHEN duration_s < 3600 THEN 1.0 WHEN duration_s < 7200 THEN 0.5 ELSE 0.33 END AS sample_fps FROM v_video""")
def adaptive_sample_fps(t):
    return t.videos().select("video_id", FR.adaptive_sample_fps(F.col("duration_s")).alias("sample_fps"))


@query("adaptive_target_k", with_views("video") + """
SELECT video_id, greatest(80, least(500, CAST(round_even(duration_s / 60.0 * 10, 0) AS BIGINT))) AS k,
       least(300, greatest(80, least(500, CAST(round_even(duration_s / 60.0 * 10, 0) AS BIGINT)))) AS capped_k FROM v_video""")
def adaptive_target_k(t):
    d = F.col("duration_s")
    return t.videos().select("video_id", FR.adaptive_target_k(d).alias("k"), FR.adaptive_target_k(d, 300).alias("capped_k"))


@query("duration_weight", with_views("seg") + """
SELECT duration_weight, count(*) AS n, min(duration_s) AS shortest, max(duration_s) AS longest FROM v_seg GROUP BY 1""")
def duration_weight(t):
    segs = X.segments(X.exposure_runs(X.score_detections(t.detections())))
    return segs.groupBy(V.duration_weight(F.col("duration_s")).alias("duration_weight")).agg(
        F.count(F.lit(1)).alias("n"), F.min("duration_s").alias("shortest"), F.max("duration_s").alias("longest")
    )


@query("size_bucket", with_views("frame") + """
SELECT video_id, frame_idx, CASE WHEN max_target_h >= 0.5 THEN 'closeup' WHEN max_target_h >= 0.3 THEN 'medium' ELSE 'wide' END AS bucket FROM v_frame""")
def size_bucket(t):
    return t.frames().select("video_id", "frame_idx", FR.size_bucket(F.col("max_target_h")).alias("bucket"))


@query("composite_score", with_views("frame") + """
SELECT video_id, frame_idx, round(0.7 * ln(1 + sharp) + n_target + 8 * avg_target_h + CASE WHEN max_target_h >= 0.4 THEN 3 ELSE 0 END - 2 * crowd_score, 6) AS composite FROM v_frame""")
def composite_score(t):
    return FO.with_composite(t.frames()).select("video_id", "frame_idx", r("composite", "composite"))


_GATES = """round(grass_ratio, 9) BETWEEN 0.25 AND 0.92 AND round(crowd_score, 9) <= 0.85 AND n_persons >= 2 AND n_target >= 1
  AND max_target_h >= 0.18 AND torso_sharp >= 15"""


def rounded_metrics(t):
    """Averages at 9 digits, so the summation order cannot move a row over a threshold."""
    return t.frames().withColumns({c: F.round(c, 9) for c in ("grass_ratio", "crowd_score")})


@query("frame_gate", with_views("frame") + f"""
SELECT video_id, frame_idx, n_target FROM v_frame WHERE {_GATES}""")
def frame_gate(t):
    return FO.passing_frames(rounded_metrics(t)).select("video_id", "frame_idx", "n_target")


_REASON = """CASE WHEN round(grass_ratio, 9) < 0.18 OR round(grass_ratio, 9) > 0.92 THEN 'grass_ratio' WHEN round(crowd_score, 9) > 0.85 THEN 'crowd'
  WHEN n_persons < 2 THEN 'n_persons' WHEN n_target < 1 THEN 'no_target_player' WHEN max_target_h < 0.18 THEN 'max_tgt_h' ELSE 'ok' END"""


@query("gate_reason", with_views("frame") + f"""
SELECT video_id, frame_idx, {_REASON} AS reason FROM v_frame""")
def gate_reason(t):
    return rounded_metrics(t).select("video_id", "frame_idx", FR.gate_reason().alias("reason"))


@query("gate_summary", with_views("frame") + f"""
SELECT video_id, count(*) AS total_sampled, count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok) AS failed,
       round(count(*) FILTER (WHERE ok) * 100.0 / count(*), 6) AS pass_rate_pct,
       count(*) FILTER (WHERE ok AND sharp < 30) AS blurry, round(count(*) FILTER (WHERE ok AND sharp < 30) * 100.0 / greatest(count(*) FILTER (WHERE ok), 1), 6) AS blurry_pct,
       count(*) FILTER (WHERE max_target_h >= 0.4) AS closeups, round(count(*) FILTER (WHERE max_target_h >= 0.4) * 100.0 / count(*), 6) AS closeup_pct_of_all,
       round(count(*) FILTER (WHERE ok AND max_target_h >= 0.4) * 100.0 / greatest(count(*) FILTER (WHERE ok), 1), 6) AS closeup_pct_of_passing
FROM (SELECT *, {_REASON} = 'ok' AS ok FROM v_frame) f GROUP BY 1""")
def gate_summary(t):
    s = FO.gate_summary(rounded_metrics(t))
    return s.select(*[r(c, c) if "pct" in c else F.col(c) for c in s.columns])


@query("gate_fail_reasons", with_views("frame") + f"""
SELECT video_id, {_REASON} AS reason, count(*) AS count FROM v_frame WHERE {_REASON} <> 'ok' GROUP BY 1, 2""")
def gate_fail_reasons(t):
    return FO.fail_reasons(rounded_metrics(t))


@query("metric_quantiles", with_views("frame") + """
SELECT video_id, round(min(sharp), 9) AS min, round(max(sharp), 9) AS max, round(avg(sharp), 9) AS mean,
       round(quantile_cont(sharp, 0.25), 9) AS p25, round(quantile_cont(sharp, 0.5), 9) AS p50, round(quantile_cont(sharp, 0.75), 9) AS p75
FROM v_frame GROUP BY 1""")
def metric_quantiles(t):
    q = FO.metric_quantiles(t.frames(), "sharp", ["video_id"])
    return q.select("video_id", *[r(c, c, 9) for c in q.columns if c != "video_id"])


@query("metric_quantiles_approx", with_views("frame") + """
SELECT video_id, round(min(sharp), 9) AS min, round(max(sharp), 9) AS max, round(avg(sharp), 9) AS mean, round(quantile_disc(sharp, 0.25), 9) AS p25,
       round(quantile_disc(sharp, 0.5), 9) AS p50, round(quantile_disc(sharp, 0.75), 9) AS p75 FROM v_frame GROUP BY 1""")
def metric_quantiles_approx(t):
    # The sketch is exact below 10,000 rows a key, and a video here has 40 frames at most.
    q = FO.metric_quantiles_approx(t.frames(), "sharp", ["video_id"])
    return q.select("video_id", *[r(c, c, 9) for c in q.columns if c != "video_id"])


@query("motion_magnitude", with_views("det") + """
SELECT det_id, video_id, round(sqrt((cx - 960) ** 2 + (cy - 540) ** 2), 6) AS motion FROM v_det""")
def motion_magnitude(t):
    return t.detections().select(*KEY, r(F.hypot(F.col("cx") - 960.0, F.col("cy") - 540.0), "motion"))


@query("delta_pct", with_views("frame") + """
SELECT video_id, frame_idx, round((torso_sharp - sharp) / greatest(sharp, 1e-6) * 100, 6) AS delta_pct FROM v_frame""")
def delta_pct(t):
    delta = (F.col("torso_sharp") - F.col("sharp")) / F.greatest(F.col("sharp"), F.lit(float("1e-6"))) * 100
    return t.frames().select("video_id", "frame_idx", r(delta, "delta_pct"))
