"""Portfolio views over the priced brand results."""

from __future__ import annotations

from pyspark.sql import functions as F

from screentime.catalog import query
from screentime.catalog.core import priced
from screentime.operators import portfolio as P
from screentime.tables import with_views


def r(col, digits=6):
    return F.round(col, digits).alias(col)


_PORT = """v_port AS (
  SELECT brand_key, sum(emv_usd) AS emv, sum(total_exposure_s) AS exposure, sum(quality_exposure_s) AS quality,
         sum(avg_visibility * total_exposure_s) / nullif(sum(total_exposure_s), 0) AS visibility, CAST(sum(segment_count) AS BIGINT) AS segments,
         count(*) AS match_count FROM v_priced GROUP BY 1)"""
_METRIC = """v_metric AS (
  SELECT brand_key, emv, exposure, visibility, emv / nullif(exposure, 0) AS emv_per_s, CAST(segments AS DOUBLE) / match_count AS segments_per_match FROM v_port)"""
_PORTV = with_views("priced", extra=_PORT)
_BOTH = with_views("priced", "match", extra=_PORT)


def port(t):
    return P.brand_portfolio(priced(t))


@query("brand_portfolio", _PORTV + """
SELECT brand_key, round(emv, 2) AS emv, exposure, round(quality, 6) AS quality, round(visibility, 6) AS visibility, segments, match_count FROM v_port""")
def brand_portfolio(t):
    return port(t).select("brand_key", r("emv", 2), "exposure", r("quality"), r("visibility"), "segments", "match_count")


@query("portfolio_kpis", with_views("priced", "match") + """
SELECT round(sum(emv_usd), 1) AS emv, round(sum(quality_exposure_s), 6) AS quality, CAST(sum(segment_count) AS BIGINT) AS segments,
       round(sum(avg_visibility * total_exposure_s) / sum(total_exposure_s), 6) AS visibility,
       (SELECT sum(duration_s) FROM v_match) AS footage_s, (SELECT count(*) FROM v_match) AS match_count FROM v_priced""")
def portfolio_kpis(t):
    return P.portfolio_kpis(priced(t), t.matches()).select(
        r("emv", 1), r("quality"), "segments", r("visibility"), "footage_s", "match_count"
    )


_TOP = "(SELECT brand_key FROM v_port ORDER BY round(emv, 2) DESC, brand_key LIMIT {n})"


@query("brand_match_emv", with_views("priced", "match") + """
SELECT m.video_id, b.brand_key, round(coalesce(emv_usd, 0), 2) AS emv FROM v_match m CROSS JOIN (SELECT DISTINCT brand_key FROM v_priced) b
LEFT JOIN v_priced p ON p.video_id = m.video_id AND p.brand_key = b.brand_key""")
def brand_match_emv(t):
    res = priced(t)
    return P.brand_match_emv(res, res, t.matches()).select("video_id", "brand_key", r("emv", 2))


_HEAT = _BOTH + f"""
SELECT m.video_id, b.brand_key, round(coalesce(emv_usd, 0), 2) AS emv FROM v_match m CROSS JOIN {_TOP.format(n=10)} b
LEFT JOIN v_priced p ON p.video_id = m.video_id AND p.brand_key = b.brand_key"""


@query("brand_match_heatmap", _HEAT)
def brand_match_heatmap(t):
    return P.heatmap(priced(t), t.matches(), 10).select("video_id", "brand_key", r("emv", 2))


SHOWN = [1, 2, 3, 5, 8]


@query("brand_match_heatmap_wide", "SELECT brand_key, " + ", ".join(
    f"round(coalesce(sum(emv) FILTER (WHERE video_id = {v}), 0), 2) AS m{v}" for v in SHOWN) + f" FROM ({_HEAT}) h GROUP BY 1")
def brand_match_heatmap_wide(t):
    wide = P.heatmap_wide(P.heatmap(priced(t), t.matches(), 10), SHOWN)
    return wide.select("brand_key", *[F.round(F.col(str(v)), 2).alias(f"m{v}") for v in SHOWN])


@query("brand_per_match", with_views("priced") + """
SELECT video_id, brand_key, round(emv_usd, 2) AS emv, total_exposure_s AS exposure, segment_count AS segments,
       round(avg_visibility * total_exposure_s / nullif(total_exposure_s, 0), 6) AS visibility, round(emv_usd / nullif(sum(emv_usd) OVER (PARTITION BY video_id), 0), 6) AS sov FROM v_priced""")
def brand_per_match(t):
    return P.brand_per_match(priced(t)).select("video_id", "brand_key", r("emv", 2), "exposure", "segments", r("visibility"), r("sov"))


@query("avg_brand_in_match", with_views("priced", "match") + """
SELECT m.video_id, round(coalesce(sum(emv_usd) / nullif(count(brand_key), 0), 0), 2) AS avg_brand_emv FROM v_match m LEFT JOIN v_priced p ON p.video_id = m.video_id GROUP BY 1""")
def avg_brand_in_match(t):
    return P.avg_brand_in_match(priced(t), t.matches()).select("video_id", r("avg_brand_emv", 2))


@query("portfolio_brand_average", with_views("priced", extra=_PORT + ",\n" + _METRIC) + """
SELECT round(avg(emv), 2) AS emv, round(avg(exposure), 6) AS exposure, round(avg(visibility), 6) AS visibility, round(avg(emv_per_s), 4) AS emv_per_s, round(avg(segments_per_match), 6) AS segments_per_match FROM v_metric""")
def portfolio_brand_average(t):
    return P.portfolio_brand_average(port(t)).select(r("emv", 2), r("exposure"), r("visibility"), r("emv_per_s", 4), r("segments_per_match"))


@query("radar_profile", with_views("priced", extra=_PORT + ",\n" + _METRIC) + """
SELECT brand_key, """ + ", ".join(f"round({m} / greatest(1e-9, max({m}) OVER ()), 6) AS {m}" for m in P.METRICS) + " FROM v_metric")
def radar_profile(t):
    return P.radar_profile(port(t)).select("brand_key", *[r(m) for m in P.METRICS])


@query("report_rows", with_views("priced", extra=_PORT) + """
SELECT 'match' AS scope, brand_key, round(emv_usd, 2) AS emv, total_exposure_s AS exposure, segment_count AS segments FROM v_priced WHERE video_id = 1
UNION ALL SELECT 'all', brand_key, round(emv, 2), exposure, segments FROM v_port UNION ALL SELECT 'brand', brand_key, round(emv, 2), exposure, segments FROM v_port WHERE brand_key = 'Brand#3'""")
def report_rows(t):
    res, m = priced(t), t.matches()
    tag = lambda df, s: df.select(F.lit(s).alias("scope"), "brand_key", r("emv", 2), "exposure", "segments")
    return (
        tag(P.report_rows(res, m, match_id=1), "match").unionByName(tag(P.report_rows(res, m), "all"))
        .unionByName(tag(P.report_rows(res, m, brand="Brand#3"), "brand"))
    )


@query("share_of_voice", _PORTV + """
SELECT brand_key, round(emv / (SELECT sum(emv) FROM v_port), 6) AS sov FROM v_port WHERE brand_key <> 'Brand#1'""")
def share_of_voice(t):
    rows = port(t)
    return P.share_of_voice(rows.filter("brand_key <> 'Brand#1'"), rows).select("brand_key", r("sov"))


@query("report_ratios", _PORTV + """
SELECT brand_key, round(quality / nullif(exposure, 0), 6) AS quality_ratio, round(emv / nullif(exposure, 0), 4) AS emv_per_s FROM v_port""")
def report_ratios(t):
    return P.report_ratios(port(t)).select("brand_key", r("quality_ratio"), r("emv_per_s", 4))


@query("match_rollup", with_views("priced") + """
SELECT brand_key, video_id, grouping_id(brand_key, video_id) AS level, round(sum(emv_usd), 1) AS emv, sum(total_exposure_s) AS exposure, CAST(sum(segment_count) AS BIGINT) AS segments
FROM v_priced GROUP BY CUBE (brand_key, video_id)""")
def match_rollup(t):
    return P.match_rollup(priced(t)).select("brand_key", "video_id", "level", r("emv", 1), "exposure", "segments")


@query("exposure_share", with_views("priced") + """
SELECT video_id, brand_key, round(total_exposure_s / a, 6) AS fraction, round((c - total_exposure_s) / a * 360, 6) AS start_angle, round(c / a * 360, 6) AS end_angle FROM (
  SELECT *, sum(total_exposure_s) OVER (PARTITION BY video_id) AS a,
         sum(total_exposure_s) OVER (PARTITION BY video_id ORDER BY round(quality_exposure_s, 9) DESC, brand_key ROWS UNBOUNDED PRECEDING) AS c FROM v_priced) x""")
def exposure_share(t):
    return P.exposure_share(priced(t)).select("video_id", "brand_key", r("fraction"), r("start_angle"), r("end_angle"))


@query("bar_fraction", _PORTV + """
SELECT brand_key, round(emv / (SELECT max(emv) FROM v_port), 6) AS fraction FROM v_port""")
def bar_fraction(t):
    return P.bar_fraction(port(t), "emv").select("brand_key", r("fraction"))


@query("emv_trend", _BOTH + f""", v_cell AS (
  SELECT m.video_id, m.match_date, b.brand_key AS series, coalesce(emv_usd, 0) AS emv FROM v_match m CROSS JOIN {_TOP.format(n=3)} b
  LEFT JOIN v_priced p ON p.video_id = m.video_id AND p.brand_key = b.brand_key
  UNION ALL SELECT m.video_id, m.match_date, 'Total EMV', coalesce(sum(emv_usd), 0) FROM v_match m LEFT JOIN v_priced p ON p.video_id = m.video_id GROUP BY 1, 2)
SELECT series, position, video_id, round(emv, 2) AS emv, round(emv - lag(emv) OVER (PARTITION BY series ORDER BY position), 2) AS delta
FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY match_date, video_id) AS position FROM v_cell) x""")
def emv_trend(t):
    return P.emv_trend(priced(t), t.matches(), 3).select("series", "position", "video_id", r("emv", 2), r("delta", 2))


@query("top_brands", _PORTV + "SELECT brand_key, round(emv, 2) AS emv FROM v_port ORDER BY round(emv, 2) DESC, brand_key LIMIT 10")
def top_brands(t):
    return P.top_brands(port(t)).select("brand_key", r("emv", 2))


@query("top8_plus_other", _PORTV + """
SELECT CASE WHEN rn <= 8 THEN brand_key ELSE 'Other' END AS brand_key, round(sum(emv), 1) AS emv
FROM (SELECT *, row_number() OVER (ORDER BY round(emv, 2) DESC, brand_key) AS rn FROM v_port) x GROUP BY 1""")
def top8_plus_other(t):
    return P.top8_plus_other(port(t)).select("brand_key", r("emv", 1))


@query("match_list_sort", with_views("priced", "match") + """
SELECT m.video_id, event_name, duration_s, round(coalesce(sum(emv_usd), 0), 2) AS total_emv, count(brand_key) AS logo_count
FROM v_match m LEFT JOIN v_priced p ON p.video_id = m.video_id GROUP BY 1, 2, 3""")
def match_list_sort(t):
    return P.match_list(priced(t), t.matches(), "emv").select("video_id", "event_name", "duration_s", r("total_emv", 2), "logo_count")


@query("table_sort", _PORTV + "SELECT brand_key, segments FROM v_port")
def table_sort(t):
    return P.table_sort(port(t), "brand_key", ascending=False).select("brand_key", "segments")


@query("analyses_newest_first", with_views("match") + "SELECT video_id, event_name, match_date FROM v_match ORDER BY match_date DESC, video_id DESC")
def analyses_newest_first(t):
    from screentime.sources.store import newest_first

    return newest_first(t.matches()).select("video_id", "event_name", "match_date")


_POS = """v_pos AS (SELECT video_id, row_number() OVER (ORDER BY match_date, video_id) AS position FROM v_match)"""


def positions(t):
    return P.match_positions(t.matches())


@query("best_match", with_views("priced", "match", extra=_POS) + """
SELECT brand_key, max(video_id) FILTER (WHERE a = 1) AS best_match FROM (
  SELECT brand_key, p.video_id, row_number() OVER (PARTITION BY brand_key ORDER BY round(emv_usd, 2) DESC, position DESC) AS a
  FROM v_priced p JOIN v_pos o ON p.video_id = o.video_id WHERE total_exposure_s > 0) x GROUP BY 1""")
def best_match(t):
    return P.best_matches(priced(t), positions(t)).select("brand_key", "best_match")


@query("most_efficient_match", with_views("priced", "match", extra=_POS) + """
SELECT brand_key, max(video_id) FILTER (WHERE a = 1) AS most_efficient_match FROM (
  SELECT brand_key, p.video_id, row_number() OVER (PARTITION BY brand_key ORDER BY round(emv_usd / total_exposure_s, 6) DESC, position DESC) AS a
  FROM v_priced p JOIN v_pos o ON p.video_id = o.video_id WHERE total_exposure_s > 0) x GROUP BY 1""")
def most_efficient_match(t):
    return P.best_matches(priced(t), positions(t)).select("brand_key", "most_efficient_match")


@query("scope_highlights", _PORTV + """
SELECT (SELECT brand_key FROM v_port ORDER BY round(exposure, 6) DESC, brand_key DESC LIMIT 1) AS most_exposed,
       (SELECT brand_key FROM v_port ORDER BY round(visibility, 6) DESC, brand_key DESC LIMIT 1) AS most_visible,
       (SELECT brand_key FROM v_port WHERE exposure > 0 ORDER BY round(emv / exposure, 6) DESC, brand_key DESC LIMIT 1) AS most_efficient""")
def scope_highlights(t):
    return P.scope_highlights(port(t))


@query("match_selection", with_views("match") + """
SELECT n_nationkey AS request_id, coalesce((SELECT video_id FROM v_match m WHERE m.video_id = n_nationkey * 7), (SELECT video_id FROM v_match ORDER BY match_date DESC, video_id DESC LIMIT 1)) AS video_id FROM nation""")
def match_selection(t):
    wanted = t.raw("nation").select(F.col("n_nationkey").alias("request_id"), (F.col("n_nationkey") * 7).alias("wanted_id"))
    return P.match_selection(t.matches(), wanted)


@query("brands_in_all_matches", with_views("priced", "match") + """
SELECT brand_key FROM v_priced GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM v_match)""")
def brands_in_all_matches(t):
    return P.brands_in_all_matches(priced(t), t.matches())
