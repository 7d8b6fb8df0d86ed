"""The whole analysis plan with the team filter in front."""

from __future__ import annotations

from pyspark.sql import functions as F

from screentime.catalog import query
from screentime.catalog.attribution import _OWNER
from screentime.operators import exposure as X
from screentime.operators import attribution as A
from screentime.plans.analysis import Settings, analyse, label_persons
from screentime.tables import with_views

_FILTERED = _OWNER + """,
v_kept AS (SELECT v.* FROM v_vis v JOIN (SELECT DISTINCT video_id, t, det_id FROM v_verdict WHERE keep) k ON v.video_id = k.video_id AND v.t = k.t AND v.det_id = k.det_id),
v_krun AS (SELECT video_id, brand_key, track_id, run_no, min(t) AS start_t, max(t) + 0.5 AS end_t, avg(visibility) AS mean_vis FROM (
  SELECT *, sum(opens) OVER (PARTITION BY video_id, brand_key, track_id ORDER BY t) AS run_no FROM (
    SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY video_id, brand_key, track_id ORDER BY t, det_id) <= 1.25 THEN 0 ELSE 1 END AS opens
    FROM v_kept WHERE visibility > 0.02) a) b GROUP BY 1, 2, 3, 4)"""


@query("team_filtered_exposure", with_views("logo", "person", "vis", extra=_FILTERED) + """
SELECT video_id, brand_key, sum(end_t - start_t) AS total_exposure_s, count(*) AS segment_count, round(sum((end_t - start_t) * mean_vis *
  CASE WHEN end_t - start_t < 1 THEN 0.5 WHEN end_t - start_t <= 5 THEN 1.0 ELSE 1.2 END), 6) AS quality_exposure_s FROM v_krun GROUP BY 1, 2""")
def team_filtered_exposure(t):
    out = analyse(t.logos(), t.meta(), t.persons(), settings=Settings(min_votes=2.5))
    return out.brands.select(*X.BRAND, "total_exposure_s", "segment_count", F.round("quality_exposure_s", 6).alias("quality_exposure_s"))


_CHAIN = """v_cls AS (SELECT *, CASE WHEN split_part(person_id, '-', 2) = '7' THEN -1 ELSE CAST(split_part(person_id, '-', 2) AS BIGINT) END AS track_id,
    CASE WHEN CAST(cx AS BIGINT) % 5 = 0 THEN NULL ELSE team END AS team_pred, (CAST(cy AS BIGINT) % 10) / 10.0 AS margin
  FROM v_person p WHERE EXISTS (SELECT 1 FROM v_logo l WHERE l.video_id = p.video_id AND l.t = p.t)),
v_inst AS (SELECT video_id, track_id, t, sum(CASE WHEN team_pred = 'target' THEN conf * (margin + 0.25) ELSE 0 END) AS vt,
    sum(CASE WHEN team_pred = 'other' THEN conf * (margin + 0.25) ELSE 0 END) AS vo FROM v_cls WHERE track_id >= 0 GROUP BY 1, 2, 3),
v_cum AS (SELECT video_id, track_id, t, sum(vt) OVER w AS a, sum(vo) OVER w AS b FROM v_inst WINDOW w AS (PARTITION BY video_id, track_id ORDER BY t)),
v_forced AS (SELECT *, CASE WHEN a + b <= 0 THEN NULL WHEN coalesce(lag(a + b) OVER (PARTITION BY video_id, track_id ORDER BY t), 0) <= 0 THEN CASE WHEN a >= b THEN 'target' ELSE 'other' END
    WHEN a > b * 1.25 THEN 'target' WHEN b > a * 1.25 THEN 'other' END AS forced FROM v_cum),
v_told AS (SELECT video_id, track_id, t, a + b AS vote_mass, coalesce(last_value(forced IGNORE NULLS) OVER (PARTITION BY video_id, track_id ORDER BY t), 'target') AS label FROM v_forced),
v_labelled AS (SELECT p.* EXCLUDE (team, vote_mass), coalesce(o.label, p.team_pred, 'other') AS team, coalesce(o.vote_mass, 0) AS vote_mass
  FROM v_cls p LEFT JOIN v_told o ON p.video_id = o.video_id AND p.track_id = o.track_id AND p.t = o.t),
"""
_CHAIN_FILTERED = _CHAIN + _FILTERED.replace("JOIN v_person p", "JOIN v_labelled p")


def predicted(t):
    """Persons with a prediction per box; line 7 stands for boxes outside a track."""
    return t.persons_with_track().withColumns({
        "track_id": F.when(F.col("track_id") == 7, -1).otherwise(F.col("track_id")),
        "team_pred": F.when(F.col("cx").cast("bigint") % 5 != 0, F.col("team")),
        "margin": F.col("cy").cast("bigint") % 10 / 10.0,
        "quality": F.col("conf"),
    })


@query("team_chain_verdicts", with_views("logo", "person", "vis", extra=_CHAIN_FILTERED) + """
SELECT DISTINCT video_id, t, det_id, person_id, team, round(vote_mass, 6) AS vote_mass, keep FROM v_verdict""")
def team_chain_verdicts(t):
    owned = A.assign_owner(t.logos(), label_persons(predicted(t), t.logos()), ["video_id", "t", "det_id"])
    rows = A.team_verdict(owned, min_votes=2.5).withColumn("vote_mass", F.round("vote_mass", 6))
    return rows.select("video_id", "t", "det_id", "person_id", "team", "vote_mass", "keep").distinct()


@query("team_chain_exposure", with_views("logo", "person", "vis", extra=_CHAIN_FILTERED) + """
SELECT video_id, brand_key, sum(end_t - start_t) AS total_exposure_s, count(*) AS segment_count, round(sum((end_t - start_t) * mean_vis *
  CASE WHEN end_t - start_t < 1 THEN 0.5 WHEN end_t - start_t <= 5 THEN 1.0 ELSE 1.2 END), 6) AS quality_exposure_s FROM v_krun GROUP BY 1, 2""")
def team_chain_exposure(t):
    out = analyse(t.logos(), t.meta(), predicted(t), settings=Settings(min_votes=2.5))
    return out.brands.select(*X.BRAND, "total_exposure_s", "segment_count", F.round("quality_exposure_s", 6).alias("quality_exposure_s"))
