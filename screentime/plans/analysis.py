"""The end-to-end plan: detections, persons and metadata to priced brands."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screentime.operators import attribution as A
from screentime.operators import exposure as X
from screentime.operators import team as T
from screentime.operators import vectors as VO

TEAMS = ("target", "other")


@dataclass(frozen=True)
class Settings:
    """Parameters of one analysis run."""

    sample_dt: float = 0.5
    visibility_floor: float = 0.02
    min_segment_s: float = 0.5
    min_votes: float = 2.0
    keep_unknown: bool = True
    keep_unassigned: bool = False
    color_weight: float = 0.6
    embedding_weight: float = 0.4


@dataclass(frozen=True)
class Analysis:
    """Lazy outputs of one run; nothing is computed until one is written."""

    segments: DataFrame
    brands: DataFrame
    totals: DataFrame
    timeline: DataFrame


def keep_team(logos: DataFrame, persons: DataFrame, keys: list[str], settings: Settings) -> DataFrame:
    """Logo rows whose owner passes the team filter."""
    verdict = A.team_verdict(
        A.assign_owner(logos, persons, keys), settings.min_votes, settings.keep_unknown, settings.keep_unassigned
    )
    return logos.join(verdict.filter("keep").select(*keys), keys, "left_semi")


def label_persons(persons: DataFrame, logos: DataFrame, teams: tuple[str, ...] = TEAMS) -> DataFrame:
    """``team`` and ``vote_mass`` of every person on a frame that shows a logo.

    ``persons``: video_id, t, track_id, team_pred, margin, quality. Voting advances on
    frames with a logo only; a person without prediction casts no vote and shows the
    label of its track so far. Persons outside a track (``track_id`` null or negative)
    show their own prediction, else the last team, with no votes.
    """
    at, keys = ["video_id", "t"], [*T.TRACK, "t"]
    seen = persons.drop("team", "vote_mass").join(logos.select(*at).distinct(), at, "left_semi")
    weight = F.when(F.col("team_pred").isNotNull(), T.vote_weight(F.col("quality"), F.col("margin")))
    votes = seen.filter("track_id >= 0").select(*keys, F.col("team_pred").alias("team"), F.coalesce(weight, F.lit(0.0)).alias("weight"))
    live = T.live_votes(votes, list(teams))
    mass = sum((F.col(f"cum_{x}") for x in teams[1:]), F.col(f"cum_{teams[0]}"))
    told = T.hysteresis_labels(live.withColumn("vote_mass", mass), list(teams), carry=("vote_mass",))
    return seen.join(told, keys, "left").select(
        *seen.columns, F.coalesce("label", "team_pred", F.lit(teams[-1])).alias("team"), F.coalesce("vote_mass", F.lit(0.0)).alias("vote_mass")
    )


def analyse(
    logos: DataFrame, meta: DataFrame, persons: DataFrame | None = None, preview: DataFrame | None = None,
    keys: tuple[str, ...] = ("video_id", "t", "det_id"), settings: Settings | None = None,
    refs: DataFrame | None = None, multipliers: DataFrame | None = None,
) -> Analysis:
    """Score, filter by team, build segments, price; the timeline comes from the
    unfiltered preview rows when they are given.

    Persons may come with ``team`` and ``vote_mass``, with a prediction per box (see
    :func:`label_persons`), or with the features ``color`` and ``embedding`` and the team
    references ``refs`` to be classified by. ``multipliers`` are the category and
    prime-time factors of :func:`price_brands`.
    """
    s = settings or Settings()
    if refs is not None:
        persons = VO.classify(persons, refs, s.color_weight, s.embedding_weight)
    if persons is not None and "team_pred" in persons.columns:
        persons = label_persons(persons, logos)
    kept = keep_team(logos, persons, list(keys), s) if persons is not None else logos
    runs = X.exposure_runs(X.score_detections(kept), s.sample_dt, s.visibility_floor)
    segments = X.segments(runs, s.sample_dt, s.min_segment_s)
    brands = X.price_brands(X.brand_exposure(segments), meta, multipliers)
    timeline = X.timeline_intervals(preview if preview is not None else kept, 1.0 / s.sample_dt)
    return Analysis(segments, brands, X.analysis_totals(brands, meta), timeline)
