"""Operators over per-frame metric rows and video metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screentime.functions import frames as FR
from screentime.operators.scans import dealt, exact_percentiles


def frame_sample(frames: DataFrame, sample_fps: float) -> DataFrame:
    """Keep every ``step``-th frame index; adds the 3-digit time."""
    step = FR.sample_step(F.col("fps"), sample_fps)
    return frames.filter(F.col("frame_idx") % step == 0).withColumn(
        "t", F.when(F.col("fps") > 0, F.bround(F.col("frame_idx") / F.col("fps"), 3)).otherwise(F.lit(0.0))
    )


def stride_plan(videos: DataFrame, sample_fps: float) -> DataFrame:
    step = FR.sample_step(F.col("fps"), sample_fps)
    return videos.filter("frame_count > 0").select(
        "video_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("frame_count") - 1, step)).alias("frame_idx")
    )


def _even(n: int, lo: Column, hi: Column) -> Column:
    step = (hi - lo) / F.lit(float(max(1, n - 1)))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i * step + lo).cast("bigint"))


def even_plan(videos: DataFrame, n: int, lo: Column, hi: Column) -> DataFrame:
    """``n`` evenly spaced indices from ``lo`` to ``hi``, truncated."""
    return videos.select("video_id", F.explode(_even(n, lo, hi)).alias("frame_idx"))


def interior_plan(videos: DataFrame, n: int) -> DataFrame:
    """Even spacing between 5 % and 95 % of the frames."""
    lo = (F.col("frame_count") * 0.05).cast("bigint")
    hi = (F.col("frame_count") * 0.95).cast("bigint")
    return even_plan(videos, n, lo, hi)


def head_plan(videos: DataFrame, seconds: float, sample_fps: float) -> DataFrame:
    """The stride plan limited to the first seconds of each video."""
    limit = F.least(F.col("frame_count"), (F.col("fps") * seconds).cast("bigint"))
    return stride_plan(videos.withColumn("frame_count", limit), sample_fps)


def uniform_plus_dense(videos: DataFrame, n_uniform: int, dense_every: int, dense_seconds: float = 120.0) -> DataFrame:
    """Distinct frames of the even plan over the whole video and of the dense one at its start.

    The indices of a video are a short list whose doubles go before it is spread; only a
    video listed with several lengths or rates meets its frames again.
    """
    lengths = dealt(videos.select("video_id", "frame_count", "fps"), "video_id").groupBy("video_id").agg(
        F.collect_set(F.struct("frame_count", "fps")).alias("lengths")
    )
    last = F.col("frame_count") - 1
    end = F.least(F.col("frame_count"), (F.col("fps") * dense_seconds).cast("bigint"))
    dense = F.when(end > 0, F.sequence(F.lit(0).cast("bigint"), F.greatest(end, F.lit(1)) - 1, F.lit(dense_every).cast("bigint")))
    both = F.concat(_even(n_uniform, F.lit(0).cast("bigint"), last), F.coalesce(dense, F.array().cast("array<bigint>")))

    def frames(rows: DataFrame) -> DataFrame:
        listed = rows.select("video_id", F.inline("lengths"))
        return listed.select("video_id", F.explode(F.array_distinct(both)).alias("frame_idx"))

    once, often = F.size("lengths") == 1, F.size("lengths") > 1
    return frames(lengths.filter(once)).union(frames(lengths.filter(often)).distinct())


def passing_frames(frames: DataFrame, grass_min: float = FR.GRASS_MIN) -> DataFrame:
    """Frames that fail none of the gates, each gate its own conjunct."""
    out = frames
    for _, fails in FR.gates(grass_min):
        out = out.filter(~fails)
    return out.filter(F.col("torso_sharp") >= FR.MIN_TORSO_SHARP)


def with_composite(frames: DataFrame) -> DataFrame:
    closeup = F.col("max_target_h") >= FR.CLOSEUP_H
    return frames.select(
        "*", closeup.alias("is_closeup"),
        FR.composite(F.col("sharp"), F.col("n_target"), F.col("avg_target_h"), closeup, F.col("crowd_score")).alias("composite"),
    )


def gate_summary(frames: DataFrame) -> DataFrame:
    """One row per video: counts, pass rate, blurry and close-up shares."""
    ok = FR.gate_reason() == "ok"
    close = F.col("max_target_h") >= FR.CLOSEUP_H
    blurry = ok & (F.col("sharp") < 30)
    n, n_ok = F.count(F.lit(1)), F.count_if(ok)
    pct = lambda part, whole: F.count_if(part) * 100.0 / F.greatest(whole, F.lit(1))
    return frames.groupBy("video_id").agg(
        n.alias("total_sampled"), n_ok.alias("passed"), (n - n_ok).alias("failed"),
        pct(ok, n).alias("pass_rate_pct"),
        F.count_if(blurry).alias("blurry"), pct(blurry, n_ok).alias("blurry_pct"),
        F.count_if(close).alias("closeups"), pct(close, n).alias("closeup_pct_of_all"),
        pct(close & ok, n_ok).alias("closeup_pct_of_passing"),
    )


def fail_reasons(frames: DataFrame) -> DataFrame:
    return frames.withColumn("reason", FR.gate_reason()).filter("reason <> 'ok'").groupBy("video_id", "reason").count()


def metric_quantiles(frames: DataFrame, metric: str, keys: list[str]) -> DataFrame:
    """min, max, mean and the exact quartiles of one metric."""
    basic = frames.groupBy(*keys).agg(
        F.min(metric).alias("min"), F.max(metric).alias("max"), F.avg(metric).alias("mean")
    )
    quartiles = exact_percentiles(frames, keys, metric, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return basic.join(quartiles, keys)


def metric_quantiles_approx(frames: DataFrame, metric: str, keys: list[str], accuracy: int = 10000) -> DataFrame:
    q = F.percentile_approx(metric, [0.25, 0.5, 0.75], accuracy)
    return frames.groupBy(*keys).agg(
        F.min(metric).alias("min"), F.max(metric).alias("max"), F.avg(metric).alias("mean"), q.alias("q")
    ).select(*keys, "min", "max", "mean", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"))
