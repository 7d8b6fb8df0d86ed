"""Frame sampling, gates and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Gate thresholds and composite weights.
GRASS_MIN, GRASS_MAX = 0.25, 0.92
AUDIT_GRASS_MIN = 0.18
CROWD_MAX = 0.85
MIN_PERSONS, MIN_TARGETS = 2, 1
MIN_TARGET_H = 0.18
MIN_TORSO_SHARP = 15.0
CLOSEUP_H = 0.40
W_SHARP, W_TARGET, W_HEIGHT, W_CLOSEUP, W_CROWD = 0.7, 1.0, 8.0, 3.0, 2.0
FRAMES_PER_MINUTE, MIN_OUTPUT, MAX_OUTPUT = 10.0, 80, 500


def sample_step(fps: Column, sample_fps: Column | float) -> Column:
    rate = F.greatest(F.lit(0.1), F.lit(sample_fps) if not isinstance(sample_fps, Column) else sample_fps)
    return F.greatest(F.lit(1), F.bround(fps / rate).cast("bigint"))


def expected_samples(frame_count: Column, step: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(frame_count / step).cast("bigint"))


def adaptive_sample_fps(duration_s: Column) -> Column:
    return F.when(duration_s < 1200, 2.0).when(duration_s < 3600, 1.0).when(duration_s < 7200, 0.5).otherwise(0.33)


def adaptive_target_k(duration_s: Column, cap: int = 0) -> Column:
    wanted = F.bround(duration_s / 60.0 * F.lit(FRAMES_PER_MINUTE)).cast("bigint")
    k = F.greatest(F.lit(MIN_OUTPUT), F.least(F.lit(MAX_OUTPUT), wanted))
    return F.least(k, F.lit(cap)) if cap > 0 else k


def size_bucket(max_h: Column) -> Column:
    return F.when(max_h >= 0.50, "closeup").when(max_h >= 0.30, "medium").otherwise("wide")


def composite(sharp: Column, n_target: Column, avg_h: Column, closeup: Column, crowd: Column) -> Column:
    return (
        F.log1p(sharp) * W_SHARP + n_target * W_TARGET + avg_h * W_HEIGHT
        + F.when(closeup, F.lit(W_CLOSEUP)).otherwise(F.lit(0.0)) - crowd * W_CROWD
    )


def gates(grass_min: float = GRASS_MIN) -> list[tuple[str, Column]]:
    """Reject conditions in their fixed order."""
    c = F.col
    return [
        ("grass_ratio", (c("grass_ratio") < grass_min) | (c("grass_ratio") > GRASS_MAX)),
        ("crowd", c("crowd_score") > CROWD_MAX),
        ("n_persons", c("n_persons") < MIN_PERSONS),
        ("no_target_player", c("n_target") < MIN_TARGETS),
        ("max_tgt_h", c("max_target_h") < MIN_TARGET_H),
    ]


def gate_reason(grass_min: float = AUDIT_GRASS_MIN) -> Column:
    """Name of the first failing gate, else ``ok``."""
    reason = None
    for name, fails in gates(grass_min):
        reason = F.when(fails, name) if reason is None else reason.when(fails, name)
    return reason.otherwise("ok")
