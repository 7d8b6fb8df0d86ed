"""Per-detection scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scoring, duration bands, placement multipliers, pricing set.
SIGMA_OF_WIDTH = 0.3
VISIBILITY_FLOOR = 0.02
MIN_SEGMENT_SECONDS = 0.5
POSITION_SIGMA = 0.4
CLARITY_SATURATION = 0.003
PLACEMENT_MULTIPLIERS = {
    "live broadcast tv": 1.00,
    "live stream": 0.85,
    "live stream online": 0.85,
    "highlight clip": 1.40,
    "highlight": 1.40,
    "social media": 0.70,
    "social media clip": 0.70,
}


def box_area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, x2 - x1) * F.greatest(zero, y2 - y1)


def size_score(area: Column, frame_w: Column, frame_h: Column) -> Column:
    return F.sqrt(F.least(F.lit(1.0), area / F.greatest(F.lit(1.0), frame_w * frame_h)))


def position_score(cx: Column, cy: Column, frame_w: Column, frame_h: Column) -> Column:
    dx, dy = cx - frame_w / 2, cy - frame_h / 2
    sigma = frame_w * F.lit(SIGMA_OF_WIDTH)
    falloff = F.exp(-F.try_divide(dx * dx + dy * dy, sigma * sigma))
    return F.when(sigma > 0, falloff).otherwise(F.lit(0.0))


def obb_penalty(rotated_area: Column, upright_area: Column) -> Column:
    """Share of the upright box that the rotated box fills; 1 without a rotated box."""
    return F.coalesce(F.least(F.lit(1.0), F.try_divide(rotated_area, upright_area)), F.lit(1.0))


def visibility(size: Column, position: Column, conf: Column, penalty: Column | None = None) -> Column:
    score = size * position * conf * (penalty if penalty is not None else F.lit(1.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def normalised_position(cx: Column, cy: Column) -> Column:
    dx, dy = cx - 0.5, cy - 0.5
    return F.exp((dx * dx + dy * dy) * F.lit(-0.5 / POSITION_SIGMA**2))


def clarity(area_frac: Column) -> Column:
    return F.least(F.lit(1.0), area_frac / F.lit(CLARITY_SATURATION))


def duration_weight(seconds: Column) -> Column:
    return F.when(seconds < 1.0, 0.5).when(seconds <= 5.0, 1.0).otherwise(1.2)


def placement_multiplier(label: Column) -> Column:
    """Lookup in the fixed table as a literal map; unknown labels count 1."""
    entries = [F.lit(v) for pair in PLACEMENT_MULTIPLIERS.items() for v in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), F.lower(F.trim(label))), F.lit(1.0))


def emv(
    quality: Column, cpm: Column, audience: Column, placement: Column,
    category: Column | None = None, prime: Column | None = None,
) -> Column:
    one = F.lit(1.0)
    return (
        quality * (cpm / 1000.0) * audience * placement
        * (category if category is not None else one)
        * (prime if prime is not None else one)
    )
