"""Visibility, media value and frame plans as temporary SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from screentime.functions.visibility import PLACEMENT_MULTIPLIERS, SIGMA_OF_WIDTH


def register_functions(spark: SparkSession) -> None:
    """Creates or replaces ``st_visibility``, ``st_placement``, ``st_emv`` and the table functions
    ``st_stride_plan``, ``st_interior_plan`` and ``st_head_plan``.

    They are SQL expressions that the optimizer inlines, so no Python runs. Nulls in
    any argument give null, but an unknown or missing placement counts 1. The table
    functions stand in an inner lateral join and give one row per frame to visit; a null
    argument or a video without frames gives none.
    """
    sigma = f"(frame_w * {SIGMA_OF_WIDTH}D)"
    cases = " ".join(f"WHEN '{label}' THEN {value}D" for label, value in PLACEMENT_MULTIPLIERS.items())
    numbers = ", ".join(f"{name} DOUBLE" for name in ("cx", "cy", "w", "h", "conf", "frame_w", "frame_h"))
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION st_visibility({numbers}) RETURNS DOUBLE RETURN
        CASE WHEN cx + cy + w + h + conf + frame_w + frame_h IS NOT NULL THEN greatest(0D, least(1D,
          sqrt(least(1D, greatest(0D, w) * greatest(0D, h) / greatest(1D, frame_w * frame_h)))
          * CASE WHEN {sigma} > 0 THEN exp(-try_divide(
              (cx - frame_w / 2) * (cx - frame_w / 2) + (cy - frame_h / 2) * (cy - frame_h / 2), {sigma} * {sigma})) ELSE 0D END
          * conf)) END""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION st_placement(label STRING) RETURNS DOUBLE RETURN
        CASE lower(trim(label)) {cases} ELSE 1D END""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION st_emv(quality DOUBLE, cpm DOUBLE, audience DOUBLE, placement STRING)
        RETURNS DOUBLE RETURN quality * (cpm / 1000D) * audience * st_placement(placement)""")
    step = "greatest(1L, CAST(bround(fps / greatest(0.1D, rate)) AS BIGINT))"
    interior = "CAST(frame_count * 0.05D AS BIGINT)", "CAST(frame_count * 0.95D AS BIGINT)"
    plans = {
        "st_stride_plan(frame_count BIGINT, fps DOUBLE, rate DOUBLE)": f"""
            CASE WHEN frame_count > 0 AND fps + rate IS NOT NULL THEN sequence(0L, frame_count - 1, {step}) END""",
        "st_interior_plan(frame_count BIGINT, frames BIGINT)": f"""
            CASE WHEN frame_count > 0 AND frames > 0 THEN transform(sequence(0L, frames - 1), i ->
              CAST(i * (({interior[1]} - {interior[0]}) / CAST(greatest(1L, frames - 1) AS DOUBLE)) + {interior[0]} AS BIGINT)) END""",
        "st_head_plan(frame_count BIGINT, fps DOUBLE, seconds DOUBLE, rate DOUBLE)": f"""
            CASE WHEN least(frame_count, CAST(fps * seconds AS BIGINT)) > 0 AND frame_count + fps + seconds + rate IS NOT NULL
            THEN sequence(0L, least(frame_count, CAST(fps * seconds AS BIGINT)) - 1, {step}) END""",
    }
    for signature, indices in plans.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS TABLE (frame_idx BIGINT) RETURN SELECT explode({indices})")
