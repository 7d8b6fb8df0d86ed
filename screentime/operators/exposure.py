"""Detections to visible segments, brand exposure and media value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screentime.functions import visibility as V
from screentime.operators.scans import CHUNK_SECONDS, dealt, merge_runs, prefix_sums

TRACK = ["video_id", "brand_key", "track_id"]
BRAND = ["video_id", "brand_key"]

# What prices a video without metadata.
DEFAULT_CPM = 22.0
DEFAULT_AUDIENCE = 0
DEFAULT_PLACEMENT = "Live Broadcast TV"


def score_detections(df: DataFrame) -> DataFrame:
    """Adds area, the score terms and visibility to rows with cx, cy, w, h, conf, frame_w, frame_h."""
    area = V.box_area(
        F.col("cx") - F.col("w") / 2, F.col("cy") - F.col("h") / 2,
        F.col("cx") + F.col("w") / 2, F.col("cy") + F.col("h") / 2,
    )
    penalty = V.obb_penalty(F.col("obb_area"), area) if "obb_area" in df.columns else F.lit(1.0)
    return df.select(
        "*",
        area.alias("area"),
        V.visibility(
            V.size_score(area, F.col("frame_w"), F.col("frame_h")),
            V.position_score(F.col("cx"), F.col("cy"), F.col("frame_w"), F.col("frame_h")),
            F.col("conf"),
            penalty,
        ).alias("visibility"),
    )


def visible(df: DataFrame, floor: float = V.VISIBILITY_FLOOR) -> DataFrame:
    return df.filter(F.col("visibility") > floor)


def instants(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key and time: the partial sums that runs are built from.

    Hits meet by key and time, so a busy key is spread over its times and carries at
    most one row per sampled time into the run step.
    """
    return dealt(df.select(*keys, "t", "visibility"), *keys, "t").groupBy(*keys, "t").agg(
        F.sum("visibility").alias("vis_sum"), F.count(F.lit(1)).alias("hits")
    )


def segment_gap(dt: float) -> float:
    return max(2.5 * dt, dt + 0.05)


def exposure_runs(
    scored: DataFrame, dt: float = 0.5, floor: float = V.VISIBILITY_FLOOR, chunk: float = CHUNK_SECONDS
) -> DataFrame:
    """Visible runs per track: first and last hit, hit count and visibility sum."""
    points = instants(visible(scored, floor), TRACK).select(
        *TRACK, F.col("t").alias("start_t"), F.col("t").alias("last_t"), "vis_sum", "hits"
    )
    return merge_runs(points, TRACK, "start_t", "last_t", segment_gap(dt), sums=["vis_sum", "hits"], chunk=chunk)


def segments(runs: DataFrame, dt: float = 0.5, min_seconds: float = V.MIN_SEGMENT_SECONDS) -> DataFrame:
    duration = F.greatest(F.col("last_t") + dt - F.col("start_t"), F.lit(dt))
    mean_vis = F.col("vis_sum") / F.col("hits")
    return (
        runs.select(
            *TRACK, "start_t", (F.col("last_t") + dt).alias("end_t"), "hits",
            duration.alias("duration_s"), mean_vis.alias("avg_visibility"),
        )
        .filter(F.col("duration_s") >= min_seconds)
        .withColumn("duration_weight", V.duration_weight(F.col("duration_s")))
        .withColumn(
            "quality_s", F.col("avg_visibility") * F.col("duration_weight") * F.col("duration_s")
        )
    )


def brand_exposure(segs: DataFrame) -> DataFrame:
    """Brand totals; the mean visibility is taken over segment means at 3 digits."""
    return segs.groupBy(*BRAND).agg(
        F.sum("duration_s").alias("total_exposure_s"),
        F.sum("quality_s").alias("quality_exposure_s"),
        F.avg(F.round("avg_visibility", 3)).alias("avg_visibility"),
        F.count(F.lit(1)).alias("segment_count"),
        F.max("duration_s").alias("longest_segment_s"),
    )


def price_brands(brands: DataFrame, meta: DataFrame, multipliers: DataFrame | None = None) -> DataFrame:
    """Adds ``emv_usd`` from per-video metadata and optional per-brand multipliers.

    A video without a metadata row, or with nulls in it, is priced with the defaults.
    """
    defaults = {"cpm_base": DEFAULT_CPM, "audience_size": DEFAULT_AUDIENCE, "placement_type": DEFAULT_PLACEMENT}
    rows = brands.join(meta.select("video_id", *defaults), "video_id", "left").withColumns(
        {name: F.coalesce(name, F.lit(value)) for name, value in defaults.items()}
    )
    category = prime = None
    if multipliers is not None:
        rows = rows.join(multipliers, BRAND, "left")
        category = F.coalesce(F.col("category_multiplier"), F.lit(1.0))
        prime = F.coalesce(F.col("prime_multiplier"), F.lit(1.0))
    value = V.emv(
        F.col("quality_exposure_s"), F.col("cpm_base"), F.col("audience_size"),
        V.placement_multiplier(F.col("placement_type")), category, prime,
    )
    return rows.select(*brands.columns, value.alias("emv_usd"))


def analysis_totals(priced: DataFrame, videos: DataFrame | None = None) -> DataFrame:
    """Totals per video; those of ``videos`` without any brand get zeros."""
    totals = priced.groupBy("video_id").agg(
        F.sum("emv_usd").alias("total_emv_usd"),
        F.sum("quality_exposure_s").alias("total_quality_s"),
        F.avg("avg_visibility").alias("avg_visibility"),
        F.count(F.lit(1)).alias("brand_count"),
    )
    if videos is None:
        return totals
    values = [c for c in totals.columns if c != "video_id"]
    return videos.select("video_id").distinct().join(totals, "video_id", "left").na.fill(0, values)


def raw_classes(dets: DataFrame) -> DataFrame:
    """Sorted raw class names per brand; the set is bounded by the detector's class list."""
    return dets.groupBy(*BRAND).agg(F.array_sort(F.collect_set("raw_name")).alias("raw_classes"))


def timeline_intervals(dets: DataFrame, fps: float = 2.0, chunk: float = CHUNK_SECONDS) -> DataFrame:
    """On-screen intervals per brand from raw hits, without floor or minimum length."""
    frame_dt = 1.0 / max(0.1, fps)
    gap = max(2.0 * frame_dt, 0.25)
    times = dealt(dets.select(*BRAND, "t"), *BRAND, "t").distinct()
    points = times.select(*BRAND, F.col("t").alias("start_t"), F.col("t").alias("last_t"))
    runs = merge_runs(points, BRAND, "start_t", "last_t", gap, chunk=chunk)
    return runs.select(*BRAND, "start_t", (F.col("last_t") + frame_dt).alias("end_t"))


def merged_intervals(segs: DataFrame, keys: list[str], chunk: float = CHUNK_SECONDS) -> DataFrame:
    """Union of overlapping segments per key, so parallel tracks count once."""
    spans = dealt(segs.select(*keys, "start_t", "end_t"), *keys, "start_t").groupBy(*keys, "start_t").agg(F.max("end_t").alias("end_t"))
    return merge_runs(spans, keys, "start_t", "end_t", 0.0, chunk=chunk, points=False)


def scene_merge(
    scenes: DataFrame, gap: float = 1.5, min_seconds: float = 2.0, chunk: float = CHUNK_SECONDS
) -> DataFrame:
    """Merge neighbouring close-up scenes; keep the tallest person of each clip."""
    closeups = (
        scenes.filter("is_closeup").groupBy("video_id", "start_t")
        .agg(F.max("end_t").alias("end_t"), F.max("max_person_h").alias("max_person_h"))
    )
    merged = merge_runs(
        closeups, ["video_id"], "start_t", "end_t", gap, maxes=["max_person_h"], chunk=chunk, points=False
    )
    return merged.filter(F.col("end_t") - F.col("start_t") >= min_seconds)


def category_multipliers(scored: DataFrame, categories: DataFrame) -> DataFrame:
    """0.80 with a same-category rival in any shared frame, 1.25 when alone, else 1.00.

    ``categories`` maps ``brand_key`` to ``category``. Rival frames are found from
    the number of distinct brands per (video, category, time), not from pairs.
    """
    named = scored.join(categories, "brand_key").select("video_id", "category", "brand_key", "t")
    hits = dealt(named, "video_id", "category", "t").distinct()
    crowded = (
        hits.groupBy("video_id", "category", "t").agg(F.count(F.lit(1)).alias("brands_in_frame"))
        .filter("brands_in_frame > 1").select("video_id", "category", "t")
    )
    contested = hits.join(crowded, ["video_id", "category", "t"], "left_semi").select(
        *BRAND, F.lit(True).alias("contested")
    ).distinct()
    brands = hits.select("video_id", "category", "brand_key").distinct()
    sizes = brands.groupBy("video_id", "category").agg(F.count(F.lit(1)).alias("brands_in_category"))
    return (
        brands.join(sizes, ["video_id", "category"]).join(contested, BRAND, "left")
        .select(
            *BRAND, "category", "brands_in_category",
            F.when(F.col("contested"), 0.80)
            .when(F.col("brands_in_category") == 1, 1.25)
            .otherwise(1.00).alias("category_multiplier"),
        )
    )


def prime_time_split(
    segs: DataFrame, clock: DataFrame, edge_seconds: float = 900.0
) -> DataFrame:
    """Cut segments at kick-off, final whistle and the edge periods; weight each piece.

    ``clock`` has one row per video with ``kickoff_s`` and ``whistle_s``. Segments of
    a video without them stay whole, with weight 1 and no phase.
    """
    rows = segs.join(clock.select("video_id", "kickoff_s", "whistle_s"), "video_id", "left")
    k, w = F.col("kickoff_s"), F.col("whistle_s")
    early_end = F.least(k + edge_seconds, w)
    late_start = F.greatest(w - edge_seconds, early_end)
    far = F.lit(float("1e18"))

    def zone(lo: Column, hi: Column, name: str | None, mult: float) -> Column:
        return F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(name).cast("string").alias("phase"), F.lit(mult).alias("mult"))

    zones = F.array(
        zone(-far, k, "pre", 0.70), zone(k, early_end, "opening", 1.30),
        zone(early_end, late_start, "middle", 1.00), zone(late_start, w, "closing", 1.30),
        zone(w, far, "post", 0.70),
    )
    whole = F.array(zone(-far, far, None, 1.00))
    pieces = rows.select("*", F.explode(F.when(k.isNull() | w.isNull(), whole).otherwise(zones)).alias("z"))
    lo = F.greatest(F.col("start_t"), F.col("z.lo"))
    hi = F.least(F.col("end_t"), F.col("z.hi"))
    return (
        pieces.select(*TRACK, "avg_visibility", "duration_weight", lo.alias("start_t"), hi.alias("end_t"),
                      F.col("z.phase").alias("phase"), F.col("z.mult").alias("prime_multiplier"))
        .filter(F.col("end_t") > F.col("start_t"))
    )


def prime_multipliers(pieces: DataFrame) -> DataFrame:
    """Per brand the quality-weighted mean multiplier of its pieces."""
    quality = F.col("avg_visibility") * F.col("duration_weight") * (F.col("end_t") - F.col("start_t"))
    return pieces.groupBy(*BRAND).agg(
        F.try_divide(F.sum(quality * F.col("prime_multiplier")), F.sum(quality)).alias("prime_multiplier")
    )


def segment_lookup(events: DataFrame, intervals: DataFrame, keys: list[str], slot: float = 60.0) -> DataFrame:
    """Attach to each timed event the open interval ``start <= t < end``.

    Intervals are spread over the time slots they touch, which makes the range
    condition an equi-join on the slot.
    """
    lo = F.floor(F.col("start_t") / slot).cast("bigint")
    hi = F.floor(F.col("end_t") / slot).cast("bigint")
    spread = intervals.withColumn("__slot", F.explode(F.sequence(lo, hi)))
    timed = events.withColumn("__slot", F.floor(F.col("t") / slot).cast("bigint"))
    return dealt(timed, *keys, "__slot").join(
        dealt(spread, *keys, "__slot"), [*keys, "__slot"]
    ).filter((F.col("t") >= F.col("start_t")) & (F.col("t") < F.col("end_t"))).drop("__slot")


def cumulative_exposure(
    segs: DataFrame, durations: DataFrame, step: float = 300.0
) -> DataFrame:
    """Visibility-weighted seconds per brand up to each grid time.

    A segment adds its clipped part at grid steps inside it and its full value at
    every later step. Inside-steps come from the segment itself; full values are
    summed per first later step and carried forward along the grid, so no segment
    meets every grid point. Brands of a video without a duration get the grid up to
    their last segment.
    """
    vis = F.col("avg_visibility")
    first = F.floor(F.col("start_t") / step).cast("bigint") + 1
    done = F.ceil(F.col("end_t") / step).cast("bigint")
    mark = lambda g, part, full: F.struct(g.alias("g"), part.alias("part"), full.alias("full"))
    none = F.lit(0.0)
    steps = F.when(done > first, F.sequence(first, done - 1)).otherwise(F.array().cast("array<bigint>"))
    inside = F.transform(steps, lambda g: mark(g, (g * step - F.col("start_t")) * vis, none))
    closed = F.array(mark(F.greatest(first, done), none, (F.col("end_t") - F.col("start_t")) * vis))
    raw = segs.select(*BRAND, F.explode(F.concat(inside, closed)).alias("m")).groupBy(*BRAND, F.col("m.g").alias("g")).agg(
        F.sum("m.part").alias("part"), F.sum("m.full").alias("full")
    )
    last = F.coalesce(F.ceil(F.col("duration_s") / step).cast("bigint"), F.col("reach"))
    grid = raw.groupBy(*BRAND).agg(F.max("g").alias("reach")).join(durations, "video_id", "left").select(
        *BRAND, F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("g"), none.alias("part"), none.alias("full"), F.lit(1).alias("on_grid")
    )
    marks = raw.withColumn("on_grid", F.lit(0)).unionByName(grid).groupBy(*BRAND, "g").agg(
        F.sum("part").alias("part"), F.sum("full").alias("full"), F.max("on_grid").alias("on_grid")
    )
    return (
        prefix_sums(marks, BRAND, "g", {"done": "full"}, chunk=1024.0).filter("on_grid = 1")
        .select(*BRAND, (F.col("g") * step).alias("t"), (F.col("done") + F.col("part")).alias("cumulative"))
    )
