"""Views over brand results of many matches.

Input ``results`` has one row per (video_id, brand_key) with emv_usd,
total_exposure_s, quality_exposure_s, avg_visibility and segment_count; it is
the reduced output of the exposure step, so its groups are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screentime.operators.scans import previous, ranked

METRICS = ("emv", "exposure", "visibility", "emv_per_s", "segments_per_match")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def brand_rank_ids(brands: DataFrame) -> DataFrame:
    """``logo-i`` per video by quality; the group is one row per brand."""
    order = Window.partitionBy("video_id").orderBy(F.round("quality_exposure_s", 9).desc(), "brand_key")
    return brands.withColumn("logo_id", F.concat(F.lit("logo-"), (F.row_number().over(order) - 1).cast("string")))


def match_filter(matches: DataFrame, text: str = "", date_from: str = "", date_to: str = "") -> DataFrame:
    """Case-insensitive substring of either name and an inclusive date range."""
    out = matches
    needle = text.strip().lower()
    if needle:
        out = out.filter(F.contains(F.lower("event_name"), F.lit(needle)) | F.contains(F.lower("video_name"), F.lit(needle)))
    if date_from:
        out = out.filter(F.col("match_date") >= F.lit(date_from).cast("date"))
    if date_to:
        out = out.filter(F.col("match_date") < F.date_add(F.lit(date_to).cast("date"), 1))
    return out


def _sums() -> list[Column]:
    weighted = F.sum(F.col("avg_visibility") * F.col("total_exposure_s"))
    return [
        F.sum("emv_usd").alias("emv"),
        F.sum("total_exposure_s").alias("exposure"),
        F.sum("quality_exposure_s").alias("quality"),
        _ratio(weighted, F.sum("total_exposure_s")).alias("visibility"),
        F.sum("segment_count").alias("segments"),
    ]


def brand_portfolio(results: DataFrame) -> DataFrame:
    """Per brand over all matches. Results hold one row per brand and match, so the
    row count is the match count and no distinct aggregate is needed."""
    return results.groupBy("brand_key").agg(*_sums(), F.count(F.lit(1)).alias("match_count"))


def portfolio_kpis(results: DataFrame, matches: DataFrame) -> DataFrame:
    footage = matches.agg(F.sum("duration_s").alias("footage_s"), F.count(F.lit(1)).alias("match_count"))
    return results.agg(*_sums()).crossJoin(footage)


def brand_per_match(results: DataFrame) -> DataFrame:
    totals = results.groupBy("video_id").agg(F.sum("emv_usd").alias("match_emv"))
    return results.groupBy("video_id", "brand_key").agg(*_sums()).join(totals, "video_id").select(
        "video_id", "brand_key", "emv", "exposure", "segments", "visibility", _ratio(F.col("emv"), F.col("match_emv")).alias("sov")
    )


def brand_match_emv(results: DataFrame, brands: DataFrame, matches: DataFrame) -> DataFrame:
    """EMV for every wanted brand and match, 0 where the brand is absent.

    The zero rows come from the cross product of matches and wanted brands, which is the
    output; no list of all brands is built.
    """
    wanted = brands.select("brand_key").filter("brand_key IS NOT NULL").distinct()
    grid = matches.select("video_id").crossJoin(wanted)
    emv = results.join(wanted, "brand_key", "left_semi").groupBy("video_id", "brand_key").agg(F.sum("emv_usd").alias("emv"))
    return grid.join(emv, ["video_id", "brand_key"], "left").select(
        "video_id", "brand_key", F.coalesce(F.col("emv"), F.lit(0.0)).alias("emv")
    )


def top_brands(portfolio: DataFrame, n: int = 10) -> DataFrame:
    return portfolio.orderBy(F.round("emv", 2).desc(), "brand_key").limit(n)


def heatmap(results: DataFrame, matches: DataFrame, n: int = 10) -> DataFrame:
    """Top brands by match as rows of (brand, match, emv); pivot with ``heatmap_wide``."""
    return brand_match_emv(results, top_brands(brand_portfolio(results), n), matches)


def heatmap_wide(cells: DataFrame, match_ids: list) -> DataFrame:
    """One column per listed match; the list bounds the width."""
    return cells.groupBy("brand_key").pivot("video_id", match_ids).agg(F.sum("emv")).na.fill(0.0)


def avg_brand_in_match(results: DataFrame, matches: DataFrame) -> DataFrame:
    per = results.groupBy("video_id").agg(F.sum("emv_usd").alias("emv"), F.count(F.lit(1)).alias("brands"))
    return matches.select("video_id").join(per, "video_id", "left").select(
        "video_id", _ratio(F.col("emv"), F.col("brands")).alias("avg_brand_emv")
    )


def brand_metrics(portfolio: DataFrame) -> DataFrame:
    """The five profile metrics per brand."""
    return portfolio.select(
        "brand_key", "emv", "exposure", "visibility",
        _ratio(F.col("emv"), F.col("exposure")).alias("emv_per_s"),
        (F.col("segments") / F.greatest(F.lit(1), F.col("match_count"))).alias("segments_per_match"),
    )


def portfolio_brand_average(portfolio: DataFrame) -> DataFrame:
    return brand_metrics(portfolio).agg(*[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in METRICS])


def _with_totals(df: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    """Attach group totals: one aggregated row per key joined back, not a window."""
    return df.join(df.groupBy(*keys).agg(*aggs), keys) if keys else df.crossJoin(df.agg(*aggs))


def radar_profile(portfolio: DataFrame) -> DataFrame:
    rows = _with_totals(brand_metrics(portfolio), [], [F.max(m).alias(f"max_{m}") for m in METRICS])
    floor = F.lit(float("1e-9"))
    return rows.select("brand_key", *[(F.col(m) / F.greatest(floor, F.col(f"max_{m}"))).alias(m) for m in METRICS])


def report_rows(results: DataFrame, matches: DataFrame, match_id=None, brand: str | None = None) -> DataFrame:
    """One match: its brands; otherwise the portfolio over ``matches``; optional brand."""
    scope = (
        results.filter(F.col("video_id") == match_id)
        if match_id is not None
        else results.join(matches.select("video_id"), "video_id", "left_semi")
    )
    rows = brand_portfolio(scope)
    return rows.filter(F.col("brand_key") == brand) if brand else rows


def share_of_voice(rows: DataFrame, scope_total: DataFrame) -> DataFrame:
    """Share of the scope's total, which ignores any brand filter on ``rows``."""
    return rows.crossJoin(scope_total.agg(F.sum("emv").alias("scope_emv"))).withColumn(
        "sov", _ratio(F.col("emv"), F.col("scope_emv"))
    ).drop("scope_emv")


def report_ratios(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {"quality_ratio": _ratio(F.col("quality"), F.col("exposure")), "emv_per_s": _ratio(F.col("emv"), F.col("exposure"))}
    )


def match_rollup(results: DataFrame) -> DataFrame:
    """Brand by match cells plus per-brand, per-match and grand totals in one pass."""
    return results.cube("brand_key", "video_id").agg(
        F.grouping_id().cast("bigint").alias("level"), F.sum("emv_usd").alias("emv"),
        F.sum("total_exposure_s").alias("exposure"), F.sum("segment_count").alias("segments"),
    )


def exposure_share(results: DataFrame) -> DataFrame:
    """Share of a video's seconds per brand with running start and end angles."""
    order = Window.partitionBy("video_id").orderBy(F.round("quality_exposure_s", 9).desc(), "brand_key")
    rows = _with_totals(results, ["video_id"], [F.sum("total_exposure_s").alias("all_s")])
    frac = F.try_divide(F.col("total_exposure_s"), F.col("all_s"))
    upto = F.sum("total_exposure_s").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(
        "video_id", "brand_key", frac.alias("fraction"),
        ((upto - F.col("total_exposure_s")) / F.col("all_s") * 360.0).alias("start_angle"),
        (upto / F.col("all_s") * 360.0).alias("end_angle"),
    )


def bar_fraction(rows: DataFrame, value: str) -> DataFrame:
    scaled = _with_totals(rows, [], [F.max(value).alias("top")])
    return scaled.withColumn("fraction", _ratio(F.col(value), F.col("top"))).drop("top")


def minmax_heatmap(rows: DataFrame, metrics: list[str]) -> DataFrame:
    bounds = [f(m).alias(f"{n}_{m}") for m in metrics for n, f in (("lo", F.min), ("hi", F.max))]
    scaled = _with_totals(rows, [], bounds)

    def cell(m: str) -> Column:
        span = F.col(f"hi_{m}") - F.col(f"lo_{m}")
        return F.when(span > 0, F.try_divide(F.col(m) - F.col(f"lo_{m}"), span)).otherwise(F.lit(0.0)).alias(m)

    return scaled.select(*[c for c in rows.columns if c not in metrics], *[cell(m) for m in metrics])


def match_positions(matches: DataFrame) -> DataFrame:
    """Matches numbered from 1 by date, then id, over slices of both."""
    return ranked(matches.select("video_id", "match_date"), [], "match_date", ["video_id"], "position").select("video_id", "position")


def emv_trend(results: DataFrame, matches: DataFrame, n: int = 3) -> DataFrame:
    """Per match in date order: total and the top brands, with the change to the match before."""
    cells = heatmap(results, matches, n).select("video_id", F.col("brand_key").alias("series"), "emv")
    totals = matches.select("video_id").join(
        results.groupBy("video_id").agg(F.sum("emv_usd").alias("emv")), "video_id", "left"
    ).select("video_id", F.lit("Total EMV").alias("series"), F.coalesce(F.col("emv"), F.lit(0.0)).alias("emv"))
    order = match_positions(matches)
    rows = cells.unionByName(totals).join(order, "video_id")
    return previous(rows, ["series"], "position", {"before": "emv"}, chunk=4096.0).select(
        "series", "position", "video_id", "emv", (F.col("emv") - F.col("before")).alias("delta")
    )


def top8_plus_other(portfolio: DataFrame, n: int = 8) -> DataFrame:
    """The largest brands and one row for the rest, present only when there is a rest."""
    head = top_brands(portfolio, n).select("brand_key", "emv")
    other = portfolio.join(head, "brand_key", "left_anti").agg(F.sum("emv").alias("emv")).filter("emv IS NOT NULL")
    return head.unionByName(other.select(F.lit("Other").alias("brand_key"), "emv"))


SORTS = {"date": "match_date", "emv": "total_emv", "duration": "duration_s"}


def match_list(results: DataFrame, matches: DataFrame, by: str = "date") -> DataFrame:
    totals = results.groupBy("video_id").agg(F.sum("emv_usd").alias("total_emv"), F.count(F.lit(1)).alias("logo_count"))
    rows = matches.join(totals, "video_id", "left").na.fill(0, ["total_emv", "logo_count"])
    return rows.orderBy(F.col(SORTS[by]).desc(), "video_id")


def table_sort(rows: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Any column; strings without regard to case first, then by code point."""
    keys = [F.lower(column), F.col(column)] if dict(rows.dtypes)[column] == "string" else [F.col(column)]
    return rows.orderBy(*[k.asc() if ascending else k.desc() for k in keys])


def best_matches(results: DataFrame, order: DataFrame) -> DataFrame:
    """Per brand the match with most EMV and the one with most EMV per second.

    ``order`` gives each match its ``position``; the later match wins a tie.
    """
    seen = results.filter("total_exposure_s > 0").join(order, "video_id")
    eff = F.round(F.col("emv_usd") / F.col("total_exposure_s"), 6)
    return seen.groupBy("brand_key").agg(
        F.max_by("video_id", F.struct(F.round("emv_usd", 2), "position")).alias("best_match"),
        F.max_by("video_id", F.struct(eff, "position")).alias("most_efficient_match"),
    )


def scope_highlights(rows: DataFrame) -> DataFrame:
    """Most exposed, most visible and most efficient brand in one aggregate."""
    eff = F.when(F.col("exposure") > 0, F.round(F.col("emv") / F.col("exposure"), 6))
    return rows.agg(
        F.max_by("brand_key", F.struct(F.round("exposure", 6), "brand_key")).alias("most_exposed"),
        F.max_by("brand_key", F.struct(F.round("visibility", 6), "brand_key")).alias("most_visible"),
        F.max_by("brand_key", F.struct(eff, "brand_key")).alias("most_efficient"),
    )


def match_selection(matches: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted analysis per request where it exists, else the newest one."""
    newest = matches.agg(F.max_by("video_id", F.struct("match_date", "video_id")).alias("newest"))
    return wanted.join(matches.select(F.col("video_id").alias("found")), F.col("wanted_id") == F.col("found"), "left").crossJoin(
        newest
    ).select("request_id", F.coalesce("found", "newest").alias("video_id"))


def brands_in_all_matches(results: DataFrame, matches: DataFrame) -> DataFrame:
    """Brands present in every match: their row count equals the number of matches."""
    total = matches.agg(F.count(F.lit(1)).alias("matches"))
    per = results.groupBy("brand_key").agg(F.count(F.lit(1)).alias("n"))
    return per.crossJoin(total).filter("n = matches").select("brand_key")
