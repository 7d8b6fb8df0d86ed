"""OCR detections to sponsor matches, exposure report and price list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screentime.functions import text as T
from screentime.functions import visibility as V
from screentime.functions.rounding import scaled_round
from screentime.operators.scans import CHUNK_SECONDS, dealt, merge_runs

# Market parameters of the price list.
CPM_GBP, VIEWERS_K, DISCOUNT = 18.0, 250.0, 0.30
VALUE_RETENTION, MATCHES_PER_SEASON = 0.75, 27
SCENARIOS = (
    ("Live TV (Sky Sports)", 250.0, 0.30),
    ("Highlights (YouTube)", 500.0, 0.10),
    ("Social clip (<1 min)", 1500.0, 0.08),
    ("Match recording (OTT)", 80.0, 0.30),
)
#: Longest dictionary key that is looked up by deletions; their number grows with its square.
SHORT_KEY = 12
REPORT_COLUMNS = (
    "sponsor", "total_seconds", "n_appearances", "n_frames", "avg_area_pct", "peak_area_pct",
    "area_seconds", "avg_cx", "avg_cy", "avg_ocr_conf", "first_seen_s", "last_seen_s",
)


def readable(df: DataFrame) -> DataFrame:
    return df.filter((F.col("ocr_conf") >= T.MIN_OCR_CONF) & (F.length(F.trim("text")) >= T.MIN_TEXT_LEN))


def drop_blank_sponsor(df: DataFrame) -> DataFrame:
    return df.filter(F.col("sponsor").isNotNull() & (F.col("sponsor") != ""))


def match_sponsors(texts: DataFrame, dictionary: DataFrame, cutoff: float = T.MIN_FUZZY) -> DataFrame:
    """Best dictionary sponsor per text: ``text, sponsor, fuzzy``.

    ``texts`` has column ``text``, ``dictionary`` has ``key, sponsor``. Only
    distinct folded texts meet the dictionary. A ratio of ``c`` needs
    ``2 * shorter >= c/100 * (shorter + longer)``, so every key is listed under the
    text lengths it can reach and the match becomes an equi-join on length; pairs whose
    letters alone rule the cut-off out are dropped before the common subsequence is sought.
    Spaced keys are asked first and despaced ones second: the second answer wins if its
    score is above the whole part of the first. Fractions of the score are dropped.
    """
    spaced = dictionary.select(F.col("key"), "sponsor", F.lit(0).alias("rank"))
    joined = dictionary.select(T.despace(F.col("key")).alias("key"), "sponsor", F.lit(1).alias("rank"))
    keys = spaced.union(joined).distinct()
    share = cutoff / 100.0
    low = F.ceil(F.length("key") * F.lit(share / (2.0 - share))).cast("int")
    high = F.floor(F.length("key") * F.lit((2.0 - share) / share)).cast("int")
    by_len = keys.withColumn("len", F.explode(F.sequence(F.greatest(low, F.lit(1)), F.greatest(high, F.lit(1)))))
    folded = texts.select("text").distinct().withColumn("folded", T.ocr_fold(F.col("text")))
    distinct = folded.select("folded").distinct().filter(F.length("folded") >= T.MIN_TEXT_LEN)
    scored = (
        distinct.withColumn("len", F.length("folded")).withColumn("letters", T.letter_mask(F.col("folded")))
        .join(by_len.withColumn("key_letters", T.letter_mask(F.col("key"))), "len")
        .filter(T.may_reach(F.col("folded"), F.col("letters"), F.col("key"), F.col("key_letters"), cutoff))
        .withColumn("ratio", T.indel_ratio(F.col("folded"), F.col("key"))).filter(F.col("ratio") >= cutoff)
    )
    answer = F.struct((-F.col("ratio")).alias("neg"), "key", "sponsor")
    best = scored.groupBy("folded").agg(*[F.min(F.when(F.col("rank") == i, answer)).alias(n) for i, n in enumerate(("spaced", "joined"))])
    second = F.col("spaced").isNull() | (-F.col("joined.neg") > F.floor(-F.col("spaced.neg")))
    best = best.select("folded", F.when(second, F.col("joined")).otherwise(F.col("spaced")).alias("m"))
    return folded.join(best, "folded").select("text", "m.sponsor", F.floor(-F.col("m.neg")).cast("bigint").alias("fuzzy"))


def _deletions(text: Column, times: int) -> Column:
    """The text and everything left of it after up to ``times`` letters are deleted."""
    found = F.array(text)
    for _ in range(times):
        one_less = lambda s: F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.left(s, i - 1), F.substr(s, i + 1))
        )
        found = F.array_union(found, F.flatten(F.transform(found, one_less)))
    return found


def _segment(i: Column, length: Column, parts: int) -> tuple[Column, Column]:
    """Begin (from 0) and width of part ``i`` of a key of this length."""
    edge = lambda k: F.floor(k * length / parts).cast("int")
    return edge(i), edge(i + 1) - edge(i)


def near_candidates(texts: DataFrame, keys: DataFrame, max_edits: int, short: int = SHORT_KEY) -> DataFrame:
    """Distinct ``folded, key`` pairs that hold every pair within ``max_edits`` edits.

    Keys of up to ``short`` letters and the texts they can reach meet in their deletion
    neighbourhoods: two strings within ``d`` edits become equal after at most ``d``
    deletions in each. A longer key is cut into ``d + 1`` parts; one of them is untouched and
    stands in the text, ``d`` places off at most, so the text's pieces of those widths
    around those places are looked up. Both are equi-joins on a hash of the piece (with
    the part's number and the key's length); a text has a bounded number of pieces.
    """
    d, parts = max_edits, max_edits + 1
    long_key, reach = F.length("key") > short, F.length("folded")
    whole = lambda name: F.transform(_deletions(F.col(name), d), lambda s: F.xxhash64(s))
    numbers = F.sequence(F.lit(0), F.lit(d))

    def own(i: Column) -> Column:
        begin, width = _segment(i, F.length("key"), parts)
        return F.xxhash64(i, F.length("key"), F.substr(F.col("key"), begin + 1, width))

    def looked_up(n: Column) -> Column:
        def part(i: Column) -> Column:
            begin, width = _segment(i, n, parts)
            places = F.filter(F.sequence(begin - d, begin + d), lambda p: (p >= 0) & (p + width <= reach))
            return F.transform(places, lambda p: F.xxhash64(i, n, F.substr(F.col("folded"), p + 1, width)))

        return F.flatten(F.transform(numbers, part))

    lengths = F.sequence(F.greatest(reach - d, F.lit(short + 1)), F.greatest(reach + d, F.lit(short + 1)))
    near_pieces = F.flatten(F.transform(lengths, looked_up))
    folded, keyed = texts.select("folded").distinct().filter("folded IS NOT NULL"), keys.select("key").distinct().filter("key IS NOT NULL")
    sides = [
        (folded.filter(reach <= short + d).select("folded", F.explode(whole("folded")).alias("piece")),
         keyed.filter(~long_key).select("key", F.explode(whole("key")).alias("piece"))),
        (folded.filter(reach > short - d).select("folded", F.explode(F.array_distinct(near_pieces)).alias("piece")),
         keyed.filter(long_key).select("key", F.explode(F.transform(numbers, own)).alias("piece"))),
    ]
    met = [a.join(b, "piece").filter(F.abs(F.length("folded") - F.length("key")) <= d).select("folded", "key") for a, b in sides]
    return met[0].union(met[1]).distinct()


def near_keys(texts: DataFrame, keys: DataFrame, max_edits: int) -> DataFrame:
    """Text and dictionary key pairs within an edit distance, with the distance."""
    distance = F.levenshtein("folded", "key", max_edits)
    return near_candidates(texts, keys, max_edits).withColumn("distance", distance.cast("bigint")).filter("distance >= 0")


def best_per_frame(df: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """The largest detection per key; ties by ``det_id``. ``keys`` include the time."""
    rest = F.struct((-F.col("area_pct")).alias("neg"), "det_id", *payload)
    return dealt(df.select(*keys, rest.alias("r")), *keys).groupBy(*keys).agg(F.min("r").alias("b")).select(
        *keys, (-F.col("b.neg")).alias("area_pct"), "b.det_id", *[F.col(f"b.{c}") for c in payload]
    )


def exposure_report(
    df: DataFrame, keys: list[str], dt: float = 1.0, gap: float = 2.0, chunk: float = CHUNK_SECONDS
) -> DataFrame:
    """The 12 report metrics per key from one detection per frame."""
    best = best_per_frame(df, [*keys, "time_s"], ["cx", "cy", "ocr_conf"])
    points = best.select(
        *keys, F.col("time_s").alias("start_t"), F.col("time_s").alias("last_t"), "area_pct",
        F.col("area_pct").alias("peak"), "cx", "cy", "ocr_conf", F.lit(1).alias("frames"),
    )
    runs = merge_runs(
        points, keys, "start_t", "last_t", gap, sums=["area_pct", "cx", "cy", "ocr_conf", "frames"],
        maxes=["peak"], chunk=chunk,
    )
    n = F.sum("frames")
    return runs.groupBy(*keys).agg(
        (n * F.lit(dt)).alias("total_seconds"),
        F.count(F.lit(1)).alias("n_appearances"),
        n.cast("bigint").alias("n_frames"),
        (F.sum("area_pct") / n).alias("avg_area_pct"),
        F.max("peak").alias("peak_area_pct"),
        (F.sum("area_pct") * F.lit(dt)).alias("area_seconds"),
        (F.sum("cx") / n).alias("avg_cx"),
        (F.sum("cy") / n).alias("avg_cy"),
        (F.sum("ocr_conf") / n).alias("avg_ocr_conf"),
        F.min("start_t").alias("first_seen_s"),
        F.max("last_t").alias("last_seen_s"),
    )


def printed() -> list[Column]:
    """Report columns at their printed precision."""
    digits = {"total_seconds": 1, "area_seconds": 2, "first_seen_s": 1, "last_seen_s": 1}
    plain = ("sponsor", "n_appearances", "n_frames")
    return [F.col(c) if c in plain else scaled_round(F.col(c), digits.get(c, 3)).alias(c) for c in REPORT_COLUMNS]


def present_report(report: DataFrame) -> DataFrame:
    """The report at its printed precision, largest area-seconds first."""
    return report.select(*printed()).orderBy(F.col("area_seconds").desc(), "sponsor")


def pct_of_match(report: DataFrame, processed_seconds: Column) -> DataFrame:
    return report.withColumn(
        "pct_of_match", F.coalesce(F.try_divide(F.col("total_seconds") * 100.0, processed_seconds), F.lit(0.0))
    )


def scored(df: DataFrame, dt: float) -> DataFrame:
    frac = F.col("area_pct") / 100.0
    pos, clear = V.normalised_position(F.col("cx"), F.col("cy")), V.clarity(frac)
    return df.select(
        "*", frac.alias("area_frac"), pos.alias("pos_score"), clear.alias("clarity"), (frac * pos * clear).alias("qi")
    ).withColumns({"eff_area_s": F.col("qi") * dt, "raw_area_s": F.col("area_frac") * dt})


def video_duration(df: DataFrame, keys: list[str], dt: float) -> DataFrame:
    return df.groupBy(*keys).agg((F.max("time_s") + dt).alias("video_duration_s"))


def pricing_agg(df: DataFrame, keys: list[str], dt: float = 1.0) -> DataFrame:
    """Per-sponsor aggregates over every detection row, sums rounded to 4 digits."""
    rows = scored(drop_blank_sponsor(df), dt)
    r4 = lambda c, name: scaled_round(c, 4).alias(name)
    per = rows.groupBy(*keys, "sponsor").agg(
        F.count("qi").alias("n_detections"),
        r4(F.count(F.lit(1)) * F.lit(dt), "screen_time_s"),
        r4(F.sum("raw_area_s"), "raw_area_sec"),
        r4(F.sum("eff_area_s"), "eff_area_sec"),
        r4(F.avg("qi"), "mean_qi"),
        r4(F.avg("area_pct"), "mean_area_pct"),
        r4(F.max("area_pct"), "peak_area_pct"),
        r4(F.avg("pos_score"), "mean_pos"),
        r4(F.avg("clarity"), "mean_clarity"),
        r4(F.avg("ocr_conf"), "mean_ocr_conf"),
        F.min("time_s").alias("first_seen_s"),
        F.max("time_s").alias("last_seen_s"),
    )
    # One row per key: the length is the latest sponsor time of the same scope.
    span = per.groupBy(*keys).agg((F.max("last_seen_s") + dt).alias("video_duration_s"))
    joined = per.join(span, keys) if keys else per.crossJoin(span)
    return joined.withColumn("screen_time_pct", scaled_round(F.col("screen_time_s") / F.col("video_duration_s") * 100.0, 1))


def cpes(cpm: float = CPM_GBP, viewers_k: float = VIEWERS_K, discount: float = DISCOUNT) -> Column:
    return F.lit(cpm) * F.lit(viewers_k) / 30.0 * F.lit(discount)


def emv_gbp(agg: DataFrame) -> DataFrame:
    """Value from the rounded area-seconds; the discount is null when the raw value is 0."""
    rows = agg.withColumns(
        {"emv_gbp": scaled_round(F.col("eff_area_sec") * cpes(), 2), "emv_raw_gbp": scaled_round(F.col("raw_area_sec") * cpes(), 2)}
    )
    ratio = F.try_divide(F.col("emv_gbp"), F.col("emv_raw_gbp"))
    return rows.withColumn("quality_disc_pct", scaled_round((F.lit(1.0) - ratio) * 100.0, 1))


def price_recommendation(priced: DataFrame, keys: list[str]) -> DataFrame:
    match = scaled_round(F.col("emv_gbp") * VALUE_RETENTION, 2)
    return priced.select(
        *keys, "sponsor", "screen_time_s", "emv_gbp", match.alias("fair_price_match_gbp"),
        scaled_round(match * MATCHES_PER_SEASON).alias("fair_price_season_gbp"),
        scaled_round(F.try_divide(F.col("emv_gbp"), match), 2).alias("sponsor_roi_x"),
    )


def sensitivity(agg: DataFrame) -> DataFrame:
    """Total effective area under each fixed audience scenario."""
    rows = F.array(*[
        F.struct(F.lit(n).alias("scenario"), F.lit(v).alias("viewers_k"), F.lit(d).alias("discount")) for n, v, d in SCENARIOS
    ])
    total = agg.agg(F.sum("eff_area_sec").alias("area"))
    per_second = F.lit(CPM_GBP) * F.col("s.viewers_k") / 30.0 * F.col("s.discount")
    return total.select("area", F.explode(rows).alias("s")).select(
        "s.scenario", "s.viewers_k", "s.discount", per_second.alias("cpes"), (F.col("area") * per_second).alias("total_emv_gbp")
    )


def full_price_table(priced: DataFrame, prices: DataFrame, keys: list[str]) -> DataFrame:
    extra = prices.select(*keys, "sponsor", "fair_price_match_gbp", "fair_price_season_gbp", "sponsor_roi_x")
    return priced.join(extra, [*keys, "sponsor"])


EXEC_COLUMNS = (
    "sponsor", "screen_time_s", "screen_time_pct", "mean_area_pct", "mean_qi", "eff_area_sec",
    "emv_gbp", "fair_price_match_gbp", "fair_price_season_gbp",
)


def audit_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("sponsor").agg(F.count(F.lit(1)).alias("n"))


def lowest_confidence(df: DataFrame, n: int = 10) -> DataFrame:
    return df.orderBy("ocr_conf", "video_id", "det_id").limit(n)
