"""Score against label: ranking quality, thresholds, best method."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screentime.operators.scans import exact_percentiles, prefix_sums, value_counts

THRESHOLD_POINTS = {f"p{p:02d}": p / 100.0 for p in range(5, 96, 5)}


def score_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Positives and negatives per distinct score."""
    pos, neg = (F.col("label") == 1).cast("bigint"), (F.col("label") == 0).cast("bigint")
    return value_counts(df, keys, "score", {"pos": pos, "neg": neg})


def roc_auc(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mann-Whitney AUC with half credit for ties, from counts per distinct score."""
    cum = prefix_sums(score_counts(df, keys), keys, "score", {"neg_upto": "neg"}, chunk=F.col("slice"))
    wins = F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2.0)
    per = cum.groupBy(*keys).agg(F.sum(wins).alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return per.select(*keys, F.coalesce(F.try_divide(F.col("w"), F.col("p") * F.col("n")), F.lit(0.5)).alias("auc"))


def _rates(tp, fp, fn):
    return tp / F.greatest(F.lit(1), tp + fp), tp / F.greatest(F.lit(1), tp + fn)


def pr_at_threshold(df: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    hit, good = F.col("score") >= threshold, F.col("label") == 1
    p, r = _rates(F.count_if(hit & good), F.count_if(hit & ~good), F.count_if(~hit & good))
    return df.groupBy(*keys).agg(p.alias("precision"), r.alias("recall"))


def threshold_scores(df: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 per key at its 5th to 95th percentile in steps of 5.

    The thresholds are 19 values per key; each distinct score is counted against
    them, not each row.
    """
    points = exact_percentiles(df, keys, "score", THRESHOLD_POINTS)
    listed = points.select(*keys, F.array(*[F.struct(F.lit(i).alias("step"), F.col(n).alias("thr")) for i, n in enumerate(THRESHOLD_POINTS)]).alias("ts"))
    counts = score_counts(df, keys).join(listed, keys).select(*keys, "score", "pos", "neg", F.explode("ts").alias("x"))
    above = F.col("score") >= F.col("x.thr")
    tp, fp = F.sum(F.when(above, F.col("pos")).otherwise(0)), F.sum(F.when(above, F.col("neg")).otherwise(0))
    fn = F.sum(F.when(~above, F.col("pos")).otherwise(0))
    sums = counts.groupBy(*keys, F.col("x.step").alias("step"), F.col("x.thr").alias("threshold")).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    p, r = _rates(F.col("tp"), F.col("fp"), F.col("fn"))
    f1 = (p * r * 2) / F.greatest(F.lit(float("1e-9")), p + r)
    return sums.select(*keys, "step", "threshold", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def best_f1_threshold(df: DataFrame, keys: list[str]) -> DataFrame:
    """The first threshold with the best F1; zeros where no threshold has a positive F1."""
    best = threshold_scores(df, keys).groupBy(*keys).agg(
        F.min(F.struct((-F.round("f1", 12)).alias("neg"), "step", "threshold", "precision", "recall", "f1")).alias("b")
    )
    some = F.col("b.f1") > 0
    return best.select(*keys, *[F.when(some, F.col(f"b.{c}")).otherwise(F.lit(0.0)).alias(c) for c in ("threshold", "precision", "recall", "f1")])


def best_method(df: DataFrame) -> DataFrame:
    return roc_auc(df, ["method"]).agg(
        F.min(F.struct((-F.round("auc", 12)).alias("neg"), "method", "auc")).alias("b")
    ).select("b.method", "b.auc")
