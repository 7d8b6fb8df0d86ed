"""Team references, classification and clustering on feature tables."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screentime.functions import text as T
from screentime.functions import vector as V

# Cluster sizes and weight bounds of the reference bootstrap.
MIN_CROPS, MIN_TARGET_SHARE = 24, 0.10
WEIGHT_LOW, WEIGHT_HIGH, MIN_ADVANTAGE = 0.1, 0.9, 1e-3


def mean_vectors(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Element-wise means per key with a map-side combine; null vectors are left out."""
    prepared = df.select(*keys, *[F.when(F.col(c).isNotNull(), array_to_vector(F.col(c))).alias(c) for c in columns])
    parts = [
        prepared.filter(F.col(c).isNotNull()).groupBy(*keys).agg(vector_to_array(Summarizer.mean(F.col(c))).alias(c))
        for c in columns
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, keys, "full")
    return out


def team_centroids(crops: DataFrame) -> DataFrame:
    """Per team the unit mean embedding and the mean colour histogram."""
    means = mean_vectors(crops, ["team"], ["embedding", "color"])
    return means.select("team", V.unit(F.col("embedding")).alias("embedding"), "color")


def with_refs(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """Attach the references as one sorted array; there is one entry per team."""
    one = refs.agg(F.array_sort(F.collect_list(F.struct("team", "embedding", "color"))).alias("refs"))
    return rows.crossJoin(one)


def classify(rows: DataFrame, refs: DataFrame, w_color: float, w_embedding: float) -> DataFrame:
    """Team, confidence and margin from the weighted softmax of both features.

    A missing feature drops out and the other weight becomes 1; with neither the
    result is null with confidence and margin 0.
    """
    joined = with_refs(rows, refs)
    usable = lambda c: F.col(c).isNotNull() & F.forall("refs", lambda r: r[c].isNotNull())
    color = F.transform("refs", lambda r: V.hist_intersection(F.col("color"), r["color"]) * V.TEMP_COLOR)
    emb = F.transform("refs", lambda r: V.dot(F.col("embedding"), r["embedding"]) * V.TEMP_EMBEDDING)
    wc = F.when(usable("color"), F.lit(float(w_color))).otherwise(F.lit(0.0))
    we = F.when(usable("embedding"), F.lit(float(w_embedding))).otherwise(F.lit(0.0))
    staged = joined.select("*", wc.alias("__wc"), we.alias("__we"), color.alias("__sc"), emb.alias("__se"))
    zero = F.transform("refs", lambda r: F.lit(0.0))
    pc = F.when(F.col("__wc") > 0, V.softmax(F.col("__sc"))).otherwise(zero)
    pe = F.when(F.col("__we") > 0, V.softmax(F.col("__se"))).otherwise(zero)
    mixed = staged.select("*", pc.alias("__pc"), pe.alias("__pe")).withColumn(
        "__p",
        F.zip_with("__pc", "__pe", lambda a, b: F.try_divide(a * F.col("__wc") + b * F.col("__we"), F.col("__wc") + F.col("__we"))),
    )
    ranked = F.reverse(F.array_sort(F.zip_with("__p", "refs", lambda p, r: F.struct(p.alias("p"), r["team"].alias("team")))))
    best = mixed.withColumn("__r", ranked)
    none = F.col("__wc") + F.col("__we") <= 0
    top, second = F.col("__r")[0], F.try_element_at("__r", F.lit(2))
    return best.select(
        *rows.columns,
        F.when(~none, top["team"]).alias("team_pred"),
        F.when(none, 0.0).otherwise(top["p"]).alias("confidence"),
        F.when(none, 0.0).otherwise(top["p"] - F.coalesce(second["p"], F.lit(0.0))).alias("margin"),
    )


def _nearest_ref(score) -> Column:
    """Team of the highest score; the first team wins ties."""
    scored = F.transform("refs", lambda r: F.struct((-score(r)).alias("neg"), r["team"].alias("team")))
    return F.array_min(scored)["team"]


def fusion_weights(crops: DataFrame, refs: DataFrame) -> DataFrame:
    """Weights from each feature's nearest-reference accuracy above chance."""
    joined = with_refs(crops, refs)
    hit = lambda score: F.avg((_nearest_ref(score) == F.col("team")).cast("double"))
    acc = joined.agg(
        hit(lambda r: V.hist_intersection(F.col("color"), r["color"])).alias("acc_color"),
        hit(lambda r: V.dot(F.col("embedding"), r["embedding"])).alias("acc_embedding"),
        (F.lit(1.0) / F.greatest(F.max(F.size("refs")), F.lit(2))).alias("chance"),
    )
    adv = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0.0)) - F.col("chance"), F.lit(MIN_ADVANTAGE))
    share = adv("acc_color") / (adv("acc_color") + adv("acc_embedding"))
    w = F.least(F.lit(WEIGHT_HIGH), F.greatest(F.lit(WEIGHT_LOW), share))
    return acc.select("acc_color", "acc_embedding", w.alias("w_color"), (F.lit(1.0) - w).alias("w_embedding"))


def nearest_centroid(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """Closest centroid by Euclidean distance; ``centroids`` has team and embedding."""
    joined = with_refs(rows, centroids.select("team", "embedding", F.lit(None).cast("array<double>").alias("color")))
    scored = F.transform(
        "refs", lambda r: F.struct(F.round(V.squared_distance(F.col("embedding"), r["embedding"]), 12).alias("d"), r["team"].alias("team"))
    )
    best = joined.withColumn("__b", F.array_min(scored))
    return best.select(*rows.columns, F.col("__b.team").alias("nearest"), F.sqrt("__b.d").alias("distance"))


def cluster_exemplars(rows: DataFrame, centroids: DataFrame, n: int) -> DataFrame:
    """The ``n`` members closest to their own centroid; ranking keeps ``n`` rows per
    cluster and task before the shuffle."""
    own = rows.join(centroids.select(F.col("team").alias("label"), F.col("embedding").alias("centre")), "label")
    dist = own.withColumn("distance", F.round(F.sqrt(V.squared_distance(F.col("embedding"), F.col("centre"))), 9))
    order = Window.partitionBy("label").orderBy("distance", "vec_id")
    return dist.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select("label", "vec_id", "rank", "distance")


def kmeans_clusters(rows: DataFrame, k: int | None = None, seed: int = 7, max_iter: int = 30) -> DataFrame:
    """Cluster number per row; ``k`` is 3 from 24 rows on, else 2."""
    data = rows.withColumn("features", array_to_vector(F.col("embedding")))
    if k is None:
        k = 3 if rows.limit(MIN_CROPS).count() >= MIN_CROPS else 2
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features", predictionCol="cluster").fit(data)
    return model.transform(data).drop("features")


def pick_target_cluster(
    crops: DataFrame, dark: bool, anchor_embedding: list[float] | None = None, anchor_color: list[float] | None = None
) -> DataFrame:
    """Target cluster by anchor similarity, else by luminance; empty when too few crops
    or the cluster holds less than the minimum share. ``crops``: cluster, embedding, color."""
    means = mean_vectors(crops, ["cluster"], ["embedding", "color"])
    sizes = crops.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    terms = []
    if anchor_embedding is not None:
        terms.append(V.dot(V.unit(F.col("embedding")), F.array(*[F.lit(float(x)) for x in anchor_embedding])))
    if anchor_color is not None:
        terms.append(V.hist_intersection(F.col("color"), F.array(*[F.lit(float(x)) for x in anchor_color])))
    if terms:
        score = sum(terms[1:], terms[0]) / F.lit(float(len(terms)))
    else:
        lum = V.luminance(F.col("color"))
        score = -lum if dark else lum
    best = means.select("cluster", F.round(score, 9).alias("score")).join(sizes, "cluster").agg(
        F.min(F.struct((-F.col("score")).alias("neg"), "cluster", "n", "score")).alias("b"), F.sum("n").alias("total")
    )
    ok = (F.col("total") >= MIN_CROPS) & (F.col("b.n") >= F.col("total") * MIN_TARGET_SHARE)
    return best.filter(ok).select("b.cluster", "b.score", "b.n", "total")


def cluster_size_rank(rows: DataFrame) -> DataFrame:
    """Largest cluster is Team A, second Team B, the rest Other. One row per cluster."""
    sizes = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    entry = F.struct((-F.col("n")).alias("neg"), "cluster")
    ordered = sizes.agg(F.array_sort(F.collect_list(entry)).alias("e")).select(F.posexplode("e").alias("pos", "e"))
    name = F.when(F.col("pos") == 0, "Team A").when(F.col("pos") == 1, "Team B").otherwise("Other")
    return ordered.select("e.cluster", (-F.col("e.neg")).alias("n"), name.alias("team"))


#: One band more than bits may differ; levels that a hot band is split on.
_BANDS, _LEVELS = 10, 3


def _band_values(words: Column, lo: int, hi: int) -> Column:
    """Bits ``lo`` to ``hi - 1`` of a 256-bit hash as one number; bands are far below 63 bits."""
    parts = []
    for w in range(4):
        a, b = max(lo, 64 * w), min(hi, 64 * (w + 1))
        if a < b:
            bits = F.shiftrightunsigned(F.element_at(words, w + 1), a - 64 * w).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("bigint"))
            parts.append(F.shiftleft(bits, a - lo))
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def _cuts(level: int) -> list[int]:
    """Borders of the bands of a level: each level shifts them by another fraction of a band."""
    width = 256 / _BANDS
    shift = width * level / _LEVELS
    return [0, *(round(i * width + shift) for i in range(1, _BANDS)), 256]


def _bands(words: Column, level: int) -> Column:
    cuts = _cuts(level)
    return F.array(*[_band_values(words, cuts[i], cuts[i + 1]) for i in range(_BANDS)])


def phash_near_pairs(frames: DataFrame, scope: tuple[str, ...] = ("video_id",), hot: int = 512) -> DataFrame:
    """Pairs of distinct hashes of one scope within 9 bits, with the frames behind each.

    Equal hashes of a scope are folded first, so copies add to a count and never to the
    pairs. Ten bands cannot all differ in nine bits, so equal bands find every pair, however
    the bits are cut. A band value that more than ``hot`` hashes share is therefore split
    again by the bands of the next level, cut at other places, and those buckets once more;
    a pair is told by its first shared band of every level its bucket went through.
    ``scope`` is the video by default; without one all hashes are compared.
    """
    keys = [*scope, "path"]
    level = frames.groupBy(*scope, "phash").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("video_id", "frame_idx")).alias("first")
    ).withColumn("path", F.array().cast("array<bigint>"))
    buckets = None
    for number in range(_LEVELS):
        cut = level.select("*", F.posexplode(_bands(F.col("phash"), number)).alias("band", "value"))
        cut = cut.withColumn("path", F.concat("path", F.array(F.col("band").cast("bigint"), "value"))).drop("band", "value")
        sizes = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("bucket")).filter("bucket > 1")
        sized = cut.join(sizes, keys)
        last = number == _LEVELS - 1
        done = (sized if last else sized.filter(F.col("bucket") <= hot)).drop("bucket")
        buckets = done if buckets is None else buckets.unionByName(done)
        level = sized.filter(F.col("bucket") > hot).drop("bucket")
    sides = [buckets.select(*keys, *[F.col(c).alias(f"{c}_{side}") for c in ("phash", "n", "first")]) for side in "ab"]
    near = sides[0].join(sides[1], keys).filter(F.col("phash_a") < F.col("phash_b"))
    distance = T.hamming(F.col("phash_a"), F.col("phash_b")).cast("bigint")
    near = near.withColumn("distance", distance).filter(F.col("distance") < _BANDS)
    for number in range(_LEVELS):
        shared = F.zip_with(_bands(F.col("phash_a"), number), _bands(F.col("phash_b"), number), lambda a, b: a == b)
        near = near.filter((F.size("path") <= 2 * number) | (F.array_position(shared, F.lit(True)) - 1 == F.get("path", F.lit(2 * number))))
    return near.select(
        "first_a.video_id", "first_a.frame_idx", F.col("first_b.video_id").alias("video_id_b"), F.col("first_b.frame_idx").alias("frame_idx_b"),
        "n_a", "n_b", "distance",
    )
