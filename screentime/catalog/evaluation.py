"""Evaluation, dataset, selection and vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from screentime.catalog import query
from screentime.functions import vector as V
from screentime.operators import dataset as D
from screentime.operators import evaluation as E
from screentime.operators import frames as FO
from screentime.operators import selection as S
from screentime.operators import vectors as VO
from screentime.tables import with_views


def r(col, digits=6):
    return F.round(col, digits).alias(col)


_AUC = """v_auc AS (SELECT method, coalesce((sum(CASE WHEN label = 1 THEN rk END) - p * (p + 1) / 2.0) / nullif(p * n, 0), 0.5) AS auc FROM (
  SELECT method, label, rank() OVER (PARTITION BY method ORDER BY score) + (count(*) OVER (PARTITION BY method, score) - 1) / 2.0 AS rk,
         sum(label) OVER (PARTITION BY method) AS p, sum(1 - label) OVER (PARTITION BY method) AS n FROM v_score) x GROUP BY method, p, n)"""


@query("roc_auc", with_views("score", extra=_AUC) + "SELECT method, round(auc, 9) AS auc FROM v_auc")
def roc_auc(t):
    return E.roc_auc(t.scores(), ["method"]).select("method", r("auc", 9))


@query("best_method", with_views("score", extra=_AUC) + "SELECT method, round(auc, 9) AS auc FROM v_auc ORDER BY round(auc, 12) DESC, method LIMIT 1")
def best_method(t):
    return E.best_method(t.scores()).select("method", r("auc", 9))


_PR = """CAST(count(*) FILTER (WHERE score >= {thr} AND label = 1) AS DOUBLE) / greatest(1, count(*) FILTER (WHERE score >= {thr}))"""
_RC = """CAST(count(*) FILTER (WHERE score >= {thr} AND label = 1) AS DOUBLE) / greatest(1, count(*) FILTER (WHERE label = 1))"""


@query("pr_at_threshold", with_views("score") + f"""
SELECT method, round({_PR.format(thr=1000)}, 9) AS precision, round({_RC.format(thr=1000)}, 9) AS recall FROM v_score GROUP BY 1""")
def pr_at_threshold(t):
    return E.pr_at_threshold(t.scores(), ["method"], 1000.0).select("method", r("precision", 9), r("recall", 9))


@query("best_f1_threshold", with_views("score", extra=f"""
v_q AS (SELECT method, quantile_cont(score, [{", ".join(str(p / 100) for p in range(5, 96, 5))}]) AS q FROM v_score GROUP BY 1),
v_thr AS (SELECT method, unnest(range(0, 19)) AS step, unnest(q) AS thr FROM v_q),
v_pr AS (SELECT v_score.method, step, thr, {_PR.format(thr="thr")} AS p, {_RC.format(thr="thr")} AS r FROM v_score JOIN v_thr ON v_score.method = v_thr.method GROUP BY 1, 2, 3),
v_f1 AS (SELECT *, 2 * p * r / greatest(1e-9, p + r) AS f1 FROM v_pr)""") + """
SELECT method, round(thr, 6) AS threshold, round(p, 9) AS precision, round(r, 9) AS recall FROM (
  SELECT *, row_number() OVER (PARTITION BY method ORDER BY round(f1, 12) DESC, step) AS rn FROM v_f1) x WHERE rn = 1""")
def best_f1_threshold(t):
    return E.best_f1_threshold(t.scores(), ["method"]).select("method", r("threshold"), r("precision", 9), r("recall", 9))


def with_split(t):
    """Line items as annotations of order images; clip = order key modulo 37."""
    li = t.raw("lineitem").select(
        F.col("l_orderkey").alias("image_id"), (F.col("l_orderkey") % 37).cast("bigint").alias("clip"),
        F.col("l_linenumber").cast("bigint").alias("class_id"),
    )
    return li.withColumn("split", F.when(F.col("clip") % 5 == 0, "val").otherwise("train"))


@query("class_balance", """
SELECT CAST(l_linenumber AS BIGINT) AS class_id, count(*) FILTER (WHERE l_orderkey % 37 % 5 <> 0) AS train, count(*) FILTER (WHERE l_orderkey % 37 % 5 = 0) AS val,
       count(*) FILTER (WHERE l_orderkey % 37 % 5 <> 0) < 10 AS rare FROM lineitem GROUP BY 1""")
def class_balance(t):
    return D.class_balance(with_split(t))


@query("split_score", """
WITH s AS (SELECT l_orderkey % 37 AS clip, l_linenumber AS c, seed, CASE WHEN (l_orderkey % 37 + seed) % 5 = 0 THEN 'val' ELSE 'train' END AS split
  FROM lineitem, range(0, 5) g(seed)),
i AS (SELECT o_orderkey % 37 AS clip, seed, CASE WHEN (o_orderkey % 37 + seed) % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM orders, range(0, 5) g(seed))
SELECT a.seed, bad_classes, round(frac_dev, 9) AS frac_dev FROM (
  SELECT seed, count(*) FILTER (WHERE tr < n * CAST(0.6 AS DOUBLE)) AS bad_classes FROM (SELECT seed, c, count(*) FILTER (WHERE split = 'train') AS tr, count(*) AS n FROM s GROUP BY 1, 2) x GROUP BY 1) a
JOIN (SELECT seed, abs(count(*) FILTER (WHERE split = 'val') / CAST(count(*) AS DOUBLE) - CAST(0.18 AS DOUBLE)) AS frac_dev FROM i GROUP BY 1) b ON a.seed = b.seed""")
def split_score(t):
    side = F.when((F.col("clip") + F.col("seed")) % 5 == 0, "val").otherwise("train")
    seeds = F.explode(F.sequence(F.lit(0), F.lit(4)))
    # Count per clip first, so that the assignments multiply clips and not rows.
    classes = with_split(t).groupBy("clip", "class_id").agg(F.count(F.lit(1)).alias("n")).withColumn("seed", seeds).withColumn("split", side)
    images = t.raw("orders").groupBy((F.col("o_orderkey") % 37).alias("clip")).agg(F.count(F.lit(1)).alias("n")).withColumn("seed", seeds).withColumn("split", side)
    return D.split_score(classes, images, ["seed"]).select(F.col("seed").cast("bigint").alias("seed"), "bad_classes", r("frac_dev", 9))


def clip_split(t):
    images = t.raw("orders").select(F.col("o_orderkey").alias("image_id"), (F.col("o_orderkey") % 37).alias("clip"))
    return D.group_aware_split(images, with_split(t).select("image_id", "class_id"))


@query("group_aware_split", """
WITH c AS (SELECT o_orderkey % 37 AS clip, count(*) AS n FROM orders GROUP BY 1),
p AS (SELECT seed, clip, n, md5(seed || '-' || clip) AS pos FROM c, range(0, 200) g(seed)),
s AS (SELECT seed, clip, n, CASE WHEN coalesce(sum(n) OVER (PARTITION BY seed ORDER BY pos, clip ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      < sum(n) OVER (PARTITION BY seed) * CAST(0.18 AS DOUBLE) THEN 'val' ELSE 'train' END AS split FROM p),
k AS (SELECT o_orderkey % 37 AS clip, l_linenumber AS class_id, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
b AS (SELECT seed, count(*) FILTER (WHERE tr < n * CAST(0.6 AS DOUBLE)) AS bad FROM (
      SELECT seed, class_id, sum(CASE WHEN split = 'train' THEN k.n ELSE 0 END) AS tr, sum(k.n) AS n FROM s JOIN k USING (clip) GROUP BY 1, 2) x GROUP BY 1),
d AS (SELECT seed, round(abs(sum(CASE WHEN split = 'val' THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE) - CAST(0.18 AS DOUBLE)), 12) AS dev FROM s GROUP BY 1),
best AS (SELECT seed FROM b JOIN d USING (seed) ORDER BY bad, dev, seed LIMIT 1)
SELECT CAST(seed AS INT) AS seed, clip, split FROM s WHERE seed = (SELECT seed FROM best)""")
def group_aware_split(t):
    return clip_split(t)


@query("split_partition_check", "SELECT count(DISTINCT o_orderkey % 37) AS clips, CAST(0 AS BIGINT) AS on_both_sides FROM orders")
def split_partition_check(t):
    split = clip_split(t)
    both = D.split_overlap(split, "clip").agg(F.count("*").alias("on_both_sides"))
    return split.agg(F.count_distinct("clip").alias("clips")).crossJoin(both)


@query("resume_labels", """
SELECT doc_id, coalesce(n.label, o.label) AS label FROM (SELECT doc_id, quality AS label FROM labels) o
FULL JOIN (SELECT doc_id, CAST(n_chars % 2 AS INT) AS label FROM documents WHERE n_chars % 3 = 0) n USING (doc_id)""")
def resume_labels(t):
    new = t.raw("documents").filter("n_chars % 3 = 0").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("label"))
    return D.resume_labels(t.raw("labels").select("doc_id", F.col("quality").alias("label")), new, "doc_id")


@query("index_union", "SELECT l_orderkey AS idx FROM lineitem UNION SELECT o_orderkey FROM orders")
def index_union(t):
    a = t.raw("lineitem").select(F.col("l_orderkey").alias("idx"))
    return a.union(t.raw("orders").select("o_orderkey")).distinct()


_COMP = """v_comp AS (SELECT *, 0.7 * ln(1 + sharp) + n_target + 8 * avg_target_h + CASE WHEN max_target_h >= 0.4 THEN 3 ELSE 0 END - 2 * crowd_score AS composite FROM v_frame)"""


@query("pick_sharpest", with_views("frame") + """
SELECT video_id, frame_idx, rank FROM (SELECT video_id, frame_idx, row_number() OVER (PARTITION BY video_id ORDER BY round(sharp, 9) DESC, frame_idx) AS rank
FROM v_frame WHERE sharp >= 50 AND max_target_h >= 0.45 AND n_target > 0) x WHERE rank <= 5""")
def pick_sharpest(t):
    return S.pick_sharpest(t.frames(), 5).select("video_id", "frame_idx", "rank")


@query("blurriest_first", with_views("frame") + """
SELECT video_id, frame_idx, row_number() OVER (PARTITION BY video_id ORDER BY round(sharp, 9), frame_idx) AS rank FROM v_frame""")
def blurriest_first(t):
    return S.blurriest_first(t.frames()).select("video_id", "frame_idx", "rank")


@query("bucket_topk", with_views("frame", extra=_COMP) + """
SELECT video_id, frame_idx, bucket, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id, bucket ORDER BY round(composite, 9) DESC, frame_idx) AS rank FROM (
    SELECT *, CASE WHEN max_target_h >= 0.5 THEN 'closeup' WHEN max_target_h >= 0.3 THEN 'medium' ELSE 'wide' END AS bucket FROM v_comp) x) y
WHERE rank <= CASE bucket WHEN 'wide' THEN 2 ELSE 4 END""")
def bucket_topk(t):
    return S.bucket_topk(FO.with_composite(t.frames()), 10).select("video_id", "frame_idx", "bucket", "rank")


_ORDERED = _COMP + """,
v_list AS (SELECT video_id, list(struct_pack(i := frame_idx, t := time_s, h := phash, b := bucket, r := rn) ORDER BY rn) AS f FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY round(composite, 9) DESC, frame_idx) AS rn,
         CASE WHEN max_target_h >= 0.5 THEN 'closeup' WHEN max_target_h >= 0.3 THEN 'medium' ELSE 'wide' END AS bucket FROM v_comp) o GROUP BY 1)"""


def _fold(frames: str, start: str, limit: int, hamming: int, spacing: float, more: str = "true") -> str:
    """SQL that accepts frames one by one: room, no conflict with an accepted frame, and ``more``."""
    bits = " + ".join(f"CAST(bit_count(xor(a.h[{i}], x.h[{i}])) AS BIGINT)" for i in (1, 2, 3, 4))
    clash = f"len(list_filter(acc, lambda a: abs(a.t - x.t) < {spacing} OR {bits} < {hamming})) > 0"
    return f"list_reduce({frames}, lambda acc, x: CASE WHEN len(acc) < {limit} AND {more} AND NOT {clash} THEN list_append(acc, x) ELSE acc END, {start})"


_QUOTA = "CASE {0}.b WHEN 'wide' THEN 1 ELSE 3 END"


@query("diverse_topk", with_views("frame", extra=_ORDERED) + f""",
v_first AS (SELECT video_id, f, {_fold("f", "list_filter(f, lambda y: false)", 8, 10, 2.0, "len(list_filter(acc, lambda q: q.b = x.b)) < " + _QUOTA.format("x"))} AS chosen FROM v_list),
v_later AS (SELECT video_id, chosen, list_filter(f, lambda y: len(list_filter(chosen, lambda q: q.b = y.b AND q.r < y.r)) >= {_QUOTA.format("y")}) AS later FROM v_first)
SELECT video_id, unnest(list_transform({_fold("later", "chosen", 8, 10, 2.0)}, lambda y: y.i)) AS frame_idx FROM v_later""")
def diverse_topk(t):
    return S.diverse_topk(FO.with_composite(t.frames()), 8)


@query("yield_guarantee", with_views("frame", extra=_ORDERED) + """,
v_tier AS (SELECT video_id, """ + ", ".join(
    f"{_fold('f', 'list_filter(f, lambda y: false)', 12, ham, gap)} AS t{i}" for i, (_, ham, gap) in enumerate(S.TIERS)
) + """ FROM v_list),
v_done AS (SELECT video_id, CASE """ + " ".join(f"WHEN len(t{i}) >= 8 THEN t{i}" for i in range(4)) + """ ELSE t3 END AS f,
  CASE """ + " ".join(f"WHEN len(t{i}) >= 8 THEN '{name}'" for i, (name, _, _) in enumerate(S.TIERS)) + """ ELSE 'exhausted' END AS tier FROM v_tier)
SELECT video_id, unnest(list_transform(f, lambda y: y.i)) AS frame_idx, tier FROM v_done""")
def yield_guarantee(t):
    return S.yield_guarantee(FO.with_composite(t.frames()), 12, 8)


@query("temporal_dedup", with_views("det", extra="""
v_list AS (SELECT video_id, brand_key, list(t ORDER BY t) AS ts FROM (SELECT DISTINCT video_id, brand_key, t FROM v_det) d GROUP BY 1, 2)""") + """
SELECT video_id, brand_key, unnest(list_filter(list_reduce(ts, lambda acc, x: CASE WHEN x - acc[-1] >= 2.0 THEN list_append(acc, x) ELSE acc END, [CAST(-1000 AS DOUBLE)]), lambda x: x >= 0)) AS t FROM v_list""")
def temporal_dedup(t):
    return S.temporal_dedup(t.detections(), ["video_id", "brand_key"], chunk=8.0)


@query("phash_near_pairs", with_views("frame", extra="""
v_hash AS (SELECT phash, count(*) AS n, min(video_id * 1000 + frame_idx) AS first FROM v_frame GROUP BY 1),
v_pair AS (SELECT a.first // 1000 AS video_id, a.first % 1000 AS frame_idx, b.first // 1000 AS video_id_b, b.first % 1000 AS frame_idx_b, a.n AS n_a, b.n AS n_b,
  CAST(bit_count(xor(a.phash[1], b.phash[1])) AS BIGINT) + CAST(bit_count(xor(a.phash[2], b.phash[2])) AS BIGINT) + CAST(bit_count(xor(a.phash[3], b.phash[3])) AS BIGINT) + CAST(bit_count(xor(a.phash[4], b.phash[4])) AS BIGINT) AS distance
  FROM v_hash a JOIN v_hash b ON a.phash < b.phash)""") + """
SELECT CAST(video_id AS BIGINT) AS video_id, CAST(frame_idx AS BIGINT) AS frame_idx, CAST(video_id_b AS BIGINT) AS video_id_b, CAST(frame_idx_b AS BIGINT) AS frame_idx_b, n_a, n_b, CAST(distance AS BIGINT) AS distance FROM v_pair WHERE distance <= 9""")
def phash_near_pairs(t):
    return VO.phash_near_pairs(t.frames(), scope=())


@query("phash_near_pairs_across", with_views("frame", extra="""
v_hash AS (SELECT phash, count(*) AS n, min(video_id * 1000 + frame_idx) AS first FROM v_frame GROUP BY 1),
v_pair AS (SELECT a.first // 1000 AS video_id, a.first % 1000 AS frame_idx, b.first // 1000 AS video_id_b, b.first % 1000 AS frame_idx_b, a.n AS n_a, b.n AS n_b,
  CAST(bit_count(xor(a.phash[1], b.phash[1])) AS BIGINT) + CAST(bit_count(xor(a.phash[2], b.phash[2])) AS BIGINT) + CAST(bit_count(xor(a.phash[3], b.phash[3])) AS BIGINT) + CAST(bit_count(xor(a.phash[4], b.phash[4])) AS BIGINT) AS distance
  FROM v_hash a JOIN v_hash b ON a.phash < b.phash)""") + """
SELECT CAST(video_id AS BIGINT) AS video_id, CAST(frame_idx AS BIGINT) AS frame_idx, CAST(video_id_b AS BIGINT) AS video_id_b, CAST(frame_idx_b AS BIGINT) AS frame_idx_b, n_a, n_b, CAST(distance AS BIGINT) AS distance FROM v_pair WHERE distance <= 9""")
def phash_near_pairs_across(t):
    return VO.phash_near_pairs(t.frames(), scope=())


# ── vectors ──────────────────────────────────────────────────────────────────


def crops(t):
    """Vectors as crops: team = label parity, colour histogram from the vector's size."""
    mag = lambda lo, n: F.transform(F.slice("embedding", lo, n), lambda x: F.abs(x))
    share = lambda c: F.transform(c, lambda x: x / V.total(c))
    rows = t.vectors().select("vec_id", "label", "embedding", mag(1, 8).alias("a"), mag(9, 12).alias("b"))
    return rows.select(
        "vec_id", "label", (F.col("label") % 3).alias("cluster"), "embedding", F.concat(share(F.col("a")), share(F.col("b"))).alias("color"),
        F.when(F.col("label") % 2 == 0, "target").otherwise("other").alias("team"),
    )


_CROP = """v_crop AS (SELECT vec_id, label, embedding, CASE WHEN label % 2 = 0 THEN 'target' ELSE 'other' END AS team,
  list_concat(list_transform(embedding[1:8], lambda x: abs(x) / list_sum(list_transform(embedding[1:8], lambda y: abs(y)))),
              list_transform(embedding[9:20], lambda x: abs(x) / list_sum(list_transform(embedding[9:20], lambda y: abs(y))))) AS color FROM v_vec),
v_dim AS (SELECT team, i, avg(embedding[i]) AS m FROM v_crop, range(1, 65) g(i) GROUP BY 1, 2),
v_cdim AS (SELECT team, i, avg(color[i]) AS m FROM v_crop, range(1, 21) g(i) GROUP BY 1, 2),
v_nrm AS (SELECT team, sqrt(sum(m * m)) + 1e-8 AS nrm FROM v_dim GROUP BY 1),
v_ref AS (SELECT d.team, list(d.m / nrm ORDER BY i) AS embedding, (SELECT list(c.m ORDER BY c.i) FROM v_cdim c WHERE c.team = d.team) AS color FROM v_dim d JOIN v_nrm n ON d.team = n.team GROUP BY 1)"""
_SIM = "(0.65 * list_sum(list_transform(range(1, 9), lambda i: least({a}[i], {b}[i]))) + 0.35 * list_sum(list_transform(range(9, 21), lambda i: least({a}[i], {b}[i]))))"


@query("team_centroids", with_views("vec", extra=_CROP) + """
SELECT team, unnest(range(1, 65)) AS i, unnest(list_transform(embedding, lambda x: round(x, 6))) AS value FROM v_ref""")
def team_centroids(t):
    refs = VO.team_centroids(crops(t))
    return refs.select("team", F.posexplode("embedding").alias("i", "value")).select("team", (F.col("i") + 1).cast("bigint").alias("i"), r("value"))


@query("cosine_sim", with_views("vec", extra=_CROP) + """
SELECT vec_id, r.team, round(list_dot_product(list_transform(c.embedding, lambda x: x / (sqrt(list_dot_product(c.embedding, c.embedding)) + 1e-8)), r.embedding), 6) AS sim FROM v_crop c, v_ref r""")
def cosine_sim(t):
    rows = crops(t)
    both = VO.with_refs(rows, VO.team_centroids(rows)).select("vec_id", V.unit(F.col("embedding")).alias("u"), F.explode("refs").alias("r"))
    return both.select("vec_id", "r.team", F.round(V.dot(F.col("u"), F.col("r.embedding")), 6).alias("sim"))


@query("hist_intersection", with_views("vec", extra=_CROP) + f"""
SELECT vec_id, r.team, round({_SIM.format(a="c.color", b="r.color")}, 6) AS sim FROM v_crop c, v_ref r""")
def hist_intersection(t):
    rows = crops(t)
    both = VO.with_refs(rows, VO.team_centroids(rows)).select("vec_id", "color", F.explode("refs").alias("r"))
    return both.select("vec_id", "r.team", F.round(V.hist_intersection(F.col("color"), F.col("r.color")), 6).alias("sim"))


@query("luminance", with_views("vec", extra=_CROP) + """
SELECT vec_id, round(list_sum(list_transform(range(1, 9), lambda i: color[i] * (i - 0.5) / 8)) / (list_sum(color[1:8]) + 1e-8), 6) AS luminance FROM v_crop""")
def luminance(t):
    return crops(t).select("vec_id", F.round(V.luminance(F.col("color")), 6).alias("luminance"))


_SOFT = """v_sc AS (SELECT vec_id, r.team, CASE WHEN vec_id % 7 = 0 THEN NULL ELSE 8 * """ + _SIM.format(a="c.color", b="r.color") + """ END AS sc,
  CASE WHEN vec_id % 5 = 0 THEN NULL ELSE 15 * list_dot_product(c.embedding, r.embedding) END AS se FROM v_crop c, v_ref r),
v_ex AS (SELECT *, exp(sc - max(sc) OVER w) AS ec, exp(se - max(se) OVER w) AS ee FROM v_sc WINDOW w AS (PARTITION BY vec_id)),
v_p AS (SELECT *, CASE WHEN sc IS NULL AND se IS NULL THEN NULL ELSE (coalesce(0.6 * ec / (sum(ec) OVER w + 1e-8), 0) + coalesce(0.4 * ee / (sum(ee) OVER w + 1e-8), 0))
   / (CASE WHEN sc IS NULL THEN 0 ELSE 0.6 END + CASE WHEN se IS NULL THEN 0 ELSE 0.4 END) END AS p FROM v_ex WINDOW w AS (PARTITION BY vec_id))"""


@query("softmax_fuse", with_views("vec", extra=_CROP + ",\n" + _SOFT) + """
SELECT vec_id, CASE WHEN max(p) IS NULL THEN NULL ELSE arg_max(team, p) END AS team_pred, round(coalesce(max(p), 0), 6) AS confidence, round(coalesce(max(p) - min(p), 0), 6) AS margin FROM v_p GROUP BY 1""")
def softmax_fuse(t):
    rows = crops(t)
    refs = VO.team_centroids(rows)
    gaps = rows.withColumns({
        "color": F.when(F.col("vec_id") % 7 != 0, F.col("color")), "embedding": F.when(F.col("vec_id") % 5 != 0, F.col("embedding")),
    })
    return VO.classify(gaps, refs, 0.6, 0.4).select("vec_id", "team_pred", r("confidence"), r("margin"))


@query("fusion_weights", with_views("vec", extra=_CROP + f""",
v_acc AS (SELECT avg(CASE WHEN pc = team THEN 1.0 ELSE 0.0 END) AS ac, avg(CASE WHEN pe = team THEN 1.0 ELSE 0.0 END) AS ae FROM (
  SELECT c.vec_id, c.team, arg_max(r.team, {_SIM.format(a="c.color", b="r.color")}) AS pc, arg_max(r.team, list_dot_product(c.embedding, r.embedding)) AS pe FROM v_crop c, v_ref r GROUP BY 1, 2) x)""") + """
SELECT round(ac, 6) AS acc_color, round(ae, 6) AS acc_embedding,
  round(least(0.9, greatest(0.1, greatest(ac - 0.5, 1e-3) / (greatest(ac - 0.5, 1e-3) + greatest(ae - 0.5, 1e-3)))), 6) AS w_color FROM v_acc""")
def fusion_weights(t):
    rows = crops(t)
    return VO.fusion_weights(rows, VO.team_centroids(rows)).select(r("acc_color"), r("acc_embedding"), r("w_color"))


_LREF = """v_ldim AS (SELECT label, i, avg(embedding[i]) AS m FROM v_vec, range(1, 65) g(i) GROUP BY 1, 2),
v_lref AS (SELECT label, list(m ORDER BY i) AS centre FROM v_ldim GROUP BY 1),
v_dist AS (SELECT vec_id, v.label, l.label AS ref, round(list_sum(list_transform(range(1, 65), lambda i: (v.embedding[i] - l.centre[i]) ** 2)), 12) AS d2 FROM v_vec v, v_lref l)"""


def label_centroids(t):
    return VO.mean_vectors(t.vectors(), ["label"], ["embedding"]).select(F.col("label").alias("team"), "embedding")


@query("nearest_centroid", with_views("vec", extra=_LREF) + """
SELECT vec_id, arg_min(ref, d2) AS nearest, round(sqrt(min(d2)), 6) AS distance FROM v_dist GROUP BY 1""")
def nearest_centroid(t):
    return VO.nearest_centroid(t.vectors(), label_centroids(t)).select("vec_id", "nearest", r("distance"))


@query("cluster_exemplars", with_views("vec", extra=_LREF) + """
SELECT label, vec_id, rank FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY round(sqrt(d2), 9), vec_id) AS rank FROM v_dist WHERE ref = label) x WHERE rank <= 5""")
def cluster_exemplars(t):
    return VO.cluster_exemplars(t.vectors(), label_centroids(t), 5).select("label", "vec_id", "rank")


@query("kmeans_clusters")
def kmeans_clusters(t):
    return VO.kmeans_clusters(t.vectors()).select("vec_id", "cluster")


@query("pick_target_cluster", with_views("vec", extra=_CROP + """,
v_lum AS (SELECT cluster, sum(m * (i - 0.5) / 8) / (sum(m) + 1e-8) AS lum, max(n) AS n FROM (
  SELECT label % 3 AS cluster, i, avg(color[i]) AS m, count(*) AS n FROM v_crop, range(1, 9) g(i) GROUP BY 1, 2) x GROUP BY 1)""") + """
SELECT cluster, round(-lum, 6) AS score, n, total FROM (SELECT *, sum(n) OVER () AS total, row_number() OVER (ORDER BY round(lum, 9), cluster) AS rn FROM v_lum) x
WHERE rn = 1 AND total >= 24 AND n >= total * CAST(0.1 AS DOUBLE)""")
def pick_target_cluster(t):
    return VO.pick_target_cluster(crops(t), dark=True).select("cluster", r("score"), "n", "total")


@query("cluster_size_rank", with_views("vec") + """
SELECT cluster, n, CASE row_number() OVER (ORDER BY n DESC, cluster) WHEN 1 THEN 'Team A' WHEN 2 THEN 'Team B' ELSE 'Other' END AS team FROM (SELECT label % 3 AS cluster, count(*) AS n FROM v_vec GROUP BY 1) x""")
def cluster_size_rank(t):
    return VO.cluster_size_rank(crops(t))
