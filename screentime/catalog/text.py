"""String, hash and label operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from screentime.catalog import query
from screentime.functions import text as T
from screentime.functions import visibility as V
from screentime.operators import attribution as A
from screentime.operators import report as R
from screentime.operators import scans as S
from screentime.tables import with_views

_RAW = """v_raw AS (
  SELECT p_partkey, '  ' || replace(p_name, ' ', '_') || CASE p_partkey % 5 WHEN 0 THEN '_Home' WHEN 1 THEN '_away' WHEN 2 THEN '_alt' WHEN 3 THEN '_third' ELSE '' END || ' ' AS raw_name FROM part)"""


def raw_names(t):
    k = F.col("p_partkey") % 5
    suffix = F.when(k == 0, "_Home").when(k == 1, "_away").when(k == 2, "_alt").when(k == 3, "_third").otherwise("")
    return t.raw("part").select(
        "p_partkey", F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit("_")), suffix, F.lit(" ")).alias("raw_name")
    )


@query("normalize_class", f"WITH {_RAW}" + """
SELECT p_partkey, regexp_replace(lower(trim(raw_name)), '_(home|away|alt|third)$', '') AS brand_key FROM v_raw""")
def normalize_class(t):
    return raw_names(t).select("p_partkey", T.normalize_class(F.col("raw_name")).alias("brand_key"))


@query("display_name", f"WITH {_RAW}" + """
SELECT p_partkey, CASE k WHEN 'red_ring' THEN 'RED Ring Ltd' WHEN 'old_anvil' THEN 'O. Anvil' ELSE
  upper(k[1]) || k[2:instr(k, '_') - 1] || ' ' || upper(k[instr(k, '_') + 1]) || k[instr(k, '_') + 2:] END AS brand_name
FROM (SELECT p_partkey, regexp_replace(lower(trim(raw_name)), '_(home|away|alt|third)$', '') AS k FROM v_raw) n""")
def display_name(t):
    names = t.spark.createDataFrame([("red_ring", "RED Ring Ltd"), ("old_anvil", "O. Anvil")], "brand_key string, brand_name string")
    rows = raw_names(t).withColumn("brand_key", T.normalize_class(F.col("raw_name")))
    return A.brand_dim_join(rows, names).select("p_partkey", "brand_name")


@query("ocr_fold", with_views("ocr") + """
SELECT det_id, video_id, translate(lower(trim(text)), '01|58', 'oiisb') AS folded FROM v_ocr""")
def ocr_fold(t):
    return t.ocr().select("det_id", "video_id", T.ocr_fold(F.col("text")).alias("folded"))


@query("despace_key", "SELECT DISTINCT p_name, replace(p_name, ' ', '') AS key FROM part")
def despace_key(t):
    return t.raw("part").select("p_name", T.despace(F.col("p_name")).alias("key")).distinct()


_LCS = """list_reduce(string_split({a}, ''), lambda prev, ch: list_reduce(range(1, length({b}) + 1), lambda acc, j:
  list_append(acc, greatest(acc[-1], prev[j + 1], prev[j] + CASE WHEN {b}[j] = ch THEN 1 ELSE 0 END)), [CAST(0 AS BIGINT)]),
  list_transform(range(0, length({b}) + 1), lambda i: CAST(0 AS BIGINT)))[-1]"""


@query("fuzzy_ratio", """
SELECT a, b, round(200.0 * """ + _LCS.format(a="a", b="b") + """ / (length(a) + length(b)), 6) AS ratio
FROM (SELECT DISTINCT p_name || p_type AS a, p_type || ' ' || p_brand AS b FROM part) p""")
def fuzzy_ratio(t):
    pairs = t.raw("part").select(
        F.concat("p_name", "p_type").alias("a"), F.concat_ws(" ", "p_type", "p_brand").alias("b")
    ).distinct()
    return pairs.select("a", "b", F.round(T.indel_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


@query("fuzzy_match_sponsor", with_views("ocr", extra="""
v_dict AS (SELECT DISTINCT k AS key, p_name AS sponsor, rk FROM (
  SELECT p_name, p_name AS k, 0 AS rk FROM part UNION ALL SELECT p_name, replace(p_name, ' ', ''), 1 FROM part) d),
v_text AS (SELECT DISTINCT text, translate(lower(trim(text)), '01|58', 'oiisb') AS folded FROM v_ocr)""") + """
, v_score AS (
  SELECT text, sponsor, key, rk, 200.0 * """ + _LCS.format(a="folded", b="key") + """ / (length(folded) + length(key)) AS ratio FROM v_text, v_dict),
v_best AS (SELECT * FROM v_score WHERE ratio >= 80 QUALIFY row_number() OVER (PARTITION BY text, rk ORDER BY ratio DESC, key, sponsor) = 1)
SELECT text, CASE WHEN a.sponsor IS NULL OR b.ratio > floor(a.ratio) THEN b.sponsor ELSE a.sponsor END AS sponsor,
       CAST(floor(CASE WHEN a.sponsor IS NULL OR b.ratio > floor(a.ratio) THEN b.ratio ELSE a.ratio END) AS BIGINT) AS fuzzy
FROM (SELECT * FROM v_best WHERE rk = 0) a FULL JOIN (SELECT * FROM v_best WHERE rk = 1) b USING (text)""")
def fuzzy_match_sponsor(t):
    names = t.raw("part").select(F.col("p_name").alias("key"), F.col("p_name").alias("sponsor")).distinct()
    return R.match_sponsors(t.ocr(), names)


@query("dict_match_join", with_views("ocr", extra="""
v_key AS (SELECT DISTINCT p_name AS key FROM part),
v_text AS (SELECT DISTINCT translate(lower(trim(text)), '01|58', 'oiisb') AS folded FROM v_ocr)""") + """
SELECT folded, key, CAST(levenshtein(folded, key) AS BIGINT) AS distance FROM v_text, v_key WHERE levenshtein(folded, key) <= 2""")
def dict_match_join(t):
    keys = t.raw("part").select(F.col("p_name").alias("key")).distinct()
    return R.near_keys(t.ocr().select(T.ocr_fold(F.col("text")).alias("folded")).distinct(), keys, 2)


@query("placement_lookup", with_views("meta") + """
SELECT video_id, CASE lower(trim(placement_type)) WHEN 'live broadcast tv' THEN 1.0 WHEN 'live stream' THEN 0.85
  WHEN 'highlight clip' THEN 1.4 WHEN 'social media' THEN 0.7 ELSE 1.0 END AS multiplier FROM v_meta""")
def placement_lookup(t):
    return t.meta().select("video_id", V.placement_multiplier(F.col("placement_type")).alias("multiplier"))


_FILES = """v_file AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '/in/M0' || (doc_id % 7) || '_white_1080p.mp4' WHEN 1 THEN '/in/' || source || '_' || lang || '_Claret.mov'
  WHEN 2 THEN 'm12_' || lang || '_green.mp4' ELSE 'M3_blue_red.mkv' END AS file FROM documents)"""


def file_names(t):
    k = F.col("doc_id") % 4
    name = (
        F.when(k == 0, F.concat(F.lit("/in/M0"), (F.col("doc_id") % 7).cast("string"), F.lit("_white_1080p.mp4")))
        .when(k == 1, F.concat(F.lit("/in/"), "source", F.lit("_"), "lang", F.lit("_Claret.mov")))
        .when(k == 2, F.concat(F.lit("m12_"), "lang", F.lit("_green.mp4")))
        .otherwise("M3_blue_red.mkv")
    )
    return t.raw("documents").select("doc_id", name.alias("file"))


@query("parse_color", f"WITH {_FILES}" + """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'white' WHEN 1 THEN 'claret' WHEN 2 THEN 'green' ELSE 'blue' END AS color FROM v_file""")
def parse_color(t):
    return file_names(t).select("doc_id", T.require_color(F.col("file")).alias("color"))


@query("clip_key", """
SELECT s_suppkey, coalesce(nullif(regexp_extract(f, '^(clip_[0-9]+)', 1), ''), 'other') AS clip FROM (
  SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'x' ELSE '' END || 'clip_' || (s_suppkey % 30) || '.mp4' AS f FROM supplier) x""")
def clip_key(t):
    name = F.concat(F.when(F.col("s_suppkey") % 4 == 0, "x").otherwise(""), F.lit("clip_"), (F.col("s_suppkey") % 30).cast("string"), F.lit(".mp4"))
    return t.raw("supplier").select("s_suppkey", T.clip_key(name).alias("clip"))


@query("phash_hamming", with_views("frame") + """
SELECT video_id, frame_idx, CAST(CAST(bit_count(xor(phash[1], p[1])) AS BIGINT) + CAST(bit_count(xor(phash[2], p[2])) AS BIGINT) + CAST(bit_count(xor(phash[3], p[3])) AS BIGINT) + CAST(bit_count(xor(phash[4], p[4])) AS BIGINT) AS BIGINT) AS distance
FROM (SELECT video_id, frame_idx, phash, lag(phash) OVER (PARTITION BY video_id ORDER BY frame_idx) AS p FROM v_frame) f WHERE p IS NOT NULL""")
def phash_hamming(t):
    rows = S.previous(t.frames(), ["video_id"], "frame_idx", {"p": "phash"}).filter("p IS NOT NULL")
    return rows.select("video_id", "frame_idx", T.hamming(F.col("phash"), F.col("p")).cast("bigint").alias("distance"))


@query("bbox_string", with_views("box") + """
SELECT det_id, video_id, concat_ws(',', CAST(trunc(x1) AS BIGINT), CAST(trunc(y1) AS BIGINT), CAST(trunc(x2) AS BIGINT), CAST(trunc(y2) AS BIGINT)) AS bbox,
       CAST(trunc(x1) AS BIGINT) AS bx1, CAST(trunc(y2) AS BIGINT) AS by2 FROM v_box""")
def bbox_string(t):
    text = T.bbox_string(*[F.col(c).cast("bigint") for c in ("x1", "y1", "x2", "y2")])
    back = T.bbox_struct(F.col("bbox"))
    return t.boxes().withColumn("bbox", text).select("det_id", "video_id", "bbox", back["x1"].alias("bx1"), back["y2"].alias("by2"))


@query("match_filter", with_views("match") + """
SELECT video_id, event_name, match_date FROM v_match
WHERE (contains(lower(event_name), '1') OR contains(lower(video_name), '1')) AND match_date >= DATE '1995-01-03' AND match_date < DATE '1995-01-05' + 1""")
def match_filter(t):
    from screentime.operators.portfolio import match_filter as keep

    return keep(t.matches(), " 1 ", "1995-01-03", "1995-01-05").select("video_id", "event_name", "match_date")
