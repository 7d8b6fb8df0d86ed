"""Adapter views: the supplied tables read as detections, persons, frames and so on.

Every view exists twice, as a DataFrame and as the SQL text of the same
definition, which the oracle statements use as common table expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screentime.functions.geometry import bigint_mod
from screentime.session import stored

FRAME_W, FRAME_H = 1920.0, 1080.0
DT = 0.5

# Keypoint positions as fractions of the person box, in COCO order.
POSE_LAYOUT = (
    (0.5, 0.08), (0.46, 0.06), (0.54, 0.06), (0.42, 0.08), (0.58, 0.08), (0.35, 0.2), (0.65, 0.2), (0.25, 0.35), (0.75, 0.35),
    (0.2, 0.5), (0.8, 0.5), (0.4, 0.5), (0.6, 0.5), (0.4, 0.72), (0.6, 0.72), (0.4, 0.95), (0.6, 0.95),
)


#: What the keypoints of a person are laid out from.
POSED = ("cx", "cy", "x1", "y1", "w", "h")


def pose_points(at: Callable[[str], Column]) -> Column:
    """The keypoints of a person, by the columns ``POSED``."""
    points = []
    for i, (fx, fy) in enumerate(POSE_LAYOUT):
        conf = bigint_mod(at("cx").cast("bigint") + at("cy").cast("bigint") * 3 + 7 * i, 40 if i > 4 else 25) / 25.0
        points.append(F.struct((at("x1") + at("w") * fx).alias("x"), (at("y1") + at("h") * fy).alias("y"), conf.alias("c")))
    return F.array(*points)


class Tables:
    """Lazy access to one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, kept: DataFrame | None = None):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.kept = kept

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def hits(self) -> DataFrame:
        """Line items with their part, as far as detections are made of them."""
        if self.kept is not None:
            return self.kept
        part = self.raw("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
        return self.raw("lineitem").join(part, "l_partkey").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "p_brand", "p_type"
        )

    def keeping_hits(self) -> Tables:
        """The same tables with the hits joined and written once, for plans that read detections several times."""
        return Tables(self.spark, self.sf_dir, stored(self.hits(), "hits"))

    def detections(self) -> DataFrame:
        """One row per logo hit; video = supplier, brand = part brand, time = order slot."""
        slot = bigint_mod(F.col("l_orderkey"), 40)
        return self.hits().select(
            F.col("l_suppkey").alias("video_id"),
            F.col("p_brand").alias("brand_key"),
            F.col("p_type").alias("category"),
            (F.col("l_linenumber") % 2).cast("bigint").alias("track_id"),
            F.col("l_linenumber").cast("bigint").alias("line_no"),
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("det_id"),
            slot.alias("slot"),
            (slot * F.lit(DT)).alias("t"),
            (F.col("l_quantity") * 8 + 20).alias("w"),
            (F.col("l_quantity") * 4 + 10).alias("h"),
            bigint_mod(F.col("l_partkey") * 37, 1920).cast("double").alias("cx"),
            bigint_mod(F.col("l_orderkey") * 53, 1080).cast("double").alias("cy"),
            (F.lit(0.5) + F.col("l_discount") * 5).alias("conf"),
            F.lit(FRAME_W).alias("frame_w"),
            F.lit(FRAME_H).alias("frame_h"),
        )

    def boxes(self, rows: DataFrame | None = None) -> DataFrame:
        """Hits with corner coordinates."""
        d = self.detections() if rows is None else rows
        return d.select(
            "*",
            (F.col("cx") - F.col("w") / 2).alias("x1"), (F.col("cy") - F.col("h") / 2).alias("y1"),
            (F.col("cx") + F.col("w") / 2).alias("x2"), (F.col("cy") + F.col("h") / 2).alias("y2"),
        )

    def logos(self) -> DataFrame:
        return self.boxes().filter("line_no <= 4")

    def persons(self) -> DataFrame:
        """Person boxes: the higher line numbers, with a team and a vote mass."""
        d = self.boxes().filter("line_no >= 5")
        return d.select(
            "video_id", "slot", "t", F.col("det_id").alias("person_id"), "x1", "y1", "x2", "y2", "w", "h", "cx", "cy", "conf",
            F.when(bigint_mod(F.col("cx").cast("bigint"), 3) == 0, "other").otherwise("target").alias("team"),
            (F.col("conf") * 4).alias("vote_mass"),
        )

    def poses(self) -> DataFrame:
        """Persons with 17 keypoints laid out inside their box; some fall below the cut-off."""
        return self.persons().select("*", pose_points(F.col).alias("keypoints"))

    def votes(self) -> DataFrame:
        """Team votes per (video, line number) track."""
        return self.persons_with_track().select(
            "video_id", "track_id", "t", F.col("slot").alias("frame_idx"), "team",
            (F.col("conf") * (bigint_mod(F.col("cy").cast("bigint"), 10) / 10.0 + 0.25)).alias("weight"), "person_id",
        )

    def persons_with_track(self) -> DataFrame:
        return self.persons().withColumn("track_id", F.split("person_id", "-")[1].cast("bigint"))

    def meta(self) -> DataFrame:
        """Per-video metadata: audience, price and placement label."""
        k = bigint_mod(F.col("s_suppkey"), 5)
        label = (
            F.when(k == 0, "Live Broadcast TV").when(k == 1, " live stream ")
            .when(k == 2, "Highlight Clip").when(k == 3, "Social Media").otherwise("Radio")
        )
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("video_id"),
            F.col("s_name").alias("event_name"),
            F.concat(F.lit("clip_"), bigint_mod(F.col("s_suppkey"), 30).cast("string"), F.lit(".mp4")).alias("video_name"),
            (F.lit(100000) + F.col("s_nationkey") * 10000).cast("bigint").alias("audience_size"),
            F.lit(22.0).alias("cpm_base"),
            label.alias("placement_type"),
        )

    def matches(self) -> DataFrame:
        """Match list: first ship date, and the span of ship dates in days as the length."""
        span = self.raw("lineitem").groupBy(F.col("l_suppkey").alias("video_id")).agg(
            F.to_date(F.min("l_shipdate")).alias("match_date"),
            F.datediff(F.max("l_shipdate"), F.min("l_shipdate")).cast("double").alias("duration_s"),
        )
        return self.meta().join(span, "video_id").select("video_id", "event_name", "video_name", "match_date", "duration_s")

    def videos(self) -> DataFrame:
        """Video dimension: length from the account balance, rate by key."""
        k = bigint_mod(F.col("s_suppkey"), 3)
        fps = F.when(k == 0, 25.0).when(k == 1, 30.0).otherwise(50.0)
        duration = F.col("s_acctbal") + 1000.0
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("video_id"), fps.alias("fps"), duration.alias("duration_s"),
            F.floor(duration * fps).cast("bigint").alias("frame_count"),
        )

    def frames(self) -> DataFrame:
        """One row of frame metrics per (video, slot), aggregated from the hits."""
        li = self.raw("lineitem").withColumn("slot", bigint_mod(F.col("l_orderkey"), 40))
        target = F.col("l_linenumber") >= 6
        height = F.col("l_quantity") / 50.0 * 0.6
        return li.groupBy(F.col("l_suppkey").alias("video_id"), F.col("slot").alias("frame_idx")).agg(
            (F.avg("l_tax") * 10).alias("grass_ratio"),
            (F.avg("l_discount") * 15).alias("crowd_score"),
            F.sum(F.when(F.col("l_linenumber") >= 4, 1).otherwise(0)).alias("n_persons"),
            F.sum(F.when(target, 1).otherwise(0)).alias("n_target"),
            F.coalesce(F.max(F.when(target, height)), F.lit(0.0)).alias("max_target_h"),
            F.coalesce(F.avg(F.when(target, height)), F.lit(0.0)).alias("avg_target_h"),
            (F.avg("l_extendedprice") / 1000.0).alias("sharp"),
            (F.max("l_extendedprice") / 1000.0).alias("torso_sharp"),
            (bigint_mod(F.sum("l_partkey"), 500) + 1).alias("base"), F.count(F.lit(1)).alias("n"),
        ).withColumns({
            "time_s": F.col("frame_idx") * F.lit(DT),
            # 500 base hashes of 256 spread bits; the hit count flips up to four bits.
            "phash": F.array(*[
                word.bitwiseXOR(bigint_mod(F.col("n"), 16)) if i == 3 else word
                for i, word in enumerate(bigint_mod(F.col("base") * m, 1000003) * 8999999999971 for m in (7919, 104729, 1299709, 15485863))
            ]),
        }).drop("base", "n")

    def ocr(self) -> DataFrame:
        """OCR rows: the part name with digit confusions, box scores from the line item."""
        li = self.raw("lineitem")
        part = self.raw("part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
        noisy = F.when(bigint_mod(F.col("l_partkey"), 3) == 0, F.translate("p_name", "oisb", "0158")).when(
            bigint_mod(F.col("l_partkey"), 3) == 1, F.concat(F.lit(" "), F.upper(F.regexp_replace("p_name", " ", "")))
        ).otherwise(F.concat("p_name", F.lit("x")))
        return li.join(part, "l_partkey").select(
            F.col("l_suppkey").alias("video_id"),
            (bigint_mod(F.col("l_orderkey"), 40) * 1.0).alias("time_s"),
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("det_id"),
            F.col("l_linenumber").cast("bigint").alias("line_no"),
            F.col("p_name").alias("sponsor"),
            noisy.alias("text"),
            (F.lit(0.5) + F.col("l_discount") * 5).alias("ocr_conf"),
            (F.lit(80) + bigint_mod(F.col("l_orderkey"), 21)).cast("bigint").alias("fuzzy"),
            (F.col("l_quantity") / 50.0).alias("area_pct"),
            (bigint_mod(F.col("l_partkey") * 37, 1920) / 1920.0).alias("cx"),
            (bigint_mod(F.col("l_orderkey") * 53, 1080) / 1080.0).alias("cy"),
        )

    def scores(self) -> DataFrame:
        """Labelled scores: document length against its quality label, method = language."""
        return self.raw("labels").join(self.raw("documents"), "doc_id").select(
            "doc_id", F.col("lang").alias("method"), F.col("n_chars").cast("double").alias("score"),
            F.col("quality").cast("bigint").alias("label"), F.col("source"),
        )

    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select(
            "vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("bigint").alias("label")
        )

    def events(self) -> DataFrame:
        return self.raw("events").select(
            "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("track_id"),
            F.col("event_type").alias("brand_key"), "value",
        )


_DET = """v_det AS (
  SELECT l_suppkey AS video_id, p_brand AS brand_key, p_type AS category,
         CAST(l_linenumber % 2 AS BIGINT) AS track_id, CAST(l_linenumber AS BIGINT) AS line_no,
         concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS det_id,
         l_orderkey % 40 AS slot, (l_orderkey % 40) * CAST(0.5 AS DOUBLE) AS t,
         l_quantity * 8 + 20 AS w, l_quantity * 4 + 10 AS h,
         CAST((l_partkey * 37) % 1920 AS DOUBLE) AS cx, CAST((l_orderkey * 53) % 1080 AS DOUBLE) AS cy,
         CAST(0.5 AS DOUBLE) + l_discount * 5 AS conf,
         CAST(1920 AS DOUBLE) AS frame_w, CAST(1080 AS DOUBLE) AS frame_h
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

_BOX = """v_box AS (
  SELECT *, cx - w / 2 AS x1, cy - h / 2 AS y1, cx + w / 2 AS x2, cy + h / 2 AS y2 FROM v_det)"""

_LOGO = "v_logo AS (SELECT * FROM v_box WHERE line_no <= 4)"

_PERSON = """v_person AS (
  SELECT video_id, slot, t, det_id AS person_id, x1, y1, x2, y2, w, h, cx, cy, conf,
         CASE WHEN CAST(cx AS BIGINT) % 3 = 0 THEN 'other' ELSE 'target' END AS team,
         conf * 4 AS vote_mass
  FROM v_box WHERE line_no >= 5)"""

_VOTE = """v_vote AS (
  SELECT video_id, CAST(split_part(person_id, '-', 2) AS BIGINT) AS track_id, t, slot AS frame_idx, team, person_id,
         conf * ((CAST(cy AS BIGINT) % 10) / 10.0 + 0.25) AS weight FROM v_person)"""

_LIVE = """v_live AS (
  SELECT video_id, track_id, t, frame_idx, sum(vt) OVER w AS cum_target, sum(vo) OVER w AS cum_other FROM (
    SELECT video_id, track_id, t, frame_idx, sum(CASE WHEN team = 'target' THEN weight ELSE 0 END) AS vt,
           sum(CASE WHEN team = 'other' THEN weight ELSE 0 END) AS vo FROM v_vote GROUP BY 1, 2, 3, 4) i
  WINDOW w AS (PARTITION BY video_id, track_id ORDER BY t))"""

_VIS = """v_vis AS (
  SELECT *, greatest(0.0, x2 - x1) * greatest(0.0, y2 - y1) AS area,
         greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE),
           sqrt(least(CAST(1 AS DOUBLE), (greatest(0.0, x2 - x1) * greatest(0.0, y2 - y1)) / (frame_w * frame_h)))
           * exp(-((cx - 960) * (cx - 960) + (cy - 540) * (cy - 540)) / (576.0 * 576.0)) * conf)) AS visibility
  FROM v_box)"""

_META = """v_meta AS (
  SELECT s_suppkey AS video_id, s_name AS event_name, 'clip_' || (s_suppkey % 30) || '.mp4' AS video_name,
         CAST(100000 + s_nationkey * 10000 AS BIGINT) AS audience_size, CAST(22 AS DOUBLE) AS cpm_base,
         CASE s_suppkey % 5 WHEN 0 THEN 'Live Broadcast TV' WHEN 1 THEN ' live stream '
              WHEN 2 THEN 'Highlight Clip' WHEN 3 THEN 'Social Media' ELSE 'Radio' END AS placement_type
  FROM supplier)"""

_MATCH = """v_match AS (
  SELECT m.video_id, event_name, video_name, match_date, duration_s FROM v_meta m JOIN (
    SELECT l_suppkey AS video_id, CAST(min(l_shipdate) AS DATE) AS match_date,
           CAST(date_diff('day', CAST(min(l_shipdate) AS DATE), CAST(max(l_shipdate) AS DATE)) AS DOUBLE) AS duration_s
    FROM lineitem GROUP BY 1) s ON m.video_id = s.video_id)"""

_RUN = """v_run AS (
  SELECT video_id, brand_key, track_id, run_no, min(t) AS start_t, max(t) AS last_t,
         count(*) AS hits, sum(visibility) AS vis_sum
  FROM (SELECT *, sum(opens) OVER (PARTITION BY video_id, brand_key, track_id ORDER BY t) AS run_no
        FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY video_id, brand_key, track_id ORDER BY t, det_id) <= 1.25
                             THEN 0 ELSE 1 END AS opens
              FROM v_vis WHERE visibility > 0.02) a) b
  GROUP BY 1, 2, 3, 4)"""

_SEG = """v_seg AS (
  SELECT *, avg_visibility * duration_weight * duration_s AS quality_s FROM (
    SELECT *, CASE WHEN duration_s < 1 THEN CAST(0.5 AS DOUBLE) WHEN duration_s <= 5 THEN CAST(1 AS DOUBLE) ELSE CAST(1.2 AS DOUBLE) END AS duration_weight
    FROM (SELECT video_id, brand_key, track_id, start_t, last_t + 0.5 AS end_t, hits,
                 greatest(last_t + 0.5 - start_t, CAST(0.5 AS DOUBLE)) AS duration_s, vis_sum / hits AS avg_visibility FROM v_run) a
    WHERE duration_s >= 0.5) b)"""

_BRAND = """v_brand AS (
  SELECT video_id, brand_key, sum(duration_s) AS total_exposure_s, sum(quality_s) AS quality_exposure_s,
         avg(round(avg_visibility, 3)) AS avg_visibility, count(*) AS segment_count, max(duration_s) AS longest_segment_s
  FROM v_seg GROUP BY 1, 2)"""

_PRICED = """v_priced AS (
  SELECT b.*, quality_exposure_s * (cpm_base / 1000) * audience_size
         * CASE lower(trim(placement_type)) WHEN 'live broadcast tv' THEN 1.0 WHEN 'live stream' THEN 0.85
                WHEN 'live stream online' THEN 0.85 WHEN 'highlight clip' THEN 1.4 WHEN 'highlight' THEN 1.4
                WHEN 'social media' THEN 0.7 WHEN 'social media clip' THEN 0.7 ELSE 1.0 END AS emv_usd
  FROM v_brand b JOIN v_meta m ON b.video_id = m.video_id)"""

_FRAME = """v_frame AS (
  SELECT l_suppkey AS video_id, l_orderkey % 40 AS frame_idx, avg(l_tax) * 10 AS grass_ratio, avg(l_discount) * 15 AS crowd_score,
         CAST(sum(CASE WHEN l_linenumber >= 4 THEN 1 ELSE 0 END) AS BIGINT) AS n_persons,
         CAST(sum(CASE WHEN l_linenumber >= 6 THEN 1 ELSE 0 END) AS BIGINT) AS n_target,
         coalesce(max(CASE WHEN l_linenumber >= 6 THEN l_quantity / 50.0 * 0.6 END), 0.0) AS max_target_h,
         coalesce(avg(CASE WHEN l_linenumber >= 6 THEN l_quantity / 50.0 * 0.6 END), 0.0) AS avg_target_h,
         avg(l_extendedprice) / 1000.0 AS sharp, max(l_extendedprice) / 1000.0 AS torso_sharp,
         [(((CAST(sum(l_partkey) % 500 AS BIGINT) + 1) * 7919) % 1000003) * 8999999999971, (((CAST(sum(l_partkey) % 500 AS BIGINT) + 1) * 104729) % 1000003) * 8999999999971, (((CAST(sum(l_partkey) % 500 AS BIGINT) + 1) * 1299709) % 1000003) * 8999999999971, xor((((CAST(sum(l_partkey) % 500 AS BIGINT) + 1) * 15485863) % 1000003) * 8999999999971, count(*) % 16)] AS phash,
         (l_orderkey % 40) * CAST(0.5 AS DOUBLE) AS time_s
  FROM lineitem GROUP BY l_suppkey, l_orderkey % 40)"""

_VIDEO = """v_video AS (
  SELECT video_id, fps, duration_s, CAST(floor(duration_s * fps) AS BIGINT) AS frame_count FROM (
    SELECT s_suppkey AS video_id, s_acctbal + 1000.0 AS duration_s,
           CASE s_suppkey % 3 WHEN 0 THEN CAST(25 AS DOUBLE) WHEN 1 THEN CAST(30 AS DOUBLE) ELSE CAST(50 AS DOUBLE) END AS fps FROM supplier) v)"""

_OCR = """v_ocr AS (
  SELECT l_suppkey AS video_id, CAST(l_orderkey % 40 AS DOUBLE) AS time_s,
         concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS det_id, CAST(l_linenumber AS BIGINT) AS line_no, p_name AS sponsor,
         CASE l_partkey % 3 WHEN 0 THEN translate(p_name, 'oisb', '0158')
              WHEN 1 THEN ' ' || upper(replace(p_name, ' ', '')) ELSE p_name || 'x' END AS text,
         CAST(0.5 AS DOUBLE) + l_discount * 5 AS ocr_conf, CAST(80 + l_orderkey % 21 AS BIGINT) AS fuzzy,
         l_quantity / 50.0 AS area_pct, ((l_partkey * 37) % 1920) / 1920.0 AS cx, ((l_orderkey * 53) % 1080) / 1080.0 AS cy
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

_SCORE = """v_score AS (
  SELECT l.doc_id, lang AS method, CAST(n_chars AS DOUBLE) AS score, CAST(quality AS BIGINT) AS label, source
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""

_EVENT = """v_event AS (
  SELECT event_id, ts, user_id AS track_id, event_type AS brand_key, value FROM events)"""

_VEC = """v_vec AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding, CAST(label AS BIGINT) AS label FROM embeddings)"""

_NEEDS = {
    "det": (_DET, []), "box": (_BOX, ["det"]), "logo": (_LOGO, ["box"]), "person": (_PERSON, ["box"]), "vote": (_VOTE, ["person"]), "live": (_LIVE, ["vote"]),
    "vis": (_VIS, ["box"]), "meta": (_META, []), "match": (_MATCH, ["meta"]), "run": (_RUN, ["vis"]),
    "seg": (_SEG, ["run"]), "brand": (_BRAND, ["seg"]), "priced": (_PRICED, ["brand", "meta"]),
    "frame": (_FRAME, []), "video": (_VIDEO, []), "ocr": (_OCR, []), "score": (_SCORE, []), "event": (_EVENT, []), "vec": (_VEC, []),
}


def with_views(*names: str, extra: str = "") -> str:
    """``WITH`` clause that defines the named views and all they depend on."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for need in _NEEDS[name][1]:
                visit(need)
            order.append(name)

    for name in names:
        visit(name)
    parts = [_NEEDS[n][0] for n in order]
    if extra:
        parts.append(extra)
    return "WITH " + ",\n".join(parts) + "\n"
