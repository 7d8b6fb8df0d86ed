"""Streaming queries, each run over the whole table; batch SQL twins where they exist."""

from __future__ import annotations

from pyspark.sql import functions as F

from screentime.catalog import query
from screentime.catalog.attribution import _OWNER
from screentime.streaming import ops as O
from screentime.streaming import run as RUN
from screentime.tables import Tables, with_views


def ms(col: str):
    """Microseconds since the epoch, which every engine prints alike."""
    return F.unix_micros(col).alias(col)


def hits(t):
    return RUN.read_table_stream(t.spark, t.sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("track_id"), F.col("event_type").alias("brand_key"), "value"
    )


_SESS = """
SELECT brand_key, track_id, epoch_us(min(ts)) AS start_ts, epoch_us(max(ts)) AS last_ts, count(*) AS hits, round(sum(value), 4) AS total FROM (
  SELECT *, sum(opens) OVER (PARTITION BY brand_key, track_id ORDER BY ts) AS run_no FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY brand_key, track_id ORDER BY ts) <= INTERVAL 12 HOURS THEN 0 ELSE 1 END AS opens FROM v_event) a) b
GROUP BY brand_key, track_id, run_no"""


def session_rows(df):
    return df.select("brand_key", "track_id", ms("start_ts"), ms("last_ts"), "hits", F.round("total", 4).alias("total"))


@query("stream_exposure_sessions", with_views("event") + _SESS)
def stream_exposure_sessions(t):
    source = RUN.with_sentinel(hits(t), t.raw("events"), "40 DAYS", track_id=-1)
    rows = RUN.run_append(O.exposure_sessions(source, "12 hours", "1 hour"), "sessions")
    return session_rows(rows.filter("track_id >= 0"))


@query("batch_exposure_sessions", with_views("event") + _SESS)
def batch_exposure_sessions(t):
    return session_rows(O.exposure_sessions(t.events(), "12 hours", "1 hour"))


@query("stream_tumbling_exposure", with_views("event") + """
SELECT brand_key, epoch_us(time_bucket(INTERVAL 5 MINUTES, ts)) AS window_start, count(*) AS hits, round(sum(value), 4) AS total FROM v_event GROUP BY 1, 2""")
def stream_tumbling_exposure(t):
    rows = RUN.run_update(O.windowed_exposure(hits(t), "5 minutes", None, "1 hour"), "tumbling", ["brand_key", "window_start"])
    return rows.select("brand_key", ms("window_start"), "hits", F.round("total", 4).alias("total"))


@query("stream_sliding_exposure", with_views("event") + """
SELECT brand_key, epoch_us(time_bucket(INTERVAL 5 MINUTES, ts) - k * INTERVAL 5 MINUTES) AS window_start, count(*) AS hits, round(sum(value), 4) AS total
FROM v_event, range(0, 2) g(k) GROUP BY 1, 2""")
def stream_sliding_exposure(t):
    rows = RUN.run_update(O.windowed_exposure(hits(t), "10 minutes", "5 minutes", "1 hour"), "sliding", ["brand_key", "window_start"])
    return rows.select("brand_key", ms("window_start"), "hits", F.round("total", 4).alias("total"))


@query("stream_dedup", with_views("event") + "SELECT event_id, brand_key, round(value, 4) AS value FROM v_event")
def stream_dedup(t):
    both = hits(t).unionByName(hits(t))
    rows = RUN.run_append(O.dedup(both, ["event_id"], "40 days"), "dedup")
    return rows.select("event_id", "brand_key", F.round("value", 4).alias("value"))


@query("stream_late_rows", with_views("event") + """
SELECT brand_key, epoch_us(hour) AS window_start, count(*) AS hits, round(sum(value), 4) AS total
FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS hour FROM v_event) e, (SELECT max(ts) - INTERVAL 7 DAY AS mark FROM v_event WHERE event_id % 2 = 0) w
WHERE event_id % 2 = 0 OR hour + INTERVAL 1 HOUR > mark GROUP BY 1, 2""")
def stream_late_rows(t):
    # Even events come first, odd ones after them: what then lies behind the watermark is late.
    arrivals = [t.events().filter(f"event_id % 2 = {i}") for i in (0, 1)]
    rows = RUN.run_arrivals(arrivals, lambda s: O.windowed_exposure(s, "1 hour", None, "7 days"), "late", ["brand_key", "window_start"])
    return rows.select("brand_key", ms("window_start"), "hits", F.round("total", 4).alias("total"))


@query("stream_enrich", with_views("event") + """
SELECT event_id, brand_key, CASE brand_key WHEN 'purchase' THEN 'Highlight Clip' WHEN 'click' THEN 'Live Stream' ELSE NULL END AS placement_type,
       CASE brand_key WHEN 'purchase' THEN 1.4 WHEN 'click' THEN 0.85 ELSE 1.0 END AS multiplier FROM v_event""")
def stream_enrich(t):
    names = t.spark.createDataFrame([("purchase", "Highlight Clip"), ("click", "Live Stream")], "brand_key string, placement_type string")
    rows = RUN.run_append(O.priced(O.enrich(hits(t), names)), "enrich")
    return rows.select("event_id", "brand_key", "placement_type", "multiplier")


@query("stream_progress", """
SELECT count(*) AS hits, count(DISTINCT event_type) AS brands, count(*) FILTER (WHERE value >= 1) AS kept, count(*) FILTER (WHERE value < 1 OR value IS NULL) AS dropped FROM events""")
def stream_progress(t):
    kept = F.coalesce(F.col("value") >= 1, F.lit(False))
    counters = {"hits": F.count(F.lit(1)), "kept": F.count_if(kept), "dropped": F.count_if(~kept)}
    rows = RUN.progress_table(hits(t), "progress", "brand_key", counters)
    return rows.agg(F.count_distinct("brand_key").alias("brands"), *[F.sum(n).alias(n) for n in counters])


class _StreamTables(Tables):
    """Adapter views over file streams of line items; the part table stays static."""

    def raw(self, name: str):
        if name == "lineitem":
            return RUN.read_table_stream(self.spark, self.sf_dir, name)
        return super().raw(name)


EPOCH_MS = 1704067200000  # a stream clock has to start after the initial watermark at 0


def stamp(df):
    return df.withColumn("ts", F.timestamp_millis((F.col("t") * 1000).cast("bigint") + EPOCH_MS))


@query("stream_logo_person_join", with_views("logo", "person", extra=_OWNER) + """
SELECT DISTINCT video_id, CAST(t * 1000000 AS BIGINT) + 1704067200000000 AS ts, det_id, person_id FROM v_owner""")
def stream_logo_person_join(t):
    s = _StreamTables(t.spark, t.sf_dir)
    last = stamp(t.boxes())
    logos = RUN.with_sentinel(stamp(s.logos()).select("video_id", "ts", "det_id", "cx", "cy"), last, "1 DAY", video_id=-1)
    persons = RUN.with_sentinel(stamp(s.persons()).select("video_id", "ts", "person_id", "x1", "y1", "x2", "y2"), last, "1 DAY", video_id=-1)
    rows = RUN.run_append(O.logo_owners(logos, persons, "1 minute"), "logo_person")
    return rows.filter("video_id >= 0").select("video_id", ms("ts"), "det_id", "person_id")


@query("stream_team_votes", with_views("vote") + """
, v_live AS (SELECT video_id, track_id, t, sum(vt) OVER w AS a, sum(vo) OVER w AS b FROM (
    SELECT video_id, track_id, t, sum(CASE WHEN team = 'target' THEN weight ELSE 0 END) AS vt, sum(CASE WHEN team = 'other' THEN weight ELSE 0 END) AS vo FROM v_vote GROUP BY 1, 2, 3) i
    WINDOW w AS (PARTITION BY video_id, track_id ORDER BY t))
SELECT video_id, track_id, CAST(t * 1000000 AS BIGINT) + 1704067200000000 AS ts, coalesce(last_value(forced IGNORE NULLS) OVER (PARTITION BY video_id, track_id ORDER BY t), 'target') AS label FROM (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY video_id, track_id ORDER BY t) = 1 THEN CASE WHEN a >= b THEN 'target' ELSE 'other' END
                 WHEN a > b * 1.25 THEN 'target' WHEN b > a * 1.25 THEN 'other' END AS forced FROM v_live) x""")
def stream_team_votes(t):
    s = _StreamTables(t.spark, t.sf_dir)

    def labels():
        votes = stamp(s.votes()).select("video_id", "track_id", "ts", "team", "weight")
        return O.team_votes(RUN.with_sentinel(votes, stamp(t.boxes()), "1 DAY", video_id=-1, track_id=-1), ["target", "other"])

    return RUN.run_stateful(labels, t.spark, "team_votes").filter("video_id >= 0").select("video_id", "track_id", ms("ts"), "label")


@query("stream_track_coast", with_views("vote") + """
SELECT video_id, track_id, frame_idx, drawn_idx, drawn_idx > frame_idx AS held FROM (
  SELECT video_id, track_id, frame_idx, unnest(range(frame_idx, greatest(least(coalesce(nxt - 1, frame_idx + 8), frame_idx + 8), frame_idx) + 1)) AS drawn_idx
  FROM (SELECT *, lead(frame_idx) OVER (PARTITION BY video_id, track_id ORDER BY frame_idx) AS nxt FROM (SELECT DISTINCT video_id, track_id, frame_idx FROM v_vote) d) x) y""")
def stream_track_coast(t):
    s = _StreamTables(t.spark, t.sf_dir)

    def drawn():
        boxes = stamp(s.votes()).select("video_id", "track_id", "frame_idx", "ts")
        boxes = RUN.with_sentinel(boxes, stamp(t.boxes()), "1 DAY", video_id=-1, track_id=-1, frame_idx=0)
        return O.track_coast(boxes, frame_ms=500)

    return RUN.run_stateful(drawn, t.spark, "coast").filter("video_id >= 0")


@query("stream_spacing", with_views("det", extra="""
v_list AS (SELECT video_id, brand_key, list(t ORDER BY t) AS ts FROM (SELECT DISTINCT video_id, brand_key, t FROM v_det) d GROUP BY 1, 2)""") + """
SELECT video_id, brand_key, CAST(t * 1000000 AS BIGINT) + 1704067200000000 AS ts FROM (
  SELECT video_id, brand_key, unnest(list_filter(list_reduce(ts, lambda acc, x: CASE WHEN x - acc[-1] >= 2.0 THEN list_append(acc, x) ELSE acc END,
    [CAST(-1000 AS DOUBLE)]), lambda x: x >= 0)) AS t FROM v_list) k""")
def stream_spacing(t):
    s = _StreamTables(t.spark, t.sf_dir)

    def kept():
        hits = stamp(s.detections()).select("video_id", "brand_key", "ts")
        return O.spaced(RUN.with_sentinel(hits, stamp(t.boxes()), "1 DAY", video_id=-1, brand_key=""), ["video_id", "brand_key"])

    return RUN.run_stateful(kept, t.spark, "spacing").filter("video_id >= 0").select("video_id", "brand_key", ms("ts"))
