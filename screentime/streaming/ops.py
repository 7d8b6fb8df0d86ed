"""Streaming operators: DataFrame in, DataFrame out, no sink attached."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from screentime.functions import visibility as V
from screentime.operators.attribution import OWNER_REACH

TRACK = ["brand_key", "track_id"]


def exposure_sessions(hits: DataFrame, gap: str, lateness: str) -> DataFrame:
    """Runs per brand and track; a hit exactly ``gap`` after the last one still belongs."""
    source = hits.withWatermark("ts", lateness) if hits.isStreaming else hits
    grouped = source.groupBy(*TRACK, F.session_window("ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("hits"), F.sum("value").alias("total"), F.max("ts").alias("last_ts")
    )
    return grouped.select(*TRACK, F.col("w.start").alias("start_ts"), "last_ts", "hits", "total")


def windowed_exposure(hits: DataFrame, length: str, slide: str | None, lateness: str) -> DataFrame:
    """Tumbling (no slide) or sliding sums per brand."""
    source = hits.withWatermark("ts", lateness) if hits.isStreaming else hits
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return source.groupBy(window.alias("w"), "brand_key").agg(
        F.count(F.lit(1)).alias("hits"), F.sum("value").alias("total")
    ).select("brand_key", F.col("w.start").alias("window_start"), "hits", "total")


def dedup(hits: DataFrame, keys: list[str], lateness: str) -> DataFrame:
    """Drop re-sent rows; state is kept only inside the watermark."""
    if not hits.isStreaming:
        return hits.dropDuplicates(keys)
    return hits.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def enrich(hits: DataFrame, names: DataFrame) -> DataFrame:
    """Stream-static join with a dimension; the planner broadcasts it when small enough."""
    return hits.join(names, "brand_key", "left")


def priced(rows: DataFrame) -> DataFrame:
    return rows.withColumn("multiplier", V.placement_multiplier(F.col("placement_type")))


def logo_owners(logos: DataFrame, persons: DataFrame, lateness: str) -> DataFrame:
    """Owner of every logo from a logo and a person stream, by the rule of the batch operator.

    The smallest containing person box, else the nearest centre within reach of the
    person's own diagonal, else null; ties go to the lower person id. Streams meet on
    frame time; a logo is told once, when the watermark has passed its frame.
    Inputs: ``video_id, ts, det_id, cx, cy`` and ``video_id, ts, person_id, x1..y2``;
    a ``det_id`` sent twice for a frame is told once.
    """
    a = logos.withWatermark("ts", lateness).alias("a")
    b = persons.withWatermark("ts", lateness).alias("b")
    x1, y1, x2, y2 = (F.col(f"b.{c}") for c in ("x1", "y1", "x2", "y2"))
    cx, cy = F.col("a.cx"), F.col("a.cy")
    inside = (x1 <= cx) & (cx <= x2) & (y1 <= cy) & (cy <= y2)
    dist = F.hypot(cx - (x1 + x2) / 2, cy - (y1 + y2) / 2)
    near = dist < F.hypot(x2 - x1, y2 - y1) * OWNER_REACH
    on = F.expr("a.video_id = b.video_id AND a.ts = b.ts") & (inside | near)
    rank = F.struct(
        F.when(inside, 0).otherwise(1).alias("tier"), F.when(inside, V.box_area(x1, y1, x2, y2)).otherwise(dist).alias("score"), F.col("b.person_id").alias("person_id")
    )
    pairs = a.join(b, on, "left").select("a.video_id", "a.ts", "a.det_id", F.when(F.col("b.person_id").isNotNull(), rank).alias("owner"))
    return pairs.groupBy("video_id", "ts", "det_id").agg(F.min("owner").alias("owner")).select("video_id", "ts", "det_id", "owner.person_id")


def _us(ts: pd.Series) -> np.ndarray:
    """Microseconds since the epoch."""
    return ts.to_numpy().astype("datetime64[us]").astype(np.int64)


class TeamVotes(StatefulProcessor):
    """Vote mass per team and the label shown, kept per track.

    Votes wait in the state until the watermark has passed them, so that they are
    counted in time order whatever order they come in.
    """

    def __init__(self, teams: list[str], hysteresis: float):
        self.teams, self.hysteresis = teams, hysteresis

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = ", ".join(f"v{i} double" for i in range(len(self.teams)))
        self.handle = handle
        self.state = handle.getValueState("votes", f"{fields}, shown int")
        self.waiting = handle.getValueState("waiting", "ts array<bigint>, team array<int>, weight array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        votes = self._waiting()
        for part in rows:
            team = part["team"].map({name: i for i, name in enumerate(self.teams)}).fillna(-1).astype(int)
            weight = part["weight"].astype(float).fillna(0.0)
            votes += list(zip(_us(part["ts"]).tolist(), team.tolist(), weight.tolist()))
        yield self._release(key, votes, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._release(key, self._waiting(), timerValues.getCurrentWatermarkInMs())

    def _waiting(self) -> list[tuple[int, int, float]]:
        return list(zip(*self.waiting.get())) if self.waiting.exists() else []

    def _release(self, key, votes: list[tuple[int, int, float]], watermark: int) -> pd.DataFrame:
        n = len(self.teams)
        old = self.state.get() if self.state.exists() else tuple([0.0] * n + [-1])
        mass, shown = np.array(old[:n], dtype=float), int(old[n])
        votes.sort()
        ready = [v for v in votes if v[0] < watermark * 1000]
        rest = votes[len(ready) :]
        out = []
        for ts, part in groupby(ready, key=itemgetter(0)):
            for _, team, weight in part:
                if weight > 0 and team >= 0:
                    mass[team] += weight
            if mass.sum() > 0:
                top = int(mass.argmax())
                if shown < 0 or (top != shown and mass[top] > mass[shown] * self.hysteresis):
                    shown = top
            out.append((*key, pd.Timestamp(ts, unit="us"), self.teams[max(shown, 0)], float(mass.sum())))
        self.state.update(tuple([*map(float, mass), shown]))
        if rest:
            self.waiting.update(tuple(map(list, zip(*rest))))
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        else:
            self.waiting.clear()
        return pd.DataFrame(out, columns=["video_id", "track_id", "ts", "label", "mass"])

    def close(self) -> None:
        pass


def team_votes(votes: DataFrame, teams: list[str], hysteresis: float = 1.25, lateness: str = "1 minute") -> DataFrame:
    """Stable label per track and time. Input: video_id, track_id, ts, team, weight.

    Rows may come up to ``lateness`` out of order; a time is told once the watermark has
    passed it. Votes for a team outside ``teams`` count for nobody, but their time is told.
    """
    return votes.withWatermark("ts", lateness).groupBy("video_id", "track_id").transformWithStateInPandas(
        statefulProcessor=TeamVotes(teams, hysteresis),
        outputStructType="video_id bigint, track_id bigint, ts timestamp, label string, mass double",
        outputMode="Append",
        timeMode="EventTime",
    )


class TrackCoast(StatefulProcessor):
    """Boxes of a track that wait until the hold after them is over.

    Then the next box, if it came, is known: the box and its copies are drawn up to
    there, or to the end of the hold.
    """

    def __init__(self, hold: int, frame_ms: int):
        self.hold, self.frame_ms = hold, frame_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "frame_idx array<bigint>, due array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        boxes = self._waiting()
        for part in rows:
            due = _us(part["ts"]) // 1000 + self.hold * self.frame_ms
            boxes.update(zip(part["frame_idx"].tolist(), due.tolist()))
        yield self._draw(key, boxes, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._draw(key, self._waiting(), timerValues.getCurrentWatermarkInMs())

    def _waiting(self) -> dict[int, int]:
        return dict(zip(*self.waiting.get())) if self.waiting.exists() else {}

    def _draw(self, key, boxes: dict[int, int], watermark: int) -> pd.DataFrame:
        frames, out, rest = sorted(boxes), [], []
        for i, idx in enumerate(frames):
            if boxes[idx] >= watermark:
                rest.append(idx)
                continue
            stop = min(frames[i + 1] - 1, idx + self.hold) if i + 1 < len(frames) else idx + self.hold
            out += [(*key, idx, drawn, drawn > idx) for drawn in range(idx, stop + 1)]
        if rest:
            self.waiting.update((rest, [boxes[idx] for idx in rest]))
            self.handle.registerTimer(min(boxes[idx] for idx in rest) + 1)
        else:
            self.waiting.clear()
        return pd.DataFrame(out, columns=["video_id", "track_id", "frame_idx", "drawn_idx", "held"])

    def close(self) -> None:
        pass


def track_coast(boxes: DataFrame, hold: int = 8, frame_ms: int = 40, lateness: str = "1 minute") -> DataFrame:
    """Every box and its copies on the frames after it, until the next box of the track
    or the end of the hold. Input: video_id, track_id, frame_idx, ts.

    A box is drawn once the watermark has passed its hold (``hold`` frames of
    ``frame_ms``), also when its track is never seen again; boxes may come up to
    ``lateness`` out of order.
    """
    return boxes.withWatermark("ts", lateness).groupBy("video_id", "track_id").transformWithStateInPandas(
        statefulProcessor=TrackCoast(hold, frame_ms),
        outputStructType="video_id bigint, track_id bigint, frame_idx bigint, drawn_idx bigint, held boolean",
        outputMode="Append",
        timeMode="EventTime",
    )


class Spacing(StatefulProcessor):
    """Last kept times of a bucket's keys and the times that wait for the watermark.

    A bucket holds the keys of one hash value: the state is called once a bucket and not
    once a key, in entries of ``ENTRY`` rows, a list a column. Keys are texts here.
    Once the watermark lies ``spacing`` behind the last kept time of a key, no later row can
    conflict with it and it is forgotten.
    """

    #: Rows of a state entry.
    ENTRY = 4096

    def __init__(self, spacing_us: int, key_names: list[str]):
        self.spacing, self.keys = spacing_us, key_names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = ", ".join(f"k{i} array<string>" for i in range(len(self.keys))) + ", ts array<bigint>"
        self.kept = handle.getListState("kept", fields)
        self.waiting = handle.getListState("waiting", fields)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [part[self.keys].assign(ts=_us(part["ts"])).drop_duplicates() for part in rows]
        yield self._release(new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._release([], timerValues.getCurrentWatermarkInMs())

    def _read(self, state) -> list[pd.DataFrame]:
        return [pd.DataFrame(dict(zip([*self.keys, "ts"], entry))) for entry in state.get()] if state.exists() else []

    def _write(self, state, rows: pd.DataFrame) -> None:
        if len(rows):
            parts = (rows.iloc[i : i + self.ENTRY] for i in range(0, len(rows), self.ENTRY))
            state.put([tuple(part[c].tolist() for c in [*self.keys, "ts"]) for part in parts])
        else:
            state.clear()

    def _release(self, new: list[pd.DataFrame], watermark: int) -> pd.DataFrame:
        mark = watermark * 1000
        before = [part.assign(kept=True) for part in self._read(self.kept)]
        later = [part.assign(kept=False) for part in [*self._read(self.waiting), *new]]
        empty = pd.DataFrame({**{k: pd.Series(dtype=object) for k in self.keys}, "ts": pd.Series(dtype="int64"), "kept": pd.Series(dtype=bool)})
        rows = pd.concat([*before, *later], ignore_index=True) if before or later else empty
        rows = rows.astype({"ts": "int64", "kept": bool}).drop_duplicates()
        rows["no"] = rows.groupby(self.keys, dropna=False, sort=False).ngroup()
        waits = (~rows["kept"] & (rows["ts"] >= mark)).to_numpy()
        rest, rows = rows[waits].sort_values("ts", kind="stable"), rows[~waits]
        rows = rows.iloc[np.lexsort((rows["ts"], ~rows["kept"], rows["no"]))]
        told, last, ends = [], {}, {}
        for i, (no, ts, kept) in enumerate(zip(rows["no"].tolist(), rows["ts"].tolist(), rows["kept"].tolist())):
            if kept or no not in last or ts - last[no] >= self.spacing:
                last[no], ends[no] = ts, i
                if not kept:
                    told.append(i)
        out = rows.iloc[told][[*self.keys, "ts"]]
        left = rows.iloc[[i for i in ends.values()]]
        left = left[left["ts"] + self.spacing > mark]
        self._write(self.waiting, rest)
        self._write(self.kept, left)
        if len(rest):
            self.handle.registerTimer(int(rest["ts"].iloc[0]) // 1000 + 1)
        if len(left):
            self.handle.registerTimer((int(left["ts"].min()) + self.spacing) // 1000 + 1)
        return out.assign(ts=out["ts"].to_numpy().astype("datetime64[us]"))

    def close(self) -> None:
        pass


#: Buckets that the keys of a stream are dealt to.
BUCKETS = 1024


def spaced(hits: DataFrame, keys: list[str], spacing: float = 2.0, lateness: str = "1 minute", buckets: int = BUCKETS) -> DataFrame:
    """Earliest-first times per key that keep ``spacing`` seconds from the last kept one.

    Times may come up to ``lateness`` out of order; one is judged, and told if kept,
    when the watermark has passed it, so the choice is that of the batch operator
    whatever order the rows come in. Equal times of a key count once. Keys are dealt to
    ``buckets`` by hash and travel as texts, so their types have to come back from a cast.
    """
    named = [F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)]
    texts = [f"k{i}" for i in range(len(keys))]
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket")
    found = hits.select(*named, "ts", bucket).withWatermark("ts", lateness).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=Spacing(round(spacing * 1_000_000), texts),
        outputStructType=", ".join(f"{k} string" for k in texts) + ", ts timestamp",
        outputMode="Append",
        timeMode="EventTime",
    )
    return found.select(*[F.col(t).cast(hits.schema[k].dataType).alias(k) for t, k in zip(texts, keys)], "ts")
