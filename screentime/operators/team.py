"""Team votes, stable labels, presence and track coasting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screentime.operators.scans import CHUNK_SECONDS, chain_starts, fill_forward, prefix_sums, previous

TRACK = ["video_id", "track_id"]

# Label hysteresis, embedding refresh age, box hold length.
HYSTERESIS = 1.25
REFRESH_FRAMES = 5
HOLD_FRAMES = 8

# A chunk is replayed in one array, so its chunks are short; rows of a replayed part.
FOLD_SECONDS = 30.0
FOLD_FRAMES = 1024.0
REPLAY_ROWS = 32


def vote_weight(quality: Column, margin: Column, prototype: bool = False) -> Column:
    """``quality * (0.25 + margin)``; the prototype weighs by margin, a fifth below 0.05."""
    if prototype:
        return quality * margin * F.when(margin < 0.05, 0.2).otherwise(1.0)
    return quality * (margin + 0.25)


def vote_totals(votes: DataFrame) -> DataFrame:
    return votes.filter("weight > 0").groupBy(*TRACK, "team").agg(F.sum("weight").alias("mass"))


def vote_instants(votes: DataFrame, teams: list[str]) -> DataFrame:
    """One row per track and time with the vote mass of each team."""
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.lit(0.0))
    return votes.groupBy(*TRACK, "t").agg(
        *[F.sum(F.when(F.col("team") == team, weight).otherwise(F.lit(0.0))).alias(f"v_{team}") for team in teams]
    )


def live_votes(votes: DataFrame, teams: list[str], chunk: float = CHUNK_SECONDS) -> DataFrame:
    """Vote mass per team up to and including each time of a track."""
    return prefix_sums(vote_instants(votes, teams), TRACK, "t", {f"cum_{x}": f"v_{x}" for x in teams}, chunk=chunk)


def fold_states(
    rows: DataFrame, keys: list[str], order: str, step: Column, states: int, initial: int, chunk: float = FOLD_SECONDS
) -> DataFrame:
    """State after each row of a finite state machine, without one task per key.

    ``step`` is an array giving the next state for every state. Maps compose, so a
    chunk is folded for all start states at once, the chunk maps are chained in blocks
    (:func:`chain_starts`), and each chunk is then replayed from its known start
    state. Rows are unique per ``(keys, order)``.
    """
    part = [*keys, "__chunk"]
    grouped = rows.select(*keys, order, step.alias("step")).groupBy(
        *keys, F.floor(F.col(order) / chunk).cast("bigint").alias("__chunk")
    ).agg(F.array_sort(F.collect_list(F.struct(order, "step"))).alias("steps"))
    identity = F.array(*[F.lit(i) for i in range(states)])
    mapped = grouped.select(
        *part, F.aggregate("steps", identity, lambda acc, x: F.transform(acc, lambda s: F.element_at(x["step"], s + 1))).alias("cmap")
    )
    begun = chain_starts(
        mapped.withColumnRenamed("cmap", "m"), keys, "__chunk", F.lit(initial),
        lambda a, b: F.transform(a, lambda s: F.element_at(b, s + 1)), lambda m, s: F.element_at(m, s + 1),
    ).withColumnRenamed("start", "__start")
    none = F.array().cast("array<int>")

    def replay(acc: Column, x: Column) -> Column:
        nxt = F.element_at(x["step"], acc["s"] + 1)
        return F.struct(nxt.alias("s"), F.concat(acc["out"], F.array(nxt)).alias("out"))

    def replay_part(acc: Column, part: Column) -> Column:
        # appending copies what is there, so parts are short and only their handles are copied
        done = F.aggregate(part, F.struct(acc["s"].alias("s"), none.alias("out")), replay)
        return F.struct(done["s"].alias("s"), F.concat(acc["out"], F.array(done["out"])).alias("out"))

    starts = F.sequence(F.lit(0), F.floor((F.size("steps") - 1) / REPLAY_ROWS).cast("int"))
    parts = F.transform(starts, lambda i: F.slice("steps", i * REPLAY_ROWS + 1, F.lit(REPLAY_ROWS)))
    out = F.flatten(F.aggregate(parts, F.struct(F.col("__start").alias("s"), F.array().cast("array<array<int>>").alias("out")), replay_part)["out"])
    return (
        grouped.join(begun, part)
        .select(*keys, F.explode(F.arrays_zip(F.col(f"steps.{order}").alias("o"), out.alias("s"))).alias("z"))
        .select(*keys, F.col("z.o").alias(order), F.col("z.s").alias("state"))
    )


def hysteresis_labels(
    live: DataFrame, teams: list[str], hysteresis: float = HYSTERESIS, chunk: float | None = None, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Label shown after each time of a track, and the columns ``carry`` of ``live``.

    The first team with votes is taken; a rival replaces it only when its mass
    exceeds the current one by the factor. No votes yet shows the first team.
    """
    n = len(teams)
    mass = [F.col(f"cum_{x}") for x in teams]
    if n == 2:
        return _two_team_labels(live, teams, hysteresis, chunk or CHUNK_SECONDS).select(*TRACK, "t", *carry, "label")
    best = F.greatest(*mass) if n > 1 else mass[0]
    top = F.coalesce(*[F.when(m == best, F.lit(i)) for i, m in enumerate(mass)])
    voted = best > 0
    step = F.array(
        *[F.when(voted & (top != i) & (best > mass[i] * hysteresis), top).otherwise(F.lit(i)) for i in range(n)],
        F.when(voted, top).otherwise(F.lit(n)),
    )
    shown = fold_states(live, TRACK, "t", step, n + 1, n, chunk or FOLD_SECONDS)
    if carry:
        shown = live.select(*TRACK, "t", *carry).join(shown, [*TRACK, "t"])
    names = F.array(*[F.lit(x) for x in teams], F.lit(teams[0]))
    return shown.select(*TRACK, "t", *carry, F.element_at(names, F.col("state") + 1).alias("label"))


def _two_team_labels(live: DataFrame, teams: list[str], hysteresis: float, chunk: float) -> DataFrame:
    """With two teams a time either decides the label, whatever it was, or leaves it: the last decision is shown.

    A time decides when one team leads by the factor, and at a track's first votes.
    """
    a, b = (F.col(f"cum_{x}") for x in teams)
    rows = previous(live.withColumn("__mass", a + b), TRACK, "t", {"__was": "__mass"}, chunk=chunk)
    lead = F.when(a >= b, teams[0]).otherwise(teams[1])
    clear = F.when(a >= b, a > b * hysteresis).otherwise(b > a * hysteresis)
    opens = (F.col("__mass") > 0) & (F.coalesce("__was", F.lit(0.0)) <= 0)
    decided = rows.withColumn("label", F.when(opens | clear, lead))
    return fill_forward(decided, TRACK, ["t"], ["label"], chunk=chunk).withColumn("label", F.coalesce("label", F.lit(teams[0])))


def embedding_refresh(
    seen: DataFrame, every: int = REFRESH_FRAMES, chunk: float = FOLD_FRAMES
) -> DataFrame:
    """Whether each sighting recomputes the embedding: first one, or the last
    recompute at least ``every`` frames ago. The state is the age at the sighting."""
    gaps = previous(seen.select(*TRACK, "frame_idx").distinct(), TRACK, "frame_idx", {"before": "frame_idx"}, chunk=chunk)
    gap = F.least(F.coalesce(F.col("frame_idx") - F.col("before"), F.lit(every)), F.lit(every)).cast("int")
    step = F.array(*[
        F.when(F.lit(age) + gap >= every, F.lit(0)).otherwise((F.lit(age) + gap).cast("int")) for age in range(every)
    ], F.lit(0))
    states = fold_states(gaps, TRACK, "frame_idx", step, every + 1, every, chunk)
    return states.select(*TRACK, "frame_idx", F.col("state").alias("age"), (F.col("state") == 0).alias("refresh"))


def team_presence(players: DataFrame, teams: list[str]) -> DataFrame:
    """Players per team and frame, one column per listed team."""
    return players.groupBy("video_id", "frame_idx").pivot("team", teams).agg(F.count(F.lit(1))).na.fill(0)


def presence_summary(presence: DataFrame, teams: list[str]) -> DataFrame:
    aggs = [f(x).alias(f"{n}_{x}") for x in teams for n, f in (("avg", F.avg), ("max", F.max))]
    return presence.groupBy("video_id").agg(*aggs)


def presence_smooth(presence: DataFrame, teams: list[str], window: int) -> DataFrame:
    """Trailing mean over the last ``window`` frame rows of a video.

    The window runs over overlapping slices of rows: each slice also receives the
    ``window - 1`` rows before it, found through the running row number.
    """
    from screentime.operators.scans import ranked

    slice_rows = max(1024, 4 * window)
    numbered = ranked(presence, ["video_id"], "frame_idx", [], "rn", F.floor(F.col("frame_idx") / 65536).cast("bigint"))
    own = F.floor((F.col("rn") - 1) / slice_rows).cast("bigint")
    into_next = ((F.col("rn") - 1) % slice_rows) >= slice_rows - (window - 1)
    slices = F.when(into_next, F.array(own, own + 1)).otherwise(F.array(own))
    spread = numbered.select("*", own.alias("own"), F.explode(slices).alias("part"))
    trail = Window.partitionBy("video_id", "part").orderBy("rn").rowsBetween(-(window - 1), 0)
    smooth = spread.select("video_id", "frame_idx", "own", "part", *[F.avg(x).over(trail).alias(x) for x in teams])
    return smooth.filter("own = part").drop("own", "part")


def relative_presence(smooth: DataFrame, a: str, b: str) -> DataFrame:
    total = F.col(a) + F.col(b) + F.lit(float("1e-9"))
    return smooth.select("video_id", "frame_idx", (F.col(a) / total * 100).alias(f"{a}_pct"), (F.col(b) / total * 100).alias(f"{b}_pct"))


def label_smoothing(labels: DataFrame, window: int = 15) -> DataFrame:
    """Most frequent label of a track's last ``window`` rows; the one seen first wins ties."""
    from screentime.operators.scans import ranked

    slice_rows = max(1024, 4 * window)
    numbered = ranked(labels, TRACK, "frame_idx", [], "rn", F.floor(F.col("frame_idx") / 65536).cast("bigint"))
    own = F.floor((F.col("rn") - 1) / slice_rows).cast("bigint")
    into_next = ((F.col("rn") - 1) % slice_rows) >= slice_rows - (window - 1)
    spread = numbered.select("*", own.alias("own"), F.explode(F.when(into_next, F.array(own, own + 1)).otherwise(F.array(own))).alias("part"))
    trail = Window.partitionBy(*TRACK, "part").orderBy("rn").rowsBetween(-(window - 1), 0)
    recent = spread.select(*TRACK, "frame_idx", "own", "part", F.collect_list("label").over(trail).alias("recent")).filter("own = part")
    counted = F.transform(
        F.array_distinct("recent"),
        lambda x: F.struct((-F.size(F.filter("recent", lambda y: y == x))).alias("neg"), F.array_position("recent", x).alias("pos"), x.alias("label")),
    )
    return recent.select(*TRACK, "frame_idx", F.array_min(counted)["label"].alias("label"))


def track_coast(boxes: DataFrame, hold: int = HOLD_FRAMES, last_frame: DataFrame | None = None, chunk: float = 2048.0) -> DataFrame:
    """Each box, and its copies on the frames after it until the next box or the hold ends.

    ``last_frame`` has one row per video with the last processed frame; a video
    without one is held to the full length.
    """
    flipped = boxes.withColumn("__neg", -F.col("frame_idx"))
    nxt = previous(flipped, TRACK, "__neg", {"next_idx": "frame_idx"}, chunk=chunk).drop("__neg")
    stop = F.least(F.coalesce(F.col("next_idx") - 1, F.col("frame_idx") + hold), F.col("frame_idx") + hold)
    if last_frame is not None:
        nxt = nxt.join(last_frame.select("video_id", "last_idx"), "video_id", "left")
        stop = F.least(stop, F.col("last_idx"))
    drawn = F.explode(F.sequence(F.col("frame_idx"), F.greatest(stop, F.col("frame_idx"))))
    return nxt.select("*", drawn.alias("drawn_idx")).select(
        *boxes.columns, "drawn_idx", (F.col("drawn_idx") > F.col("frame_idx")).alias("held")
    )
