"""Choosing frames: sorted picks, quotas, diverse top-k and spacing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screentime.functions import frames as FR
from screentime.operators.scans import chain_starts, ranked
from screentime.session import stored

# Distances, bucket shares and the relaxation tiers.
HAMMING, SPACING = 10, 2.0
BUCKET_SHARE = {"closeup": 0.40, "medium": 0.40, "wide": 0.20}
TIERS = (("strict", 10, 2.0), ("relax_temporal", 10, 1.0), ("relax_dedup", 6, 1.0), ("minimal_dedup", 3, 0.5))


def pick_sharpest(frames: DataFrame, n: int, min_sharp: float = 50.0, min_h: float = 0.45) -> DataFrame:
    """The ``n`` sharpest qualified frames per video."""
    good = frames.filter((F.col("sharp") >= min_sharp) & (F.col("max_target_h") >= min_h) & (F.col("n_target") > 0))
    order = Window.partitionBy("video_id").orderBy(F.round("sharp", 9).desc(), "frame_idx")
    return good.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def blurriest_first(frames: DataFrame) -> DataFrame:
    """Rank by ascending sharpness per video, numbered per slice of (sharpness, frame)."""
    return ranked(frames.withColumn("sharp", F.round("sharp", 9)), ["video_id"], "sharp", ["frame_idx"], "rank")


def bucket_topk(frames: DataFrame, k: int) -> DataFrame:
    """Best frames per size bucket up to the bucket's quota."""
    quota = F.create_map(*[F.lit(v) for b, s in BUCKET_SHARE.items() for v in (b, max(1, int(k * s)))])
    rows = frames.withColumn("bucket", FR.size_bucket(F.col("max_target_h")))
    order = Window.partitionBy("video_id", "bucket").orderBy(F.round("composite", 9).desc(), "frame_idx")
    most = max(1, int(k * max(BUCKET_SHARE.values())))
    return (
        rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
        .filter(F.col("rank") <= F.element_at(quota, F.col("bucket")))
    )


#: Best remaining frames of a video that one round looks at.
ROUND_FRAMES = 256
_STATE = ["video_id", "tier"]


def _conflict(frame: Column, chosen: Column) -> Column:
    """Whether a frame is too near to a chosen one in time or, if both have a hash, in hash bits."""
    near = F.abs(frame["time_s"] - chosen["time_s"]) < chosen["spacing"]
    bits = sum((F.bit_count(frame[f"h{i}"].bitwiseXOR(chosen[f"h{i}"])) for i in range(1, 4)), F.bit_count(frame["h0"].bitwiseXOR(chosen["h0"])))
    alike = frame["hashed"] & chosen["hashed"] & (bits < chosen["hamming"])
    same = frame["frame_idx"] == chosen["frame_idx"]
    return same | F.coalesce(near, F.lit(False)) | F.coalesce(alike, F.lit(False))


def _choose(queue: Column, chosen: Column, k: int, quota: Column | None) -> Column:
    """Frames of ``queue`` taken in turn: room, no conflict, and room in the frame's bucket if ``quota`` is given."""

    def step(acc: Column, x: Column) -> Column:
        ok = (F.size(acc) < k) & ~F.exists(acc, lambda c: _conflict(x, c))
        if quota is not None:
            ok = ok & (F.size(F.filter(acc, lambda c: c["bucket"] == x["bucket"])) < F.element_at(quota, x["bucket"]))
        return F.when(ok, F.concat(acc, F.array(x))).otherwise(acc)

    return F.aggregate(queue, chosen, step)


def _greedy(frames: DataFrame, tiers: tuple, k: int, quotas: dict[str, int] | None = None, look: int = ROUND_FRAMES) -> DataFrame:
    """Frames chosen best score first, per video and tier of distances, in rounds over all videos.

    A round takes the ``look`` best frames of each video that conflict with no chosen
    one (every task keeps that many per video before the shuffle), and walks them in
    order. What it chooses is final: greedy choice meets the frames in this very order, and
    a conflict stays one. A video is done when ``k`` frames are chosen or its remaining
    frames were fewer than ``look``; each round chooses at least one frame, so ``k`` rounds
    are the most, and mostly one is enough. With quotas, a first pass of rounds
    fills the buckets and a second one takes any frames. No task holds a video; the
    state is ``k`` frames a video and tier. State and frames are tables of the shared
    folder, so a lost executor costs no earlier round.

    Returns video_id, tier and ``chosen``, an array of frames.
    """
    one_per_frame = frames.groupBy("video_id", "frame_idx").agg(
        F.max_by(
            F.struct(F.round("composite", 9).alias("composite"), "time_s", "phash", "max_target_h"), F.round("composite", 9)
        ).alias("f")
    ).select("video_id", "frame_idx", "f.*")
    rows = one_per_frame.select(
        "video_id", "frame_idx", "composite", "time_s", *[F.coalesce(F.get("phash", F.lit(i)), F.lit(0)).cast("bigint").alias(f"h{i}") for i in range(4)],
        F.coalesce(F.size("phash") == 4, F.lit(False)).alias("hashed"), FR.size_bucket(F.col("max_target_h")).alias("bucket"),
    )
    base = stored(rows, "frames")
    spark = base.sparkSession
    names = spark.createDataFrame([(i, int(ham), float(gap)) for i, (_, ham, gap) in enumerate(tiers)], "tier int, hamming int, spacing double")
    frame = F.struct(*[c for c in base.columns if c != "video_id"], "hamming", "spacing")
    order = Window.partitionBy(*_STATE).orderBy(F.col("composite").desc(), "frame_idx")
    quota = F.create_map(*[F.lit(v) for item in (quotas or {}).items() for v in item]) if quotas else None
    state = None
    for filling in ((True, False) if quotas else (False,)):
        open_state = None if state is None else state.filter(F.size("chosen") < k)
        for _ in range(k):
            offered = base.crossJoin(F.broadcast(names)) if state is None else base.join(open_state, "video_id").join(F.broadcast(names), "tier")
            offered = offered.withColumn("frame", frame)
            if state is not None:
                offered = offered.filter(~F.exists("chosen", lambda c: _conflict(F.col("frame"), c)))
                if filling:
                    taken = F.size(F.filter("chosen", lambda c: c["bucket"] == F.col("bucket")))
                    offered = offered.filter(taken < F.element_at(quota, F.col("bucket")))
            best = offered.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= look)
            queue = best.groupBy(*_STATE).agg(F.array_sort(F.collect_list(F.struct("rank", "frame"))).alias("q")).select(
                *_STATE, F.transform("q", lambda x: x["frame"]).alias("queue")
            )
            if state is None:
                queue = queue.withColumn("chosen", F.filter("queue", lambda x: F.lit(False)))
            else:
                queue = queue.join(state, _STATE, "right")
            walked = queue.select(
                *_STATE, F.coalesce(_choose(F.col("queue"), F.col("chosen"), k, quota if filling else None), "chosen").alias("chosen"),
                F.coalesce(F.size("queue") == look, F.lit(False)).alias("more"),
            )
            state = stored(walked, "chosen")
            open_state = state.filter((F.size("chosen") < k) & F.col("more")).drop("more")
            state = state.drop("more")
            if open_state.isEmpty():
                break
    return state


def diverse_topk(frames: DataFrame, k: int, look: int = ROUND_FRAMES) -> DataFrame:
    """Up to ``k`` frames per video, two seconds and ten hash bits apart: size quotas first, then any."""
    quotas = {b: max(1, int(k * s)) for b, s in BUCKET_SHARE.items()}
    chosen = _greedy(frames, (("", HAMMING, SPACING),), k, quotas, look)
    return chosen.select("video_id", F.explode("chosen.frame_idx").alias("frame_idx"))


def yield_guarantee(frames: DataFrame, k: int, min_out: int, look: int = ROUND_FRAMES) -> DataFrame:
    """Top ``k`` with distances relaxed tier by tier until ``min_out`` frames remain.

    All tiers are chosen side by side; the first that reaches ``min_out`` is told, else
    the last one under the name ``exhausted``.
    """
    chosen = _greedy(frames, TIERS, k, None, look)
    found = F.when(F.size("chosen") >= min_out, F.col("tier"))
    told = chosen.groupBy("video_id").agg(
        F.min_by("chosen", F.coalesce(found, len(TIERS) - F.col("tier") + F.lit(len(TIERS)))).alias("chosen"), F.min(found).alias("tier")
    )
    name = F.coalesce(F.get(F.array(*[F.lit(n) for n, *_ in TIERS]), F.col("tier")), F.lit("exhausted"))
    return told.select("video_id", F.explode("chosen.frame_idx").alias("frame_idx"), name.alias("tier"))


def temporal_dedup(points: DataFrame, keys: list[str], spacing: float = SPACING, chunk: float = 600.0) -> DataFrame:
    """Earliest-first times that keep ``spacing`` seconds from the last kept one.

    A chunk's outcome depends on earlier chunks only through the time it is entered
    at, and only rows of its first ``spacing`` seconds, or the first row after them,
    can be that entry. So each chunk is walked once per possible entry, the entries
    are chained in blocks of chunks, and each chunk is walked again from its real entry.
    A chunk is ``spacing`` wide at least.
    """
    chunk = max(chunk, spacing)
    part = [*keys, "chunk"]
    grouped = points.select(*keys, "t").distinct().groupBy(
        *keys, F.floor(F.col("t") / chunk).cast("bigint").alias("chunk")
    ).agg(F.array_sort(F.collect_list("t")).alias("ts"))
    never = F.lit(float("-1e18"))

    def leave(times: Column, entry: Column) -> Column:
        """Last kept time of a chunk entered at ``entry``."""
        rest = F.filter(times, lambda x: x > entry)
        return F.aggregate(rest, entry, lambda last, x: F.when(x - last >= spacing, x).otherwise(last))

    limit = F.col("chunk") * F.lit(float(chunk)) + spacing
    early = F.size(F.filter("ts", lambda x: x < limit))
    exits = F.transform(
        F.slice("ts", F.lit(1), early + 1), lambda e: F.struct(e.alias("entry"), leave(F.col("ts"), e).alias("leave"))
    )
    # a map: leave time per possible entry, and ``skip``, the leave time if its first chunk is not entered
    fit = lambda m, last: F.try_element_at(F.filter(m["exits"], lambda e: e["entry"] - last >= spacing), F.lit(1))
    apply = lambda m, last: F.coalesce(fit(m, last)["leave"], m["skip"], last)

    def compose(a: Column, b: Column) -> Column:
        # who skips a whole chunk is far enough from everything in the next one
        through = F.transform(a["exits"], lambda e: F.struct(e["entry"].alias("entry"), apply(b, e["leave"]).alias("leave")))
        return F.struct(through.alias("exits"), apply(b, F.coalesce(a["skip"], never)).alias("skip"))

    maps = grouped.select(*part, exits.alias("exits"), F.struct(exits.alias("exits"), F.lit(None).cast("double").alias("skip")).alias("m"))
    starts = chain_starts(maps.select(*part, "m"), keys, "chunk", never, compose, apply)
    entered = maps.join(starts, part).select(*part, fit(F.struct("exits"), F.col("start"))["entry"].alias("entry")).filter("entry IS NOT NULL")
    rest = F.filter("ts", lambda x: x > F.col("entry"))
    kept = F.aggregate(
        rest, F.array("entry"), lambda acc, x: F.when(x - F.element_at(acc, -1) >= spacing, F.concat(acc, F.array(x))).otherwise(acc)
    )
    return grouped.join(entered, part).select(*keys, F.explode(kept).alias("t"))
