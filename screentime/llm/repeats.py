"""Substring dedup: repeated word windows found by super-k-mer partitioning."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screentime.llm.common import Bitmap, WordHashes, arrow_map, batch, broadcast, ngram_hashes, row_key, table, texts

#: Windows a bucket task sorts at once, at least; whole buckets only.
SORT_WINDOWS = 100_000


def _leftmost_minimum(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Value and leftmost position of the minimum of every ``width`` consecutive values, by doubling."""
    low, at, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        a, b = low[:-step], low[step:]
        later = b < a
        low, at = np.where(later, b, a), np.where(later, at[step:], at[:-step])
        have += step
    return low, at


def _super_kmers(docs: list[list[bytes]], hashes: WordHashes, window: int, minimizer: int):
    """Runs of consecutive windows that share one occurrence of their minimiser.

    Returns (document, first word, windows, minimiser hash) arrays; a run never
    leaves its document.
    """
    lens = np.array([len(w) for w in docs], np.int64)
    ends = np.cumsum(lens)
    flat = hashes.of([w for words in docs for w in words])
    if len(flat) < window:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, np.uint64)
    low, at = _leftmost_minimum(ngram_hashes(flat, minimizer), window - minimizer + 1)
    doc = np.repeat(np.arange(len(docs)), lens)
    start = np.flatnonzero(np.arange(len(low)) + window <= np.repeat(ends, lens)[: len(low)])
    if not len(start):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, np.uint64)
    new = np.ones(len(start), bool)
    new[1:] = (at[start[1:]] != at[start[:-1]]) | (doc[start[1:]] != doc[start[:-1]])
    first = np.flatnonzero(new)
    head = start[first]
    runs = np.diff(np.append(first, len(start)))
    return doc[head], head - (ends - lens)[doc[head]], runs, low[head]


def repeated_windows(
    transcripts: DataFrame,
    id_col: str = "video_id",
    text_col: str = "ocr_text",
    window: int = 35,
    minimizer: int = 8,
    hot_share: int = 65_536,
    hot_least: int = 200,
) -> DataFrame:
    """Ranges of word windows of OCR transcripts that start at two or more places.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Consecutive windows whose smallest
    ``minimizer``-word hash is the same occurrence form a super-k-mer. Minimisers are
    counted first: windows of a minimiser met once cannot repeat, and a filter of
    fixed size (no false negatives) keeps those that can. Each remaining super-k-mer
    travels as one packed string to its minimiser's bucket, where sorting counts
    windows exactly.

    Copies inside one batch are settled there and sent once, with multiplicity two.
    Super-k-mers of a minimiser with more than ``1/hot_share`` of all occurrences (and
    at least ``hot_least``) are cut into windows dealt by their own hash, so that a
    passage common to a third of all rows never meets in one task. At most
    ``hot_share`` such minimisers exist, which bounds the broadcast.

    Returns (row, start, windows): ``row`` is :func:`row_key` of id and text; windows
    ``start .. start+windows-1`` repeat. Null or short texts have none; repeated rows
    repeat all their windows; an empty table gives an empty result.
    """
    spark = transcripts.sparkSession
    rows = transcripts.select(row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            values, n = np.unique(_super_kmers([t.split() for t in texts(b.column(0))], hashes, window, minimizer)[3], return_counts=True)
            yield batch(["minimizer", "n"], values.view(np.int64), n.astype(np.int64))
            hashes.trim()

    counts = arrow_map(rows.select("text"), count, "minimizer bigint, n bigint").groupBy("minimizer").agg(F.sum("n").alias("n"))
    repeated = table(counts.where("n > 1"), "minimizers")
    total = repeated.agg(F.sum("n")).first()[0] or 0
    hot = repeated.where(F.col("n") >= max(hot_least, total // hot_share)).select("minimizer").toArrow()
    known = broadcast(spark, (Bitmap.build(repeated, "minimizer", 26), np.sort(hot.column(0).to_numpy().view(np.uint64))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, hot = known.value
        hashes = WordHashes()
        for b in batches:
            ids = b.column(0).to_pylist()
            docs = [t.split() for t in texts(b.column(1))]
            doc, start, runs, low = _super_kmers(docs, hashes, window, minimizer)
            keep = np.flatnonzero(bitmap.has(low))
            spots = np.searchsorted(hot, low[keep])
            is_hot = (spots < len(hot)) & (hot[np.minimum(spots, len(hot) - 1)] == low[keep]) if len(hot) else np.zeros(len(keep), bool)
            met: dict[bytes, list] = {}
            for d, s, n, v, cut in zip(
                doc[keep].tolist(), start[keep].tolist(), runs[keep].tolist(), low[keep].view(np.int64).tolist(), is_hot.tolist()
            ):
                for first, many in ((s + k, 1) for k in range(n)) if cut else ((s, n),):
                    packed = b" ".join(docs[d][first : first + many + window - 1])
                    met.setdefault(packed, [v, cut, many]).append((d, first))
            out: list[tuple] = []
            for packed, (v, cut, many, *places) in met.items():
                key = xxhash.xxh3_64_intdigest(packed) - (1 << 63) if cut else v
                if len(places) == 1:
                    out.append((key, packed, 1, ids[places[0][0]], places[0][1], many))
                else:
                    out.append((key, packed, 2, None, 0, many))
                    out.extend((ids[d] ^ s, None, 2, ids[d], s, many) for d, s in places)
            names = ["key", "packed", "times", "row", "start", "windows"]
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
            yield batch(names, *(pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)))
            hashes.trim()

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        sorted_windows: list[tuple[bytes, int, int]] = []
        flags: list[np.ndarray] = []
        for i, (packed, _, _, _, many) in enumerate(rows):
            flags.append(np.full(many, packed is None))
            if packed is not None:
                cuts = np.flatnonzero(np.frombuffer(packed, np.uint8) == 32).tolist()
                left, right = [0, *(c + 1 for c in cuts)], [*cuts, len(packed)]
                sorted_windows.extend((packed[left[k] : right[k + window - 1]], i, k) for k in range(many))
        sorted_windows.sort()
        begin = 0
        while begin < len(sorted_windows):
            end = begin + 1
            while end < len(sorted_windows) and sorted_windows[end][0] == sorted_windows[begin][0]:
                end += 1
            if end - begin > 1 or rows[sorted_windows[begin][1]][1] > 1:
                for _, i, k in sorted_windows[begin:end]:
                    flags[i][k] = True
            begin = end
        out: list[tuple[int, int, int]] = []
        for (_, _, row, start, _), flag in zip(rows, flags):
            if row is None or not flag.any():
                continue
            edges = np.flatnonzero(np.diff(np.concatenate(([0], flag.astype(np.int8), [0]))))
            out.extend((row, start + a, z - a) for a, z in zip(edges[::2].tolist(), edges[1::2].tolist()))
        return batch(
            ["row", "start", "windows"],
            pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32()),
        )

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, windows, last = [], 0, None
        for b in batches:
            for key, *row in zip(*(b.column(i).to_pylist() for i in range(6))):
                if windows >= SORT_WINDOWS and key != last:
                    yield settle(held)
                    held, windows = [], 0
                held.append(tuple(row))
                windows, last = windows + row[4], key
        if held:
            yield settle(held)

    packed = arrow_map(rows, pack, "key bigint, packed binary, times int, row bigint, start int, windows int")
    dealt = packed.repartition("key").sortWithinPartitions("key")
    return arrow_map(dealt, bucket, "row bigint, start int, windows int")


def remove_repeated_passages(
    transcripts: DataFrame, id_col: str = "video_id", text_col: str = "ocr_text", window: int = 35, **options
) -> DataFrame:
    """Transcripts without the words that lie in a window repeated anywhere in the table.

    All places of a repeated window lose it, its first one too; windows are judged on
    the input. Returns id_col, n_words, n_removed, kept_text (kept words joined by one
    space) and kept_sha256. Null texts have no words and an empty kept_text.
    """
    ranges = (
        repeated_windows(transcripts, id_col, text_col, window, **options)
        .groupBy("row")
        .agg(F.collect_list(F.struct("start", "windows")).alias("ranges"))
    )
    rows = transcripts.select(row_key(id_col, text_col).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for text, ranges in zip(texts(b.column("text")), b.column("ranges").to_pylist()):
                words = text.split()
                gone = np.zeros(len(words) + 1, np.int64)
                for r in ranges or ():
                    gone[r["start"]] += 1
                    gone[r["start"] + r["windows"] + window - 1] -= 1
                alive = np.cumsum(gone)[: len(words)] == 0
                kept.append(b" ".join(words[i] for i in np.flatnonzero(alive)) if ranges else b" ".join(words))
                n_words.append(len(words))
                n_removed.append(len(words) - int(alive.sum()))
            yield batch(
                ["id", "n_words", "n_removed", "kept_text", "kept_sha256"],
                b.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                pa.array(kept, pa.binary()).cast(pa.string()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            )

    joined = rows.join(ranges, "row", "left").select("id", "text", "ranges")
    out = arrow_map(joined, cut, f"id {kind}, n_words bigint, n_removed bigint, kept_text string, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)
