"""Periodic runs: Lyndon arrays by Baier's grouping, their roots extended to maximal runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screentime.llm.common import WordHashes, arrow_map, batch, mix, ngram_hashes, texts

#: Words whose stretches are worked on together; one longer stretch is worked on alone.
CHUNK_WORDS = 200_000


def lyndon_lengths(symbols: np.ndarray, stretches: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word starting at every place, for stretches that lie end to end.

    Phase one of Baier's suffix sorter: places are grouped by their symbol; groups are
    taken from the highest down. Each member is final then: its Lyndon word is the word
    of its group. It is appended to the place before it that is not yet settled, and places
    of a group that got the same number of words split off into a new group right above
    their old one. ``stretches`` holds the first place of each stretch; no word leaves one.
    Linear time after the first sort.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    names, group = np.unique(symbols, return_inverse=True)
    cuts = np.searchsorted(symbols[order], names)
    members: list[list[int]] = [[]] + [part.tolist() for part in np.split(order, cuts[1:])]
    count = len(names)
    # ring of groups, 0 is the end; words of group g have width[g] symbols
    lower, upper, width = [count, *range(count)], [1, *range(2, count + 1), 0], [1] * (count + 1)
    group = (group + 1).tolist()
    before, after = np.arange(-1, n), np.arange(1, n + 2)
    before[stretches] = -1
    after[np.append(stretches[1:], n) - 1] = n
    before, after = before.tolist(), after.tolist()
    length = [0] * n
    top = count
    while top:
        size = width[top]
        grown: dict[int, int] = {}
        for i in members[top]:
            if group[i] == top:
                length[i] = size
                p, q = before[i], after[i]
                after[p], before[q] = q, p
                if p >= 0:
                    grown[p] = grown.get(p, 0) + 1
        members[top] = []
        split: dict[tuple[int, int], list[int]] = {}
        for p, times in grown.items():
            split.setdefault((times, group[p]), []).append(p)
        for times, old in sorted(split, reverse=True) if len(split) > 1 else split:
            new, above = len(width), upper[old]
            moved = split[times, old]
            width.append(width[old] + times * size)
            members.append(moved)
            lower.append(old)
            upper.append(above)
            lower[above] = upper[old] = new
            for p in moved:
                group[p] = new
        top = lower[top]
    return np.array(length, np.int64)


class CommonExtensions:
    """Exact longest common extensions: names of all blocks of 1, 2, 4, ... symbols.

    Equal blocks have equal names; a block that would leave its stretch has a name of its own.
    """

    def __init__(self, symbols: np.ndarray, stretches: np.ndarray):
        n = len(symbols)
        ends = np.append(stretches[1:], n)
        room = np.repeat(ends, ends - stretches) - np.arange(n)
        self.levels = [np.unique(symbols, return_inverse=True)[1].astype(np.int32)]
        size = 1
        while 2 * size <= room.max(initial=0):
            have, last = np.flatnonzero(room >= 2 * size), self.levels[-1]
            pairs = last[have].astype(np.int64) << 32 | last[have + size]
            found, name = np.unique(pairs, return_inverse=True)
            if len(found) == len(pairs):
                break
            level = -1 - np.arange(n, dtype=np.int32)
            level[have] = name
            self.levels.append(level)
            size *= 2

    def _walk(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
        done = np.zeros(len(a), np.int64)
        # the largest level may match several times, each level below at most once more
        for k in range(len(self.levels) - 1, -1, -1):
            size, names = 1 << k, self.levels[k]
            active = np.arange(len(a))
            while len(active):
                active = active[done[active] + size <= limit[active]]
                shift = done[active] if step > 0 else -done[active] - size
                active = active[names[a[active] + shift] == names[b[active] + shift]]
                done[active] += size
                if k < len(self.levels) - 1:
                    break
        return done

    def forward(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Equal symbols from ``a`` and ``b`` on, ``limit`` at most."""
        return self._walk(a, b, limit, 1)

    def backward(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Equal symbols right before ``a`` and ``b``, ``limit`` at most."""
        return self._walk(a, b, limit, -1)


def runs_of(symbols: np.ndarray, stretches: np.ndarray, min_length: int) -> np.ndarray:
    """Rows (start, length, period) of the runs of at least ``min_length`` symbols, sorted.

    Every run holds a Lyndon word of its period's length that is the longest one at its
    start under the order of symbols or under the reverse order; so the words of both
    Lyndon arrays, extended to both sides as far as the period goes, give all runs.
    """
    n = len(symbols)
    if not n:
        return np.zeros((0, 3), np.int64)
    ends = np.append(stretches[1:], n)
    begin, end = np.repeat(stretches, ends - stretches), np.repeat(ends, ends - stretches)
    at = np.tile(np.arange(n), 2)
    period = np.concatenate((lyndon_lengths(symbols, stretches), lyndon_lengths(symbols.max() - symbols, stretches)))
    fits = at + period < end[at]
    at, period = at[fits], period[fits]
    # a root that continues on neither side is no run
    goes_on = symbols[at] == symbols[at + period]
    goes_on |= (at > begin[at]) & (symbols[at - 1] == symbols[at + period - 1])
    at, period = at[goes_on], period[goes_on]
    common = CommonExtensions(symbols, stretches)
    right = common.forward(at, at + period, end[at] - at - period)
    left = common.backward(at, at + period, at - begin[at])
    length = left + period + right
    kept = length >= np.maximum(min_length, 2 * period)
    return np.unique(np.column_stack((at - left, length, period))[kept], axis=0)


def repeated_stretches(flat: np.ndarray, lens: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches covered by ``width``-word windows that stand twice in one text.

    A run of period q and length n >= max(2 * width, 2 * q) matches itself q words on for
    n - q >= width words; those windows stand twice and cover all of it, so every
    run lies inside one stretch. Equal hashes of different windows only add stretches.
    """
    ends = np.cumsum(lens)
    keys = ngram_hashes(flat, width)
    doc = np.repeat(np.arange(len(lens)), lens)
    starts = np.flatnonzero(np.arange(len(keys)) + width <= ends[doc[: len(keys)]])
    keys = mix(keys[starts] + mix(doc[starts].astype(np.uint64)))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    depth = np.zeros(len(flat) + 1, np.int64)
    np.add.at(depth, starts[twice], 1)
    np.add.at(depth, starts[twice] + width, -1)
    covered = np.cumsum(depth)[:-1] > 0
    head, tail = covered.copy(), covered.copy()
    # stretches of neighbouring texts stay apart
    limits = ends[(ends > 0) & (ends < len(flat))]
    head[1:] &= ~covered[:-1]
    head[limits] = covered[limits]
    tail[:-1] &= ~covered[1:]
    tail[limits - 1] = covered[limits - 1]
    return np.flatnonzero(head), np.flatnonzero(tail) + 1


def all_runs(docs: list[list[bytes]], hashes: WordHashes, min_length: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of each text: (start, length, period) rows in text coordinates, and the text of each."""
    lens = np.array([len(words) for words in docs], np.int64)
    heads = np.cumsum(lens) - lens
    flat = hashes.of([w for words in docs for w in words])
    begins, ends = repeated_stretches(flat, lens, (min_length + 1) // 2)
    doc = np.searchsorted(heads, begins, "right") - 1
    found, owners = [], []
    at = 0
    while at < len(begins):
        to = max(at + 1, at + int(np.searchsorted(np.cumsum(ends[at:] - begins[at:]), CHUNK_WORDS, "right")))
        ids: dict[bytes, int] = {}
        symbols = np.array(
            [ids.setdefault(w, len(ids)) for d, b, e in zip(doc[at:to], begins[at:to], ends[at:to]) for w in docs[d][b - heads[d] : e - heads[d]]], np.int64
        )
        sizes = ends[at:to] - begins[at:to]
        places = np.cumsum(sizes) - sizes
        runs = runs_of(symbols, places, min_length)
        own = np.searchsorted(places, runs[:, 0], "right") - 1
        runs[:, 0] += (begins[at:to] - heads[doc[at:to]] - places)[own]
        found.append(runs)
        owners.append(doc[at:to][own])
        at = to
    if not found:
        return np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
    runs, owner = np.concatenate(found), np.concatenate(owners)
    order = np.lexsort((runs[:, 2], runs[:, 0], owner))
    return runs[order], owner[order]


def find_periodic_runs(transcripts: DataFrame, id_col: str = "video_id", text_col: str = "ocr_text", min_length: int = 12) -> DataFrame:
    """Stretches of OCR transcripts that go round in circles: a board read over and over.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a stretch of at least
    ``max(min_length, 2 * period)`` words (``min_length`` from 2 on) with smallest period
    ``period`` that no neighbouring word extends. Stretches of a text that hold repeated
    windows are cut out (no run reaches outside, see :func:`repeated_stretches`); there,
    Lyndon arrays under both orders of the words come from phase one of Baier's suffix
    sorter, and their roots are extended by exact longest common extensions. A text is
    handled in one task in time linear in its words, but for sorting; texts do not meet.

    Returns id_col, n_words, runs (array of start, length, period by start, then period)
    and collapsed_text: the words that no run contains after its first ``period``
    words, joined by one space. Null and empty texts have no words, no runs and an empty
    collapsed_text; repeated rows and null ids stay; an empty table gives an empty
    result; other columns are ignored.
    """
    if min_length < 2:
        raise ValueError("min_length is 2 at least")
    rows = transcripts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            docs = [t.split() for t in texts(b.column(1))]
            runs, owner = all_runs(docs, hashes, min_length)
            edges = np.searchsorted(owner, np.arange(len(docs) + 1))
            kept = []
            for words, low, high in zip(docs, edges[:-1].tolist(), edges[1:].tolist()):
                if low < high:
                    start, length, period = runs[low:high].T
                    gone = np.zeros(len(words) + 1, np.int64)
                    np.add.at(gone, start + period, 1)
                    np.add.at(gone, start + length, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0)]
                kept.append(b" ".join(words))
            told = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in range(3)], ["start", "length", "period"])
            yield batch(
                ["id", "n_words", "runs", "collapsed_text"], b.column(0), pa.array([len(d) for d in docs], pa.int64()),
                pa.ListArray.from_arrays(pa.array(edges, pa.int32()), told), pa.array(kept, pa.binary()).cast(pa.string()),
            )
            hashes.trim()

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed_text string"
    return arrow_map(rows, find, schema).withColumnRenamed("id", id_col)
