"""Benchmark decontamination by suffix arrays over shards of the transcripts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from screentime.llm.common import arrow_map, batch, broadcast, carried, row_key, schema_of, table, texts

#: Lower-cases A-Z and blanks every ASCII character that is not a letter or digit; other bytes belong to words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def contamination_words(text: bytes) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    return text.translate(_FOLD).split()


#: An item longer than this is cut into pieces that overlap by a window less one word.
PIECE_WORDS = 100_000


class Queries:
    """The test suffixes of a block of benchmark pieces, folded and ready for binary search.

    Equal pieces are one text and equal windows one query, whatever number of items holds
    them. Texts are also kept as sequences of window numbers, ordered to the full depth,
    so that a place in a shard finds the longest passage of any text that starts there.
    """

    def __init__(self, pieces: list[tuple[str, int, bytes]], width: int):
        self.width, self.numbers, self.owners = width, {}, []
        known: dict[bytes, int] = {}
        lens, flat = [], []
        for item, base, text in pieces:
            words = text.split()
            if not words:
                continue
            at = known.setdefault(text, len(known))
            if at == len(self.owners):
                self.owners.append({})
                lens.append(len(words))
                flat += [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]
                flat.append(0)
            self.owners[at][item] = min(base, self.owners[at].get(item, base))
        self.witness = [min(held.items()) for held in self.owners]
        self.lens = np.array(lens, np.int64)
        self.begins = np.cumsum(self.lens + 1) - self.lens - 1
        need = np.minimum(self.lens, width)
        many = self.lens - need + 1
        text = np.repeat(np.arange(len(lens)), many)
        starts = self.begins[text] + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        words = np.array(flat + [0] * width, np.uint32)
        inside = np.arange(width) < need[text][:, None]
        grid = np.where(inside, words[starts[:, None] + np.arange(width)], 0).astype(np.uint32)
        self.low, first, window = np.unique(as_keys(grid), return_index=True, return_inverse=True)
        self.need = need[text][first]
        self.high = as_keys(np.where(inside[first], grid[first], 0xFFFFFFFF))
        self._sets(window, text)
        # a suffix can only match where its first one or two words do
        grid = grid[first].astype(np.int64)
        self.single = np.zeros(len(self.numbers) + 1, bool)
        self.single[grid[self.need == 1, 0]] = True
        pairs = grid[self.need > 1, :2] if width > 1 else np.zeros((0, 2), np.int64)
        self.pairs = np.unique(pairs[:, 0] * (len(self.numbers) + 1) + pairs[:, 1])
        full = need[text] == width
        self._order(starts[full], window[full] + 1, len(flat) + 1)

    def _sets(self, window: np.ndarray, text: np.ndarray) -> None:
        """The texts that hold a window, each set of texts once: a number below ``len(owners)`` is that text alone."""
        held = np.unique(window * np.int64(len(self.owners)) + text) if len(window) else np.zeros(0, np.int64)
        held_by = held % max(1, len(self.owners))
        begin = np.searchsorted(held // max(1, len(self.owners)), np.arange(len(self.low) + 1))
        self.set_of, self.sets, numbers = held_by[begin[:-1]], [], {}
        for at in np.flatnonzero(np.diff(begin) > 1).tolist():
            members = held_by[begin[at] : begin[at + 1]]
            number = numbers.setdefault(members.tobytes(), len(self.sets))
            if number == len(self.sets):
                self.sets.append(members)
            self.set_of[at] = len(self.owners) + number

    def _order(self, starts: np.ndarray, window: np.ndarray, size: int) -> None:
        """Numbers of runs of 1, 2, 4, ... windows, and the places of all windows in suffix order."""
        base = np.zeros(size, np.int64)
        base[starts] = window
        self.runs, self.codes, step = [base], [], 1
        while True:
            now, then = self.runs[-1], ahead(self.runs[-1], step)
            both = (now > 0) & (then > 0)
            if not both.any():
                break
            code, number = np.unique(now[both] * (now.max() + 1) + then[both], return_inverse=True)
            self.codes.append((code, int(now.max()) + 1))
            self.runs.append(np.zeros(size, np.int64))
            self.runs[-1][both] = number + 1
            step *= 2
        rank, step, longest = base, 1, int(self.lens.max(initial=0))
        while step <= longest:
            rank = np.unique(rank * (rank.max() + 1) + ahead(rank, step), return_inverse=True)[1]
            step *= 2
        order = np.argsort(rank, kind="stable")
        self.order = order[base[order] > 0]

    def items_of(self, sets: list[int]) -> list[str]:
        """Sorted ids of the items in any of the sets."""
        alone = len(self.owners)
        return sorted({i for s in sets for t in ([s] if s < alone else self.sets[s - alone].tolist()) for i in self.owners[t]})

    def longest(self, seen: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(windows, place in the texts) of the longest passage that starts at each place of a sequence of windows."""
        runs, step = [seen], 1
        for code, base in self.codes:
            now, then = runs[-1], ahead(runs[-1], step)
            at = np.flatnonzero((now > 0) & (then > 0))
            key = now[at] * base + then[at]
            spot = np.minimum(np.searchsorted(code, key), len(code) - 1)
            same = code[spot] == key
            if not same.any():
                break
            runs.append(np.zeros_like(seen))
            runs[-1][at[same]] = spot[same] + 1
            step *= 2

        def shared(text: np.ndarray) -> np.ndarray:
            far = np.zeros(len(places), np.int64)
            for k in range(len(runs) - 1, -1, -1):
                run = runs[k][np.minimum(places + far, len(seen) - 1)]
                far += np.where((run > 0) & (run == self.runs[k][np.minimum(text + far, len(base) - 1)]), 1 << k, 0)
            return far

        base, low, high = self.runs[0], np.zeros(len(places), np.int64), np.full(len(places), len(self.order))
        while (low < high).any():
            middle = np.minimum((low + high) // 2, len(self.order) - 1)
            text = self.order[middle]
            far = shared(text)
            less = base[np.minimum(text + far, len(base) - 1)] < seen[np.minimum(places + far, len(seen) - 1)]
            low, high = np.where((low < high) & less, middle + 1, low), np.where((low < high) & ~less, middle, high)
        before, after = self.order[np.maximum(low - 1, 0)], self.order[np.minimum(low, len(self.order) - 1)]
        near, next_ = shared(before), shared(after)
        return np.maximum(near, next_), np.where(near >= next_, before, after)


def ahead(values: np.ndarray, step: int) -> np.ndarray:
    """Each place's value ``step`` places further on, 0 behind the end."""
    out = np.zeros_like(values)
    out[: max(0, len(values) - step)] = values[step:]
    return out


def as_keys(grid: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that compare like the rows."""
    width = grid.shape[1]
    return np.ascontiguousarray(grid.astype(">u4")).view(f"S{4 * width}").reshape(len(grid))


Match = tuple[str, int, int, int]


def search_shard(docs: list[list[bytes]], q: Queries) -> tuple[list[list[Match]], list[list[str]]]:
    """Longest matches (item, item_start, start, length) and all item ids of each document of one shard.

    The shard's suffixes that begin like a test suffix are sorted into a suffix array
    (compared to the depth of a window), and every distinct test suffix is
    binary-searched in it. A place keeps one full window and the longest short item at
    most, so what is held grows with the words of the shard, not with places times items.
    """
    lens = np.array([len(d) for d in docs], np.int64)
    found: list[list[Match]] = [[] for _ in docs]
    items: list[list[str]] = [[] for _ in docs]
    if not len(q.low) or not lens.sum():
        return found, items
    ends = np.cumsum(lens + 1)  # one stop, number 0, behind each document
    get = q.numbers.get
    flat = np.zeros(int(ends[-1]) + q.width, np.int64)
    for words, end in zip(docs, ends.tolist()):
        flat[end - 1 - len(words) : end - 1] = [get(w, 0) for w in words]
    now, then = flat[: ends[-1]], flat[1 : ends[-1] + 1]
    code = now * len(q.single) + then
    maybe = np.flatnonzero((now > 0) & (then > 0))
    spots = np.searchsorted(q.pairs, code[maybe])
    maybe = maybe[(spots < len(q.pairs)) & (q.pairs[np.minimum(spots, len(q.pairs) - 1)] == code[maybe])] if len(q.pairs) else maybe[:0]
    starts = np.union1d(maybe, np.flatnonzero(q.single[now]))
    if not len(starts):
        return found, items
    doc = np.searchsorted(ends, starts, side="right")
    grid = flat[starts[:, None] + np.arange(q.width)]
    grid[starts[:, None] + np.arange(q.width) >= ends[doc][:, None]] = 0
    keys = as_keys(grid)
    suffix_array = np.argsort(keys, kind="stable")
    ordered = keys[suffix_array]
    low, high = np.searchsorted(ordered, q.low, "left"), np.searchsorted(ordered, q.high, "right")
    many = np.maximum(high - low, 0)
    query = np.repeat(np.arange(len(low)), many)
    if not len(query):
        return found, items
    place = suffix_array[np.repeat(low, many) + np.arange(len(query)) - np.repeat(np.cumsum(many) - many, many)]
    for d, number in zip(*np.divmod(np.unique(doc[place] * (len(q.owners) + len(q.sets)) + q.set_of[query]), len(q.owners) + len(q.sets))):
        items[d].append(int(number))
    items = [q.items_of(sets) if sets else [] for sets in items]

    # the longest match from each place: a passage of full windows, or else the longest short item
    full = q.need[query] == q.width
    length, text, at = (np.zeros(len(starts), np.int64) for _ in range(3))
    short = np.flatnonzero(~full)
    short = short[np.argsort(q.need[query[short]], kind="stable")]
    length[place[short]], text[place[short]] = q.need[query[short]], q.set_of[query[short]]
    if full.any() and len(q.order):
        seen = np.zeros(int(ends[-1]) + 1, np.int64)
        seen[starts[place[full]]] = query[full] + 1
        spots = np.unique(place[full])
        windows, where = q.longest(seen, starts[spots])
        length[spots] = windows + q.width - 1
        text[spots] = np.searchsorted(q.begins, where, side="right") - 1
        at[spots] = where - q.begins[text[spots]]
    stop = starts + length
    fresh = np.concatenate([[0], np.maximum.accumulate(stop)[:-1]]) < stop
    kept = np.flatnonzero((length > 0) & fresh)
    begin = starts[kept] - (ends - lens - 1)[doc[kept]]
    for d, t, a, s, n in zip(*(x.tolist() for x in (doc[kept], text[kept], at[kept], begin, length[kept]))):
        item, base = q.witness[t]
        found[d].append((item, base + a, s, n))
    return found, items


def blocks_of(items: DataFrame, window: int, block_words: int) -> Iterator[list[tuple[str, int, bytes]]]:
    """Pieces (item, item_start, folded text) of the benchmark, ``block_words + PIECE_WORDS`` words a block at most."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            item, base, piece = [], [], []
            for name, text in zip(b.column("item").to_pylist(), texts(b.column("text"))):
                words = contamination_words(text)
                for at in range(0, max(1, len(words) - window + 1), PIECE_WORDS) if words else ():
                    item.append(name)
                    base.append(at)
                    piece.append(b" ".join(words[at : at + PIECE_WORDS + window - 1]))
            yield batch(["item", "base", "piece"], pa.array(item, pa.string()), pa.array(base, pa.int64()), pa.array(piece, pa.binary()))

    block, size = [], 0
    for r in arrow_map(items, cut, "item string, base bigint, piece binary").toLocalIterator():
        block.append((r["item"], r["base"], bytes(r["piece"])))
        size += block[-1][2].count(b" ") + 1
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def benchmark_matches(
    transcripts: DataFrame,
    benchmark: DataFrame,
    id_col: str = "video_id",
    text_col: str = "ocr_text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    block_words: int = 1_000_000,
    carry_cols: tuple[str, ...] = (),
) -> DataFrame:
    """Longest verbatim matches between OCR transcripts and benchmark items.

    Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters. Test
    suffixes are searched in suffix arrays of shards of the transcripts. The benchmark
    is read in blocks of ``block_words`` words, which bounds what is broadcast; each
    block passes over all transcripts. With several blocks, all but the first run when
    this is called, one after the other, and their hits are written; at most two blocks
    exist at a time. A match has ``window`` words at least, or all words of a shorter item.

    Returns id_col, n_words, n_hit (words inside a match), n_items, items_sha256
    (item ids sorted as strings, comma-joined), items (these ids), matches (item_id,
    item_start, start, length) and ``carry_cols`` unchanged. A match is the longest that
    starts at its word and ends behind those before it; of the items that hold it, one is
    named. Passages of more than ``PIECE_WORDS`` words may be told in overlapping parts, and
    blocks tell theirs separately. Null texts have no words; items without words or id match
    nothing; repeated rows each get their row; without benchmark items every row is clean.
    """
    spark = transcripts.sparkSession
    listed = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where(
        "item IS NOT NULL AND text IS NOT NULL"
    )
    rows = transcripts.select(row_key(id_col, text_col).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), carried(carry_cols))
    match = "array<struct<item_id:string,item_start:bigint,start:bigint,length:bigint>>"
    match_type = pa.list_(
        pa.struct([("item_id", pa.string()), ("item_start", pa.int64()), ("start", pa.int64()), ("length", pa.int64())])
    )
    hits = f"matches {match}, items array<string>"
    head = schema_of(rows, ("key", "id", "carry"), f"n_words bigint, {hits}")
    whole = StructType(head.fields + StructType.fromDDL("n_hit bigint, n_items bigint, items_sha256 string").fields)

    def measures(found: list, items: list[list[str]]) -> tuple[list[str], list[pa.Array]]:
        n_hit = []
        for matches in found:
            reach = hit = 0
            for s, e in sorted((m["start"], m["start"] + m["length"]) for m in matches):
                hit += max(0, e - max(s, reach))
                reach = max(reach, e)
            n_hit.append(hit)
        digest = [hashlib.sha256(",".join(names).encode()).hexdigest() for names in items]
        values = pa.array(n_hit, pa.int64()), pa.array([len(names) for names in items], pa.int64()), pa.array(digest, pa.string())
        return ["n_hit", "n_items", "items_sha256"], list(values)

    def search(shared, alone: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = shared.value
            for b in batches:
                docs = [contamination_words(t) for t in texts(b.column("text"))]
                found, items = search_shard(docs, q)
                out = [[dict(zip(("item_id", "item_start", "start", "length"), m)) for m in ms] for ms in found]
                names, more = measures(out, items) if alone else ([], [])
                n_words = pa.array([len(d) for d in docs], pa.int64())
                same = [b.column(n) for n in ("key", "id", "carry")]
                listed = pa.array(items, pa.list_(pa.string()))
                yield batch(["key", "id", "carry", "n_words", "matches", "items", *names], *same, n_words, pa.array(out, match_type), listed, *more)

        return arrow_map(rows, run, whole if alone else head)

    blocks = blocks_of(listed, window, block_words)
    first = broadcast(spark, Queries(next(blocks, []), window))
    others = []
    for block in blocks:
        shared = broadcast(spark, Queries(block, window))
        # repeated rows find the same matches: one of them speaks for the key
        found = search(shared, False).where("size(matches) > 0").select("key", "matches", "items")
        others.append(table(found, "benchmark-hits").dropDuplicates(["key"]))
        shared.destroy()
    out = search(first, not others)
    if others:
        merged = others[0]
        for part in others[1:]:
            merged = merged.unionByName(part)
        merged = merged.groupBy("key").agg(
            F.flatten(F.collect_list("matches")).alias("more"), F.flatten(F.collect_list("items")).alias("more_items")
        )
        joined = out.join(merged, "key", "left").select(
            "key", "id", "carry", "n_words",
            F.concat("matches", F.coalesce("more", F.expr(f"CAST(array() AS {match})"))).alias("matches"),
            F.array_distinct(F.concat("items", F.coalesce("more_items", F.expr("CAST(array() AS array<string>)")))).alias("items"),
        )

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                items = [sorted(i) for i in b.column("items").to_pylist()]
                names, more = measures(b.column("matches").to_pylist(), items)
                same = [b.column(n) for n in ("key", "id", "carry", "n_words", "matches")]
                yield batch([*whole.names[:6], *names], *same, pa.array(items, pa.list_(pa.string())), *more)

        out = arrow_map(joined, measure, whole)
    columns = ["n_words", "n_hit", "n_items", "items_sha256", "items", "matches"]
    return out.select(F.col("id").alias(id_col), *(F.col(f"carry.`{c}`") for c in carry_cols), *columns)


def is_contaminated():
    """Any hit, and hits on at least a twentieth of the words."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
