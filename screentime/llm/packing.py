"""Sequence packing: length combinations weighted by non-negative least squares."""

from __future__ import annotations

import string
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screentime.llm.common import arrow_map, batch, broadcast, row_key, table

#: Rows that are numbered together, about, and the fewest groups of them.
GROUP_ROWS, LEAST_GROUPS = 50_000, 64


#: The tokenizer's sign for each byte: printable ones stand for themselves, others follow from 256 on.
_BYTE_SIGNS = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}

#: ASCII signs that cannot start a contraction or a special token.
_SIGNS = "".join(c for c in string.punctuation if c not in "'<|")


class WordTokens(dict):
    """White-space separated chunk to its ids as little-endian bytes, remembered.

    The tokenizer drops white space and never joins across it, so a text's ids are
    those of its chunks in order. It also lower-cases, and splits letters from other
    characters, so ``The,`` has the ids of ``the`` and of ``,``.
    """

    #: Chunks a worker keeps newest, over all tasks it runs; as many before them are asked for what they hold.
    LIMIT = 400_000
    _held: dict[str, WordTokens] = {}

    @classmethod
    def of(cls, path: str) -> WordTokens:
        """The worker's own memory for this tokenizer file."""
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # chunks are remembered here, not once more by the model
        self.model._resize_cache(0)
        self.before: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        value = self.before.get(chunk)
        self[chunk] = value = self._bytes(chunk) if value is None else value
        return value

    def _bytes(self, chunk: str) -> bytes:
        letters = chunk.rstrip(_SIGNS)
        if not letters.isalpha():
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        elif len(letters) < len(chunk) and letters[-1] < "\u0250" and letters[-1] != "\u0130":
            # the tokenizer leaves no mark behind these letters that would join the signs
            return self[letters] + self[chunk[len(letters) :]]
        elif (ascii_only := chunk.isascii()) or (letters == chunk and max(chunk) < "\u0250"):
            # no character below U+0300 is changed by composition
            low = chunk.lower()
            if low != chunk:
                return self[low]
            # letters are one piece: the model alone gives the same ids, faster
            piece = chunk if ascii_only else chunk.encode().decode("latin-1").translate(_BYTE_SIGNS)
            ids = [t.id for t in self.model.tokenize(piece)]
        else:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str, end_id: int) -> bytes:
        if len(self) > self.LIMIT:
            self.before = dict(self)
            self.clear()
        chunks = text.replace("\n", " ").split(" ")
        return b"".join(map(self.__getitem__, chunks)) + np.array([end_id], "<u4").tobytes()


@dataclass
class Plan:
    """Where the pieces of each length go: intervals of their numbers, and the greedy rest."""

    window: int
    #: per interval: length, first number, pieces a sequence takes, first sequence, first offset
    length: np.ndarray
    first: np.ndarray
    copies: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    #: per length: pieces placed by combinations, and tokens of the rest before it
    placed: np.ndarray
    rest_start: np.ndarray
    rest_sequence: int

    def place(self, lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, offset, in the rest) of each piece."""
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        rest = numbers >= self.placed[lengths]
        at = self.rest_start[lengths[rest]] + (numbers[rest] - self.placed[lengths[rest]]) * lengths[rest]
        sequence[rest], offset[rest] = self.rest_sequence + at // self.window, at % self.window
        if not rest.all():
            n, k = lengths[~rest], numbers[~rest]
            order = self.length.astype(np.int64) << 40 | self.first
            i = np.searchsorted(order, n.astype(np.int64) << 40 | k, side="right") - 1
            step = k - self.first[i]
            sequence[~rest] = self.sequence[i] + step // self.copies[i]
            offset[~rest] = self.offset[i] + step % self.copies[i] * n
        return sequence, offset, rest


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Shallow combinations (a, i, b, j) that fill the window exactly: i pieces of a and j of b.

    j is at most 2; a is repeated as often as it fits, or once less. More choices would
    spread the counts so thinly that rounding loses them.
    """
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    out = set()
    for a in lengths.tolist():
        most = window // a
        for i in {most, most - 1}:
            if not 0 < i <= most:
                continue
            left = window - a * i
            if left == 0:
                out.add((a, i, 0, 0))
            for j in (1,) if i == most else (1, 2):
                if left > 0 and left % j == 0 and have[left // j]:
                    out.add((a, i, left // j, j))
    return np.array(sorted(out), np.int64).reshape(-1, 4)


def solve_counts(patterns: np.ndarray, histogram: np.ndarray, sweeps: int = 12) -> np.ndarray:
    """Non-negative least squares of combination counts against the histogram, by coordinate descent.

    Each step sets one count to its best value given the others, or to zero. Few counts
    end up large instead of many small, which is what rounding needs.
    """
    left = histogram.astype(np.float64).tolist()
    rows = patterns.tolist()
    order = sorted(range(len(rows)), key=lambda k: (-max(rows[k][0], rows[k][2]), k))
    x = [0.0] * len(rows)
    for _ in range(sweeps):
        for k in order:
            a, i, b, j = rows[k]
            if a == b:
                i, j = i + j, 0
            gain = i * left[a] + (j * left[b] if j else 0.0)
            new = max(0.0, x[k] + gain / (i * i + j * j))
            step = new - x[k]
            if step:
                x[k] = new
                left[a] -= i * step
                if j:
                    left[b] -= j * step
    return np.array(x)


def make_plan(histogram: np.ndarray, window: int, first_sequence: int = 0) -> Plan:
    """Combinations for the histogram of piece lengths (all below the window), the rest greedily.

    Repeat counts are solved, rounded and held to what is left, three times over; the
    pieces left then follow each other, longest first, cut where a sequence is full.
    The plan's size depends on the window alone.
    """
    left = histogram.astype(np.int64).copy()
    used: list[tuple[int, int, int, int, int]] = []
    for _ in range(3):
        lengths = np.flatnonzero(left)
        patterns = combinations(lengths[lengths > 0], window)
        if not len(patterns):
            break
        solved = solve_counts(patterns, left.astype(np.float64))
        for k in np.argsort(-solved, kind="stable").tolist():
            a, i, b, j = patterns[k].tolist()
            times = round(float(solved[k]) + 0.2)
            if a == b:
                times = min(times, left[a] // (i + j))
            else:
                times = min(times, left[a] // i, left[b] // j if j else times)
            if times > 0:
                left[a] -= times * i
                left[b] -= times * j
                used.append((a, i, b, j, int(times)))
    intervals, placed, sequence = [], np.zeros(window + 1, np.int64), first_sequence
    for a, i, b, j, times in used:
        for size, copies, offset in ((a, i, 0), (b, j, a * i)):
            if copies:
                intervals.append((size, int(placed[size]), copies, sequence, offset))
                placed[size] += copies * times
        sequence += times
    intervals.sort()
    columns = np.array(intervals, np.int64).reshape(-1, 5).T
    tokens = left * np.arange(window + 1)
    longest_first = np.cumsum(tokens[::-1])[::-1] - tokens
    return Plan(window, *columns, placed, longest_first, sequence)


def pack_sequences(
    transcripts: DataFrame,
    tokenizer_path: str,
    id_col: str = "video_id",
    text_col: str = "ocr_text",
    window: int = 4096,
    end_id: int = 2,
) -> DataFrame:
    """Cut and pack all OCR transcripts into sequences of at most ``window`` tokens.

    A transcript's ids are the tokenizer's, without special tokens, then ``end_id``.
    Whole windows of a long transcript are sequences by themselves. Its remainder goes
    into a combination of lengths that fills a window exactly: shallow combinations are
    enumerated, non-negative least squares solves their repeat counts against the
    histogram of remainders (at most ``window`` numbers), and what rounding leaves over
    is laid out greedily, longest first, cut where a sequence is full. Only the last
    sequence can have padding.

    Pieces are numbered per length within groups of records, then over groups, so no
    length, however common, meets in one task. Returns id_col, row (key of the record),
    copy (number among equal records), start, length, ids_crc32 (of little-endian
    unsigned 32-bit ids), doc_tokens, sequence_id, offset. A null text is empty and has
    one token, ``end_id``. Repeated rows are packed each; an empty table gives none.
    """
    rows = transcripts.select(row_key(id_col, text_col).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    size = 4 * window

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens.of(tokenizer_path)
        for b in batches:
            total, crcs = [], []
            for text in b.column("text").to_pylist():
                ids = tokens.ids(text or "", end_id)
                total.append(len(ids) // 4)
                crcs.append([zlib.crc32(ids[at : at + size]) for at in range(0, len(ids), size)])
            yield batch(["row", "id", "tokens", "crcs"], b.column("row"), b.column("id"), pa.array(total, pa.int64()), pa.array(crcs, pa.list_(pa.int64())))

    lengths = table(arrow_map(rows, measure, f"row bigint, id {kind}, tokens bigint, crcs array<bigint>"), "token-lengths")
    full, rest = F.floor(F.col("tokens") / window), F.col("tokens") % window
    group = F.pmod("row", F.lit(max(LEAST_GROUPS, lengths.count() // GROUP_ROWS))).cast("int")
    groups = lengths.select(group.alias("group"), full.alias("whole"), rest.alias("length")).groupBy("group", "length")
    counts = table(groups.agg(F.count("*").alias("n"), F.sum("whole").alias("whole")), "length-counts")

    # one row per group, and per group and length: few against the records
    by_group = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    whole = counts.groupBy("group").agg(F.sum("whole").alias("whole"))
    whole_first = whole.select("group", F.coalesce(F.sum("whole").over(by_group), F.lit(0)).alias("whole_first"))
    by_length = Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    number_first = counts.where("length > 0").select("group", "length", F.coalesce(F.sum("n").over(by_length), F.lit(0)).alias("number_first"))

    found = counts.groupBy("length").agg(F.sum("n").alias("n"), F.sum("whole").alias("whole")).collect()
    histogram = np.zeros(window + 1, np.int64)
    for r in found:
        histogram[r["length"]] = r["n"]
    histogram[0] = 0
    plan = broadcast(transcripts.sparkSession, make_plan(histogram, window, sum(r["whole"] for r in found)))

    in_length = Window.partitionBy("group", "length").orderBy("row")
    in_group = Window.partitionBy("group").orderBy("length", "row").rowsBetween(Window.unboundedPreceding, -1)
    numbered = (
        lengths.select("*", group.alias("group"), full.alias("whole"), rest.alias("length"))
        .withColumn("number", F.row_number().over(in_length) - 1)
        .withColumn("whole_at", F.coalesce(F.sum("whole").over(in_group), F.lit(0)))
        .join(whole_first, "group")
        .join(number_first, ["group", "length"], "left")
        .withColumn("number", F.col("number") + F.coalesce("number_first", F.lit(0)))
        .withColumn("whole_at", F.col("whole_at") + F.col("whole_first"))
        .select("row", "id", "tokens", "crcs", "number", "whole_at")
    )
    piece_names = ["row", "id", "number", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        for b in batches:
            tokens, number, whole_at = (b.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("tokens", "number", "whole_at"))
            sequence, offset, loose = p.place(tokens % window, number)
            keys, ids = b.column("row").to_pylist(), b.column("id").to_pylist()
            out: list[tuple] = []
            for k, crcs in enumerate(b.column("crcs").to_pylist()):
                n, whole = int(tokens[k]), int(tokens[k]) // window
                head = (keys[k], ids[k], int(number[k]))
                for w in range(whole):
                    out.append((*head, w * window, window, crcs[w], n, int(whole_at[k]) + w, 0))
                at, left, seq, off = whole * window, n % window, int(sequence[k]), int(offset[k])
                while left:
                    part = min(left, window - off) if loose[k] else left
                    uncut = part == n % window
                    out.append((*head, at, part, crcs[whole] if uncut else None, n, seq, off))
                    at, left, seq, off = at + part, left - part, seq + 1, 0
            types = [pa.int64(), b.schema.field("id").type, *[pa.int64()] * 7]
            yield batch(piece_names, *(pa.array([r[i] for r in out], t) for i, t in enumerate(types)))

    longs = ", ".join(f"{n} bigint" for n in piece_names[2:])
    pieces = table(arrow_map(numbered, place, f"row bigint, id {kind}, {longs}"), "pieces")

    # pieces cut from a remainder: at most two for each sequence of the rest; their ids are made again
    cut = pieces.where("ids_crc32 IS NULL")
    spans = cut.groupBy("row").agg(F.collect_list(F.struct(*piece_names[1:])).alias("spans"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens.of(tokenizer_path)
        for b in batches:
            out: list[tuple] = []
            for row, text, spans in zip(*(b.column(n).to_pylist() for n in ("row", "text", "spans"))):
                ids = tokens.ids(text or "", end_id)
                for s in spans:
                    crc = zlib.crc32(ids[4 * s["start"] : 4 * (s["start"] + s["length"])])
                    out.append((row, *(crc if n == "ids_crc32" else s[n] for n in piece_names[1:])))
            id_type = b.schema.field("spans").type.value_type.field("id").type
            types = [pa.int64(), id_type, *[pa.int64()] * 7]
            yield batch(piece_names, *(pa.array([r[i] for r in out], t) for i, t in enumerate(types)))

    # equal records share a row key: one text serves all their pieces
    source = rows.select("row", "text").join(spans.select("row"), "row", "left_semi")
    source = source.dropDuplicates(["row"]).join(spans, "row").select("row", "text", "spans")
    again = arrow_map(source, check, f"row bigint, id {kind}, {longs}")
    out = pieces.where("ids_crc32 IS NOT NULL").unionByName(again)
    return out.select(F.col("id").alias(id_col), "row", F.col("number").alias("copy"), *piece_names[3:])
