"""LM scoring: context-tree weighting over binary-decomposed bytes, next to a word-frequency base."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screentime.llm.common import arrow_map, batch, broadcast, mix, table, texts

#: Closes a text; white space, so it occurs in no word.
END = b"\n"
#: Distinct keys a counting task holds before it hands them on.
_HELD = 2_000_000
#: Bytes that are hashed and coded at a time, so that they stay in the processor's cache.
_BLOCK = 1 << 16
#: Odd multiplier whose upper product bits spread over all bits of a key.
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def canonical(text: bytes) -> tuple[list[bytes], bytes]:
    """Lower-cased words ``[^\\x20\\x09-\\x0D]+`` and the byte string the model codes: words joined by a space, then the end."""
    words = text.lower().split()
    return words, b" ".join(words) + END


def gram_codes(strings: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with its ``depth`` predecessors as one number, and the first byte of each string; strings start after ``END``s."""
    data = np.frombuffer(b"".join(END * depth + s for s in strings), np.uint8).astype(np.uint64)
    sizes = np.array([len(s) for s in strings], np.int64)
    begin = np.cumsum(sizes + depth) - sizes
    code, width = data.copy(), 1
    while width <= depth:
        # bytes that both parts hold are the same
        step = min(width, depth + 1 - width)
        code[step:] |= code[:-step] << np.uint64(8 * step)
        width += step
    keep = np.ones(len(data), bool)
    for k in range(1, depth + 1):
        keep[begin - k] = False
    return code[keep], np.cumsum(sizes) - sizes


def token_hashes(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes, none 0, of the words and the end of each canonical string, and how many each string has.

    A word's hash sums a random value for every byte at its place in the word.
    """
    data = np.frombuffer(b"".join(strings), np.uint8)
    cut = np.flatnonzero((data == 32) | (data == END[0]))
    starts = np.append(0, cut[:-1] + 1)
    sizes = cut - starts
    value = np.arange(len(data)) - np.repeat(starts, sizes + 1)
    value = mix(((value << 8) | data).view(np.uint64) + np.uint64(1))
    value[cut] = 0
    # an empty text has no word before its end
    ends, words = data[cut] == END[0], sizes > 0
    hashes = np.maximum(mix(np.add.reduceat(value, starts)), np.uint64(1))[words]
    upto = np.cumsum(words)[ends]
    return np.insert(hashes, upto, _END_HASH), np.diff(upto, prepend=0) + 1


#: The end token counts as a word that no text can hold.
_END_HASH = mix(np.array([1 << 63], np.uint64))[0]


def blocks(strings: list[bytes]) -> Iterator[list[bytes]]:
    """Consecutive strings, about ``_BLOCK`` bytes at a time; a longer string stays whole."""
    held, size = [], 0
    for s in strings:
        held.append(s)
        size += len(s)
        if size >= _BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


class _Tally:
    """Counts of 64-bit keys, merged when many are held."""

    def __init__(self):
        self.parts, self.held = [], 0

    def add(self, keys: np.ndarray) -> None:
        found = np.unique(keys, return_counts=True)
        self.parts.append(found)
        self.held += len(found[0])

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in self.parts]) if self.parts else np.zeros(0, np.uint64)
        counts = np.concatenate([c for _, c in self.parts]) if self.parts else np.zeros(0, np.int64)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.parts, self.held = [], 0
        return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def corpus_counts(rows: DataFrame, depth: int) -> DataFrame:
    """(kind, key, n, seen): word counts (kind 0, by 64-bit hash) and byte-context counts (kind 1) over whole texts.

    A second column of ``rows`` tells which texts count in ``n``; ``seen`` counts the byte contexts of all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # words, byte contexts, byte contexts of texts that are not learned
        tallies = _Tally(), _Tally(), _Tally()

        def flush() -> Iterator[pa.RecordBatch]:
            for place, tally in enumerate(tallies):
                keys, counts = tally.take()
                for at in range(0, len(keys), 100_000):
                    part, seen = keys[at : at + 100_000].view(np.int64), counts[at : at + 100_000].astype(np.int64)
                    kind = np.full(len(part), min(place, 1), np.int32)
                    yield batch(["kind", "key", "n", "seen"], kind, part, seen * (place < 2), seen)

        for b in batches:
            learn = b.column(1).to_pylist() if b.num_columns > 1 else [True] * b.num_rows
            strings, others = [], []
            for text, learned in zip(texts(b.column(0)), learn):
                (strings if learned else others).append(canonical(text)[1])
            none = [np.zeros(0, np.uint64)]
            tallies[0].add(np.concatenate(none + [token_hashes(part)[0] for part in blocks(strings)]))
            for tally, own in ((tallies[1], strings), (tallies[2], others)):
                tally.add(np.concatenate(none + [gram_codes(part, depth)[0] for part in blocks(own)]))
            if sum(t.held for t in tallies) > _HELD:
                yield from flush()
        yield from flush()

    counted = arrow_map(rows, run, "kind int, key bigint, n bigint, seen bigint").groupBy("kind", "key")
    return counted.agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))


def _log_gamma(x: Column) -> Column:
    """Stirling's series after shifting the argument by six; for x >= 1/2."""
    y = x + 6
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - F.log(x) - F.log(x + 1) - F.log(x + 2) - F.log(x + 3) - F.log(x + 4) - F.log(x + 5)


def _kt(zeros: str, ones: str) -> Column:
    """Log probability of a bit sequence by Krichevsky and Trofimov's estimator."""
    a, b = F.col(zeros).cast("double"), F.col(ones).cast("double")
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1) - float(np.log(np.pi))


def tree_levels(grams: DataFrame, depth: int) -> list[DataFrame]:
    """(context, node, zeros, ones, weighted, own) of every node, one table per context length from 0 to ``depth``.

    A byte is eight binary decisions; a node is a context of 0 to ``depth`` bytes and the
    bits decided so far. ``own`` is the node's weight against its longer contexts. Weights
    come from all contexts, bottom up; contexts with n = 0 get nodes that weigh nothing.
    """
    bits = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j")
    byte = F.col("key").bitwiseAND(F.lit(255))
    # codes meet by context before they become eight nodes each, so the nodes need no exchange of their own
    codes = grams.select(F.shiftrightunsigned("key", 8).alias("context"), byte.alias("byte"), "n").repartition("context")
    counted = codes.select("context", "byte", "n", bits).select(
        "context",
        F.expr("shiftleft(1L, j) | shiftrightunsigned(byte, 8 - j)").alias("node"),
        F.expr("CASE WHEN shiftrightunsigned(byte, 7 - j) & 1 = 0 THEN n ELSE 0 END").alias("zeros"),
        F.expr("CASE WHEN shiftrightunsigned(byte, 7 - j) & 1 = 1 THEN n ELSE 0 END").alias("ones"),
    )
    levels = []
    level = counted.groupBy("context", "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
    level = level.withColumn("weighted", _kt("zeros", "ones")).withColumn("own", F.lit(1.0))
    for d in range(depth, -1, -1):
        if d < depth:
            level = level.groupBy(F.col("context").bitwiseAND(F.lit((1 << (8 * d)) - 1)).alias("context"), "node").agg(
                F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("longer")
            )
            level = level.withColumn("kt", _kt("zeros", "ones"))
            top = F.greatest("kt", "longer")
            both = top + F.log(F.exp(F.col("kt") - top) + F.exp(F.col("longer") - top))
            level = level.select("context", "node", "zeros", "ones", (both - float(np.log(2))).alias("weighted"), F.exp(F.col("kt") - both).alias("own"))
        level = table(level, "context-level")
        levels.append(level)
    return levels[::-1]


def context_tree(grams: DataFrame, depth: int, node_share: float) -> DataFrame:
    """(key, one, own): nodes of the weighted tree that hold ``node_share`` of all bytes at least, for a :class:`ContextTree`.

    ``one`` is the estimate for a one. Per depth and bit position at most ``1 / node_share`` nodes pass.
    """
    total = grams.agg(F.sum("n")).first()[0] or 0
    kept = None
    for d, level in enumerate(tree_levels(grams, depth)):
        count = F.col("zeros") + F.col("ones")
        key = F.shiftleft("context", 8).bitwiseOR(F.col("node")).bitwiseOR(F.lit(d << 56))
        part = level.where(count >= max(1.0, total * node_share)).select(
            key.alias("key"), ((F.col("ones") + 0.5) / (count + 1.0)).cast("float").alias("one"), F.col("own").cast("float").alias("own")
        )
        kept = part if kept is None else kept.unionByName(part)
    return kept


def code_values(grams: DataFrame, depth: int) -> DataFrame:
    """(key, seen, value): log10 probability of the last byte of every code in ``grams`` (key, n, seen) under the whole tree.

    Top down, every node takes over what the shorter contexts have mixed so far; where a
    context was never learned, the longest learned one stands in for it.
    """
    count = F.col("zeros") + F.col("ones")
    learned, one = count > 0, (F.col("ones") + 0.5) / (count + 1.0)
    above = None
    for d, level in enumerate(tree_levels(grams, depth)):
        if above is None:
            level = level.withColumns({"chance0": F.lit(0.0), "rest0": F.lit(1.0), "last0": F.lit(0.5)})
        else:
            shorter = F.col("context").bitwiseAND(F.lit((1 << (8 * (d - 1))) - 1))
            level = level.withColumn("shorter", shorter).join(above, ["shorter", "node"])
        above = level.select(
            F.col("context").alias("shorter"), "node",
            F.when(learned, F.col("chance0") + F.col("rest0") * F.col("own") * one).otherwise(F.col("chance0")).alias("chance0"),
            F.when(learned, F.col("rest0") * (1 - F.col("own"))).otherwise(F.col("rest0")).alias("rest0"),
            F.when(learned, one).otherwise(F.col("last0")).alias("last0"),
        )
    entry = F.struct("node", (F.col("chance0") + F.col("rest0") * F.col("last0")).alias("p"))
    nodes = above.groupBy(F.col("shorter").alias("context")).agg(F.map_from_entries(F.collect_list(entry)).alias("nodes"))
    codes = grams.select("key", "seen", F.shiftrightunsigned("key", 8).alias("context"), F.col("key").bitwiseAND(F.lit(255)).alias("byte"))
    value = F.lit(0.0)
    for j in range(8):
        p = F.expr(f"element_at(nodes, {1 << j}L | shiftrightunsigned(byte, {8 - j}))")
        value = value + F.log10(F.when(F.expr(f"shiftrightunsigned(byte, {7 - j}) & 1 = 1"), p).otherwise(1 - p))
    return codes.join(nodes, "context").select("key", "seen", value.alias("value"))


class _Slots:
    """Open addressing over 64-bit keys other than 0; ``columns`` of values stand in the slots of their keys."""

    def __init__(self, keys: np.ndarray, *columns: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(2 * max(1, len(keys))))))
        self.keys = np.zeros(1 << self.bits, np.uint64)
        # one place more, for slot -1
        self.columns = [np.zeros((1 << self.bits) + 1, c.dtype) for c in columns]
        left = np.arange(len(keys))
        spot = self._home(keys)
        while len(left):
            # of the keys that want one free spot, the first gets it
            free = self.keys[spot[left]] == 0
            _, first = np.unique(spot[left][free], return_index=True)
            win = left[free][first]
            self.keys[spot[win]] = keys[win]
            for column, values in zip(self.columns, columns):
                column[spot[win]] = values[win]
            left = np.setdiff1d(left, win, assume_unique=True)
            spot[left] = (spot[left] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where it is not held."""
        out = self._home(keys)
        held = self.keys[out]
        left = np.flatnonzero(held != keys)
        want, spot, held = keys[left], out[left], held[left]
        while len(left):
            empty = held == 0
            out[left[empty]] = -1
            left, want = left[~empty], want[~empty]
            spot = (spot[~empty] + 1) & ((1 << self.bits) - 1)
            held = self.keys[spot]
            hit = held == want
            out[left[hit]] = spot[hit]
            left, want, spot, held = left[~hit], want[~hit], spot[~hit], held[~hit]
        return out


class ContextTree(_Slots):
    """Frozen weighted tree in memory: code length of a byte after its context. No key is 0: a node number is at least 1."""

    def __init__(self, keys: np.ndarray, one: np.ndarray, own: np.ndarray, depth: int):
        super().__init__(keys, one, own)
        self.depth, (self.one, self.own) = depth, self.columns

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """Log10 probability of the last byte of each code after the bytes before it."""
        byte, context = codes & np.uint64(255), codes >> np.uint64(8)
        total = np.zeros(len(codes))
        for j in range(8):
            node = np.uint64(1 << j) | (byte >> np.uint64(8 - j))
            bit = (byte >> np.uint64(7 - j)) & np.uint64(1)
            chance, rest, last = np.zeros(len(codes)), np.ones(len(codes)), np.full(len(codes), 0.5)
            live = np.arange(len(codes))
            for d in range(self.depth + 1):
                short = context[live] & np.uint64((1 << (8 * d)) - 1)
                slot = self.find((short << np.uint64(8)) | node[live] | np.uint64(d << 56))
                live, slot = live[slot >= 0], slot[slot >= 0]
                if not len(live):
                    break
                own, one = self.own[slot].astype(np.float64), self.one[slot].astype(np.float64)
                chance[live] += rest[live] * own * one
                rest[live] *= 1 - own
                last[live] = one
            chance += rest * last
            total += np.log10(np.where(bit == 1, chance, 1 - chance))
        return total


def most_common(df: DataFrame, count_col: str, rows: float) -> DataFrame:
    """At most ``rows`` rows, those with the largest counts; counts of one eighth of an octave stay together."""
    octave = F.floor(8 * F.log2(count_col))
    sizes = sorted(df.where(F.col(count_col) > 0).groupBy(octave.alias("o")).count().collect(), reverse=True)
    kept = np.cumsum([r["count"] for r in sizes]) <= rows
    return df.where(octave >= sizes[int(kept.sum()) - 1]["o"]) if kept.any() else df.limit(0)


def _block_scores(strings: list[bytes], usual: _Slots, often: _Slots, depth: int) -> tuple[np.ndarray, ...]:
    """Per string its tokens, rare tokens, sum of its frequent words' values, rare codes and sum of the others' values;
    then the hashes of all rare tokens and all rare codes."""
    hashes, n_tokens = token_hashes(strings)
    place, at = often.find(hashes), np.cumsum(n_tokens) - n_tokens
    codes, first = gram_codes(strings, depth)
    slot = usual.find(codes + np.uint64(1))
    return (
        n_tokens, np.add.reduceat(place < 0, at, dtype=np.int64), np.add.reduceat(often.columns[0][place], at),
        np.add.reduceat(slot < 0, first, dtype=np.int64), np.add.reduceat(usual.columns[0][slot], first),
        hashes[place < 0].view(np.int64), codes[slot < 0].view(np.int64),
    )


def _lists(sizes: np.ndarray, values: np.ndarray) -> pa.ListArray:
    """Consecutive lists of the given sizes."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values))


def score_texts(
    transcripts: DataFrame,
    id_col: str = "video_id",
    text_col: str = "ocr_text",
    learn_from: Column | None = None,
    depth: int = 5,
    code_share: float = 2.0**-20,
    word_share: float = 2.0**-20,
) -> DataFrame:
    """Log10 probability of every whole OCR transcript under context-tree weighting.

    The model is learned from the rows where ``learn_from`` holds (all by default). A
    text is its lower-cased (A-Z) words ``[^\\x20\\x09-\\x0D]+`` joined by one space, then
    an end. Each byte is eight binary decisions; every decision mixes the estimates of
    contexts of 0 to ``depth`` bytes with the weights of the tree. Counts and nodes of all
    training bytes take part; the longest learned context stands in for longer ones that
    training does not hold. Each distinct code (a byte and its ``depth`` predecessors) of
    the texts is valued once. Values of the most common codes (at most ``1 / code_share``,
    those above ``code_share`` of all bytes among them) are broadcast; other codes meet theirs in a join.

    The base sums log10((c + 0.5) / (N + 0.5 (V + 1))) over tokens: words and one end.
    The most common words (at most ``1 / word_share``) are broadcast; tokens of other words
    meet their counts in a join.

    Returns id_col, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.
    Null and empty texts are one end token. Repeated rows each get their row; without
    training rows counts are 0 and every bit has probability one half.
    """
    spark = transcripts.sparkSession
    learn = F.coalesce(learn_from, F.lit(False)) if learn_from is not None else F.lit(True)
    rows = transcripts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), learn.alias("learn"))
    kind = rows.schema["id"].dataType.simpleString()

    counts = table(corpus_counts(rows.select("text", "learn"), depth), "corpus-counts")
    words = counts.where("kind = 0").select("key", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    values = table(code_values(counts.where("kind = 1"), depth), "code-values")
    usual = most_common(values, "seen", 1 / code_share).select("key", "value").toArrow()
    # a code can be 0, a key of the slots cannot
    codes = _Slots(usual.column("key").to_numpy().view(np.uint64) + np.uint64(1), usual.column("value").to_numpy())
    often = most_common(words, "n", 1 / word_share).toArrow()
    often = _Slots(often.column("key").to_numpy().view(np.uint64), np.log10(often.column("n").to_numpy() + 0.5))
    shared = broadcast(spark, (codes, often))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        usual, often = shared.value
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            strings = [canonical(text)[1] for text in texts(b.column("text"))]
            parts = [_block_scores(part, usual, often, depth) for part in blocks(strings)]
            n_tokens, n_others, base, n_unusual, scores, others, unusual = (
                np.concatenate([np.zeros(0, t), *(p[i] for p in parts)]).astype(t) for i, t in enumerate([np.int64, np.int64, float, np.int64, float, np.int64, np.int64])
            )
            ids = pa.array(np.arange(row, row + len(strings), dtype=np.int64))
            row += len(strings)
            yield batch(
                ["row", "id", "n_tokens", "n_known", "base", "score", "bytes", "others", "unusual"],
                ids, b.column("id"), n_tokens, n_tokens - n_others, base, scores, pa.array([len(s) for s in strings], pa.int64()),
                _lists(n_others, others), _lists(n_unusual, unusual),
            )

    schema = f"row bigint, id {kind}, n_tokens bigint, n_known bigint, base double, score double, bytes bigint, others array<bigint>, unusual array<bigint>"
    # row numbers belong to this table once it is written
    scored = table(arrow_map(rows.select("id", "text"), score, schema), "scored")
    seldom = scored.select("row", F.explode("others").alias("key")).join(words, "key", "left")
    seldom = seldom.groupBy("row").agg(F.count("n").alias("more_known"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more_base"))
    unusual = scored.select("row", F.explode("unusual").alias("key")).join(values, "key").groupBy("row").agg(F.sum("value").alias("more_score"))
    out = scored.drop("others", "unusual").join(seldom, "row", "left").join(unusual, "row", "left")
    out = out.withColumn("score", F.col("score") + F.coalesce("more_score", F.lit(0.0)))
    floor = F.log10(F.lit(total + 0.5 * (distinct + 1)))
    return out.select(
        F.col("id").alias(id_col), "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(total)).alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * floor).alias("base_score"), "score",
        (-F.col("score") * float(np.log2(10)) / F.col("bytes")).alias("bits_per_byte"),
    )
