"""MinHash near-dedup: bottom-k sketches of word shingles from one hash function."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screentime.llm.common import Bitmap, WordHashes, arrow_map, batch, broadcast, mix, ngram_hashes, row_key, table, texts

#: Values a sketch retains.
SKETCH = 32
#: Chance at most with which a sketch test may miss a link at the threshold.
MISSED = 1e-7
#: Lists from this length on choose their first partner by full sets.
LONG_LIST = 32
#: Ratio of two neighbouring size classes.
CLASS_RATIO = 0.96


def least_shared(threshold_pct: int) -> int:
    """Values of ``SKETCH`` that a linked pair shares but for a chance of ``MISSED``: lower binomial tail at the threshold."""
    share, tail = threshold_pct / 100, 0.0
    for k in range(SKETCH + 1):
        tail += comb(SKETCH, k) * share**k * (1 - share) ** (SKETCH - k)
        if tail > MISSED:
            return max(1, k)
    return SKETCH


def shingle_set(text: bytes, hashes: WordHashes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; the whole sequence if it is shorter."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.int64)
    return np.unique(ngram_hashes(hashes.of(words), min(size, len(words))).view(np.int64))


def sketches(rows: DataFrame, shingle: int) -> DataFrame:
    """(row, id, n, node, sketch): set size, hash of the whole set, and its smallest values."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            sets = [shingle_set(t, hashes, shingle) for t in texts(b.column("text"))]
            nodes = [int(mix(np.array([s.view(np.uint64).sum() ^ mix(s.view(np.uint64)).sum() + np.uint64(len(s))]))[0]) if len(s) else None for s in sets]
            yield batch(
                ["row", "id", "n", "node", "sketch"],
                b.column("row"), b.column("id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([v if v is None else v - (1 << 63) for v in nodes], pa.int64()), pa.array([s[:SKETCH] for s in sets], pa.list_(pa.int64())),
            )
            hashes.trim()

    return arrow_map(rows, run, f"row bigint, id {kind}, n bigint, node bigint, sketch array<bigint>")


def full_sets(rows: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, n, set) of the wanted (node, row): texts are filtered by a fixed-size filter, then exactly."""
    shared = broadcast(rows.sparkSession, Bitmap.build(wanted, "row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            row = b.column("row").to_numpy().view(np.uint64)
            pick = np.flatnonzero(shared.value.has(row))
            text = texts(b.column("text").take(pa.array(pick)))
            yield batch(
                ["row", "set"], row[pick].view(np.int64), pa.array([shingle_set(t, hashes, shingle) for t in text], pa.list_(pa.int64()))
            )
            hashes.trim()

    sets = arrow_map(rows.select("row", "text"), run, "row bigint, set array<bigint>")
    # equal records share a row key, so a row may come twice
    return sets.dropDuplicates(["row"]).join(wanted, "row").select("node", F.size("set").alias("n"), "set")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): smallest node reachable, for every node with an edge.

    Every round hangs each label under its smallest neighbour, follows two more steps,
    and contracts the edges; edges inside one component disappear.
    """
    work = table(edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo != hi").distinct(), "edges")
    labels = work.select(F.explode(F.array("lo", "hi")).alias("node")).distinct().withColumn("component", F.col("node"))
    while not work.isEmpty():
        parent = work.groupBy(F.col("hi").alias("label")).agg(F.min("lo").alias("above"))
        for _ in range(2):
            higher = parent.select(F.col("label").alias("above"), F.col("above").alias("top"))
            parent = parent.join(higher, "above", "left").select("label", F.coalesce("top", "above").alias("above"))
        parent = table(parent, "parents")

        def raised(df: DataFrame, column: str) -> DataFrame:
            up = parent.select(F.col("label").alias(column), F.col("above").alias("_above"))
            return df.join(up, column, "left").withColumn(column, F.coalesce("_above", column)).drop("_above")

        labels = raised(labels, "component")
        moved = raised(raised(work, "lo"), "hi").where("lo != hi")
        work = table(moved.select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).distinct(), "edges")
    return labels


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / -np.log(CLASS_RATIO)).cast("int")


def near_copies(
    transcripts: DataFrame, id_col: str = "video_id", text_col: str = "ocr_text", threshold_pct: int = 85, shingle: int = 5
) -> DataFrame:
    """Groups of near-copies among OCR transcripts.

    A transcript's set holds its distinct ``shingle``-word runs (lower-cased A-Z, words
    ``[^\\x20\\x09-\\x0D]+``); a shorter text is one shingle; a text without words has an
    empty set and no links. Two sets link when 100 * intersection >= ``threshold_pct`` *
    union. Sets are held as 64-bit hashes.

    Equal sets are one node. Each node keeps the 32 smallest hashes of its set. Inverted
    lists of retained values give overlaps; nodes that share too few values with any
    other node have no link and leave. First every list is compared with its most
    typical member only, which joins large groups at linear cost. Members of lists that
    still hold several groups meet again by an exact prefix filter on their full sets,
    rarest shingles first, by size class. Every pair is estimated on the union sketch
    before its full sets are compared.

    Each of the two sketch tests misses a true link with a chance below ``MISSED`` at the threshold.
    Returns id_col, n_shingles, component_id (smallest id in the group), kept (id =
    component_id), row. Null texts have no words; repeated rows are one node, both kept
    if they share the id; null ids never win over others.
    """
    rows = transcripts.select(row_key(id_col, text_col).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = table(sketches(rows, shingle), "sketches")
    nodes = table(
        found.where("n > 0").groupBy("node").agg(F.min("id").alias("least"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("sketch").alias("sketch")),
        "nodes",
    )

    # nodes that share enough retained values with others, twice over
    least = least_shared(threshold_pct)
    open_nodes = nodes
    for _ in range(2):
        values = open_nodes.select("node", F.size("sketch").alias("m"), F.explode("sketch").alias("v"))
        shared = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
        enough = (
            values.join(shared, "v").groupBy("node", "m").agg(F.count("*").alias("q"), F.avg("df").alias("typical"))
            .where((F.col("q") >= least) | (100 * F.col("q") >= threshold_pct * F.col("m"))).select("node", "typical")
        )
        open_nodes = table(nodes.join(enough, "node"), "open-nodes")
    lists = table(open_nodes.select("node", "typical", F.explode("sketch").alias("v")).join(shared, "v"), "lists")
    sets = table(full_sets(rows, open_nodes.select("node", "row"), shingle), "sets")
    sizes = open_nodes.select("node", "n", "sketch")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose union sketch lets them pass, then their full sets."""
        for side in "ab":
            pairs = pairs.join(sizes.select(F.col("node").alias(side), F.col("sketch").alias(f"sketch_{side}")), side)
        union = F.slice(F.sort_array(F.array_union("sketch_a", "sketch_b")), 1, SKETCH)
        both = F.size(F.array_intersect(F.array_intersect("sketch_a", "sketch_b"), F.col("union")))
        likely = pairs.withColumn("union", union).where((both >= least) | (100 * both >= threshold_pct * F.size("union"))).select("a", "b")
        likely = table(likely, "likely")
        for side in "ab":
            likely = likely.join(sets.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("set").alias(f"set_{side}")), side)
        inter = likely.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("set_a", "set_b")).alias("both"))
        return inter.where(100 * F.col("both") >= threshold_pct * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")

    # the member of a long list whose whole set is the most common can link to the most others
    crowd = lists.where(F.col("df") >= LONG_LIST).select("node").distinct()
    crowd = sets.select("node", "n", "set").join(crowd, "node").select("node", "n", F.explode("set").alias("s"))
    often = crowd.groupBy("s").agg(F.count("*").alias("c")).where("c > 1")
    central = crowd.join(often, "s").groupBy("node", "n").agg(F.sum("c").alias("c")).select("node", (F.col("c") / F.col("n")).alias("central"))
    ranked = lists.join(central, "node", "left").withColumn("central", F.coalesce("central", F.lit(0.0)))
    leaders = ranked.groupBy("v").agg(F.max(F.struct("central", "typical", "node")).alias("top")).select("v", F.col("top.node").alias("b"))
    stars = lists.join(leaders, "v").where("node != b").select(F.col("node").alias("a"), "b").distinct()
    first = components(confirmed(stars))
    labelled = table(
        sizes.select("node", "n").join(first, "node", "left").select("node", "n", F.coalesce("component", "node").alias("component")), "labels"
    )

    # lists that still hold several groups: their members go through a prefix filter on full sets. Shingles are
    # ordered by how many open nodes have them; the one at place ``at`` can be a pair's first common shingle only
    # if the partner has ``most`` shingles or fewer, so what a group has in common meets almost nobody.
    members = lists.join(labelled, "node")
    apart = members.groupBy("v").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("v")
    apart = table(members.join(apart, "v", "left_semi").select("node", "n", "component").distinct(), "apart")
    exploded = sets.select("node", "set").join(apart.select("node"), "node").select("node", F.explode("set").alias("s"))
    common = exploded.groupBy("s").agg(F.count("*").alias("c")).where("c > 1")
    ranked = exploded.join(common, "s").select(
        "node", "s", F.expr("row_number() OVER (PARTITION BY node ORDER BY c, s) - count(*) OVER (PARTITION BY node)").alias("place")
    )
    ranked = ranked.join(apart, "node").withColumn("at", F.col("n") + F.col("place"))
    able = (
        ranked.withColumn("most", F.expr(f"(n + 1 - at) * {100 + threshold_pct} DIV {threshold_pct} - n"))
        .where(100 * F.col("most") >= threshold_pct * F.col("n"))
        .select("node", "s", "n", "component", "most", _size_class(F.col("n")).alias("class"))
    )
    able = table(able, "able")
    low = F.greatest(F.lit(1), F.ceil(F.col("n") * (threshold_pct / 100)))
    larger = able.select(
        *(F.col(c).alias(f"{c}_a") for c in ("node", "n", "component", "most")), "s",
        F.explode(F.sequence(_size_class(low) - 1, _size_class(F.least("n", "most")))).alias("class"),
    )
    smaller = able.select(*(F.col(c).alias(f"{c}_b") for c in ("node", "n", "component", "most")), "s", "class")
    pairs = (
        larger.join(smaller, ["s", "class"])
        .where("component_a != component_b AND (n_b < n_a OR n_b = n_a AND node_b < node_a) AND n_b <= most_a AND n_a <= most_b")
        .where(100 * F.col("n_b") >= threshold_pct * F.col("n_a"))
        .select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    )
    late = confirmed(pairs)
    for side in "ab":
        late = late.join(labelled.select(F.col("node").alias(side), F.col("component").alias(f"c{side}")), side)
    second = components(late, "ca", "cb").select(F.col("node").alias("component"), F.col("component").alias("whole"))
    groups = labelled.join(second, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    groups = nodes.select("node", "least").join(groups, "node").select("node", "least", "component")
    lowest = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    joined = table(groups.join(lowest, "component").select("node", "component_id"), "groups")
    named = nodes.join(joined, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id"))
    out = found.select("row", "id", "n", "node").join(named, "node", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), "row"
    )


def keep_one_of_each(transcripts: DataFrame, id_col: str = "video_id", text_col: str = "ocr_text", **options) -> DataFrame:
    """The transcripts, all columns, without near-copies: of each group the row with the smallest id stays."""
    kept = near_copies(transcripts, id_col, text_col, **options).where("kept").select(F.col("row").alias("_row")).distinct()
    return transcripts.join(kept, row_key(id_col, text_col) == F.col("_row"), "left_semi")
