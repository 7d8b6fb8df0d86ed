"""Line dedup and quality rules over lines, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screentime.llm.common import carried, row_key, table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = " \t\n\x0b\x0c\r"
#: Groups that the records of one line are dealt to.
SALTS = 16


def normal_line(line: Column) -> Column:
    """A line in lower case (A-Z) without blanks around it."""
    return F.trim(F.translate(line, _UPPER, _LOWER), F.lit(_BLANKS))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dealt(lines: DataFrame, few: DataFrame) -> DataFrame:
    """``lines`` with the columns of ``few`` (a row per line), met by (line, salt): one line in every record is
    ``SALTS`` groups, not one."""
    return lines.join(few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["line", "salt"])


def boilerplate_lines(lines: DataFrame, max_sites: int = 8, near: float = 0.1, log2_size: int = 12) -> DataFrame:
    """(line, first): hashes of lines on more than ``max_sites`` sites, and the smallest id that has one.

    ``lines`` has (line, salt, id, site). One HyperLogLog sketch per line takes the sites and merges
    by aggregation, next to the smallest id. Estimates within ``near`` of the limit (over five standard
    errors at 2^12 registers) are settled by an exact distinct count; others stand.
    """
    spread = lines.groupBy("line").agg(F.hll_sketch_agg("site", log2_size).alias("sketch"), F.min("id").alias("first"))
    spread = spread.select("line", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    spread = table(spread.where(F.col("sites") >= F.floor(F.lit((max_sites + 1) * (1 - near)))), "line-spread")
    close = spread.where(F.col("sites") <= F.ceil(F.lit(max_sites * (1 + near)))).select("line", "first")
    exact = dealt(lines.select("line", "salt", "site"), close).groupBy("line", "first").agg(F.count_distinct("site").alias("sites"))
    sure = spread.where(F.col("sites") > F.ceil(F.lit(max_sites * (1 + near))))
    return sure.select("line", "first").unionByName(exact.where(F.col("sites") > max_sites).select("line", "first"))


def remove_site_boilerplate(
    transcripts: DataFrame, id_col: str = "video_id", text_col: str = "ocr_text", site_col: str = "channel", max_sites: int = 8,
    carry_cols: tuple[str, ...] = (),
) -> DataFrame:
    """OCR transcripts without the lines that many channels share.

    Lines are compared in lower case without outer blanks (tabs and carriage returns count); blank lines stay. A line on
    more than ``max_sites`` distinct channels is boilerplate and goes everywhere but in
    the record with the smallest id that has it, so no content leaves the table whole.
    Returns id_col, n_lines, n_removed, kept_text and ``carry_cols`` unchanged. A null text stays null, has one
    (blank) line and loses nothing; a null channel is no site; a record with a null id
    never counts as the first; repeated rows lose the same lines.
    """
    rows = transcripts.select(
        row_key(id_col, text_col, site_col).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(site_col).alias("site"),
        carried(carry_cols),
    )
    split = rows.select("row", "id", F.xxhash64("site").alias("hash"), "site", F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
    split = split.withColumn("line", normal_line(F.col("line"))).where("line != ''")
    site = F.when(F.col("site").isNotNull(), F.col("hash")).alias("site")
    salt = F.pmod(F.hash("row", "at"), F.lit(SALTS)).alias("salt")
    lines = table(split.select("row", "id", "at", F.xxhash64("line").alias("line"), salt, site), "lines")
    found = dealt(lines.select("row", "id", "at", "line", "salt"), boilerplate_lines(lines, max_sites))
    gone = found.where(~F.col("id").eqNullSafe(F.col("first"))).groupBy("row").agg(F.collect_set("at").alias("gone"))
    joined = rows.select("row", "id", "text", "carry").join(gone, "row", "left").withColumn("all", lines_of(F.col("text")))
    keep = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), F.col("gone"))
    kept = F.array_join(F.transform(keep, lambda i: F.get(F.col("all"), i)), "\n")
    return joined.select(
        F.col("id").alias(id_col), *(F.col(f"carry.`{c}`") for c in carry_cols), F.size("all").cast("bigint").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("bigint").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("kept_text"),
    )


def word_rules(rows: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words to rows with ``text``; drops nothing."""
    text = F.coalesce(F.col("text"), F.lit(""))
    solid = F.translate(text, _BLANKS, "")
    some = F.filter(F.split(text, "\n", -1), lambda line: F.translate(line, _BLANKS, "") != "")
    step = rows.select(
        "*",
        F.length(solid).cast("bigint").alias("word_chars"),
        (F.length(solid) - F.length(F.translate(solid, "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
        (F.size(some) - F.size(F.array_distinct(some))).cast("bigint").alias("n_dup_lines"),
        F.transform(F.filter(F.split(F.translate(text, _BLANKS, "      "), " "), lambda w: w != ""), lambda w: F.xxhash64(w)).alias("_words"),
    )
    step = step.withColumn("n_words", F.size("_words").cast("bigint"))
    # hash of each window of three words, and the hashes met twice
    step = step.withColumn(
        "_grams", F.expr("CASE WHEN n_words >= 3 THEN transform(sequence(0, size(_words) - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])) END")
    )
    step = step.withColumn("_sorted", F.sort_array("_grams"))
    step = step.withColumn("_twice", F.array_distinct(F.expr("filter(_sorted, (g, i) -> i > 0 AND g = _sorted[greatest(i - 1, 0)])")))
    few = "filter(sequence(0, size(_grams) - 1), i -> array_contains(_twice, _grams[i]))"
    # many different repeats: by sorting windows with their places, to stay below quadratic work
    order = "sort_array(transform(_grams, (g, i) -> struct(g, i)))"
    step = step.withColumn("_order", F.expr(f"CASE WHEN size(_twice) > 48 THEN {order} END"))
    many = (
        "transform(filter(_order, (p, k) -> (k > 0 AND p.g = _order[greatest(k - 1, 0)].g) "
        "OR (k < size(_order) - 1 AND p.g = _order[least(k + 1, size(_order) - 1)].g)), p -> p.i)"
    )
    step = step.withColumn("_at", F.expr(f"CASE WHEN _twice IS NULL OR size(_twice) = 0 THEN NULL WHEN size(_twice) > 48 THEN {many} ELSE {few} END"))
    covered = "CASE WHEN _at IS NULL THEN 0 ELSE size(array_union(array_union(_at, transform(_at, i -> i + 1)), transform(_at, i -> i + 2))) END"
    return step.withColumn("n_repeat_words", F.expr(covered).cast("bigint")).drop("_words", "_grams", "_sorted", "_twice", "_order", "_at")


def _count_words(line: Column) -> Column:
    return F.size(F.filter(F.split(F.translate(line, _BLANKS, "      "), " "), lambda w: w != ""))


def quality_rules(
    transcripts: DataFrame,
    id_col: str = "video_id",
    text_col: str = "ocr_text",
    host_col: str = "channel",
    max_records: int = 50,
    least_left_pct: int = 30,
) -> DataFrame:
    """Rules on words and lines of OCR transcripts, and on lines common to a channel.

    Lines are hashed in lower case without outer blanks. A line that more than
    ``max_records`` records of one channel hold is removed there; a record that keeps
    less than ``least_left_pct`` percent of its words is depleted. The base rule fails
    records with under 50 words, or with over half of their words in three-word windows
    that the text repeats. Returns id_col, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_common_words (in removed lines), base_failed, kept. A null text has
    no words and fails; records without channel count as one channel; equal rows count
    once for a line.
    """
    rows = transcripts.select(row_key(id_col, text_col, host_col).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(host_col).alias("host"))
    pieces = F.transform(
        F.filter(lines_of(F.col("text")), lambda line: F.translate(line, _BLANKS, "") != ""),
        lambda line: F.struct(F.xxhash64(normal_line(line)).alias("line"), _count_words(line).alias("words")),
    )
    lines = rows.select("row", "host", F.explode(pieces).alias("p")).select("row", F.xxhash64("host", "p.line").alias("line"), F.col("p.words").alias("words"))
    lines = table(lines, "host-lines")
    common = lines.groupBy("line").agg(F.count_distinct("row").alias("records")).where(F.col("records") > max_records).select("line")
    gone = lines.join(common, "line", "left_semi").groupBy("row", "line").agg(F.count("*"), F.sum("words").alias("words"))
    gone = gone.groupBy("row").agg(F.sum("words").alias("n_common_words"))
    # equal rows add up in the table of lines: share out their sum
    equal = rows.groupBy("row").agg(F.count("*").alias("equal")).where("equal > 1")
    gone = gone.join(equal, "row", "left").select("row", F.expr("n_common_words DIV coalesce(equal, 1)").alias("n_common_words"))
    measured = word_rules(rows.select("row", "id", "text")).drop("text")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = 100 * (F.col("n_words") - F.col("n_common_words")) < least_left_pct * F.col("n_words")
    out = measured.join(gone, "row", "left").withColumn("n_common_words", F.coalesce("n_common_words", F.lit(0)).cast("bigint"))
    return out.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_common_words",
        failed.alias("base_failed"), (~failed & ~depleted).alias("kept"),
    )
