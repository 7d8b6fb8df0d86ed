"""Registered queries of the subpackage: the given tables mapped to the operators and back."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screentime.llm import (
    byte_pairs, contamination, extraction, language_model, lines, nearcopies, packing, periods, quality, repeats, secrets, whitening
)
from screentime.llm.sql import ORACLES

__all__ = ["ORACLES", "QUERIES", "tokenizer_path"]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as transcript records; ``n_chars`` stays as metadata."""
    documents = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    return documents.select(F.col("doc_id").alias("video_id"), F.col("text").alias("ocr_text"), F.col("source").alias("channel"), "n_chars")


def fold(column: str, parts: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(os.path.join(sf_dir, "labels.parquet")).select(F.col("doc_id").alias("video_id"), "quality")
    out = quality.score_quality(transcripts(spark, sf_dir), labels, learn_from=fold("video_id", 4) != 2, metadata_cols=("n_chars",))
    return out.select(F.col("video_id").alias("doc_id"), (fold("video_id", 4) == 2).alias("held_out"), "score", "predicted")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_model.score_texts(transcripts(spark, sf_dir), learn_from=fold("video_id", 5) != 1)
    return out.select(
        F.col("video_id").alias("doc_id"), (fold("video_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.near_copies(transcripts(spark, sf_dir)).select(F.col("video_id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_main_text(spark.read.parquet(os.path.join(sf_dir, "pages.parquet")))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_sequences(transcripts(spark, sf_dir), tokenizer_path())
    return out.select(F.col("video_id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(os.path.join(sf_dir, "benchmark.parquet"))
    out = contamination.benchmark_matches(transcripts(spark, sf_dir), benchmark)
    return out.select(
        F.col("video_id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", contamination.is_contaminated().alias("contaminated")
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan_secrets(transcripts(spark, sf_dir))
    return out.select(F.col("video_id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.remove_site_boilerplate(transcripts(spark, sf_dir))
    kept = F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    return out.select(F.col("video_id").alias("doc_id"), "n_lines", "n_removed", kept)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.quality_rules(transcripts(spark, sf_dir)).withColumnRenamed("video_id", "doc_id")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeated_passages(transcripts(spark, sf_dir))
    return out.select(F.col("video_id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(os.path.join(sf_dir, "embeddings.parquet")))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    tokens = byte_pairs.encode_texts(transcripts(spark, sf_dir), ranks, public_tokenizers.PATTERN)
    out = byte_pairs.decode_tokens(tokens, ranks, carry_cols=("n_tokens", "token_ids"))
    digest = lambda c: F.sha2(c, 256).alias(c.replace("token_ids", "ids") + "_sha256")
    return out.select(F.col("video_id").alias("doc_id"), "n_tokens", digest("token_ids"), digest("decoded"))


def looped(rows: DataFrame) -> DataFrame:
    """Transcripts of which one in ten repeats its end, as the contract of op13 lays down."""
    h = F.crc32(F.col("video_id").cast("string").cast("binary"))
    words = F.filter(F.split("ocr_text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = rows.withColumn("w", F.when(h % 10 == 0, words)).withColumn("n", F.size("w")).withColumn("g", F.floor(h / 10))
    cut = cut.withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    cut = cut.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    block = F.slice("w", F.col("a") + 1, F.col("p"))
    end = F.slice(F.flatten(F.array_repeat(block, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    text = F.concat_ws(" ", F.concat(F.slice("w", F.lit(1), F.col("a")), end))
    return cut.select("video_id", F.when(F.col("n") > 0, text).otherwise(F.col("ocr_text")).alias("ocr_text"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periods.find_periodic_runs(looped(transcripts(spark, sf_dir)))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("neg"), r["start"].alias("start"), r["period"].alias("period"))))
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return out.withColumn("best", best).select(
        F.col("video_id").alias("doc_id"), F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"),
        (-F.col("best.neg")).alias("length"), F.col("best.period").alias("period"),
        F.expr("-1000 * best.neg DIV best.period").alias("exponent_milli"),
        F.sha2(told.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_machine": op1,
    "op2_context_tree": op2,
    "op3_near_copies": op3,
    "op4_main_text": op4,
    "op5_pack_sequences": op5,
    "op6_benchmark_matches": op6,
    "op7_secret_scan": op7,
    "op8_site_boilerplate": op8,
    "op9_quality_rules": op9,
    "op10_repeated_passages": op10,
    "op11_whitening": op11,
    "op12_byte_pairs": op12,
    "op13_periodic_runs": op13,
}
