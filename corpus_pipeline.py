"""Training-data pipeline over documents: quality, boilerplate lines, near-copies, benchmark passages, packing."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screentime.llm import contamination, lines, nearcopies, packing, quality
from screentime.llm.common import table
from screentime.llm.queries import fold, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Stages after the first need more than one kind of text, so SQL cannot express the run.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels outside its held-out fold."""
    labels = spark.read.parquet(os.path.join(sf_dir, "labels.parquet"))
    scored = quality.score_quality(
        docs, labels, "doc_id", "text", learn_from=fold("doc_id", 4) != 2, metadata_cols=("n_chars",), carry_cols=COLUMNS[1:]
    )
    return scored.where("predicted = 1").select(*COLUMNS)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sources share; every document stays."""
    cut = lines.remove_site_boilerplate(docs, "doc_id", "text", "source", carry_cols=("lang", "source"))
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("bigint").alias("n_chars"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies."""
    return nearcopies.keep_one_of_each(docs, "doc_id", "text").select(*COLUMNS)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage of weight."""
    benchmark = spark.read.parquet(os.path.join(sf_dir, "benchmark.parquet"))
    found = contamination.benchmark_matches(docs, benchmark, "doc_id", "text", carry_cols=COLUMNS[1:])
    return found.where(~contamination.is_contaminated()).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in training sequences."""
    out = packing.pack_sequences(docs, tokenizer_path(), "doc_id", "text")
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("line_dedup", without_boilerplate),
    ("near_dedup", without_near_copies),
    ("decontamination", uncontaminated),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written below the shared folder and read again."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
