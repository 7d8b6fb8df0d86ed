"""Shared helpers: words, hashes, Arrow passes, tables in the shared folder, bounded filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from screentime.session import scratch_path

#: Rows in an Arrow batch: texts are long, so fewer than Spark's 10,000.
BATCH_ROWS = 1000
#: Words a worker remembers before it starts anew.
REMEMBERED_WORDS = 400_000


def arrow_map(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType
) -> DataFrame:
    """``mapInArrow`` over batches of at most ``BATCH_ROWS`` texts (sets the session's batch size)."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: lineage ends there, any executor can read it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def carried(columns: Sequence[str]) -> Column:
    """Columns that an Arrow pass hands on unread, as one column ``carry``."""
    return (F.struct(*(F.col(c) for c in columns)) if columns else F.lit(None).cast("string")).alias("carry")


def schema_of(df: DataFrame, names: Sequence[str], more: str) -> StructType:
    """Fields of ``df`` followed by new ones."""
    return StructType([df.schema[n] for n in names] + StructType.fromDDL(more).fields)


def smallest_hashes(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """The about ``rows`` rows whose 64-bit ``key`` is smallest; only keys meet in one place, not texts."""
    cut = df.select(key.alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    return df.where(key <= F.lit(cut)) if cut is not None else df.limit(0)


def row_key(*cols: str) -> Column:
    """A 64-bit key of a record: equal records share it, so repeated rows stay harmless."""
    return F.xxhash64(*(F.col(c) for c in cols))


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column, null as empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """Word to 64-bit hash, remembered; ``trim`` between batches bounds it."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def trim(self) -> None:
        if len(self) > REMEMBERED_WORDS:
            self.clear()

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of ``n`` consecutive word hashes; empty when there are fewer."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    acc = words[:count].copy()
    for j in range(1, n):
        acc *= np.uint64(0x9E3779B97F4A7C15)
        acc += words[j : j + count]
    return mix(acc)


def batch(names: list[str], *arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], names=names)


class Bitmap:
    """Fixed-size filter over 64-bit hashes: no false negatives, two bits a value.

    Its size is a constant, so it may be broadcast at any input size; when it fills
    up it lets more rows pass, and the exact step behind it drops them.
    """

    def __init__(self, words: np.ndarray, log2_bits: int):
        self.words, self.log2_bits = words, log2_bits

    @classmethod
    def build(cls, df: DataFrame, column: str, log2_bits: int = 25) -> Bitmap:
        mask = (1 << log2_bits) - 1
        value = F.col(column)
        spots = df.select(F.explode(F.array(F.shiftrightunsigned(value, 64 - log2_bits), value.bitwiseAND(F.lit(mask)))).alias("p"))
        cells = (
            spots.select(F.shiftright("p", 6).alias("cell"), F.expr("shiftleft(1L, CAST(p & 63 AS INT))").alias("bit"))
            .groupBy("cell")
            .agg(F.bit_or("bit").alias("bits"))
            .toArrow()
        )
        words = np.zeros(1 << (log2_bits - 6), np.uint64)
        words[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy().view(np.uint64)
        return cls(words, log2_bits)

    def has(self, values: np.ndarray) -> np.ndarray:
        def bit(p):
            return (self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1)

        return (bit(values >> np.uint64(64 - self.log2_bits)) & bit(values & np.uint64((1 << self.log2_bits) - 1))).astype(bool)


def broadcast(spark: SparkSession, value):
    """A broadcast of data whose size its caller bounds."""
    return spark.sparkContext.broadcast(value)
