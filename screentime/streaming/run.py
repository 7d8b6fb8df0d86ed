"""Bounded runs of streaming queries into tables of the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screentime.session import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """File stream over one table of a data folder."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _append(df: DataFrame, path: str) -> None:
    query = (
        df.writeStream.outputMode("append").format("parquet").option("path", f"{path}/table")
        .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_append(df: DataFrame, name: str) -> DataFrame:
    """Run to the end of the available input with a file sink; read the table back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    _append(df, path)
    return spark.read.schema(df.schema).parquet(f"{path}/table")


def run_append_arrivals(arrivals: list[DataFrame], transform: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """As ``run_append`` over row sets that arrive one after the other, in one stream's state."""
    spark = arrivals[0].sparkSession
    path = scratch_path(spark, name)
    df = None
    for rows in arrivals:
        rows.write.mode("append").parquet(f"{path}/in")
        df = transform(spark.readStream.schema(rows.schema).parquet(f"{path}/in"))
        _append(df, path)
    return spark.read.schema(df.schema).parquet(f"{path}/table")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that stateful processors need, for the streams started inside."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def run_stateful(df_of, spark: SparkSession, name: str) -> DataFrame:
    """As ``run_append`` with the RocksDB state store."""
    with rocksdb(spark):
        return run_append(df_of(), name)


def _changes(df: DataFrame, path: str) -> None:
    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table/batch={number}")

    query = (
        df.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def _newest(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    stored = df.sparkSession.read.option("basePath", f"{path}/table").parquet(f"{path}/table")
    return stored.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def run_update(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Update mode through ``foreachBatch``: every changed row is stored with its batch
    number, and the newest row of a key is the result. A replayed batch overwrites
    its own folder."""
    path = scratch_path(df.sparkSession, name)
    _changes(df, path)
    return _newest(df, path, keys)


def run_arrivals(arrivals: list[DataFrame], transform: Callable[[DataFrame], DataFrame], name: str, keys: list[str]) -> DataFrame:
    """As ``run_update`` over row sets that arrive one after the other.

    Each set is added to the folder the stream reads and run to its end before the next
    one comes; the state and the watermark live on in the stream's checkpoint.
    """
    spark = arrivals[0].sparkSession
    path = scratch_path(spark, name)
    df = None
    for rows in arrivals:
        rows.write.mode("append").parquet(f"{path}/in")
        df = transform(spark.readStream.schema(rows.schema).parquet(f"{path}/in"))
        _changes(df, path)
    return _newest(df, path, keys)


def progress_table(df: DataFrame, name: str, by: str, counters: dict) -> DataFrame:
    """Counters per batch and value of ``by``, written by ``foreachBatch``: distinct values
    of any number of batches can be counted, and the other counters add up."""
    spark = df.sparkSession
    path = scratch_path(spark, name)

    def store(batch: DataFrame, number: int) -> None:
        counted = batch.groupBy(by).agg(*[c.alias(n) for n, c in counters.items()])
        counted.write.mode("overwrite").parquet(f"{path}/table/batch={number}")

    query = df.writeStream.foreachBatch(store).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.option("basePath", f"{path}/table").parquet(f"{path}/table")


def with_sentinel(rows: DataFrame, newest: DataFrame, after: str, **values) -> DataFrame:
    """Add one far later row, so that the watermark passes every real one.

    The row comes from a one-row table next to the run's state, stamped ``after`` the
    newest ``ts`` of the batch table ``newest``; ``values`` mark it, other columns are null.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, "sentinel")
    last = newest.agg((F.max("ts").cast("timestamp") + F.expr(f"INTERVAL {after}")).alias("ts"))
    columns = [F.col("ts") if f.name == "ts" else F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema]
    last.select(*columns).write.parquet(path)
    return rows.unionByName(spark.readStream.schema(rows.schema).parquet(path))
