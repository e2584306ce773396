"""Start streams over landed tables and write their results where every executor can reach them."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.session import STATE_STORE, new_path

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
STATEFUL_BATCH = 64 << 20


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Keyed state on local disk with changelogs in the checkpoint folder, for queries started inside."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, STATE_STORE)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def stream_table(spark: SparkSession, path: str, max_bytes: int = 1 << 30, files_per_batch: int | None = None) -> DataFrame:
    """Stream of the Parquet files at `path` (a folder or a pattern), with the schema they have now.

    A micro-batch takes at most about `max_bytes` of files. Keyed state reads the rows of one key of a
    batch into one task, so give those queries small batches: `STATEFUL_BATCH`.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    limit = ("maxFilesPerTrigger", files_per_batch) if files_per_batch else ("maxBytesPerTrigger", str(max_bytes))
    return reader.option(*limit).parquet(path)


def run_available(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process all available input, then return what was written.

    Append results go to a Parquet sink (exactly once). Update results are written per batch,
    with the batch number as a column so that the newest row per key can be taken.
    """
    spark = df.sparkSession
    out, checkpoint = new_path(spark, name), new_path(spark, f"{name}-checkpoint")
    with rocksdb_state(spark):
        writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        if mode == "append":
            started = writer.format("parquet").option("path", out).start()
        else:
            started = writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")).start()
        started.awaitTermination()
    reader = spark.read if mode == "append" else spark.read.option("basePath", out)
    return reader.schema(df.schema if mode == "append" else df.schema.add("batch", "long")).parquet(out)


def run_to_now(df: DataFrame, name: str, checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """As `run_available` for sources that know no end: what is there when the stream starts is processed, then it stops.

    With `checkpoint` and `out` of an earlier run, that run is continued.
    """
    spark = df.sparkSession
    out, checkpoint = out or new_path(spark, name), checkpoint or new_path(spark, f"{name}-checkpoint")
    started = df.writeStream.outputMode("append").option("checkpointLocation", checkpoint).format("parquet").option("path", out).start()
    try:
        started.processAllAvailable()
    finally:
        started.stop()
    return spark.read.schema(df.schema).parquet(out)


def newest_per_key(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Last update of each key."""
    values = [c for c in updates.columns if c not in keys]
    latest = updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return latest.select(*keys, "_v.*").drop("batch")
