"""Event store, JSON and CSV exports, dead letters and audit rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def store_layout(df: DataFrame, shards: int = 4, ts: str = "ts", source: str = "source") -> DataFrame:
    """Add the partition columns `date` and `hour`, and `shard`, a number per source."""
    at = F.col(ts).cast("timestamp")
    return df.withColumns({"date": F.to_date(at), "hour": F.hour(at), "shard": F.pmod(F.xxhash64(source), F.lit(shards)).cast("int")})


def sink_event_store(df: DataFrame, path: str, shards: int = 4, by: str = "hour", mode: str = "append", rows_per_file: int = 5_000_000) -> None:
    """Write hour (or `by="day"`) partitions; within a file rows are clustered by source shard.

    Rebalancing lets adaptive execution merge small hours into one task and split an hour
    that holds far more than the others, so a busy hour or source is not written by one task.
    """
    folders = ["date", "hour"] if by == "hour" else ["date"]
    placed = store_layout(df, shards).hint("rebalance", *folders)
    ordered = placed.sortWithinPartitions(*folders, "shard", "ts")
    ordered.write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy(*folders).parquet(path)


def stream_event_store(df: DataFrame, path: str, checkpoint: str, shards: int = 4):
    """The same layout from a stream; each micro-batch is appended once."""
    writer = store_layout(df, shards).writeStream.format("parquet").partitionBy("date", "hour")
    return writer.option("path", path).option("checkpointLocation", checkpoint)


def sink_jsonl(df: DataFrame, path: str, rows_per_file: int = 1_000_000, mode: str = "append") -> None:
    """JSON lines in segments of limited size."""
    df.write.mode(mode).option("maxRecordsPerFile", rows_per_file).json(path)


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header and every value quoted, quotes doubled."""
    df.write.mode(mode).option("header", "true").option("quoteAll", "true").option("escape", '"').csv(path)


def export_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line, NULL fields included; one array would need a single writer."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def split_records(df: DataFrame, error: Column, at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Good rows, and dead letters with error text, time and retry count."""
    marked = df.withColumn("error", error)
    good = marked.where("error is null").drop("error")
    bad = marked.where("error is not null").withColumn("failed_at", F.current_timestamp() if at is None else at)
    return good, bad.withColumn("retries", F.lit(0))


def reprocess(letters: DataFrame, error: Column, at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Try dead letters again: successes leave the queue, failures stay with one more retry."""
    tried = letters.drop("error").withColumn("error", error)
    good = tried.where("error is null").drop("error", "failed_at", "retries")
    again = tried.where("error is not null").withColumn("failed_at", F.current_timestamp() if at is None else at)
    return good, again.withColumn("retries", F.col("retries") + 1)


def sink_dead_letter(path_good: str, path_bad: str, error: Callable[[DataFrame], Column]):
    """`foreachBatch` function: one pass over the cached micro-batch, two writes."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            good, bad = split_records(batch, error(batch))
            # a folder per batch makes a replayed batch overwrite itself
            good.write.mode("overwrite").parquet(f"{path_good}/batch={batch_id}")
            bad.write.mode("overwrite").parquet(f"{path_bad}/batch={batch_id}")
        finally:
            batch.unpersist()

    return write


AUDIT = "audit_id string, ts timestamp, actor string, action string, resource string, status string, result_hash string, rows bigint, details string"


def audited_write(df: DataFrame, path: str, audit_path: str, actor: str, action: str, details: str = "") -> None:
    """Write a result and append one audit row with its row count and an order-independent hash.

    The hash is the sum of the rows' hashes, so that repeated rows count too. Both figures are observed while the result is written, so there is no second pass.
    """
    spark = df.sparkSession
    watch = Observation(f"audit-{uuid.uuid4().hex}")
    values = F.xxhash64(*df.columns)
    counted = df.observe(watch, F.count(F.lit(1)).alias("rows"), F.sum(values.cast("decimal(38,0)")).alias("hash"))
    status, figures = "success", {}
    try:
        counted.write.mode("overwrite").parquet(path)
        figures = watch.get
    except Exception:
        status = "failure"
        raise
    finally:
        digest = f"{int(figures.get('hash') or 0) & (2**64 - 1):016x}"
        row = spark.range(1).select(
            F.lit(uuid.uuid4().hex).alias("audit_id"),
            F.current_timestamp().alias("ts"),
            F.lit(actor).alias("actor"),
            F.lit(action).alias("action"),
            F.lit(path).alias("resource"),
            F.lit(status).alias("status"),
            F.lit(digest).alias("result_hash"),
            F.lit(figures.get("rows")).cast("bigint").alias("rows"),
            F.lit(details).alias("details"),
        )
        row.write.mode("append").parquet(audit_path)
