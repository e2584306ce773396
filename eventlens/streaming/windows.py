"""Streaming forms of the windowed, deduplicating, detecting and enriching operators.

Every function takes and returns a streaming DataFrame. `delay` is how long after the newest
event a late one is still counted; later ones are dropped by the watermark (see `late_split`).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.functions.fields import event_time
from eventlens.functions.spans import span_seconds
from eventlens.operators.correlate import rule_matches
from eventlens.operators.lifecycle import dedup_key
from eventlens.operators.rules import Rule, detect_rules
from eventlens.operators.stats import aggregate_columns, group_key
from eventlens.streaming.stateful import Spaced


def stream_timechart(events: DataFrame, span: str, aggs=(("count", None),), by: tuple[str, ...] = (), delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Tumbling time chart; a bucket is emitted once the watermark has passed its end."""
    seconds = span_seconds(span)
    timed = event_time(events, ts).withWatermark(ts, delay)
    grouped = timed.groupBy(F.window(ts, f"{seconds} seconds"), *[group_key(timed, b) for b in by])
    chart = grouped.agg(*aggregate_columns(timed, aggs))
    return chart.select(F.col("window.start").alias("_time"), *by, *[c for c in chart.columns if c not in ("window", *by)], F.lit(seconds).alias("_span"))


def stream_threshold(events: DataFrame, rules: Iterable[Rule], slides: int = 1, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Windows in which a key reaches a rule's threshold; one aggregation per window length."""
    rules = list(rules)
    parts = []
    for span in sorted({span_seconds(r.window) for r in rules}):
        same = [r for r in rules if span_seconds(r.window) == span]
        hits = rule_matches(event_time(events, ts), same, ts).withWatermark("ts", delay)
        window = F.window("ts", f"{span} seconds", f"{max(1, span // slides)} seconds")
        keys = ["rule_id", "rule_name", "severity", "threshold", "entity_key"]
        counted = hits.groupBy(window, *keys).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        found = counted.where("n >= threshold").select(*keys, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n", "first_ts", "last_ts")
        parts.append(found)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def stream_idle(events: DataFrame, rules: Iterable[Rule], gap: str = "5m", delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Windows per rule and key that live while matches keep arriving within `gap`."""
    hits = rule_matches(event_time(events, ts), list(rules), ts).withWatermark("ts", delay)
    session = F.session_window("ts", f"{span_seconds(gap)} seconds")
    keys = ["rule_id", "rule_name", "severity", "threshold", "entity_key"]
    counted = hits.groupBy(session, *keys).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return counted.where("n >= threshold").drop("session_window")


def stream_dedup(events: DataFrame, ttl: str = "5m", event_id: str = "id", ts: str = "ts", delay: str = "10 minutes", tie: str = "event_id") -> DataFrame:
    """Drop events whose key was last accepted less than `ttl` before, in event time, however rows fall into batches."""
    timed = event_time(events, ts).withColumn("_key", dedup_key(events, event_id)).withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp")))
    schema = T.StructType([f for f in timed.schema if f.name not in ("_key", "_at")])
    grouped = timed.withWatermark(ts, delay).groupBy("_key")
    return grouped.transformWithState(Spaced(span_seconds(ttl), schema.names, tie), schema, "append", "eventtime")


def stream_detect(events: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Stateless detection: the batch operator as it is."""
    return events.transform(detect_rules(rules))


def stream_enrich(events: DataFrame, *steps) -> DataFrame:
    """Lookups against static tables; each step is an enrichment function of `operators.enrich`."""
    for step in steps:
        events = events.transform(step)
    return events


def stream_features(updates: DataFrame, window: str = "1h", delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Running count, sum, mean and maximum per entity, feature and window, for update mode."""
    timed = event_time(updates, ts).withWatermark(ts, delay)
    grouped = timed.groupBy(F.window(ts, f"{span_seconds(window)} seconds"), "entity", "feature")
    features = grouped.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("value").alias("total"),
        F.avg("value").alias("mean"),
        F.greatest(F.lit(0.0), F.max("value")).alias("highest"),
    )
    return features.select(F.col("window.start").alias("window_start"), "entity", "feature", "n", "total", "mean", "highest")


def late_split(on_time: str, late: str, seen: str, delay: str, ts: str = "ts"):
    """`foreachBatch` function that writes rows older than (newest time of earlier batches − delay) apart.

    The newest time per batch is kept as a one-row table under `seen`, so a restarted query
    goes on with the same limit and a replayed batch overwrites its own output.
    """
    seconds = span_seconds(delay)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            limit = None
            if batch_id > 0:
                # one row per earlier batch
                limit = spark.read.parquet(seen).where(F.col("batch") < batch_id).agg(F.max("newest")).first()[0]
            is_late = F.lit(False) if limit is None else F.unix_micros(F.col(ts).cast("timestamp")) < limit - seconds * 1_000_000
            batch.where(~is_late).write.mode("overwrite").parquet(f"{on_time}/batch={batch_id}")
            batch.where(is_late).write.mode("overwrite").parquet(f"{late}/batch={batch_id}")
            newest = batch.agg(F.max(F.unix_micros(F.col(ts).cast("timestamp"))).alias("newest"))
            newest.write.mode("overwrite").parquet(f"{seen}/batch={batch_id}")
        finally:
            batch.unpersist()

    return write
