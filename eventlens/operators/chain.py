"""Operators composed as a deployment runs them: ingest, alerts of what was stored, masked search."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.operators.behavior import ENTITY_FIELDS, ueba_anomalies
from eventlens.operators.correlate import correlate_threshold
from eventlens.operators.privacy import mask_by_role, tokenize_pii
from eventlens.operators.risk import anomaly_increments, risk_score
from eventlens.operators.rules import Rule, matched
from eventlens.operators.tenancy import tenant_id
from eventlens.sources.writers import audited_write

Step = Callable[[DataFrame], DataFrame]


def ingest(rules: Iterable[Rule], salt: str, *context: Step) -> Step:
    """Each event with `tenant_id`, personal data as tokens, the columns of the `context` lookups, and `detections`.

    Lookups run in the order given and see plain values; rules see what the lookups added. `detections` is an
    array of the rules matched, empty for most events, so that storing it needs one pass and keeps every event.
    """
    rules = list(rules)

    def apply(df: DataFrame) -> DataFrame:
        rows = tenant_id(df)
        for step in context:
            rows = rows.transform(step)
        rows = rows.withColumn("detections", matched(rows, rules))
        return rows.transform(tokenize_pii(salt=salt))

    return apply


def stored_alerts(stored: DataFrame, correlations: Iterable[Rule], entity=ENTITY_FIELDS, group_rows: int | None = None) -> DataFrame:
    """Alerts of stored events as (kind, rule_id, severity, entity, ts): detections, correlated windows, anomalies.

    A detection names no entity; a window's time is its last event's.
    """
    at = F.col("ts").cast("timestamp").alias("ts")
    found = stored.select(at, F.inline("detections")).select(F.lit("detection").alias("kind"), "rule_id", "severity", F.lit(None).cast("string").alias("entity"), "ts")
    windows = correlate_threshold(correlations)(stored).select(F.lit("correlation").alias("kind"), "rule_id", "severity", F.col("entity_key").alias("entity"), F.col("last_ts").alias("ts"))
    odd = ueba_anomalies(stored, entity, group_rows=group_rows)
    return found.union(windows).union(odd.select(F.lit("anomaly").alias("kind"), F.concat(F.lit("UEBA-"), "anomaly_type").alias("rule_id"), "severity", "entity", at))


def alert_risk(alerts: DataFrame) -> DataFrame:
    """Risk score per entity from the anomalies among the alerts."""
    return risk_score(anomaly_increments(alerts.where("kind = 'anomaly'")))


def masked_search(found: DataFrame, role: str, salt: str, path: str, audit_path: str, details: str = "") -> DataFrame:
    """What a role may see of a search result: masked, written to `path`, with one audit row, and read back."""
    masked = found.transform(mask_by_role(role, salt))
    audited_write(masked, path, audit_path, role, "SEARCH", details)
    return found.sparkSession.read.schema(masked.schema).parquet(path)
