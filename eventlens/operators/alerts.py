"""Alerts, incidents, staged responses and rule backtests."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.functions.ordered import FOLD_ROWS, Runs, greedy_spaced
from eventlens.functions.spans import span_seconds
from eventlens.operators.correlate import correlate_related
from eventlens.operators.rules import Rule, matched


def route_alerts(correlations: DataFrame | None = None, detections: DataFrame | None = None, anomalies: DataFrame | None = None) -> DataFrame:
    """One alert table from correlation matches, detections and behaviour anomalies.

    Inputs need rule_id, rule_name, severity, source, ts (anomalies: anomaly_type, description).
    `event_id` is kept where all inputs have it; `dedup_alerts` needs it to tell alerts apart.
    """
    given = [f for f in (correlations, detections, anomalies) if f is not None]
    kept = ["event_id"] if all("event_id" in f.columns for f in given) else []
    parts = []
    if correlations is not None:
        at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
        parts.append(
            correlations.select(
                F.col("rule_id").alias("alert_id"),
                F.concat(F.lit("Correlation: "), "rule_name").alias("title"),
                F.concat(F.lit("Correlation rule triggered at "), at).alias("description"),
                "severity",
                "source",
                "ts",
                *kept,
            )
        )
    if detections is not None:
        parts.append(
            detections.select(
                F.col("rule_id").alias("alert_id"),
                F.concat(F.lit("Detection: "), "rule_name").alias("title"),
                F.concat(F.lit("Detection rule triggered for event from "), "source").alias("description"),
                "severity",
                "source",
                "ts",
                *kept,
            )
        )
    if anomalies is not None:
        parts.append(
            anomalies.select(
                F.concat(F.lit("UEBA-"), "anomaly_type").alias("alert_id"),
                F.concat(F.lit("UEBA: "), "anomaly_type").alias("title"),
                "description",
                "severity",
                "source",
                "ts",
                *kept,
            )
        )
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def dedup_alerts(window: str = "5m", tie: str = "event_id", fold_rows: int = FOLD_ROWS, group_rows: int | None = None):
    """Drop alerts of the same id and title that follow a passed one within the window."""

    def apply(df: DataFrame) -> DataFrame:
        keyed = df.withColumn("_key", F.concat_ws(":", "alert_id", "title")).withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp")))
        gap = span_seconds(window) * 1_000_000
        flagged = greedy_spaced(keyed, ["_key"], "_at", gap, [tie], "_passed", fold_rows, group_rows)
        return flagged.where("_passed").select(*df.columns)

    return apply


def promote_incidents(signals: DataFrame) -> DataFrame:
    """Incidents for signals of severity high or critical, with one system journal entry."""
    journal = F.array(
        F.struct(
            F.col("ts").alias("ts"),
            F.lit("System").alias("author"),
            F.concat(F.lit("Incident created automatically from detection signal "), F.col("signal_id")).alias("message"),
            F.lit("system").alias("type"),
        )
    )
    return signals.where(F.col("severity").isin("high", "critical")).select(
        F.concat(F.lit("INC-"), "signal_id").alias("incident_id"),
        F.concat(F.lit("Detection: "), "rule_name").alias("title"),
        F.col("message").alias("description"),
        "severity",
        F.lit("New").alias("status"),
        F.array("signal_id").alias("source_signals"),
        journal.alias("journal"),
        F.col("ts").alias("created_at"),
        "risk_score",
    )


def incident_journal(changes: DataFrame, order: list[str] | None = None, group_rows: int | None = None) -> DataFrame:
    """Changes as journal rows with text; `from` in a status change is the status before it."""
    order = order or ["ts", "change_id"]
    runs = Runs(changes, ["incident_id"], order, group_rows)
    told = runs.before(_from=("last", F.when(F.col("kind") == "status", F.col("value")))).done()
    message = (
        F.when(
            F.col("kind") == "status",
            F.concat(F.lit("Status changed from "), F.coalesce("_from", F.lit("New")), F.lit(" to "), F.col("value")),
        )
        .when(F.col("kind") == "assign", F.concat(F.lit("Incident assigned to "), F.col("value")))
        .otherwise(F.col("value"))
    )
    kind = F.when(F.col("kind") == "note", "note").otherwise("system")
    return told.select(*changes.columns, message.alias("message"), kind.alias("type"))


def incident_latest(changes: DataFrame) -> DataFrame:
    """Current status and assignee, note count and last update per incident."""
    at = F.struct("ts", "change_id")
    latest = lambda kind: F.max_by("value", F.when(F.col("kind") == kind, at))
    return changes.groupBy("incident_id").agg(
        F.coalesce(latest("status"), F.lit("New")).alias("status"),
        latest("assign").alias("assignee"),
        F.count_if(F.col("kind") == "note").alias("notes"),
        F.max("ts").alias("updated_at"),
    )


def stage_actions(correlations: DataFrame | None = None, anomalies: DataFrame | None = None) -> DataFrame:
    """Pending responses: block the source address of critical correlations; for high anomalies
    block the entity if it is an address, else disable the user."""
    parts = []
    if correlations is not None:
        hot = correlations.where("severity = 'critical' and src_ip is not null")
        parts.append(hot.select(F.lit("block_ip").alias("action"), F.col("src_ip").alias("entity"), "severity", "ts", F.lit("pending").alias("status")))
    if anomalies is not None:
        hot = anomalies.where("severity = 'high'")
        action = F.when(F.col("entity").contains("."), "block_ip").otherwise("disable_user")
        parts.append(hot.select(action.alias("action"), "entity", "severity", "ts", F.lit("pending").alias("status")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def rule_backtest(
    events: DataFrame,
    detection_rules: Iterable[Rule] = (),
    correlation_rules: Iterable[Rule] = (),
    anomalies: DataFrame | None = None,
    event_id: str = "event_id",
    ts: str = "ts",
) -> DataFrame:
    """Per event: matched detections, correlations whose window it is in, anomaly count, and whether any applies."""
    detection_rules, correlation_rules = list(detection_rules), list(correlation_rules)
    found = matched(events, detection_rules) if detection_rules else F.array()
    result = events.select(event_id, F.array_sort(F.transform(found, lambda d: d["rule_id"])).alias("detections"))
    if correlation_rules:
        related = correlate_related(events, correlation_rules, ts=ts, event_id=event_id).select(F.col("event_id").alias("_e"), "rule_id").distinct()
        # one array per event, at most as long as the rule list
        lists = related.groupBy("_e").agg(F.array_sort(F.collect_list("rule_id")).alias("correlations"))
        result = result.join(lists, result[event_id] == lists["_e"], "left").drop("_e")
    else:
        result = result.withColumn("correlations", F.lit(None).cast("array<string>"))
    if anomalies is not None:
        counts = anomalies.groupBy(F.col(event_id).alias("_e")).agg(F.count(F.lit(1)).alias("anomalies"))
        result = result.join(counts, result[event_id] == counts["_e"], "left").drop("_e")
    else:
        result = result.withColumn("anomalies", F.lit(0).cast("bigint"))
    result = result.fillna(0, ["anomalies"]).withColumn("correlations", F.coalesce("correlations", F.array().cast("array<string>")))
    fired = (F.size("detections") > 0) | (F.size("correlations") > 0) | (F.col("anomalies") > 0)
    return result.withColumn("triggered", fired)


def backtest_totals(result: DataFrame) -> DataFrame:
    return result.agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if("triggered").alias("triggered"),
        F.coalesce(F.sum(F.size("detections")), F.lit(0)).alias("detections"),
        F.coalesce(F.sum(F.size("correlations")), F.lit(0)).alias("correlations"),
        F.coalesce(F.sum("anomalies"), F.lit(0)).alias("anomalies"),
    )
