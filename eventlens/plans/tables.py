"""Test-data tables and the security-shaped views derived from them.

The same expressions serve Spark (`selectExpr`) and the SQL check (`SEC`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


SEC_COLUMNS = {
    "event_id": "event_id",
    "ts": "CAST(ts AS TIMESTAMP)",
    "event_type": "event_type",
    "source": "CASE event_type WHEN 'error' THEN 'auth-server' WHEN 'signup' THEN 'auth-server' WHEN 'purchase' THEN 'web-gateway' "
    "WHEN 'click' THEN 'endpoint-pc-04' ELSE 'firewall-01' END",
    "user_name": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE concat('u', CAST(user_id AS VARCHAR(20))) END",
    "src_ip": "concat('10.', CAST(user_id % 4 AS VARCHAR(20)), '.', CAST(event_id % 3 AS VARCHAR(20)), '.', CAST(user_id % 250 + 1 AS VARCHAR(20)))",
    "dst_ip": "concat('198.51.100.', CAST(event_id % 50 AS VARCHAR(20)))",
    "hostname": "concat('h', CAST(event_id % 20 AS VARCHAR(20)))",
    "category": "CASE WHEN event_type IN ('error','signup') THEN 'authentication' ELSE 'network' END",
    "action": "CASE event_type WHEN 'error' THEN 'login_failed' WHEN 'signup' THEN 'login' WHEN 'purchase' THEN 'file_access' "
    "WHEN 'click' THEN 'connection_allow' ELSE 'connection_deny' END",
    "status": "CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END",
    "direction": "CASE WHEN event_id % 2 = 0 THEN 'outbound' ELSE 'inbound' END",
    "bytes": "value * 100000",
    "value": "value",
    "process_name": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('p', CAST((event_id * event_id) % 37 AS VARCHAR(20))) END",
    "tenant": "concat('t', CAST(user_id % 3 AS VARCHAR(20)))",
    "message": "concat('user u', CAST(user_id AS VARCHAR(20)), ' ', event_type, ' on h', CAST(event_id % 20 AS VARCHAR(20)))",
    "props": "props",
}

SEC = "sec AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in SEC_COLUMNS.items()) + " FROM events)"


def sec_events(spark: SparkSession, sf: str) -> DataFrame:
    """Security events over the `events` table."""
    return table(spark, sf, "events").selectExpr(*[f"{e} AS {n}" for n, e in SEC_COLUMNS.items()])


def utc(col):
    """Zone-free timestamp, the type the SQL check returns."""
    return col.cast("timestamp_ntz")
