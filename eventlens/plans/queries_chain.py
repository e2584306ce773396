"""Driver queries for composed operators: the ingest chain through the event store, its alerts, masked search."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlens.operators import chain as H
from eventlens.operators import correlate as C
from eventlens.operators import enrich as E
from eventlens.operators import rules as R
from eventlens.operators.search import search_field
from eventlens.plans import queries_behavior as QB
from eventlens.plans import queries_detect as QD
from eventlens.plans import queries_protect as QP
from eventlens.plans.catalog import query
from eventlens.plans.tables import SEC, sec_events, utc
from eventlens.session import new_path
from eventlens.sources.writers import sink_event_store

W = f"WITH {SEC} "


def ingested(spark, sf):
    """Events sent through the chain, stored, and read back from the store."""
    e = sec_events(spark, sf).withColumn("event_type", F.col("category")).withColumnRenamed("user_name", "user")
    e = e.withColumn("email", F.concat("user", F.lit("@example.com"))).withColumn("file_hash", F.md5("process_name"))
    context = E.enrich_user(QD.user_table(spark, sf)), E.enrich_asset(QD.asset_table(spark, sf)), E.enrich_threat(QD.threat_table(spark, sf))
    path = new_path(spark, "ingested")
    sink_event_store(e.transform(H.ingest(R.DETECTION_RULES, QP.TOKEN_SALT, *context)), path, by="day")
    return spark.read.parquet(path)


CONTEXT = f"""{QD.THREATS}, {QD.ASSETS}, chained AS (SELECT sec.*, c_name, assets.k AS owner, a.k AS ip_threat, b.k AS file_threat
 FROM sec LEFT JOIN customer ON user_name = 'u' || c_custkey LEFT JOIN assets ON assets.key = src_ip
 LEFT JOIN threats a ON dst_ip = a.indicator AND ts < a.last_seen + INTERVAL 1 HOUR LEFT JOIN threats b ON md5(process_name) = b.indicator AND ts < b.last_seen + INTERVAL 1 HOUR)"""
RULES_MET = "['auth-001', 'file-001', 'net-001'], [category = 'authentication' AND status = 'failed', coalesce(file_threat % 2 = 0, false), bytes > 10000000]"


@query(
    "ingest_pipeline",
    W + f""", {CONTEXT} SELECT event_id, tenant AS tenant_id, 'detok_' || {QP.hash_sql("(user_name || '@example.com')", QP.TOKEN_SALT)} AS email, c_name AS user_full_name, 'owner-' || owner AS asset_owner,
    CAST(ip_threat % 2 = 0 AS VARCHAR) AS dst_ip_threat_malicious, array_to_string(list_where({RULES_MET}), ',') AS detections FROM chained""",
)
def _(spark, sf):
    rules = F.array_join(F.array_sort(F.col("detections.rule_id")), ",").alias("detections")
    return ingested(spark, sf).select("event_id", "tenant_id", "email", "user_full_name", "asset_owner", F.col("dst_ip_threat_malicious").cast("string").alias("dst_ip_threat_malicious"), rules)


@query(
    "ingest_alerts",
    W + f""", {CONTEXT}, {QD.KEYED}, {QD._windows(1)}, {QB.ent('tenant')}, {QB.AFTER_HOURS}, {QB.TRAVEL}, {QB.RARE},
    odd AS (SELECT anomaly_type, severity, entity, ts FROM ah UNION ALL SELECT anomaly_type, severity, entity, ts FROM it UNION ALL SELECT anomaly_type, severity, entity, ts FROM rp),
    hot AS (SELECT rule_id, entity_key, max(ts) AS ts FROM inside GROUP BY rule_id, threshold, span, entity_key, window_start HAVING count(*) >= threshold)
    SELECT 'detection' AS kind, rule_id, CASE rule_id WHEN 'auth-001' THEN 'medium' WHEN 'net-001' THEN 'high' ELSE 'critical' END AS severity, NULL AS entity, ts FROM (SELECT unnest(list_where({RULES_MET})) AS rule_id, ts FROM chained)
    UNION ALL SELECT 'correlation', rule_id, 'low', entity_key, ts FROM hot UNION ALL SELECT 'anomaly', 'UEBA-' || anomaly_type, severity, entity, ts FROM odd""",
)
def alerts(spark, sf):
    return H.stored_alerts(ingested(spark, sf), QD.WINDOW_RULES, ("tenant",)).withColumn("ts", utc(F.col("ts")))


# a day of events is squeezed into a quarter of an hour, so that thresholds within minutes are reached
QUICK = "quick AS (SELECT * REPLACE (make_timestamp(epoch_us(ts) // 100) AS ts) FROM ruled)"


@query(
    "correlation_pack",
    W + f""", {QD.RULED}, {QUICK}, hit AS (SELECT 'CORR-001' AS rule_id, 5 AS threshold, 300 AS span, * FROM quick WHERE event_type = 'authentication' AND status = 'failed'
    UNION ALL SELECT 'CORR-002', 10, 60, * FROM quick WHERE event_type = 'network' UNION ALL SELECT 'CORR-003', 1, 60, * FROM quick WHERE direction = 'outbound' AND bytes > 1000000),
    keyed AS (SELECT rule_id, threshold, epoch_us(ts) // 1000000 // span * span AS window_start, unnest(list_filter(['src_ip:' || src_ip, 'user:' || user_name, 'hostname:' || hostname, 'global'], lambda k: k IS NOT NULL)) AS entity_key FROM hit)
    SELECT rule_id, entity_key, window_start, count(*) AS n FROM keyed GROUP BY rule_id, threshold, entity_key, window_start HAVING count(*) >= threshold""",
)
def _(spark, sf):
    e = QD.ruled_events(spark, sf)
    quick = e.withColumn("ts", F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 100)))
    return quick.transform(C.correlate_threshold(R.CORRELATION_RULES)).select("rule_id", "entity_key", "window_start", "n")


@query(
    "search_masked",
    f"""WITH {QP.PII} SELECT doc_id, {QP.hash_sql('email')} AS email, '[REDACTED]' AS ssn, {QP.PARTIAL.format(c='src_ip')} AS src_ip, {QP.PARTIAL.format(c='dst_ip')} AS dst_ip, {QP.hash_sql('phone')} AS phone,
    {QP.masked_sql('"user"')} AS "user", {QP.masked_sql('action')} AS action, {QP.masked_sql('message')} AS message FROM pii WHERE action = 'en'""",
)
def _(spark, sf):
    return H.masked_search(QP.pii_rows(spark, sf).transform(search_field(action="en")), "analyst", QP.MASK_SALT, new_path(spark, "masked"), new_path(spark, "search-audit"))
