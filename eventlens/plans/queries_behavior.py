"""Driver queries for behaviour baselines, features, anomalies and risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlens.operators import behavior as B
from eventlens.operators import risk as K
from eventlens.operators.shape import top_entities
from eventlens.plans.catalog import query
from eventlens.plans.tables import SEC, sec_events, table, utc

W = f"WITH {SEC} "
PRIOR = "ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

AFTER_HOURS = f"""ah AS (SELECT event_id, entity, ts, source, 'AfterHoursActivity' AS anomaly_type, 'medium' AS severity FROM ent
 QUALIFY count(*) OVER (PARTITION BY entity {PRIOR}) > 50 AND count(*) OVER (PARTITION BY entity, hour(ts) {PRIOR}) < count(*) OVER (PARTITION BY entity {PRIOR}) // 48)"""
TRAVEL = f"""it AS (SELECT event_id, entity, ts, source, 'ImpossibleTravel' AS anomaly_type, 'high' AS severity FROM ent
 QUALIFY last_value(src_ip IGNORE NULLS) OVER (PARTITION BY entity {PRIOR}) <> src_ip AND epoch_us(ts) - max(epoch_us(ts)) OVER (PARTITION BY entity {PRIOR}) < 300000000)"""
RARE = f"""nth AS (SELECT *, row_number() OVER (PARTITION BY entity, process_name ORDER BY ts, event_id) AS nth FROM ent WHERE process_name IS NOT NULL),
 seen AS (SELECT *, count(*) OVER (PARTITION BY entity {PRIOR}) AS total, coalesce(sum(CASE WHEN nth = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY entity {PRIOR}), 0) AS known FROM nth),
 rp AS (SELECT event_id, entity, ts, source, 'RareProcess' AS anomaly_type, CASE WHEN nth = 1 THEN 'high' ELSE 'medium' END AS severity FROM seen
 WHERE (nth = 1 AND known > 10) OR (nth > 1 AND total > 100 AND nth - 1 < total // 100))"""


def ent(expr):
    return f"ent AS (SELECT *, {expr} AS entity FROM sec)"


@query("ueba_after_hours", W + f", {ent('tenant')}, {AFTER_HOURS} SELECT event_id, entity, severity FROM ah")
def _(spark, sf):
    return B.ueba_after_hours(sec_events(spark, sf), ("tenant",)).select("event_id", "entity", "severity")


@query("ueba_after_hours_by_user", W + f", {ent('coalesce(user_name, src_ip)')}, {AFTER_HOURS} SELECT event_id, entity, severity FROM ah")
def _(spark, sf):
    return B.ueba_after_hours(sec_events(spark, sf)).select("event_id", "entity", "severity")


@query("ueba_impossible_travel", W + f", {ent('tenant')}, {TRAVEL} SELECT event_id, entity, severity FROM it")
def _(spark, sf):
    return B.ueba_impossible_travel(sec_events(spark, sf), ("tenant",)).select("event_id", "entity", "severity")


@query("ueba_rare_process", W + f", {ent('hostname')}, {RARE} SELECT event_id, entity, severity FROM rp")
def _(spark, sf):
    return B.ueba_rare_process(sec_events(spark, sf), ("hostname",)).select("event_id", "entity", "severity")


@query(
    "ueba_anomalies",
    W + f", {ent('tenant')}, {AFTER_HOURS}, {TRAVEL}, {RARE} SELECT * FROM ah UNION ALL SELECT * FROM it UNION ALL SELECT * FROM rp",
)
def _(spark, sf):
    return B.ueba_anomalies(sec_events(spark, sf), ("tenant",)).drop("description").withColumn("ts", utc(F.col("ts")))


@query(
    "ueba_profile",
    W + f""", {ent('coalesce(user_name, src_ip)')} SELECT entity, count(*) AS total_activity, array_to_string(list_transform(range(0, 24), lambda h: len(list_filter(list(hour(ts)), lambda x: x = h))), ',') AS hour_baseline,
    count(DISTINCT src_ip) AS unique_ips, count(DISTINCT process_name) AS unique_procs FROM ent GROUP BY 1""",
)
def _(spark, sf):
    out = B.ueba_profile(sec_events(spark, sf))
    return out.withColumn("hour_baseline", F.array_join(F.col("hour_baseline").cast("array<string>"), ","))


FEATURED = """fe AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN 'r' || event_id END AS resource, CASE WHEN direction = 'outbound' THEN bytes END AS bytes_out, CASE WHEN event_id % 3 = 0 THEN value / 3 END AS cpu_usage FROM sec),
 rows_ AS (SELECT 'user:' || user_name AS entity, 'login_count_1h' AS feature, 1.0 AS v, ts FROM fe WHERE user_name IS NOT NULL AND action = 'login'
 UNION ALL SELECT 'user:' || user_name, 'resource_access_count_1h', 1.0, ts FROM fe WHERE user_name IS NOT NULL AND resource IS NOT NULL
 UNION ALL SELECT 'ip:' || src_ip, 'bytes_out_1h', bytes_out, ts FROM fe WHERE bytes_out IS NOT NULL
 UNION ALL SELECT 'asset:' || hostname, 'cpu_avg_1h', cpu_usage, ts FROM fe WHERE cpu_usage IS NOT NULL)"""


def featured(spark, sf):
    e = sec_events(spark, sf)
    e = e.withColumn("resource", F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("r"), F.col("event_id").cast("string"))))
    return e.withColumn("bytes_out", F.when(F.col("direction") == "outbound", F.col("bytes"))).withColumn("cpu_usage", F.when(F.col("event_id") % 3 == 0, F.col("value") / 3))


@query(
    "extract_features",
    W + f""", {FEATURED} SELECT entity, feature, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, round(CASE WHEN feature = 'cpu_avg_1h' THEN avg(v) ELSE sum(v) END, 4)::DOUBLE AS value, count(*) AS n
    FROM rows_ GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    out = B.extract_features(featured(spark, sf)).drop("ts")
    return out.withColumn("window_start", utc(F.col("window_start"))).withColumn("value", F.round("value", 4))


@query(
    "feature_ops",
    """WITH u AS (SELECT user_id AS entity, event_type AS feature, CASE event_type WHEN 'error' THEN 'set' WHEN 'view' THEN 'inc' WHEN 'click' THEN 'avg' WHEN 'signup' THEN 'max' ELSE 'sum' END AS op, value, ts, event_id FROM events)
    SELECT entity, feature, round(CASE any_value(op) WHEN 'set' THEN arg_max(value, ts) WHEN 'avg' THEN avg(value) WHEN 'max' THEN greatest(0.0, max(value)) ELSE sum(value) END, 8) AS value,
    CASE any_value(op) WHEN 'set' THEN 1 WHEN 'max' THEN 0 ELSE count(*) END AS n FROM u GROUP BY 1, 2""",
)
def _(spark, sf):
    kind = F.col("event_type")
    op = F.when(kind == "error", "set").when(kind == "view", "inc").when(kind == "click", "avg").when(kind == "signup", "max").otherwise("sum")
    e = table(spark, sf, "events")
    updates = e.select(F.col("user_id").alias("entity"), kind.alias("feature"), op.alias("op"), "value", "ts", "event_id")
    return B.feature_ops(updates).withColumn("value", F.round("value", 8)).drop("ts")


@query(
    "population_anomaly",
    W + f""", {FEATURED}, f AS (SELECT entity, feature, CASE WHEN feature = 'cpu_avg_1h' THEN avg(v) ELSE sum(v) END AS value FROM rows_ GROUP BY entity, feature, date_trunc('hour', ts)),
    s AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS sd FROM f GROUP BY 1 HAVING count(*) >= 5 AND stddev_pop(value) > 0)
    SELECT entity, feature, round(value, 4)::DOUBLE AS value, round(m, 4) AS baseline, round((value - m) / sd, 4) AS score, printf('Value %.2f is %.2f sigmas from mean %.2f', value, (value - m) / sd, m) AS description FROM f JOIN s USING (feature) WHERE abs((value - m) / sd) > 3""",
)
def _(spark, sf):
    out = B.population_anomaly(B.extract_features(featured(spark, sf)))
    return out.withColumn("value", F.round("value", 4)).withColumn("baseline", F.round("baseline", 4)).withColumn("score", F.round("score", 4))


ROLLING = """m AS (SELECT event_id, tenant, ts, unnest([{{'metric': 'bytes', 'value': bytes}}, {{'metric': 'cpu', 'value': CAST(event_id * event_id % 1009 AS DOUBLE)}}], recursive := true) FROM sec),
 r AS (SELECT *, avg(value) OVER w AS expected, stddev_pop(value) OVER w AS sd, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) - 1 AS seen FROM m
 WINDOW w AS (PARTITION BY {key} ORDER BY ts, event_id ROWS BETWEEN 1000 PRECEDING AND 1 PRECEDING)),
 d AS (SELECT *, abs(value - expected) / sd AS deviation FROM r WHERE seen > 10)
 SELECT event_id, metric, value, round(expected, 3) AS expected, round(deviation, 6) AS deviation, CASE WHEN deviation > 5 THEN 'critical' WHEN deviation > 4 THEN 'high' ELSE 'medium' END AS severity FROM d WHERE deviation > {limit}"""


def _rolling(spark, sf, by, limit=3.0):
    e = sec_events(spark, sf).withColumn("cpu", (F.col("event_id") * F.col("event_id") % 1009).cast("double"))
    out = B.rolling_anomaly(e, by=by, threshold=limit)
    out = out.withColumn("expected", F.round("expected", 3)).withColumn("deviation", F.round("deviation", 6))
    return out.select("event_id", "metric", "value", "expected", "deviation", "severity")


@query("rolling_anomaly", W + ", " + ROLLING.format(key="metric, tenant", limit=3))
def _(spark, sf):
    return _rolling(spark, sf, ("tenant",))


@query("rolling_anomaly_global", W + ", " + ROLLING.format(key="metric", limit=3))
def _(spark, sf):
    return _rolling(spark, sf, ())


@query("anomaly_severity", "SELECT event_id, CASE WHEN value / 20 > 5 THEN 'critical' WHEN value / 20 > 4 THEN 'high' WHEN value / 20 > 3 THEN 'medium' ELSE 'low' END AS severity FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", B.anomaly_severity(F.col("value") / 20).alias("severity"))


@query(
    "explain_anomaly",
    """WITH a AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'login_count_1h' WHEN 'purchase' THEN 'bytes_out_1h' ELSE 'cpu' END AS anomaly_type, value * 1000 AS value FROM events),
    f AS (SELECT event_id, anomaly_type, 'Login Frequency' AS factor, 0.85 AS weight, value AS factor_value, 'User logged in ' || CAST(trunc(value) AS BIGINT) || ' times in the last hour, which is significantly higher than the baseline.' AS factor_text, 'Unusual high frequency of login attempts detected.' AS summary FROM a WHERE anomaly_type = 'login_count_1h'
    UNION ALL SELECT event_id, anomaly_type, 'Time of Day', 0.15, 0, 'Activity occurred during off-peak hours.', 'Unusual high frequency of login attempts detected.' FROM a WHERE anomaly_type = 'login_count_1h'
    UNION ALL SELECT event_id, anomaly_type, 'Data Volume', 0.9, value, printf('Data transfer of %.2f MB exceeds 99th percentile of peer group.', value / 1048576), 'Potential data exfiltration detected based on volume.' FROM a WHERE anomaly_type = 'bytes_out_1h'
    UNION ALL SELECT event_id, anomaly_type, 'Destination IP Reputation', 0.1, 0, 'Destination IP has no prior history with this entity.', 'Potential data exfiltration detected based on volume.' FROM a WHERE anomaly_type = 'bytes_out_1h'
    UNION ALL SELECT event_id, anomaly_type, 'Unknown Factor', 1.0, value, 'Anomaly detected based on statistical deviation.', 'Statistical anomaly detected.' FROM a WHERE anomaly_type = 'cpu')
    SELECT event_id, anomaly_type, factor, weight::DOUBLE AS weight, factor_value::DOUBLE AS factor_value, factor_text, summary, 0.92::DOUBLE AS confidence FROM f""",
)
def _(spark, sf):
    kind = F.when(F.col("event_type") == "error", "login_count_1h").when(F.col("event_type") == "purchase", "bytes_out_1h").otherwise("cpu")
    a = table(spark, sf, "events").select("event_id", kind.alias("anomaly_type"), (F.col("value") * 1000).alias("value"))
    return B.explain_anomaly(a).drop("value")


# risk --------------------------------------------------------------------
INC = """inc AS (SELECT 'u' || user_id AS entity, ts, event_id, CAST(trunc((CASE event_type WHEN 'error' THEN 50 WHEN 'signup' THEN 30 WHEN 'purchase' THEN 15 WHEN 'click' THEN 5 ELSE 0 END) * (event_id % 10) / 10.0) AS BIGINT) AS score FROM events)"""


def increments(spark, sf):
    kind = F.col("event_type")
    severity = F.when(kind == "error", "critical").when(kind == "signup", "high").when(kind == "purchase", "medium").when(kind == "click", "low").otherwise("none")
    score = K.severity_score(severity, (F.col("event_id") % 10) / 10.0)
    return table(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("entity"), "ts", "event_id", score.alias("score"))


@query("risk_score", f"WITH {INC} SELECT entity, CAST(least(100, sum(score)) AS INTEGER) AS score, count(*) AS incidents, max(ts) AS last_update FROM inc GROUP BY 1")
def _(spark, sf):
    return K.risk_score(increments(spark, sf))


@query(
    "top_entities",
    f"WITH {INC} SELECT entity, CAST(least(100, sum(score)) AS INTEGER) AS score FROM inc GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25",
)
def _(spark, sf):
    return K.risk_score(increments(spark, sf)).transform(top_entities(25)).select("entity", "score")


@query(
    "risk_decay",
    f"""WITH {INC}, h AS (SELECT entity, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS slot, sum(score)::BIGINT AS added FROM inc WHERE ts <= TIMESTAMP '2024-01-30 18:30:00' GROUP BY 1, 2),
    b AS (SELECT entity, min(slot) AS lo, list({{'slot': slot, 'added': added}} ORDER BY slot) AS hs FROM h GROUP BY 1),
    g AS (SELECT entity, unnest(range(lo, CAST(floor(epoch(TIMESTAMP '2024-01-30 18:30:00') / 3600) AS BIGINT) + 1)) AS slot FROM b),
    s AS (SELECT entity, list({{'last': slot = CAST(floor(epoch(TIMESTAMP '2024-01-30 18:30:00') / 3600) AS BIGINT), 'added': coalesce(added, 0)}} ORDER BY slot) AS l FROM g LEFT JOIN h USING (entity, slot) GROUP BY 1)
    SELECT entity, CAST(list_reduce(l, lambda a, x: CASE WHEN x.last THEN least(100, a + x.added) ELSE floor(least(100, a + x.added) * 0.8)::BIGINT END, 0::BIGINT) AS INTEGER) AS score FROM s""",
)
def _(spark, sf):
    return K.risk_decay(increments(spark, sf), "2024-01-30 18:30:00", factor=0.8)


@query(
    "entity_risk_adjust",
    """WITH d AS (SELECT 't' || (user_id % 3) AS entity, ts, event_id, CASE WHEN event_type IN ('error', 'signup') THEN event_id % 40 ELSE -(event_id % 30) END AS delta FROM events),
    l AS (SELECT entity, list(delta ORDER BY ts, event_id) AS ds FROM d GROUP BY 1)
    SELECT entity, CAST(list_reduce(ds, lambda a, x: greatest(0, least(100, a + x)), 0::BIGINT) AS INTEGER) AS score FROM l""",
)
def _(spark, sf):
    delta = F.when(F.col("event_type").isin("error", "signup"), F.col("event_id") % 40).otherwise(-(F.col("event_id") % 30))
    d = table(spark, sf, "events").select(F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("entity"), "ts", "event_id", delta.alias("delta"))
    return K.entity_risk_adjust(d)
