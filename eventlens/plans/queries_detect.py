"""Driver queries for rules, correlation, alerts, incidents and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlens.operators import alerts as L
from eventlens.operators import behavior as B
from eventlens.operators import correlate as C
from eventlens.operators import enrich as E
from eventlens.operators import rules as R
from eventlens.operators import terms as M
from eventlens.operators.reports import indicator_stats, posture_score
from eventlens.operators.shape import recent_indicators
from eventlens.plans.catalog import query
from eventlens.plans.tables import SEC, sec_events, table, utc

W = f"WITH {SEC} "

# The rule packs call the category of an event `event_type`.
RULED = """ruled AS (SELECT * REPLACE (category AS event_type), event_id % 13 = 0 AS src_ip_threat_malicious,
 CASE WHEN event_id % 17 = 0 THEN 'KP' WHEN event_id % 17 = 1 THEN 'IR' ELSE 'DE' END AS dst_ip_geo_country,
 event_id % 101 = 0 AS file_threat_malicious FROM sec)"""


def ruled_events(spark, sf):
    e = sec_events(spark, sf).withColumn("event_type", F.col("category"))
    slot = F.col("event_id") % 17
    e = e.withColumn("src_ip_threat_malicious", F.col("event_id") % 13 == 0).withColumn("file_threat_malicious", F.col("event_id") % 101 == 0)
    return e.withColumn("dst_ip_geo_country", F.when(slot == 0, "KP").when(slot == 1, "IR").otherwise("DE"))


DETECTED = """det AS (SELECT 'auth-001' AS rule_id, 'Failed Login Attempt' AS rule_name, 'medium' AS severity, * FROM ruled WHERE event_type = 'authentication' AND status = 'failed'
 UNION ALL SELECT 'auth-002', 'Successful Login from Malicious IP', 'critical', * FROM ruled WHERE event_type = 'authentication' AND status = 'success' AND src_ip_threat_malicious
 UNION ALL SELECT 'net-001', 'Large Data Transfer', 'high', * FROM ruled WHERE bytes > 10000000
 UNION ALL SELECT 'net-002', 'Connection to High-Risk Country', 'medium', * FROM ruled WHERE dst_ip_geo_country IN ('KP', 'IR', 'SY')
 UNION ALL SELECT 'file-001', 'Malware Hash Detected', 'critical', * FROM ruled WHERE file_threat_malicious)"""


@query("detect_rules", W + f", {RULED}, {DETECTED} SELECT event_id, rule_id, rule_name, severity FROM det")
def detected(spark, sf):
    return ruled_events(spark, sf).transform(R.detect_rules(R.DETECTION_RULES)).select("event_id", "rule_id", "rule_name", "severity")


def _rule(name, *conditions, **options):
    return R.Rule(name, name, "low", tuple(R.Condition(*c) for c in conditions), **options)


OPERATOR_RULES = (
    _rule("eq", ("hostname", "equals", "h3")),
    _rule("ne", ("user_name", "not_equals", "u3"), ("status", "eq", "failed")),
    _rule("gt", ("value", "gt", 90)),
    _rule("lt", ("value", "lt", 0.5)),
    _rule("gte", ("bytes", "gte", 9000000)),
    _rule("lte", ("bytes", "lte", 50000)),
    _rule("contains", ("message", "contains", "click on h1")),
    _rule("in", ("process_name", "in", ["p1", "p4", "p9"])),
    _rule("regex", ("message", "regex", "^user u[0-9] error")),
    _rule("missing", ("no_such_field", "ne", "x")),
    _rule("off", ("hostname", "eq", "h3"), enabled=False),
)


@query(
    "detect_operators",
    W + """SELECT event_id, 'eq' AS rule_id FROM sec WHERE hostname = 'h3' UNION ALL SELECT event_id, 'ne' FROM sec WHERE user_name <> 'u3' AND status = 'failed'
    UNION ALL SELECT event_id, 'gt' FROM sec WHERE value > 90 UNION ALL SELECT event_id, 'lt' FROM sec WHERE value < 0.5
    UNION ALL SELECT event_id, 'gte' FROM sec WHERE bytes >= 9000000 UNION ALL SELECT event_id, 'lte' FROM sec WHERE bytes <= 50000
    UNION ALL SELECT event_id, 'contains' FROM sec WHERE contains(message, 'click on h1') UNION ALL SELECT event_id, 'in' FROM sec WHERE process_name IN ('p1', 'p4', 'p9')
    UNION ALL SELECT event_id, 'regex' FROM sec WHERE regexp_matches(message, '^user u[0-9] error')""",
)
def _(spark, sf):
    return sec_events(spark, sf).transform(R.detect_rules(OPERATOR_RULES)).select("event_id", "rule_id")


WINDOW_RULES = (
    _rule("R-failed", ("category", "equals", "authentication"), ("status", "equals", "failed"), threshold=3, window="6h"),
    _rule("R-network", ("category", "equals", "network"), threshold=10, window="1d"),
    _rule("R-exfil", ("direction", "equals", "outbound"), ("bytes", "gt", 1_000_000.0), threshold=2, window="30m"),
)

KEYED = """hit AS (SELECT 'R-failed' AS rule_id, 3 AS threshold, 21600 AS span, * FROM sec WHERE category = 'authentication' AND status = 'failed'
 UNION ALL SELECT 'R-network', 10, 86400, * FROM sec WHERE category = 'network'
 UNION ALL SELECT 'R-exfil', 2, 1800, * FROM sec WHERE direction = 'outbound' AND bytes > 1000000),
 keyed AS (SELECT rule_id, threshold, span, event_id, ts, unnest(list_filter(['src_ip:' || src_ip, 'user:' || user_name, 'hostname:' || hostname, 'global'], lambda k: k IS NOT NULL)) AS entity_key FROM hit)"""


def _windows(slides):
    return f"""win AS (SELECT *, CAST(floor(epoch(ts) / (span // {slides})) AS BIGINT) * (span // {slides}) - i * (span // {slides}) AS window_start
    FROM keyed, range(0, {slides}) AS g(i)),
    inside AS (SELECT * FROM win WHERE floor(epoch(ts)) < window_start + span)"""


def _threshold_sql(slides):
    return W + f""", {KEYED}, {_windows(slides)} SELECT rule_id, entity_key, window_start, window_start + span AS window_end, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts
    FROM inside GROUP BY rule_id, threshold, span, entity_key, window_start HAVING count(*) >= threshold"""


def _threshold(spark, sf, slides):
    out = sec_events(spark, sf).transform(C.correlate_threshold(WINDOW_RULES, slides=slides))
    return out.select("rule_id", "entity_key", "window_start", "window_end", "n", utc(F.col("first_ts")).alias("first_ts"), utc(F.col("last_ts")).alias("last_ts"))


@query("correlate_threshold", _threshold_sql(1))
def _(spark, sf):
    return _threshold(spark, sf, 1)


@query("correlate_threshold_sliding", _threshold_sql(6))
def _(spark, sf):
    return _threshold(spark, sf, 6)


@query(
    "correlate_trailing",
    W + f""", {KEYED}, counted AS (SELECT *, count(*) OVER (PARTITION BY rule_id, entity_key ORDER BY epoch_us(ts) RANGE BETWEEN (CAST(span AS BIGINT) * 1000000 - 1) PRECEDING AND CURRENT ROW) AS n FROM keyed)
    SELECT rule_id, entity_key, event_id, n FROM counted WHERE n >= threshold""",
)
def _(spark, sf):
    return sec_events(spark, sf).transform(C.correlate_trailing(WINDOW_RULES)).select("rule_id", "entity_key", "event_id", "n")


@query(
    "correlate_idle_window",
    W + f""", {KEYED}, g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER k <= 1800000000 THEN 0 ELSE 1 END AS fresh FROM keyed WINDOW k AS (PARTITION BY rule_id, entity_key ORDER BY ts, event_id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY rule_id, entity_key ORDER BY ts, event_id) AS part FROM g)
    SELECT rule_id, entity_key, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY rule_id, threshold, entity_key, part HAVING count(*) >= threshold""",
)
def _(spark, sf):
    out = sec_events(spark, sf).transform(C.correlate_idle_window(WINDOW_RULES, gap="30m"))
    return out.select("rule_id", "entity_key", "n", utc(F.col("first_ts")).alias("first_ts"), utc(F.col("last_ts")).alias("last_ts"))


RESET = """lists AS (SELECT {key} AS k, list({{'id': event_id, 't': epoch_us(ts)}} ORDER BY ts, event_id) AS l FROM sec WHERE {cond} GROUP BY 1),
 folded AS (SELECT k, list_reduce(l, lambda s, x: CASE
  WHEN len(list_filter(list_append(s.buf, x), lambda b: b.t > x.t - {span})) >= {n}
  THEN {{'buf': []::STRUCT(id BIGINT, t BIGINT)[], 'out': list_append(s.out, list_filter(list_append(s.buf, x), lambda b: b.t > x.t - {span}))}}
  ELSE {{'buf': list_filter(list_append(s.buf, x), lambda b: b.t > x.t - {span}), 'out': s.out}} END,
  {{'buf': []::STRUCT(id BIGINT, t BIGINT)[], 'out': []::STRUCT(id BIGINT, t BIGINT)[][]}}) AS s FROM lists),
 fired AS (SELECT k, unnest(s.out) AS f FROM folded)"""


@query(
    "correlate_reset",
    W + ", " + RESET.format(key="'all'", cond="action = 'login_failed'", span=7200 * 1000000, n=5)
    + " SELECT 'R-reset' AS rule_id, f[-1].id AS trigger_id, array_to_string(list_transform(f, lambda b: b.id), ',') AS source_ids FROM fired",
)
def _(spark, sf):
    rule = _rule("R-reset", ("action", "equals", "login_failed"), threshold=5, window="2h")
    out = sec_events(spark, sf).transform(C.correlate_reset(rule))
    return out.select("rule_id", "trigger_id", F.array_join(F.col("source_ids").cast("array<string>"), ",").alias("source_ids"))


@query(
    "correlate_reset_by_key",
    W + ", " + RESET.format(key="hostname", cond="action = 'login_failed'", span=86400 * 1000000, n=4)
    + " SELECT k AS hostname, f[-1].id AS trigger_id, array_to_string(list_transform(f, lambda b: b.id), ',') AS source_ids FROM fired",
)
def _(spark, sf):
    rule = _rule("R-reset", ("action", "equals", "login_failed"), threshold=4, window="1d")
    out = sec_events(spark, sf).transform(C.correlate_reset(rule, by=("hostname",)))
    return out.select("hostname", "trigger_id", F.array_join(F.col("source_ids").cast("array<string>"), ",").alias("source_ids"))


@query(
    "correlate_operators",
    W + """SELECT event_id, 'c-contains' AS rule_id FROM sec WHERE contains(message, 'purchase') UNION ALL SELECT event_id, 'c-equals' FROM sec WHERE value = 1.5
    UNION ALL SELECT event_id, 'c-gt' FROM sec WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) > 95 UNION ALL SELECT event_id, 'c-lt' FROM sec WHERE value < 2""",
)
def _(spark, sf):
    rules = [
        _rule("c-contains", ("message", "contains", "purchase")),
        _rule("c-equals", ("value", "equals", 1.5)),
        _rule("c-gt", ("k", "gt", 95)),
        _rule("c-lt", ("value", "lt", 2)),
    ]
    e = sec_events(spark, sf).withColumnRenamed("props", "data")
    return e.transform(R.detect_rules(rules)).select("event_id", "rule_id")


@query(
    "rule_pack",
    W + f""", {RULED}, {DETECTED}, sig AS (SELECT rule_id, 'detection' AS kind, event_id FROM det
    UNION ALL SELECT 'CORR-001', 'match', event_id FROM ruled WHERE event_type = 'authentication' AND status = 'failed'
    UNION ALL SELECT 'CORR-002', 'match', event_id FROM ruled WHERE event_type = 'network'
    UNION ALL SELECT 'CORR-003', 'match', event_id FROM ruled WHERE direction = 'outbound' AND bytes > 1000000
    UNION ALL SELECT 'rule-brute-force', 'match', event_id FROM ruled WHERE action = 'login_failed')
    SELECT kind, rule_id, count(*) AS n, min(event_id) AS first_event FROM sig GROUP BY 1, 2""",
)
def _(spark, sf):
    e = ruled_events(spark, sf)
    parts = e.transform(R.detect_rules(R.DETECTION_RULES)).select(F.lit("detection").alias("kind"), "rule_id", "event_id")
    others = e.transform(R.detect_rules([*R.CORRELATION_RULES, *R.SIGNAL_RULES])).select(F.lit("match").alias("kind"), "rule_id", "event_id")
    return parts.union(others).groupBy("kind", "rule_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query(
    "correlate_related",
    W + f""", {KEYED}, {_windows(1)}, hot AS (SELECT rule_id, entity_key, window_start, count(*) AS n FROM inside GROUP BY rule_id, threshold, entity_key, window_start HAVING count(*) >= threshold)
    SELECT rule_id, entity_key, window_start, n, event_id FROM inside JOIN hot USING (rule_id, entity_key, window_start)""",
)
def _(spark, sf):
    return C.correlate_related(sec_events(spark, sf), WINDOW_RULES).select("rule_id", "entity_key", "window_start", "n", "event_id")


# alerts ------------------------------------------------------------------
UEBA_TRAVEL = """travel AS (SELECT event_id, ts, source, src_ip, who AS entity FROM (SELECT *, coalesce(user_name, src_ip) AS who FROM sec)
 WINDOW w AS (PARTITION BY who ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
 QUALIFY last_value(src_ip IGNORE NULLS) OVER w <> src_ip AND epoch_us(ts) - max(epoch_us(ts)) OVER w < {us})"""

ALERTS = f"""{RULED}, {DETECTED}, {UEBA_TRAVEL.format(us=3600 * 1000000)},
 corr AS (SELECT 'CORR-003' AS rule_id, 'Data Exfiltration' AS rule_name, 'critical' AS severity, source, src_ip, ts, event_id FROM ruled WHERE direction = 'outbound' AND bytes > 1000000),
 alerts AS (SELECT rule_id AS alert_id, 'Correlation: ' || rule_name AS title, severity, source, ts, event_id,
  'Correlation rule triggered at ' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS description FROM corr
 UNION ALL SELECT rule_id, 'Detection: ' || rule_name, severity, source, ts, event_id, 'Detection rule triggered for event from ' || source FROM det
 UNION ALL SELECT 'UEBA-ImpossibleTravel', 'UEBA: ImpossibleTravel', 'high', source, ts, event_id, 'Rapid location change detected between disparate IP addresses.' FROM travel)"""


def alert_inputs(spark, sf):
    e = ruled_events(spark, sf)
    corr = e.transform(R.detect_rules([r for r in R.CORRELATION_RULES if r.id == "CORR-003"]))
    return corr, e.transform(R.detect_rules(R.DETECTION_RULES)), B.ueba_impossible_travel(e, window="1h")


@query("route_alerts", W + f", {ALERTS} SELECT alert_id, title, description, severity, source, ts FROM alerts")
def _(spark, sf):
    out = L.route_alerts(*alert_inputs(spark, sf)).drop("event_id")
    return out.withColumn("ts", utc(F.col("ts")))


DEDUP = """lists AS (SELECT {key} AS k, list_sort(list(epoch_us({ts}))) AS l FROM {rel} GROUP BY 1),
 kept AS (SELECT k, unnest(list_reduce(l, lambda acc, x: CASE WHEN len(acc) = 0 OR x - acc[-1] >= {gap} THEN list_append(acc, x) ELSE acc END, []::BIGINT[])) AS t FROM lists)"""


@query(
    "dedup_alerts",
    W + f", {ALERTS}, " + DEDUP.format(key="alert_id || ':' || title", ts="ts", rel="alerts", gap=3600 * 1000000)
    + " SELECT k AS alert_key, make_timestamp(t) AS ts FROM kept",
)
def _(spark, sf):
    out = L.route_alerts(*alert_inputs(spark, sf))
    passed = out.transform(L.dedup_alerts("1h"))
    return passed.select(F.concat_ws(":", "alert_id", "title").alias("alert_key"), utc(F.col("ts")).alias("ts"))


def signal_table(spark, sf):
    hits = ruled_events(spark, sf).transform(R.detect_rules(R.DETECTION_RULES))
    return hits.select(
        F.concat_ws("-", F.lit("S"), "rule_id", "event_id").alias("signal_id"),
        "rule_id",
        "rule_name",
        "severity",
        "ts",
        F.lit(50).alias("risk_score"),
        F.concat(F.lit("Rule '"), "rule_name", F.lit("' triggered by "), "source").alias("message"),
        F.filter(F.array("user_name", "hostname"), lambda x: x.isNotNull()).alias("entities"),
    )


@query(
    "promote_incidents",
    W + f""", {RULED}, {DETECTED} SELECT 'INC-S-' || rule_id || '-' || event_id AS incident_id, 'Detection: ' || rule_name AS title, 'Rule ''' || rule_name || ''' triggered by ' || source AS description,
    severity, 'New' AS status, 'System: Incident created automatically from detection signal S-' || rule_id || '-' || event_id AS journal, ts AS created_at, 50 AS risk_score FROM det WHERE severity IN ('high', 'critical')""",
)
def _(spark, sf):
    out = L.promote_incidents(signal_table(spark, sf))
    entry = F.element_at("journal", 1)
    out = out.withColumn("journal", F.concat(entry["author"], F.lit(": "), entry["message"])).withColumn("created_at", utc(F.col("created_at")))
    return out.drop("source_signals")


CHANGES = """chg AS (SELECT 'I' || CAST(user_id % 40 AS VARCHAR) AS incident_id, ts, event_id AS change_id, 'analyst' || CAST(event_id % 5 AS VARCHAR) AS author,
 CASE event_type WHEN 'error' THEN 'status' WHEN 'signup' THEN 'assign' ELSE 'note' END AS kind,
 CASE event_type WHEN 'error' THEN ['Open','Triage','Resolved','Closed'][1 + event_id % 4] WHEN 'signup' THEN 'analyst' || CAST(event_id % 7 AS VARCHAR) ELSE 'note ' || event_id END AS value FROM events)"""


def incident_changes(spark, sf):
    e, kind = table(spark, sf, "events"), F.col("event_type")
    status = F.element_at(F.array(*map(F.lit, ["Open", "Triage", "Resolved", "Closed"])), (F.col("event_id") % 4 + 1).cast("int"))
    agent = F.concat(F.lit("analyst"), (F.col("event_id") % 7).cast("string"))
    return e.select(
        F.concat(F.lit("I"), (F.col("user_id") % 40).cast("string")).alias("incident_id"),
        "ts",
        F.col("event_id").alias("change_id"),
        F.concat(F.lit("analyst"), (F.col("event_id") % 5).cast("string")).alias("author"),
        F.when(kind == "error", "status").when(kind == "signup", "assign").otherwise("note").alias("kind"),
        F.when(kind == "error", status).when(kind == "signup", agent).otherwise(F.concat(F.lit("note "), F.col("event_id").cast("string"))).alias("value"),
    )


@query(
    "incident_latest",
    f"""WITH {CHANGES} SELECT incident_id, coalesce(max_by(value, ts) FILTER (kind = 'status'), 'New') AS status, max_by(value, ts) FILTER (kind = 'assign') AS assignee,
    count(*) FILTER (kind = 'note') AS notes, max(ts) AS updated_at FROM chg GROUP BY 1""",
)
def _(spark, sf):
    return L.incident_latest(incident_changes(spark, sf))


@query(
    "incident_journal",
    f"""WITH {CHANGES}, s AS (SELECT *, last_value(CASE WHEN kind = 'status' THEN value END IGNORE NULLS) OVER (PARTITION BY incident_id ORDER BY ts, change_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM chg)
    SELECT incident_id, change_id, author, CASE kind WHEN 'status' THEN 'Status changed from ' || coalesce(prev, 'New') || ' to ' || value WHEN 'assign' THEN 'Incident assigned to ' || value ELSE value END AS message,
    CASE kind WHEN 'note' THEN 'note' ELSE 'system' END AS type FROM s""",
)
def _(spark, sf):
    return L.incident_journal(incident_changes(spark, sf)).select("incident_id", "change_id", "author", "message", "type")


@query(
    "stage_actions",
    W + f""", {ALERTS} SELECT 'block_ip' AS action, src_ip AS entity, severity, ts, 'pending' AS status FROM corr
    UNION ALL SELECT CASE WHEN contains(entity, '.') THEN 'block_ip' ELSE 'disable_user' END, entity, 'high', ts, 'pending' FROM travel""",
)
def _(spark, sf):
    corr, _, travel = alert_inputs(spark, sf)
    return L.stage_actions(corr, travel).withColumn("ts", utc(F.col("ts")))


@query(
    "rule_backtest",
    W + f""", {RULED}, {DETECTED}, {UEBA_TRAVEL.format(us=3600 * 1000000)}, {KEYED}, {_windows(1)},
    hot AS (SELECT rule_id, entity_key, window_start FROM inside GROUP BY rule_id, threshold, entity_key, window_start HAVING count(*) >= threshold),
    rel AS (SELECT event_id, array_to_string(list(DISTINCT rule_id ORDER BY rule_id), ',') AS c FROM inside JOIN hot USING (rule_id, entity_key, window_start) GROUP BY 1),
    d AS (SELECT event_id, array_to_string(list(rule_id ORDER BY rule_id), ',') AS d FROM det GROUP BY 1), a AS (SELECT event_id, count(*) AS a FROM travel GROUP BY 1)
    SELECT event_id, coalesce(d, '') AS detections, coalesce(c, '') AS correlations, coalesce(a, 0) AS anomalies, d IS NOT NULL OR c IS NOT NULL OR a IS NOT NULL AS triggered
    FROM sec LEFT JOIN d USING (event_id) LEFT JOIN rel USING (event_id) LEFT JOIN a USING (event_id)""",
)
def backtest(spark, sf):
    e = ruled_events(spark, sf)
    out = L.rule_backtest(e, R.DETECTION_RULES, WINDOW_RULES, B.ueba_impossible_travel(e, window="1h"))
    return out.withColumn("detections", F.array_join("detections", ",")).withColumn("correlations", F.array_join("correlations", ","))


@query(
    "rule_backtest_totals",
    W + f""", {RULED}, {DETECTED} SELECT (SELECT count(*) FROM sec) AS events, count(DISTINCT event_id) AS triggered, count(*) AS detections, CAST(0 AS BIGINT) AS correlations, CAST(0 AS BIGINT) AS anomalies FROM det""",
)
def _(spark, sf):
    return L.backtest_totals(L.rule_backtest(ruled_events(spark, sf), R.DETECTION_RULES))


@query(
    "mitre_coverage",
    W + f""", {RULED}, {DETECTED}, f AS (SELECT rule_id, count(*) AS fired FROM det GROUP BY 1),
    r AS (SELECT * FROM (VALUES ('auth-001', 'Credential Access', 'T1110'), ('auth-002', 'Initial Access', 'T1078'), ('net-001', 'Exfiltration', 'T1048'), ('net-002', 'Command and Control', NULL),
     ('file-001', 'Execution', 'T1204'), ('priv-001', 'Privilege Escalation', 'T1068'), ('CORR-001', 'Credential Access', 'T1110'), ('CORR-002', 'Discovery', 'T1046'), ('CORR-003', 'Exfiltration', 'T1041')) v(rule_id, tactic, technique)),
    e AS (SELECT rule_id, 'tactic' AS kind, tactic AS entry FROM r UNION ALL SELECT rule_id, 'technique', technique FROM r WHERE technique IS NOT NULL)
    SELECT kind, entry, count(*) AS rules, CAST(sum(coalesce(fired, 0)) AS BIGINT) AS fired, CASE WHEN kind = 'tactic' THEN least(100.0, count(*) / 20.0 * 100)::DOUBLE END AS coverage_pct
    FROM e LEFT JOIN f USING (rule_id) GROUP BY 1, 2""",
)
def _(spark, sf):
    hits = ruled_events(spark, sf).transform(R.detect_rules(R.DETECTION_RULES))
    return R.mitre_coverage(R.rules_frame(spark, [*R.DETECTION_RULES, *R.CORRELATION_RULES]), hits)


# enrichment --------------------------------------------------------------
ASSETS = """assets AS (SELECT key, min(s_suppkey) AS k FROM (SELECT 'h' || s_suppkey AS key, s_suppkey FROM supplier
 UNION ALL SELECT '10.' || (s_suppkey % 4) || '.0.' || (s_suppkey % 250 + 1), s_suppkey FROM supplier) GROUP BY 1)"""


def asset_table(spark, sf):
    s = table(spark, sf, "supplier")
    part = lambda e: e.cast("string")
    ip = F.concat(F.lit("10."), part(F.col("s_suppkey") % 4), F.lit(".0."), part(F.col("s_suppkey") % 250 + 1))
    keyed = s.select(F.explode(F.array(F.concat(F.lit("h"), part(F.col("s_suppkey"))), ip)).alias("key"), "s_suppkey")
    k = F.col("k").cast("string")
    return keyed.groupBy("key").agg(F.min("s_suppkey").alias("k")).select(
        "key",
        F.concat(F.lit("host-"), k).alias("hostname"),
        F.concat(F.lit("owner-"), k).alias("owner"),
        F.concat(F.lit("dept-"), k).alias("department"),
        F.when(F.col("k") % 3 == 0, "high").otherwise("low").alias("criticality"),
        F.lit("production").alias("environment"),
        F.array(F.lit("managed"), F.concat(F.lit("s"), k)).alias("tags"),
    )


@query(
    "enrich_asset",
    W + f""", {ASSETS} SELECT event_id, 'host-' || k AS asset_hostname, 'owner-' || k AS asset_owner, 'dept-' || k AS asset_department, CASE WHEN k % 3 = 0 THEN 'high' WHEN k IS NOT NULL THEN 'low' END AS asset_criticality,
    CASE WHEN k IS NOT NULL THEN 'production' END AS asset_environment, 'managed,s' || k AS asset_tags
    FROM sec LEFT JOIN assets ON key = CASE WHEN event_id % 3 = 1 THEN hostname ELSE src_ip END""",
)
def _(spark, sf):
    e = sec_events(spark, sf).withColumn("src_ip", F.when(F.col("event_id") % 3 != 1, F.col("src_ip")))
    out = e.transform(E.enrich_asset(asset_table(spark, sf)))
    cols = [c for c in out.columns if c.startswith("asset_")]
    return out.select("event_id", *cols).withColumn("asset_tags", F.array_join("asset_tags", ","))


def user_table(spark, sf):
    k = F.col("c_custkey").cast("string")
    return table(spark, sf, "customer").select(
        F.concat(F.lit("u"), k).alias("key"),
        F.col("c_name").alias("full_name"),
        F.concat(F.lit("u"), k, F.lit("@example.com")).alias("email"),
        F.col("c_mktsegment").alias("department"),
        F.when(F.col("c_custkey") % 10 == 0, "admin").otherwise("user").alias("role"),
        F.concat(F.lit("u"), (F.col("c_custkey") % 10).cast("string")).alias("manager"),
        F.lit("staff").alias("title"),
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("location"),
    )


@query(
    "enrich_user",
    W + """SELECT event_id, c_name AS user_full_name, user_name || '@example.com' AS user_email, c_mktsegment AS user_department, CASE WHEN c_custkey % 10 = 0 THEN 'admin' WHEN c_custkey IS NOT NULL THEN 'user' END AS user_role,
    'u' || (c_custkey % 10) AS user_manager, CASE WHEN c_custkey IS NOT NULL THEN 'staff' END AS user_title, 'n' || c_nationkey AS user_location
    FROM sec LEFT JOIN customer ON user_name = 'u' || c_custkey""",
)
def _(spark, sf):
    out = sec_events(spark, sf).withColumnRenamed("user_name", "username").transform(E.enrich_user(user_table(spark, sf)))
    return out.select("event_id", *[c for c in out.columns if c.startswith("user_")])


THREATS = """threats AS (SELECT '198.51.100.' || s_suppkey AS indicator, s_suppkey AS k, TIMESTAMP '2024-01-05' + to_hours(CAST(s_suppkey * 10 AS INTEGER)) AS last_seen FROM supplier
 UNION ALL SELECT md5('p' || s_suppkey), s_suppkey, TIMESTAMP '2024-01-20' FROM supplier)"""


def threat_table(spark, sf):
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    start = F.unix_seconds(F.lit("2024-01-05").cast("timestamp"))
    ips = s.select(F.concat(F.lit("198.51.100."), k.cast("string")).alias("indicator"), k.alias("k"), F.timestamp_seconds(start + k * 36000).alias("last_seen"))
    hashes = s.select(F.md5(F.concat(F.lit("p"), k.cast("string"))).alias("indicator"), k.alias("k"), F.lit("2024-01-20").cast("timestamp").alias("last_seen"))
    return ips.union(hashes).select(
        "indicator",
        (F.col("k") % 2 == 0).alias("is_malicious"),
        (F.col("k") % 100).cast("int").alias("reputation"),
        F.array(F.lit("botnet"), F.concat(F.lit("c"), F.col("k").cast("string"))).alias("categories"),
        "last_seen",
        F.lit("feed").alias("source"),
    )


@query(
    "enrich_threat",
    W + f""", {THREATS} SELECT event_id, CAST(a.k % 2 = 0 AS VARCHAR) AS dst_ip_threat_malicious, CAST(a.k % 100 AS VARCHAR) AS dst_ip_threat_reputation, 'botnet,c' || a.k AS dst_ip_threat_categories, CASE WHEN a.k IS NOT NULL THEN 'feed' END AS dst_ip_threat_source,
    CAST(b.k % 2 = 0 AS VARCHAR) AS file_threat_malicious, 'botnet,c' || b.k AS file_threat_categories
    FROM sec LEFT JOIN threats a ON dst_ip = a.indicator AND ts < a.last_seen + INTERVAL 1 HOUR LEFT JOIN threats b ON md5(process_name) = b.indicator AND ts < b.last_seen + INTERVAL 1 HOUR""",
)
def _(spark, sf):
    e = sec_events(spark, sf).withColumn("file_hash", F.md5("process_name")).withColumn("sha1", F.sha1("process_name"))
    out = e.drop("src_ip").transform(E.enrich_threat(threat_table(spark, sf)))
    out = out.select("event_id", *[c for c in out.columns if "_threat_" in c])
    for c in ("dst_ip_threat_malicious", "dst_ip_threat_reputation", "file_threat_malicious"):
        out = out.withColumn(c, F.col(c).cast("string"))
    return out.withColumn("dst_ip_threat_categories", F.array_join("dst_ip_threat_categories", ",")).withColumn("file_threat_categories", F.array_join("file_threat_categories", ","))


@query(
    "enrich_geo",
    W + """, ranges AS (SELECT 167772160 + (n_nationkey % 4) * 65536 + (n_nationkey // 4) * 100 AS lo, 167772160 + (n_nationkey % 4) * 65536 + (n_nationkey // 4) * 100 + 119 AS hi, n_name, n_regionkey, n_nationkey FROM nation),
    ips AS (SELECT src_ip, list_reduce(list_transform(string_split(src_ip, '.'), lambda p: CAST(p AS BIGINT)), lambda a, p: a * 256 + p) AS n FROM (SELECT DISTINCT src_ip FROM sec)),
    geo AS (SELECT * FROM ips JOIN ranges ON n BETWEEN lo AND hi QUALIFY row_number() OVER (PARTITION BY src_ip ORDER BY lo) = 1)
    SELECT event_id, n_name AS src_ip_geo_country, 'city' || n_nationkey AS src_ip_geo_city, n_nationkey * 1.5::DOUBLE AS src_ip_geo_latitude, n_nationkey * -1.5::DOUBLE AS src_ip_geo_longitude, 'r' || n_regionkey AS src_ip_geo_region
    FROM sec LEFT JOIN geo USING (src_ip)""",
)
def _(spark, sf):
    n = F.col("n_nationkey")
    low = F.lit(167772160) + (n % 4) * 65536 + F.floor(n / 4) * 100
    ranges = table(spark, sf, "nation").select(
        low.alias("start_ip"),
        (low + 119).alias("end_ip"),
        F.col("n_name").alias("country"),
        F.concat(F.lit("city"), n.cast("string")).alias("city"),
        (n * 1.5).alias("lat"),
        (n * -1.5).alias("lon"),
        F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("region"),
    )
    out = sec_events(spark, sf).drop("dst_ip").transform(E.enrich_geo(ranges))
    return out.select("event_id", *[c for c in out.columns if "_geo_" in c])


NETWORK_IP = "CASE event_id % 4 WHEN 0 THEN src_ip WHEN 1 THEN concat('::ffff:', src_ip) WHEN 2 THEN concat('2001:db8::', CAST(event_id % 7 AS VARCHAR(20)), ':', CAST(user_id % 10 AS VARCHAR(20))) ELSE 'nowhere' END"
# the networks nest: 10.0.0.0/8, its four /16, some /24; 2001:db8::/32 and /112 below it. A key is (family, number), of v6 its last two groups.
NETWORK_SQL = """, nets AS (
      SELECT 4 AS family, 10 * 16777216 AS lo, 10 * 16777216 + 16777215 AS hi, 8 AS bits, 'ten' AS country, 0 AS k
      UNION ALL SELECT 4, 10 * 16777216 + n_nationkey * 65536, 10 * 16777216 + n_nationkey * 65536 + 65535, 16, n_name, n_nationkey FROM nation WHERE n_nationkey % 2 = 0
      UNION ALL SELECT 4, 10 * 16777216 + n_nationkey % 4 * 65536 + n_nationkey % 5 * 256, 10 * 16777216 + n_nationkey % 4 * 65536 + n_nationkey % 5 * 256 + 255, 24, n_name, n_nationkey FROM nation WHERE n_nationkey BETWEEN 1 AND 14
      UNION ALL SELECT 6, 0, 4294967295, 32, 'docs', 0
      UNION ALL SELECT 6, n_nationkey * 65536, n_nationkey * 65536 + 65535, 112, n_name, n_nationkey FROM nation WHERE n_nationkey % 3 = 1
    ), parts AS (SELECT event_id, event_id % 4 = 2 AS six, CASE WHEN event_id % 4 < 2 THEN 10 * 16777216 + uid % 4 * 65536 + event_id % 3 * 256 + uid % 250 + 1 WHEN event_id % 4 = 2 THEN event_id % 7 * 65536 + uid % 10 END AS n
      FROM (SELECT event_id, user_id AS uid FROM events)),
    best AS (SELECT event_id, country, k, bits FROM parts JOIN nets ON n BETWEEN lo AND hi AND six = (family = 6) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY bits DESC) = 1)
    """


def network_table(spark, sf):
    n, k = table(spark, sf, "nation"), F.col("n_nationkey").cast("string")
    row = lambda net, name, key: [net.alias("network"), name.alias("country"), key.alias("k")]
    parts = [
        n.where("n_nationkey % 2 = 0").select(*row(F.concat(F.lit("10."), k, F.lit(".0.0/16")), F.col("n_name"), F.col("n_nationkey"))),
        n.where("n_nationkey between 1 and 14").select(*row(F.expr("concat('10.', n_nationkey % 4, '.', n_nationkey % 5, '.0/24')"), F.col("n_name"), F.col("n_nationkey"))),
        n.where("n_nationkey % 3 = 1").select(*row(F.concat(F.lit("2001:DB8:0:0:0:0:"), F.lower(F.hex("n_nationkey")), F.lit(":0/112")), F.col("n_name"), F.col("n_nationkey"))),
        n.where("n_nationkey = 0").select(*row(F.lit("10.0.0.0/8"), F.lit("ten"), F.lit(0))),
        n.where("n_nationkey = 0").select(*row(F.lit("2001:db8::/32"), F.lit("docs"), F.lit(0))),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole


def network_events(spark, sf):
    # user_id is no column of the security events
    both = sec_events(spark, sf).join(table(spark, sf, "events").select("event_id", "user_id"), "event_id")
    return both.selectExpr("event_id", "ts", f"{NETWORK_IP} AS ip")


@query("enrich_geo_networks", W + NETWORK_SQL + """SELECT event_id, country AS ip_geo_country, 'city' || k AS ip_geo_city, k * 1.5::DOUBLE AS ip_geo_latitude, k * -1.5::DOUBLE AS ip_geo_longitude, 'r' || k AS ip_geo_region
    FROM parts LEFT JOIN best USING (event_id)""")
def _(spark, sf):
    k = F.col("k").cast("string")
    nets = network_table(spark, sf).select("network", "country", F.concat(F.lit("city"), k).alias("city"), (F.col("k") * 1.5).alias("lat"), (F.col("k") * -1.5).alias("lon"), F.concat(F.lit("r"), k).alias("region"))
    out = network_events(spark, sf).transform(E.enrich_geo(nets))
    return out.select("event_id", *[c for c in out.columns if "_geo_" in c])


@query("enrich_threat_networks", W + NETWORK_SQL + """SELECT event_id, CASE WHEN ts < seen + INTERVAL 24 HOUR THEN CAST(k % 2 = 0 AS VARCHAR) END AS malicious, CASE WHEN ts < seen + INTERVAL 24 HOUR THEN country END AS source
    FROM (SELECT parts.event_id, ts, country, k, TIMESTAMP '2024-01-10' + to_hours(CAST(k * 13 AS INTEGER)) AS seen FROM parts JOIN sec ON parts.event_id = sec.event_id LEFT JOIN best ON parts.event_id = best.event_id)""")
def _(spark, sf):
    start, k = F.unix_seconds(F.lit("2024-01-10").cast("timestamp")), F.col("k")
    feed = network_table(spark, sf).select(F.col("network").alias("indicator"), (k % 2 == 0).alias("is_malicious"), k.alias("reputation"), F.array(F.lit("c")).alias("categories"), F.col("country").alias("source"), F.timestamp_seconds(start + k * 13 * 3600).alias("last_seen"))
    out = network_events(spark, sf).transform(E.enrich_threat_networks(feed, "24 hours"))
    return out.select("event_id", F.col("ip_threat_malicious").cast("string").alias("malicious"), F.col("ip_threat_source").alias("source"))


@query(
    "enrich_identity",
    W + """SELECT event_id, c_name AS owner_user, c_mktsegment AS owner_department, 'uid-' || c_custkey AS owner_uid FROM sec LEFT JOIN customer ON coalesce(user_name, src_ip) = 'u' || c_custkey""",
)
def _(spark, sf):
    k = F.col("c_custkey").cast("string")
    ids = table(spark, sf, "customer").select(F.concat(F.lit("u"), k).alias("key"), F.concat(F.lit("uid-"), k).alias("uid"), F.col("c_name").alias("primary_user"), F.col("c_mktsegment").alias("department"))
    e = sec_events(spark, sf).withColumn("user", F.upper("user_name"))
    return e.transform(E.enrich_identity(ids)).select("event_id", "owner_user", "owner_department", "owner_uid")


@query(
    "resolve_identity_asof",
    W + """, m AS (SELECT 'u' || o_custkey AS identifier, 'e' || o_orderkey AS entity_id, TIMESTAMP '2024-01-01' + to_hours(CAST(o_orderkey % 720 AS INTEGER)) AS vf,
     CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01' + to_hours(CAST(o_orderkey % 720 + o_orderkey % 48 + 1 AS INTEGER)) END AS vt FROM orders),
    f AS (SELECT event_id, entity_id FROM sec JOIN m ON user_name = identifier AND ts >= vf AND (vt IS NULL OR ts <= vt) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY vf, entity_id) = 1)
    SELECT event_id, entity_id FROM sec LEFT JOIN f USING (event_id)""",
)
def _(spark, sf):
    k = F.col("o_orderkey")
    start = F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + (k % 720) * 3600
    mappings = table(spark, sf, "orders").select(
        F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("identifier"),
        F.concat(F.lit("e"), k.cast("string")).alias("entity_id"),
        F.timestamp_seconds(start).alias("valid_from"),
        F.when(k % 5 != 0, F.timestamp_seconds(start + (k % 48 + 1) * 3600)).alias("valid_to"),
    )
    return E.resolve_identity_asof(sec_events(spark, sf), mappings, "user_name").select("event_id", "entity_id")


INDICATORS = """ind AS (SELECT 'ind-' || p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN '[ipv4-addr:value = ''198.51.100.' || (p_partkey * p_partkey % 77) || ''']' WHEN 1 THEN '[domain-name:value = ''d' || p_partkey || '.example'']' ELSE '[file:hashes.MD5 = ''' || md5(p_name) || ''']' END AS pattern,
 CASE p_size % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, TIMESTAMP '2024-01-01' + to_minutes(CAST(p_partkey * 7 % 10000 AS INTEGER)) AS created FROM part)"""


def indicator_table(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    pattern = (
        F.when(k % 3 == 0, F.concat(F.lit("[ipv4-addr:value = '198.51.100."), (k * k % 77).cast("string"), F.lit("']")))
        .when(k % 3 == 1, F.concat(F.lit("[domain-name:value = 'd"), k.cast("string"), F.lit(".example']")))
        .otherwise(F.concat(F.lit("[file:hashes.MD5 = '"), F.md5("p_name"), F.lit("']")))
    )
    size = F.col("p_size") % 4
    created = F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + (k * 7) % 10000 * 60)
    severity = F.when(size == 0, "critical").when(size == 1, "high").when(size == 2, "medium").otherwise("low")
    return p.select(F.concat(F.lit("ind-"), k.cast("string")).alias("id"), pattern.alias("pattern"), severity.alias("severity"), created.alias("created"))


FIRST_IND = "one AS (SELECT regexp_extract(pattern, '= ''([^'']+)''', 1) AS v, min(id) AS id, arg_min(severity, id) AS severity FROM ind GROUP BY 1)"


@query("match_indicator", W + f", {INDICATORS}, {FIRST_IND} SELECT event_id, id AS indicator_id, severity AS indicator_severity FROM sec LEFT JOIN one ON dst_ip = v")
def _(spark, sf):
    return sec_events(spark, sf).transform(E.match_indicator(indicator_table(spark, sf), "dst_ip")).select("event_id", "indicator_id", "indicator_severity")


@query("match_indicator_anti", W + f", {INDICATORS}, {FIRST_IND} SELECT event_id FROM sec ANTI JOIN one ON dst_ip = v")
def _(spark, sf):
    return sec_events(spark, sf).transform(E.match_indicator(indicator_table(spark, sf), "dst_ip", "left_anti")).select("event_id")


NOTE = "concat(message, ' to ', dst_ip, ' by ', coalesce(process_name, '-'), ' ', md5(coalesce(process_name, 'none')), ' d', CAST(event_id % 400 AS VARCHAR(20)), '.example')"
TEXT_SQL = W + f""", {INDICATORS}, {FIRST_IND}, notes AS (SELECT event_id, {NOTE} AS note FROM sec), lines AS (SELECT DISTINCT note FROM notes),
    best AS (SELECT note, id AS indicator_id, severity AS indicator_severity FROM lines JOIN one ON contains(note, v) QUALIFY row_number() OVER (PARTITION BY note ORDER BY length(v) DESC, id) = 1)
    """


@query("match_indicator_text", TEXT_SQL + "SELECT event_id, indicator_id, indicator_severity FROM notes LEFT JOIN best USING (note)")
def _(spark, sf):
    notes = sec_events(spark, sf).selectExpr("event_id", f"{NOTE} AS note")
    return notes.transform(M.match_text(indicator_table(spark, sf), "note")).select("event_id", "indicator_id", "indicator_severity")


@query("match_indicator_all", TEXT_SQL + "SELECT event_id, id AS indicator_id FROM notes JOIN one ON contains(note, v)")
def _(spark, sf):
    notes = sec_events(spark, sf).selectExpr("event_id", f"{NOTE} AS note")
    return notes.transform(M.match_all(indicator_table(spark, sf), "note")).select("event_id", "indicator_id")


@query("match_artifact", W + f""", {INDICATORS}, vals AS (SELECT DISTINCT dst_ip AS v FROM sec), hit AS (SELECT v, min(id) AS indicator_id, arg_min(severity, id) AS indicator_severity FROM vals JOIN ind ON contains(pattern, v) GROUP BY v)
    SELECT event_id, indicator_id, indicator_severity FROM sec LEFT JOIN hit ON dst_ip = v""")
def _(spark, sf):
    return sec_events(spark, sf).transform(M.match_artifact(indicator_table(spark, sf), "dst_ip")).select("event_id", "indicator_id", "indicator_severity")


@query("recent_indicators", f"WITH {INDICATORS} SELECT id, severity, created FROM ind ORDER BY created DESC, id LIMIT 50")
def _(spark, sf):
    return indicator_table(spark, sf).transform(recent_indicators(50)).select("id", "severity", utc(F.col("created")).alias("created"))


@query(
    "indicator_stats",
    f"""WITH {INDICATORS} SELECT count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
    count(*) FILTER (contains(pattern, 'ipv4-addr')) AS ip, count(*) FILTER (contains(pattern, 'domain-name')) AS domain, count(*) FILTER (contains(pattern, 'file:hashes')) AS hash FROM ind""",
)
def _(spark, sf):
    return indicator_stats(indicator_table(spark, sf))


@query(
    "posture_score",
    W + f""", {RULED}, {DETECTED} SELECT hostname, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, CAST(floor(least(100, 10 * count(*) FILTER (severity = 'critical') + 0.5 * count(*))) AS INTEGER) AS posture_score,
    CAST(floor(count(*) / 5) AS BIGINT) AS active_incidents FROM det GROUP BY 1, 2""",
)
def _(spark, sf):
    hits = ruled_events(spark, sf).transform(R.detect_rules(R.DETECTION_RULES))
    return posture_score(hits.withColumn("day", utc(F.date_trunc("day", "ts"))), by=("hostname", "day"))


@query(
    "incident_entities",
    W + f""", {RULED}, {DETECTED}, links AS (SELECT 'INC-' || rule_id || '-' || (event_id % 200) AS incident_id, user_name, hostname FROM det),
    n AS (SELECT DISTINCT incident_id, unnest([user_name, hostname]) AS entity_id FROM links)
    SELECT incident_id, entity_id, c_name AS name FROM n JOIN customer ON entity_id = 'u' || c_custkey""",
)
def _(spark, sf):
    signals = signal_table(spark, sf)
    slot = (F.split("signal_id", "-")[3].cast("long") % 200).cast("string")
    incidents = signals.select(F.concat_ws("-", F.lit("INC"), "rule_id", slot).alias("incident_id"), F.array("signal_id").alias("source_signals"))
    entities = table(spark, sf, "customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("entity_id"), F.col("c_name").alias("name"))
    return E.incident_entities(incidents, signals, entities)


@query(
    "config_drift",
    """SELECT CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey % 7 = 0 THEN 'missing' ELSE 'drift' END AS kind,
    CASE WHEN c_custkey % 7 = 0 THEN 'Missing configuration key: ' || c_custkey ELSE 'Drift in ' || c_custkey || ': expected ' || c_mktsegment || ', got changed' END AS discrepancy
    FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 5 = 0""",
)
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("key"), "c_custkey", F.col("c_mktsegment").alias("value"))
    runtime = c.where("c_custkey % 7 <> 0").select("key", F.when(F.col("c_custkey") % 5 == 0, "changed").otherwise(F.col("value")).alias("value"))
    return E.config_drift(c.select("key", "value"), runtime)
