"""Driver queries for tenancy, lifecycle, sources and sinks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from eventlens import registry as X
from eventlens.operators import lifecycle as Y
from eventlens.operators import stats as A
from eventlens.operators import tenancy as T
from eventlens.plans.catalog import query
from eventlens.plans.tables import SEC, sec_events, table, utc
from eventlens.session import new_path
from eventlens.sources import parsers as P
from eventlens.sources import readers as R
from eventlens.sources import retention as N
from eventlens.sources import writers as O
from eventlens.streaming.runner import run_to_now

W = f"WITH {SEC} "
RECEIVED = "2024-02-01 00:00:00"


def vc(e):
    return f"CAST({e} AS VARCHAR(20))"


# tenancy -----------------------------------------------------------------
@query(
    "tenant_id",
    W + """SELECT event_id, CASE WHEN event_id % 4 = 1 THEN tenant WHEN event_id % 4 = 2 THEN 'org' || user_name WHEN event_id % 4 = 3 THEN 'default' ELSE 'tid' END AS tid FROM sec WHERE event_id % 4 <> 2 OR user_name IS NOT NULL
    UNION ALL SELECT event_id, 'default' FROM sec WHERE event_id % 4 = 2 AND user_name IS NULL""",
)
def _(spark, sf):
    slot = F.col("event_id") % 4
    e = sec_events(spark, sf).withColumn("tenant_id", F.when(slot == 0, "tid").when(slot == 1, ""))
    e = e.withColumn("tenant", F.when(slot == 1, F.col("tenant")).when(slot == 3, "")).withColumn("org_id", F.when(slot == 2, F.concat(F.lit("org"), "user_name")))
    return e.transform(lambda d: T.tenant_id(d, "tid")).select("event_id", "tid")


BURST = "burst AS (SELECT event_id, tenant, date_trunc('hour', ts) AS ts, bytes, event_type FROM sec)"


@query("tenant_rate_quota", W + f", {BURST} SELECT event_id, row_number() OVER (PARTITION BY tenant, ts ORDER BY event_id) <= 5 AS accepted FROM burst")
def _(spark, sf):
    burst = sec_events(spark, sf).withColumn("ts", F.date_trunc("hour", "ts"))
    return burst.transform(T.tenant_rate_quota(5)).select("event_id", "accepted")


@query(
    "tenant_storage_quota",
    W + """, l AS (SELECT tenant, list({'id': event_id, 'b': CAST(trunc(bytes) AS BIGINT)} ORDER BY ts, event_id) AS l FROM sec GROUP BY 1),
    f AS (SELECT list_reduce(l, lambda s, x: CASE WHEN s.used + x.b <= 3000000000 THEN {'used': s.used + x.b, 'ids': list_append(s.ids, x.id)} ELSE s END, {'used': 0::BIGINT, 'ids': []::BIGINT[]}) AS s FROM l),
    ok AS (SELECT unnest(s.ids) AS event_id FROM f) SELECT event_id, ok.event_id IS NOT NULL AS accepted FROM sec LEFT JOIN ok USING (event_id)""",
)
def _(spark, sf):
    return sec_events(spark, sf).transform(T.tenant_storage_quota(3_000_000_000)).select("event_id", "accepted")


@query(
    "tenant_usage",
    W + f""", {BURST}, q AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY tenant, ts ORDER BY event_id) <= 5 THEN 'accepted' ELSE 'rate_limited' END AS outcome FROM burst)
    SELECT tenant, outcome, count(*) AS events, CAST(sum(CAST(trunc(bytes) AS BIGINT)) AS BIGINT) AS bytes FROM q GROUP BY 1, 2""",
)
def _(spark, sf):
    burst = sec_events(spark, sf).withColumn("ts", F.date_trunc("hour", "ts")).transform(T.tenant_rate_quota(5))
    return T.tenant_usage(burst.withColumn("outcome", F.when(F.col("accepted"), "accepted").otherwise("rate_limited")))


@query(
    "event_priority",
    """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'urgent' WHEN event_type = 'error' THEN 'critical' WHEN event_type = 'signup' THEN 'high' ELSE 'medium' END AS priority FROM events""",
)
def _(spark, sf):
    kind = F.col("event_type")
    e = table(spark, sf, "events").withColumn("severity", F.when(kind == "error", "critical").when(kind == "signup", "high").when(kind == "view", "low"))
    e = e.withColumn("priority", F.when(F.col("event_id") % 10 == 0, "urgent"))
    return e.transform(T.event_priority).select("event_id", "priority")


@query("sample_events", "SELECT event_id, event_type FROM events WHERE ('0x' || left(md5(event_id::VARCHAR), 8))::BIGINT % 1000000 < 250000")
def _(spark, sf):
    return table(spark, sf, "events").transform(T.sample_events(0.25)).select("event_id", "event_type")


# lifecycle ---------------------------------------------------------------
@query(
    "dedup_ttl",
    W + """, l AS (SELECT sha256(concat(source, 'm', hostname)) AS k, list_sort(list(epoch_us(ts))) AS l FROM sec GROUP BY 1),
    a AS (SELECT k, unnest(list_reduce(l, lambda acc, x: CASE WHEN len(acc) = 0 OR x - acc[-1] >= 21600000000 THEN list_append(acc, x) ELSE acc END, []::BIGINT[])) AS t FROM l)
    SELECT event_id FROM sec JOIN a ON sha256(concat(source, 'm', hostname)) = k AND epoch_us(ts) = t""",
)
def _(spark, sf):
    e = sec_events(spark, sf).withColumn("message", F.concat(F.lit("m"), "hostname"))
    return e.transform(Y.dedup_ttl("6h")).select("event_id")


@query(
    "assign_tier",
    """SELECT event_id, CASE WHEN age > 30 * 86400 THEN 'delete' WHEN age > 7 * 86400 THEN 'cold' WHEN age > 86400 THEN 'warm' ELSE 'hot' END AS tier
    FROM (SELECT event_id, epoch(TIMESTAMP '2024-02-05 06:00:00') - epoch(date_trunc('hour', ts)) AS age FROM events)""",
)
def _(spark, sf):
    return table(spark, sf, "events").transform(Y.assign_tier("2024-02-05 06:00:00")).select("event_id", "tier")


@query(
    "expire_events",
    "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - CASE WHEN event_type = 'error' THEN INTERVAL 20 DAY ELSE INTERVAL 7 DAY END",
)
def _(spark, sf):
    return table(spark, sf, "events").transform(Y.expire_events("2024-01-31", 7, 20, F.col("event_type") == "error")).select("event_id")


@query(
    "expire_store",
    "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31 06:30:00' - CASE WHEN event_type = 'error' THEN INTERVAL 20 DAY ELSE INTERVAL 7 DAY END",
)
def _(spark, sf):
    """Retention on a stored table, run twice: the second run finds nothing to do."""
    path = new_path(spark, "store")
    O.sink_event_store(table(spark, sf, "events").withColumn("source", F.col("event_type")), path, by="day")
    for _ in range(2):
        N.expire_store(spark, path, "2024-01-31 06:30:00", 7, 20, F.col("event_type") == "error")
    return spark.read.parquet(path).select("event_id")


@query(
    "tier_store",
    """SELECT event_id, CASE WHEN age > 7 * 86400 THEN 'cold' WHEN age > 86400 THEN 'warm' ELSE 'hot' END AS tier
    FROM (SELECT event_id, epoch(TIMESTAMP '2024-01-28 06:00:00') - epoch(date_trunc('day', ts) + INTERVAL 23 HOUR) AS age FROM events)""",
)
def _(spark, sf):
    """Days of a stored table moved to the tiers of two dates, one after the other."""
    stores = {tier: new_path(spark, tier) for tier in ("hot", "warm", "cold")}
    O.sink_event_store(table(spark, sf, "events").withColumn("source", F.col("event_type")), stores["hot"])
    for as_of in ("2024-01-20 06:00:00", "2024-01-28 06:00:00"):
        N.move_tiers(spark, stores, as_of)
    return N.read_tiers(spark, stores).select("event_id", "tier")


@query("drop_tombstones", "SELECT event_id FROM events WHERE event_type <> 'view'")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("_is_tombstone", F.when(F.col("event_type") == "view", True))
    return e.transform(Y.drop_tombstones).select("event_id")


@query(
    "stage_metrics",
    W + """SELECT 'scan' AS stage, count(*) AS events_in, count(*) AS events_out, CAST(0 AS BIGINT) AS dropped FROM sec
    UNION ALL SELECT 'failed', count(*), count(*) FILTER (status = 'failed'), count(*) FILTER (status <> 'failed') FROM sec
    UNION ALL SELECT 'outbound', count(*), count(*) FILTER (direction = 'outbound'), count(*) FILTER (direction <> 'outbound') FROM sec WHERE status = 'failed'""",
)
def _(spark, sf):
    return Y.stage_metrics(sec_events(spark, sf), ("scan", F.lit(True)), ("failed", F.col("status") == "failed"), ("outbound", F.col("direction") == "outbound"))


# sources -----------------------------------------------------------------
COLLECTOR = (
    "CASE WHEN event_id % 50 = 0 THEN 'not json' ELSE concat('{\"time\":', " + vc("1704067200 + event_id") + ", ',\"host\":\"h', " + vc("event_id % 20")
    + ", '\",\"source\":\"s', " + vc("event_id % 5") + ", '\",\"sourcetype\":\"st\",\"index\":\"main\",\"event\":\"', event_type, '\",\"fields\":{\"user\":\"u', " + vc("user_id") + ", '\"}}') END"
)


def raw(spark, sf, expression):
    return table(spark, sf, "events").selectExpr("event_id", f"{expression} AS value")


@query(
    "src_collector_json",
    """SELECT epoch_us(make_timestamp((1704067200 + event_id) * 1000000)) AS at, 's' || (event_id % 5) AS source, 'h' || (event_id % 20) AS host, 'main' AS index, event_type AS message, 'u' || user_id AS user FROM events WHERE event_id % 50 <> 0""",
)
def _(spark, sf):
    e = R.from_collector(raw(spark, sf, COLLECTOR)).where("not bad_record")
    return e.select(F.unix_micros("ts").alias("at"), "source", "host", "index", "message", F.col("data")["user"].alias("user"))


SYSLOG = "concat(CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '<>' WHEN 2 THEN '<x>' ELSE concat('<', " + vc("event_id % 192") + ", '>') END, 'Oct 11 host app: ', event_type)"


@query(
    "src_syslog",
    f"""SELECT {SYSLOG} AS message, CASE event_id % 4 WHEN 2 THEN 'x' WHEN 3 THEN CAST(event_id % 192 AS VARCHAR) END AS priority, CAST(coalesce(CASE event_id % 4 WHEN 3 THEN (event_id % 192) // 8 END, -1) AS INTEGER) AS facility,
    CAST(coalesce(CASE event_id % 4 WHEN 3 THEN event_id % 192 % 8 END, -1) AS INTEGER) AS severity_code, event_id % 4 <> 3 AS bad_record FROM events""",
)
def _(spark, sf):
    e = R.from_syslog(raw(spark, sf, SYSLOG), received=F.lit(RECEIVED).cast("timestamp"))
    return e.drop("ts", "source").fillna(-1, ["facility", "severity_code"])


@query("src_kafka", "SELECT 'kafka:' || event_type AS source, event_type AS topic, CAST(user_id % 4 AS INTEGER) AS partition, event_id AS offset, props AS payload, 'u' || user_id AS key, epoch_us(ts) AS at FROM events")
def _(spark, sf):
    e = table(spark, sf, "events").select(
        F.encode(F.concat(F.lit("u"), F.col("user_id").cast("string")), "utf-8").alias("key"),
        F.encode("props", "utf-8").alias("value"),
        F.col("event_type").alias("topic"),
        (F.col("user_id") % 4).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )
    return R.from_kafka(e).withColumn("at", F.unix_micros("ts")).drop("ts")


MQTT = "concat('{\"topic\":\"site/', event_type, '\",\"payload\":\"p', " + vc("event_id") + ", '\",\"qos\":', " + vc("event_id % 3") + ", '}')"
AMQP = "concat('{\"exchange\":\"ex\",\"routing_key\":\"rk.', event_type, '\",\"payload\":\"p', " + vc("event_id") + ", '\",\"priority\":', " + vc("event_id % 10") + ", '}')"


@query(
    "src_message_envelope",
    """SELECT 'mqtt:site/' || event_type AS source, 'p' || event_id AS payload, CAST(event_id % 3 AS INTEGER) AS level FROM events UNION ALL SELECT 'amqp:rk.' || event_type, 'p' || event_id, CAST(event_id % 10 AS INTEGER) FROM events""",
)
def _(spark, sf):
    at = F.lit(RECEIVED).cast("timestamp")
    mqtt = R.from_messages(raw(spark, sf, MQTT), "mqtt", received=at).select("source", "payload", F.col("qos").alias("level"))
    return mqtt.union(R.from_messages(raw(spark, sf, AMQP), "amqp", received=at).select("source", "payload", "priority"))


LOG_LINE = "concat(CASE event_id % 12 WHEN 0 THEN 'query a.example' WHEN 1 THEN 'DHCPACK on eth0' WHEN 2 THEN 'from=<a@b>' WHEN 3 THEN 'BIND dn' WHEN 4 THEN 'offset 0.1' WHEN 5 THEN 'INVITE sip:x' WHEN 6 THEN 'RTSP play' WHEN 7 THEN 'outstation 4' WHEN 8 THEN 'New BLOCK' WHEN 9 THEN 'Peer pubsub' WHEN 10 THEN 'invite lower' ELSE 'noise' END, ' ', event_type)"
LOG_SQL = " UNION ALL ".join(
    f"SELECT '{p}' AS source, {LOG_LINE} AS message FROM events WHERE " + (" OR ".join(f"contains({'lower(' + LOG_LINE + ')' if p in R.IGNORE_CASE else LOG_LINE}, '{w}')" for w in words) or "true")
    for p, words in R.LOG_KEYWORDS.items()
)


@query("src_log_tail", LOG_SQL)
def _(spark, sf):
    return R.from_logs(raw(spark, sf, LOG_LINE)).select("source", "message")


@query("src_log_follow", LOG_SQL)
def _(spark, sf):
    """The lines as text files, followed as a stream."""
    folder = new_path(spark, "logs")
    raw(spark, sf, LOG_LINE).select("value").write.text(folder)
    return run_to_now(R.read_log_stream(spark, f"{folder}/*.txt"), "followed").select("source", "message")


@query("parse_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id % 20 = 0 AS bad FROM events WHERE event_id % 20 <> 0 UNION ALL SELECT event_id, -1, true FROM events WHERE event_id % 20 = 0")
def _(spark, sf):
    lines = raw(spark, sf, "CASE WHEN event_id % 20 = 0 THEN '{broken' ELSE props END")
    parsed = lines.transform(P.parse_json(schema="k bigint"))
    return parsed.select("event_id", F.coalesce("data.k", F.lit(-1)).alias("k"), F.col("bad_record").alias("bad"))


@query("parse_json_variant", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, sf):
    parsed = raw(spark, sf, "props").transform(P.parse_json())
    return parsed.select("event_id", F.try_variant_get("data", "$.k", "bigint").alias("k"))


XML = "CASE WHEN event_id % 20 = 0 THEN '<e><user>' ELSE concat('<e><user>u', " + vc("user_id") + ", '</user><kind>', event_type, '</kind></e>') END"


@query(
    "parse_xml",
    "SELECT event_id, CASE WHEN event_id % 20 <> 0 THEN 'u' || user_id END AS user, CASE WHEN event_id % 20 <> 0 THEN event_type END AS kind, event_id % 20 = 0 AS bad_record FROM events",
)
def _(spark, sf):
    parsed = raw(spark, sf, XML).transform(P.parse_xml("user string, kind string"))
    return parsed.select("event_id", "data.user", "data.kind", "bad_record")


CSV = "concat('\"u', " + vc("user_id") + ", '\",\"said \"\"', event_type, '\"\", ok\",', " + vc("event_id") + ")"


@query("parse_csv", "SELECT event_id, 'u' || user_id AS user, 'said \"' || event_type || '\", ok' AS note, event_id AS n FROM events")
def _(spark, sf):
    parsed = raw(spark, sf, CSV).transform(P.parse_csv("user string, note string, n bigint", escape='"'))
    return parsed.select("event_id", "data.user", "data.note", "data.n")


@query(
    "parse_regex",
    W + """SELECT event_id, nullif(regexp_extract(message, 'user (u[0-9]+)', 1), '') AS who, nullif(regexp_extract(message, 'h[0-9]+$', 0), '') AS host, nullif(regexp_extract(message, '(error|click)', 1), '') AS kind FROM sec""",
)
def _(spark, sf):
    patterns = {"who": r"user (u[0-9]+)", "host": "h[0-9]+$", "kind": "(error|click)"}
    return sec_events(spark, sf).transform(P.parse_regex(patterns, raw="message")).select("event_id", "who", "host", "kind")


SHOWN = (
    "yyyy-MM-dd'T'HH:mm:ss'Z'",
    "EEE, dd MMM yyyy HH:mm:ss 'GMT'",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy/MM/dd HH:mm:ss",
)


@query(
    "normalize_event",
    """SELECT event_id, CAST(CASE WHEN event_id % 5 = 4 THEN TIMESTAMP '2024-02-01' ELSE date_trunc('second', ts) END AS TIMESTAMP) AS at, 'u' || user_id AS actor, 'u' || user_id AS user FROM events""",
)
def _(spark, sf):
    slot = F.col("event_id") % 5
    shown = F.lit("yesterday")
    for i, pattern in enumerate(SHOWN):
        shown = F.when(slot == i, F.date_format("ts", pattern)).otherwise(shown)
    e = table(spark, sf, "events").select("event_id", F.lit("n/a").alias("timestamp"), shown.alias("time"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user"))
    out = e.transform(P.normalize_event({"user": "actor"}, default=F.lit(RECEIVED).cast("timestamp")))
    return out.select("event_id", utc(F.col("`@timestamp`")).alias("at"), "actor", "user")


# sinks -------------------------------------------------------------------
def stored(spark, sf, by):
    path = new_path(spark, "store")
    O.sink_event_store(sec_events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")), path, by=by)
    return path


@query("sink_event_store", W + "SELECT event_id, source, strftime(ts, '%Y-%m-%d') AS date, CAST(hour(ts) AS INTEGER) AS hour, value FROM sec")
def _(spark, sf):
    return spark.read.parquet(stored(spark, sf, "hour")).select("event_id", "source", F.col("date").cast("string").alias("date"), F.col("hour").cast("int").alias("hour"), "value")


@query("src_event_scan", W + "SELECT event_id, source FROM sec WHERE ts BETWEEN TIMESTAMP '2024-01-10 06:30:00' AND TIMESTAMP '2024-01-12 18:00:00'")
def _(spark, sf):
    return R.scan_events(spark, stored(spark, sf, "day"), datetime(2024, 1, 10, 6, 30), datetime(2024, 1, 12, 18)).select("event_id", "source")


@query("sink_jsonl", W + "SELECT event_id, user_name, message FROM sec")
def _(spark, sf):
    path = new_path(spark, "jsonl")
    O.sink_jsonl(sec_events(spark, sf).select("event_id", "user_name", "message"), path, rows_per_file=4000)
    return spark.read.schema("event_id bigint, user_name string, message string").json(path)


@query("export_csv", "SELECT doc_id, lang, text FROM documents")
def _(spark, sf):
    path = new_path(spark, "csv")
    O.export_csv(table(spark, sf, "documents").select("doc_id", "lang", "text"), path)
    return P.read_csv(spark, path).withColumn("doc_id", F.col("doc_id").cast("bigint"))


@query("export_json", W + "SELECT event_id, user_name, value FROM sec")
def _(spark, sf):
    path = new_path(spark, "json")
    O.export_json(sec_events(spark, sf).select("event_id", "user_name", "value"), path)
    return spark.read.schema("event_id bigint, user_name string, value double").json(path)


@query(
    "sink_dead_letter",
    """SELECT event_id, CASE WHEN event_id % 20 = 0 THEN 'dead' WHEN event_id % 30 = 1 THEN 'recovered' ELSE 'good' END AS state, CASE WHEN event_id % 20 = 0 THEN 1 ELSE 0 END AS retries FROM events""",
)
def _(spark, sf):
    lines = raw(spark, sf, "CASE WHEN event_id % 20 = 0 THEN '{broken' WHEN event_id % 30 = 1 THEN concat('x', props) ELSE props END")
    error = F.when(F.try_parse_json("value").isNull(), "unreadable JSON")
    good, letters = O.split_records(lines, error, at=F.lit(RECEIVED).cast("timestamp"))
    repaired = letters.withColumn("value", F.regexp_replace("value", "^x", ""))
    recovered, still = O.reprocess(repaired, error)
    parts = good.select("event_id", F.lit("good").alias("state"), F.lit(0).alias("retries"))
    return parts.union(recovered.select("event_id", F.lit("recovered"), F.lit(0))).union(still.select("event_id", F.lit("dead"), "retries"))


@query("sink_audit", "SELECT 'alice' AS actor, 'EXPORT' AS action, 'success' AS status, count(*) AS rows, true AS hashed FROM events")
def _(spark, sf):
    path, trail = new_path(spark, "result"), new_path(spark, "audit")
    O.audited_write(table(spark, sf, "events"), path, trail, "alice", "EXPORT")
    return spark.read.parquet(trail).select("actor", "action", "status", "rows", (F.length("result_hash") == 16).alias("hashed"))


# extensions --------------------------------------------------------------
@query("ext_transform", W + "SELECT event_id, message FROM sec WHERE status = 'failed' AND bytes > 1000000")
def _(spark, sf):
    X.register_transform("large_failures", lambda df, limit: df.where((F.col("status") == "failed") & (F.col("bytes") > limit)))
    return sec_events(spark, sf).transform(X.transform("large_failures", limit=1_000_000)).select("event_id", "message")


@query("ext_aggregate", "SELECT event_type, round(sum(value * value), 2) AS energy FROM events GROUP BY 1")
def _(spark, sf):
    A.register_aggregate("sumsq", lambda c: F.sum(c.try_cast("double") * c.try_cast("double")))
    out = table(spark, sf, "events").transform(A.stats_by("event_type", aggs=[("sumsq", "value", "energy")]))
    return out.withColumn("energy", F.round("energy", 2))


@query("ext_parser", "SELECT event_id, CAST(user_id AS VARCHAR) || ':' || event_type AS parsed FROM events")
def _(spark, sf):
    X.register_parser("kv", lambda raw: F.concat_ws(":", F.regexp_extract(raw, "id=([0-9]+)", 1), F.regexp_extract(raw, "kind=(.*)$", 1)))
    lines = raw(spark, sf, "concat('id=', " + vc("user_id") + ", ' kind=', event_type)")
    return lines.transform(X.parse("kv", target="parsed")).select("event_id", "parsed")


@query(
    "ext_parser_records",
    "SELECT conv_id, turn, CAST(i AS INTEGER) AS position, string_split(text, ' ')[i] AS word FROM (SELECT conv_id, turn, text, unnest(range(1, len(string_split(text, ' ')) + 1)) AS i FROM conversations)",
)
def _(spark, sf):
    class Words:
        """Table function: one record per blank-separated word of a text."""

        def eval(self, text: str):
            for position, word in enumerate((text or "").split(" "), 1):
                yield position, word

    X.register_record_parser("words", F.udtf(Words, returnType="position int, word string"))
    return table(spark, sf, "conversations").transform(X.parse_records("words", raw="text", keep=["conv_id", "turn"]))
