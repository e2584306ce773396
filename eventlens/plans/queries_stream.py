"""Driver queries for the streaming operators: each streams the whole events table to completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlens.operators import enrich as E
from eventlens.plans import queries_behavior as QB
from eventlens.plans import queries_detect as QD
from eventlens.plans.catalog import ORACLES, query
from eventlens.plans.tables import SEC, SEC_COLUMNS, table, utc
from eventlens.session import new_path
from eventlens.sources import writers as O
from eventlens.streaming import runner as N
from eventlens.streaming import stateful as S
from eventlens.streaming import windows as Z
from eventlens.streaming.drops import counted_drops

W = f"WITH {SEC} "


def event_stream(spark, sf, max_bytes=1 << 30):
    return N.stream_table(spark, f"{sf}/events*.parquet", max_bytes)


def sec_stream(spark, sf, max_bytes=1 << 30):
    return event_stream(spark, sf, max_bytes).selectExpr(*[f"{e} AS {n}" for n, e in SEC_COLUMNS.items()]).withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "stream_timechart",
    W + """SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS _time, tenant, count(*) AS "count", round(sum(bytes), 2) AS total FROM sec
    GROUP BY 1, 2 HAVING date_trunc('hour', any_value(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM sec) - INTERVAL 10 MINUTE""",
)
def _(spark, sf):
    chart = Z.stream_timechart(sec_stream(spark, sf), "1h", aggs=[("count", None), ("sum", "bytes", "total")], by=("tenant",))
    out = N.run_available(chart, "timechart")
    return out.select(utc(F.col("_time")).alias("_time"), "tenant", "count", F.round("total", 2).alias("total"))


@query(
    "stream_threshold",
    W + f""", {QD.KEYED}, {QD._windows(1)}, t AS (SELECT rule_id, entity_key, window_start, span, count(*) AS n FROM inside GROUP BY rule_id, threshold, span, entity_key, window_start HAVING count(*) >= threshold)
    SELECT rule_id, entity_key, window_start, n FROM t WHERE make_timestamp((window_start + span) * 1000000) <= (SELECT max(ts) FROM keyed k WHERE k.span = t.span) - INTERVAL 10 MINUTE""",
)
def _(spark, sf):
    out = N.run_available(Z.stream_threshold(sec_stream(spark, sf), QD.WINDOW_RULES), "threshold")
    return out.select("rule_id", "entity_key", F.unix_seconds("window_start").alias("window_start"), "n")


@query(
    "stream_idle",
    W + f""", {QD.KEYED}, g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER k <= 1800000000 THEN 0 ELSE 1 END AS fresh FROM keyed WINDOW k AS (PARTITION BY rule_id, entity_key ORDER BY ts, event_id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY rule_id, entity_key ORDER BY ts, event_id) AS part FROM g)
    SELECT rule_id, entity_key, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY rule_id, threshold, entity_key, part
    HAVING count(*) >= threshold AND max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM keyed) - INTERVAL 10 MINUTE""",
)
def _(spark, sf):
    out = N.run_available(Z.stream_idle(sec_stream(spark, sf), QD.WINDOW_RULES, gap="30m"), "idle")
    return out.select("rule_id", "entity_key", "n", utc(F.col("first_ts")).alias("first_ts"), utc(F.col("last_ts")).alias("last_ts"))


@query("stream_dedup", ORACLES["dedup_ttl"])
def _(spark, sf):
    e = sec_stream(spark, sf).withColumn("message", F.concat(F.lit("m"), "hostname"))
    return N.run_available(Z.stream_dedup(e, "6h"), "dedup").select("event_id")


@query("stream_detect", ORACLES["detect_operators"])
def _(spark, sf):
    return N.run_available(Z.stream_detect(sec_stream(spark, sf), QD.OPERATOR_RULES), "detect").select("event_id", "rule_id")


@query("stream_enrich", ORACLES["enrich_user"])
def _(spark, sf):
    e = sec_stream(spark, sf).withColumnRenamed("user_name", "username")
    out = N.run_available(Z.stream_enrich(e, E.enrich_user(QD.user_table(spark, sf))), "enrich")
    return out.select("event_id", *[c for c in out.columns if c.startswith("user_")])


@query("stream_ueba", W + f", {QB.ent('tenant')}, {QB.AFTER_HOURS}, {QB.TRAVEL}, {QB.RARE} SELECT event_id, entity, anomaly_type, severity FROM (SELECT * FROM ah UNION ALL SELECT * FROM it UNION ALL SELECT * FROM rp)")
def _(spark, sf):
    return N.run_available(S.stream_ueba(sec_stream(spark, sf, N.STATEFUL_BATCH), ("tenant",)), "ueba")


RISK = """inc AS (SELECT 'u' || user_id AS entity, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS slot, CASE event_type WHEN 'error' THEN 30 WHEN 'signup' THEN 10 ELSE 0 END AS score FROM events),
 mark AS (SELECT CAST(floor(epoch(max(ts) - INTERVAL 10 MINUTE) / 3600) AS BIGINT) AS slot FROM events),
 h AS (SELECT entity, slot, sum(score)::BIGINT AS added FROM inc GROUP BY 1, 2),
 b AS (SELECT entity, min(slot) AS lo, greatest(max(slot), (SELECT slot FROM mark)) AS hi FROM h GROUP BY 1),
 g AS (SELECT entity, hi, unnest(range(lo, hi + 1)) AS slot FROM b),
 l AS (SELECT entity, list({'last': slot = hi, 'added': coalesce(added, 0)} ORDER BY slot) AS l FROM g LEFT JOIN h USING (entity, slot) GROUP BY 1)"""


@query(
    "stream_risk",
    f"""WITH {RISK} SELECT entity, CAST(list_reduce(l, lambda a, x: CASE WHEN x.last THEN least(100, a + x.added) ELSE floor(least(100, a + x.added) * 0.5)::BIGINT END, 0::BIGINT) AS INTEGER) AS score FROM l""",
)
def _(spark, sf):
    kind = F.col("event_type")
    score = F.when(kind == "error", 30).when(kind == "signup", 10).otherwise(0)
    e = event_stream(spark, sf, N.STATEFUL_BATCH).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("entity"), "ts", "event_id", score.alias("score"))
    updates = N.run_available(S.stream_risk(e), "risk", "update")
    return N.newest_per_key(updates, ["entity"]).select("entity", "score")


@query(
    "stream_reset",
    W + ", " + QD.RESET.format(key="hostname", cond="action = 'login_failed'", span=86400 * 1000000, n=4)
    + " SELECT k AS hostname, f[-1].id AS trigger_id, array_to_string(list_transform(f, lambda b: b.id), ',') AS source_ids FROM fired",
)
def _(spark, sf):
    rule = QD._rule("R-reset", ("action", "equals", "login_failed"), threshold=4, window="1d")
    out = N.run_available(S.stream_reset(sec_stream(spark, sf, N.STATEFUL_BATCH), rule, by="hostname"), "reset")
    return out.select(F.col("key").alias("hostname"), "trigger_id", F.array_join(F.col("source_ids").cast("array<string>"), ",").alias("source_ids"))


@query(
    "stream_features",
    """SELECT CAST(user_id AS VARCHAR) AS entity, event_type AS feature, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 8) AS mean, greatest(0.0, max(value)) AS highest FROM events GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    e = event_stream(spark, sf).select(F.col("user_id").cast("string").alias("entity"), F.col("event_type").alias("feature"), "ts", "value")
    out = N.newest_per_key(N.run_available(Z.stream_features(e), "features", "update"), ["window_start", "entity", "feature"])
    return out.withColumn("window_start", utc(F.col("window_start"))).withColumn("total", F.round("total", 4)).withColumn("mean", F.round("mean", 8))


# every fiftieth event comes with the last quarter, most of them late
ARRIVAL = "CASE WHEN event_id % 50 = 0 THEN 3 ELSE event_id * 4 // n END"
LATE_SQL = f"""WITH e AS (SELECT event_id, event_type, value, epoch_us(ts) AS us, {ARRIVAL} AS batch FROM events, (SELECT count(*) AS n FROM events)),
 b AS (SELECT batch, max(max(us)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest, max(max(us)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS older FROM e GROUP BY 1)"""


def arriving(spark, sf):
    """The events as four files, one after another; a stream takes one in each batch."""
    events, path = table(spark, sf, "events"), new_path(spark, "arriving")
    n = events.count()
    batch = F.when(F.col("event_id") % 50 == 0, 3).otherwise(F.floor(F.col("event_id") * 4 / n))
    for k in range(4):
        events.where(batch == k).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
    return N.stream_table(spark, path, files_per_batch=1)


@query("stream_late", LATE_SQL + " SELECT event_id, CASE WHEN us < newest - 600000000 THEN 'late' ELSE 'on_time' END AS state FROM e JOIN b USING (batch)")
def _(spark, sf):
    on_time, late, seen = (new_path(spark, n) for n in ("on-time", "late", "seen"))
    writer = arriving(spark, sf).writeStream.foreachBatch(Z.late_split(on_time, late, seen, "10m"))
    writer.option("checkpointLocation", new_path(spark, "late-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    parts = [spark.read.parquet(p).select("event_id", F.lit(n).alias("state")) for p, n in ((on_time, "on_time"), (late, "late"))]
    return parts[0].union(parts[1])


@query("stream_drops", LATE_SQL + " SELECT batch, CAST(count(*) FILTER (us < older // 1000 * 1000 - 600000000) AS BIGINT) AS dropped FROM e JOIN b USING (batch) GROUP BY 1")
def _(spark, sf):
    """Rows that the watermark of a deduplicating stream drops, by batch."""
    with counted_drops(spark) as counter:
        events = arriving(spark, sf).withWatermark("ts", "10 minutes").dropDuplicates(["event_id", "ts"])
        started = events.writeStream.format("noop").option("checkpointLocation", new_path(spark, "drops")).trigger(availableNow=True).start()
        started.awaitTermination()
        counter.wait(str(started.runId))
    # a batch without rows may follow, to let go of old state
    return counter.counts(spark).where("batch < 4").select("batch", "dropped")


@query("stream_event_store", "SELECT event_id, CAST(date_trunc('day', ts) AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour FROM events")
def _(spark, sf):
    out = new_path(spark, "store")
    events = arriving(spark, sf).withColumn("source", F.col("event_type"))
    O.stream_event_store(events, out, new_path(spark, "store-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("event_id", "date", "hour")


@query("stream_dead_letter", "SELECT event_id, CASE WHEN event_type = 'error' AND value > 40 THEN 'too large' ELSE 'good' END AS state FROM events")
def _(spark, sf):
    good, bad = new_path(spark, "good"), new_path(spark, "bad")
    write = O.sink_dead_letter(good, bad, lambda df: F.when((F.col("event_type") == "error") & (F.col("value") > 40), "too large"))
    arriving(spark, sf).writeStream.foreachBatch(write).option("checkpointLocation", new_path(spark, "letters")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(good).select("event_id", F.lit("good").alias("state")).union(spark.read.parquet(bad).select("event_id", "error"))
