"""Driver queries for filters, aggregation, ordering and result shaping."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from eventlens.functions.fields import field
from eventlens.operators import heavy as H
from eventlens.operators import postings as G
from eventlens.operators import rollups as U
from eventlens.operators import search as S
from eventlens.operators import shape as P
from eventlens.operators import stats as A
from eventlens.plans.catalog import query
from eventlens.plans.tables import SEC, sec_events, table, utc
from eventlens.session import new_path

W = f"WITH {SEC} "


# filters -----------------------------------------------------------------
@query("search_keyword", "SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'license')")
def _(spark, sf):
    return table(spark, sf, "documents").transform(S.search_keyword("THE", "License", message="text")).select("doc_id", "n_chars")


@query("search_field", W + "SELECT event_id, source, status FROM sec WHERE status = 'failed' AND source = 'auth-server' AND tenant = 't1'")
def _(spark, sf):
    hits = sec_events(spark, sf).transform(S.search_field(status="failed", source="auth-server", tenant="t1"))
    return hits.select("event_id", "source", "status")


STOPS = ", ".join(f"'{w}'" for w in S.STOP_WORDS)
TOKENS = f"""tok AS (SELECT DISTINCT doc_id, token FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-zA-Z0-9]+')) AS token
 FROM documents) WHERE length(token) >= 2 AND token NOT IN ({STOPS}))"""


@query("search_tokens", f"WITH {TOKENS} SELECT doc_id FROM tok WHERE token IN ('thtion', 'attion') GROUP BY doc_id HAVING count(*) = 2")
def _(spark, sf):
    return table(spark, sf, "documents").transform(S.search_tokens("The Thtion, attion", body="text")).select("doc_id")


@query("search_tokens_index", f"WITH {TOKENS} SELECT token, count(*) AS docs, min(doc_id) AS first_doc FROM tok GROUP BY token")
def _(spark, sf):
    index = S.token_index(table(spark, sf, "documents"), "doc_id", "text")
    return index.groupBy("token").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first_doc"))


@query("search_tokens_lookup", f"WITH {TOKENS} SELECT doc_id FROM tok WHERE token IN ('thtion', 'attion') GROUP BY doc_id HAVING count(*) = 2")
def _(spark, sf):
    path = new_path(spark, "tokens")
    S.write_token_index(S.token_index(table(spark, sf, "documents"), "doc_id", "text"), "doc_id", path)
    return S.search_index(spark.read.parquet(path), "thtion attion", "doc_id")


BOOLEAN = ("or", ("and", "thtion", ("not", "attion")), ("and", "Attion the", ("or", "ingthe", ("not", "thtion"))))


@query(
    "search_postings",
    f"""WITH {TOKENS}, h AS (SELECT documents.doc_id, coalesce(bool_or(token = 'thtion'), false) AS a, coalesce(bool_or(token = 'attion'), false) AS b, coalesce(bool_or(token = 'ingthe'), false) AS c FROM documents LEFT JOIN tok ON documents.doc_id = tok.doc_id GROUP BY 1)
    SELECT doc_id FROM h WHERE (a AND NOT b) OR (b AND (c OR NOT a))""",
)
def _(spark, sf):
    path = new_path(spark, "postings")
    G.write_postings(table(spark, sf, "documents"), "doc_id", "text", path)
    return G.search_postings(spark, path, BOOLEAN).withColumnRenamed("key", "doc_id")


@query(
    "where_compare",
    W + """SELECT event_id, value, user_name FROM sec WHERE value > 9.5 AND (user_name <> 'u7' OR user_name IS NULL)
    AND CAST(event_id AS VARCHAR) > '5'""",
)
def _(spark, sf):
    hits = sec_events(spark, sf).transform(S.where_compare("value", ">", 9.5)).transform(S.where_compare("user_name", "!=", "u7"))
    return hits.transform(S.where_compare("event_id", ">", "5", lexical=True)).select("event_id", "value", "user_name")


@query("where_field_compare", "SELECT o_orderkey FROM orders WHERE o_orderkey % 1500 = o_custkey OR o_custkey > o_orderkey")
def _(spark, sf):
    orders = table(spark, sf, "orders").withColumn("slot", F.col("o_orderkey") % 1500)
    same = S.where_bool(("slot", "=", S.FieldRef("o_custkey")), ("o_custkey", ">", S.FieldRef("o_orderkey")), any_of=True)
    return orders.transform(same).select("o_orderkey")


@query("where_bool", W + "SELECT event_id FROM sec WHERE NOT ((status = 'failed' AND direction = 'outbound') OR tenant = 't2')")
def _(spark, sf):
    events = sec_events(spark, sf)
    both = lambda df: S.compare(df, "status", "=", "failed") & S.compare(df, "direction", "=", "outbound")
    return events.transform(S.where_bool(both, ("tenant", "=", "t2"), any_of=True, negate=True)).select("event_id")


@query("fields_keep", W + "SELECT event_id, user_name, action FROM sec")
def _(spark, sf):
    return sec_events(spark, sf).transform(S.fields_keep("event_id", "user_name", "action", "no_such_field"))


@query("fields_drop", "SELECT event_id, user_id, event_type, value FROM events")
def _(spark, sf):
    return table(spark, sf, "events").transform(S.fields_drop("props", "ts"))


@query("fields_regex", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").transform(S.fields_regex("^o_order")).transform(S.fields_regex("date$", drop=True))


@query("eval_copy", W + "SELECT event_id, coalesce(process_name, action) AS action, coalesce(user_name, hostname) AS who FROM sec")
def _(spark, sf):
    copied = sec_events(spark, sf).transform(S.eval_copy("action", "process_name"))
    return copied.transform(S.eval_copy("who", "hostname")).transform(S.eval_copy("who", "user_name")).select("event_id", "action", "who")


@query(
    "eval_arith",
    """SELECT event_id, value + user_id AS a, value - 1.5 AS b, value * 2.0 AS c, 0.0 - value AS d,
    CASE WHEN user_id % 3 = 0 THEN NULL ELSE value / (user_id % 3) END AS e FROM events""",
)
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("third", F.col("user_id") % 3)
    e = e.transform(S.eval_arith("a", "value", "+", "user_id")).transform(S.eval_arith("b", "value", "-", 1.5))
    e = e.transform(S.eval_arith("c", "value", "*", 2)).transform(S.eval_arith("d", "event_type", "-", "value"))
    return e.transform(S.eval_arith("e", "value", "/", "third")).select("event_id", "a", "b", "c", "d", "e")


@query("drill_include", W + "SELECT event_id FROM sec WHERE hostname = 'h3' AND action = 'login_failed'")
def _(spark, sf):
    return sec_events(spark, sf).transform(S.drill_include({"hostname": "h3", "action": "login_failed", "_time": "x"})).select("event_id")


@query("drill_exclude", W + "SELECT event_id FROM sec WHERE (user_name <> 'u3' OR user_name IS NULL) AND status <> 'failed'")
def _(spark, sf):
    return sec_events(spark, sf).transform(S.drill_exclude({"user_name": "u3", "status": "failed", "_span": 1})).select("event_id")


@query(
    "drill_timezoom",
    "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-15 11:55:00' AND ts < TIMESTAMP '2024-01-15 12:05:00'",
)
def _(spark, sf):
    return sec_events(spark, sf).transform(S.drill_timezoom(datetime(2024, 1, 15, 12))).select("event_id")


@query("drill_pivot", W + 'SELECT hostname, count(*) AS "count" FROM sec GROUP BY hostname')
def _(spark, sf):
    return sec_events(spark, sf).transform(S.drill_pivot({"_time": 1, "hostname": "h3"}))


@query("text_find", "SELECT page_id FROM pages WHERE contains(lower(url), '/de/') OR contains(lower(html), 'license') OR contains(lower(url), 'license')")
def _(spark, sf):
    pages = table(spark, sf, "pages").withColumn("labels", F.array("url"))
    by_url = S.where_bool(lambda d: F.lower("url").contains("/de/"), lambda d: F.lower("html").contains("license"), any_of=True)
    found = pages.transform(S.text_find("License", ["html"], labels="labels")).select("page_id")
    return found.union(pages.transform(by_url).select("page_id")).distinct()


@query("scope_filter", "SELECT 'admin' AS role, event_id FROM events UNION ALL SELECT 'auditor', event_id FROM events WHERE event_type = 'error'")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("index", F.when(F.col("event_type") == "error", "_audit").otherwise("main"))
    views = [e.transform(S.scope_filter(r)).select(F.lit(r).alias("role"), "event_id") for r in ("admin", "auditor", "guest")]
    return views[0].union(views[1]).union(views[2])


# ordering ----------------------------------------------------------------
@query("limit_rows", "SELECT event_id, value FROM events ORDER BY ts, event_id LIMIT 100")
def _(spark, sf):
    return table(spark, sf, "events").transform(P.limit_rows(100, "ts", "event_id")).select("event_id", "value")


@query("sort_rows", W + "SELECT event_id, value, user_name FROM sec ORDER BY value DESC, user_name NULLS LAST, event_id")
def _(spark, sf):
    return sec_events(spark, sf).transform(P.sort_rows("-value", "user_name", "event_id")).select("event_id", "value", "user_name")


@query("head_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _(spark, sf):
    return table(spark, sf, "orders").transform(P.head_rows(20, "-o_totalprice", "o_orderkey")).select("o_orderkey", "o_totalprice")


@query("merge_latest", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def _(spark, sf):
    e = table(spark, sf, "events")
    error = F.col("event_type").eqNullSafe("error")
    return P.merge_latest(e.where(error), None, e.where(~error), limit=50).select("event_id", "event_type")


@query("merge_ordered", "SELECT event_id FROM events ORDER BY ts, event_id")
def _(spark, sf):
    e = table(spark, sf, "events")
    return P.merge_ordered(e.where("event_type <=> 'error'"), e.where("not (event_type <=> 'error')")).select("event_id")


@query(
    "top_n_others",
    W + """, s AS (SELECT date_trunc('day', ts) AS day, process_name AS series, count(*) AS v FROM sec WHERE process_name IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY v DESC, series) AS k FROM s)
    SELECT CAST(day AS TIMESTAMP) AS day, CASE WHEN k <= 10 THEN series ELSE 'others' END AS series, CAST(sum(v) AS BIGINT) AS value FROM r GROUP BY 1, 2""",
)
def _(spark, sf):
    e = sec_events(spark, sf).where("process_name is not null")
    e = e.select(utc(F.date_trunc("day", "ts")).alias("day"), F.col("process_name").alias("series"))
    return e.transform(P.top_n_others("day", "series", F.count(F.lit(1))))


@query(
    "top_values",
    W + """SELECT process_name, count(*) AS "count", round(count(*) * 100.0 / (SELECT count(*) FROM sec WHERE process_name IS NOT NULL), 6) AS percent
    FROM sec WHERE process_name IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, process_name LIMIT 10""",
)
def _(spark, sf):
    top = sec_events(spark, sf).where("process_name is not null").transform(P.top_values("process_name"))
    return top.withColumn("percent", F.round("percent", 6))


@query(
    "rare_values",
    W + """SELECT process_name, count(*) AS "count", round(count(*) * 100.0 / (SELECT count(*) FROM sec WHERE process_name IS NOT NULL), 6) AS percent
    FROM sec WHERE process_name IS NOT NULL GROUP BY 1 ORDER BY count(*), process_name LIMIT 10""",
)
def _(spark, sf):
    top = sec_events(spark, sf).where("process_name is not null").transform(P.rare_values("process_name"))
    return top.withColumn("percent", F.round("percent", 6))


# aggregation -------------------------------------------------------------
@query("stats_count", W + 'SELECT user_name, count(*) AS "count" FROM sec GROUP BY user_name')
def _(spark, sf):
    return sec_events(spark, sf).transform(A.stats_by("user_name", aggs=[("count", None)]))


@query(
    "stats_sum",
    "SELECT event_type, round(sum(value), 4) AS total, 0.0::DOUBLE AS nothing, CAST(sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS DOUBLE) AS k FROM events GROUP BY 1",
)
def _(spark, sf):
    e = table(spark, sf, "events").withColumnRenamed("props", "data")
    out = e.transform(A.stats_by("event_type", aggs=[("sum", "value", "total"), ("sum", "event_type", "nothing"), ("sum", "k", "k")]))
    return out.withColumn("total", F.round("total", 4))


@query("stats_avg", "SELECT event_type, round(avg(value), 6) AS mean, 0.0::DOUBLE AS nothing FROM events GROUP BY 1")
def _(spark, sf):
    out = table(spark, sf, "events").transform(A.stats_by("event_type", aggs=[("avg", "value", "mean"), ("avg", "no_field", "nothing")]))
    return out.withColumn("mean", F.round("mean", 6))


@query("stats_min", 'SELECT user_id, min(value) AS "min(value)", 0.0::DOUBLE AS "min(event_type)" FROM events GROUP BY 1')
def _(spark, sf):
    return table(spark, sf, "events").transform(A.stats_by("user_id", aggs=[("min", "value"), ("min", "event_type")]))


@query("stats_max", 'SELECT user_id, max(value) AS "max(value)", 0.0::DOUBLE AS "max(event_type)" FROM events GROUP BY 1')
def _(spark, sf):
    return table(spark, sf, "events").transform(A.stats_by("user_id", aggs=[("max", "value"), ("max", "event_type")]))


@query(
    "stats_global",
    """SELECT 'all' AS part, count(*) AS "count", round(sum(value), 4) AS total FROM events
    UNION ALL SELECT 'none', count(*), coalesce(sum(value), 0.0) FROM events WHERE event_type = 'absent'""",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    aggs = A.stats_global(("count", None), ("sum", "value", "total"))
    whole = e.transform(aggs).select(F.lit("all").alias("part"), "count", F.round("total", 4).alias("total"))
    return whole.union(e.where("event_type = 'absent'").transform(aggs).select(F.lit("none"), "count", "total"))


@query(
    "stats_by",
    W + """SELECT coalesce(user_name, '(null)') AS user_name, tenant, count(*) AS "count", round(sum(bytes), 2) AS total,
    round(avg(value), 8) AS mean, min(value) AS low, max(value) AS high FROM sec GROUP BY 1, 2""",
)
def _(spark, sf):
    aggs = [("count", None), ("sum", "bytes", "total"), ("avg", "value", "mean"), ("min", "value", "low"), ("max", "value", "high")]
    out = sec_events(spark, sf).transform(A.stats_by("user_name", "tenant", aggs=aggs, stringify=True))
    return out.withColumn("total", F.round("total", 2)).withColumn("mean", F.round("mean", 8))


@query("stats_dc", W + "SELECT hostname, count(DISTINCT user_name) AS users, count(DISTINCT src_ip) AS ips FROM sec GROUP BY 1")
def _(spark, sf):
    return sec_events(spark, sf).transform(A.stats_by("hostname", aggs=[("dc", "user_name", "users"), ("dc", "src_ip", "ips")]))


def hours_stored(spark, sf):
    """Hour roll-up, written and read back."""
    path = new_path(spark, "hours")
    sec_events(spark, sf).transform(U.rollup("1h", ("hostname",), ("user_name", "src_ip"), ("value",))).write.parquet(path)
    return spark.read.parquet(path)


@query(
    "rollup_distinct_day",
    W + """SELECT hostname, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, count(*) AS "count", round(min(value), 6) AS min_value, round(max(value), 6) AS max_value, count(DISTINCT user_name) AS dc_user_name, count(DISTINCT src_ip) AS dc_src_ip FROM sec GROUP BY 1, 2""",
)
def _(spark, sf):
    day = hours_stored(spark, sf).transform(U.coarser("1d", ("hostname",))).transform(U.distinct_counts)
    return day.select("hostname", F.floor(F.unix_seconds("_time") / 86400).alias("day"), "count", F.round("min_value", 6).alias("min_value"), F.round("max_value", 6).alias("max_value"), "dc_user_name", "dc_src_ip")


@query("rollup_distinct_all", W + "SELECT hostname, count(*) AS \"count\", count(DISTINCT user_name) AS dc_user_name, count(DISTINCT src_ip) AS dc_src_ip FROM sec GROUP BY 1")
def _(spark, sf):
    return hours_stored(spark, sf).transform(U.coarser(None, ("hostname",))).transform(U.distinct_counts).select("hostname", "count", "dc_user_name", "dc_src_ip")


@query(
    "rollup_overlap",
    W + """, a AS (SELECT DISTINCT hostname, user_name FROM sec WHERE user_name IS NOT NULL AND floor(epoch(ts) / 3600) * 3600 < epoch(TIMESTAMP '2024-01-15')), b AS (SELECT DISTINCT hostname, user_name FROM sec WHERE user_name IS NOT NULL AND floor(epoch(ts) / 3600) * 3600 >= epoch(TIMESTAMP '2024-01-15')),
    u AS (SELECT hostname, user_name, max(l) AS l, max(r) AS r FROM (SELECT *, 1 AS l, 0 AS r FROM a UNION ALL SELECT *, 0, 1 FROM b) GROUP BY 1, 2)
    SELECT hostname, CAST(sum(l) AS BIGINT) AS left_dc, CAST(sum(r) AS BIGINT) AS right_dc, CAST(sum(l * r) AS BIGINT) AS both_dc, CAST(sum(l * (1 - r)) AS BIGINT) AS only_left_dc FROM u GROUP BY 1""",
)
def _(spark, sf):
    hours = hours_stored(spark, sf)
    half = lambda a, b: U.within(hours, a, b).transform(U.coarser(None, ("hostname",)))
    return U.overlap(half("2000-01-01", "2024-01-15"), half("2024-01-15", "2100-01-01"), "user_name", ["hostname"])


@query(
    "stats_largest",
    W + """, g AS (SELECT process_name, row_number() OVER (ORDER BY count(*) DESC, CASE WHEN process_name IS NULL THEN '{"process_name":null}' ELSE '{"process_name":"' || process_name || '"}' END) <= 5 AS shown FROM sec GROUP BY 1),
    m AS (SELECT sec.*, shown FROM sec JOIN g ON sec.process_name IS NOT DISTINCT FROM g.process_name)
    SELECT CASE WHEN shown THEN process_name END AS process_name, NOT shown AS rest, count(*) AS n, count(DISTINCT user_name) AS users, max(value) AS highest FROM m GROUP BY 1, 2""",
)
def _(spark, sf):
    return sec_events(spark, sf).transform(H.stats_largest(("process_name",), [("count", None, "n"), ("dc", "user_name", "users"), ("max", "value", "highest")], 5))


@query("stats_values", W + "SELECT hostname, process_name AS value, count(*) AS n FROM sec WHERE process_name IS NOT NULL GROUP BY 1, 2")
def _(spark, sf):
    return sec_events(spark, sf).transform(A.stats_values("process_name", "hostname"))


@query("stats_list", W + "SELECT hostname, process_name AS value FROM sec WHERE process_name IS NOT NULL")
def _(spark, sf):
    return sec_events(spark, sf).transform(A.stats_list("process_name", "hostname"))


FLOOR = "CAST(to_timestamp(CAST(floor(epoch(ts) / {n}) * {n} AS BIGINT)) AT TIME ZONE 'UTC' AS TIMESTAMP)"


@query("bucket_time", f"SELECT event_id, {FLOOR.format(n=600)} AS _time FROM events")
def _(spark, sf):
    e = table(spark, sf, "events").transform(A.bucket_time("10m"))
    return e.select("event_id", utc(F.col("_time")).alias("_time"))


@query(
    "timechart",
    W + f"""SELECT {FLOOR.format(n=3600)} AS _time, user_name, count(*) AS "count", round(sum(bytes), 2) AS total,
    3600 AS _span, 'timechart' AS _type FROM sec WHERE status = 'failed' GROUP BY 1, 2""",
)
def failed_timechart(spark, sf):
    chart = A.timechart("1h", aggs=[("count", None), ("sum", "bytes", "total")], by=("user_name",))
    out = sec_events(spark, sf).transform(S.search_field(status="failed")).transform(chart)
    return out.withColumn("_time", utc(F.col("_time"))).withColumn("total", F.round("total", 2))


@query(
    "timechart_fill",
    f"""WITH c AS (SELECT {FLOOR.format(n=900)} AS t, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1),
    g AS (SELECT unnest(generate_series((SELECT min(t) FROM c), (SELECT max(t) FROM c), INTERVAL 15 MINUTE)) AS t)
    SELECT g.t AS _time, coalesce(n, 0) AS "count", 900 AS _span, 'timechart' AS _type FROM g LEFT JOIN c USING (t)""",
)
def _(spark, sf):
    out = table(spark, sf, "events").where("event_type = 'error'").transform(A.timechart("15m", fill=True))
    return out.withColumn("_time", utc(F.col("_time"))).withColumn("count", F.coalesce("count", F.lit(0)))


@query(
    "series_unpivot",
    """WITH d AS (SELECT date_trunc('day', ts) AS _time, count(*)::DOUBLE AS n, round(sum(value), 4) AS total FROM events GROUP BY 1)
    SELECT CAST(_time AS TIMESTAMP) AS _time, 'n' AS series, n AS value FROM d UNION ALL SELECT CAST(_time AS TIMESTAMP), 'total', total FROM d""",
)
def _(spark, sf):
    wide = table(spark, sf, "events").transform(A.timechart("1d", aggs=[("count", None, "n"), ("sum", "value", "total")]))
    wide = wide.withColumn("_time", utc(F.col("_time"))).withColumn("total", F.round("total", 4))
    return wide.transform(P.series_unpivot())


@query(
    "series_pivot",
    """SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS _time, count(*) FILTER (event_type = 'error') AS error,
    count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1""",
)
def _(spark, sf):
    cut = table(spark, sf, "events").transform(A.bucket_time("1d"))
    wide = cut.transform(P.series_pivot("event_type", F.count(F.lit(1)), ["error", "view"]))
    filled = wide.fillna(0, ["error", "view"])
    return filled.withColumn("_time", utc(F.col("_time")))


# shaping -----------------------------------------------------------------
@query(
    "classify_threshold",
    "SELECT event_id, CASE WHEN value >= 40 THEN 'critical' WHEN value >= 10 THEN 'warning' WHEN value >= 1 THEN 'ok' END AS label FROM events",
)
def _(spark, sf):
    limits = [(10, "warning"), (40, "critical"), (1, "ok")]
    return table(spark, sf, "events").transform(P.classify_threshold("value", limits)).select("event_id", "label")


@query(
    "flag_cells",
    W + """, c AS (SELECT event_id, CAST(event_id % 600 AS VARCHAR) AS status, value * 40 AS latency,
    CASE WHEN event_id % 7 = 0 THEN 'ERROR' WHEN event_id % 7 = 1 THEN 'WARN' ELSE 'error ok' END AS log_level, message FROM sec)
    SELECT event_id, CASE WHEN CAST(status AS INT) >= 500 THEN 'server_error' WHEN CAST(status AS INT) >= 400 THEN 'client_error' WHEN CAST(status AS INT) >= 200 THEN 'ok' END AS status_flag,
    CASE WHEN latency > 1000 THEN 'very_slow' WHEN latency > 500 THEN 'slow' END AS latency_flag,
    CASE log_level WHEN 'ERROR' THEN 'error_level' WHEN 'WARN' THEN 'warn_level' ELSE 'anomaly' END AS log_level_flag,
    CASE WHEN regexp_matches(lower(message), 'error|fail|deny|critical|exception|unauthorized') THEN 'anomaly' END AS message_flag FROM c""",
)
def _(spark, sf):
    e = sec_events(spark, sf).withColumn("status", (F.col("event_id") % 600).cast("string")).withColumn("latency", F.col("value") * 40)
    level = F.when(F.col("event_id") % 7 == 0, "ERROR").when(F.col("event_id") % 7 == 1, "WARN").otherwise("error ok")
    flagged = e.withColumn("log_level", level).transform(P.flag_cells("status", "latency", "log_level", "message"))
    return flagged.select("event_id", "status_flag", "latency_flag", "log_level_flag", "message_flag")


@query(
    "report_delta",
    """WITH b AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1, 2),
    a AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1, 2)
    SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, coalesce(b.n, -1) AS "before", coalesce(a.n, -1) AS "after",
    coalesce(a.n, 0) - coalesce(b.n, 0) AS diff,
    CASE WHEN b.n IS NULL THEN 'added' WHEN a.n IS NULL THEN 'removed' WHEN a.n = b.n THEN 'unchanged' ELSE 'changed' END AS status
    FROM b FULL OUTER JOIN a ON a.user_id = b.user_id AND a.event_type = b.event_type""",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    split = F.lit("2024-01-16").cast("timestamp_ntz")
    count = A.stats_by("user_id", "event_type", aggs=[("count", None, "n")])
    delta = P.report_delta(e.where(F.col("ts") < split).transform(count), e.where(F.col("ts") >= split).transform(count), ["user_id", "event_type"], "n")
    return delta.fillna(-1, ["before", "after"])


@query("eval_expr", "SELECT event_id, upper(event_type) || '-' || CAST(user_id AS VARCHAR) AS tag FROM events")
def _(spark, sf):
    e = table(spark, sf, "events")
    return e.transform(S.eval_expr("tag", F.concat(F.upper(field(e, "event_type")), F.lit("-"), F.col("user_id").cast("string")))).select("event_id", "tag")
