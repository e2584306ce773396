"""Cases in which results once depended on limits, types or the way rows were grouped."""

from times import at
from pyspark.sql import functions as F

from eventlens.operators import enrich as E
from eventlens.operators import lifecycle as Y
from eventlens.operators import rules as R
from eventlens.operators import search as S
from eventlens.operators.behavior import rolling_anomaly
from eventlens.operators.correlate import window_starts
from eventlens.operators.tenancy import tenant_storage_quota
from eventlens.session import new_path
from eventlens.sources.writers import audited_write
from eventlens.streaming import runner as N
from eventlens.streaming import windows as Z


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_integers_compare_exactly_and_reach_the_scan(spark):
    path = new_path(spark, "big")
    spark.createDataFrame([(9007199254740992, "a"), (9007199254740993, "b"), (None, "c")], "id long, name string").write.parquet(path)
    df = spark.read.parquet(path)
    assert [r.name for r in df.transform(S.where_compare("id", "=", 9007199254740993)).collect()] == ["b"]
    rule = R.Rule("r", "R", "low", (R.Condition("id", "eq", 9007199254740993),))
    assert [r.name for r in df.transform(R.detect_rules([rule])).collect()] == ["b"]
    for shown in (df.transform(S.where_compare("id", ">", 5)), df.transform(S.where_bool(("id", ">", 5), ("name", "=", "b"))), df.transform(R.detect_rules([rule]))):
        assert "PushedFilters: []" not in plan(shown) and ("GreaterThan(id" in plan(shown) or "EqualTo(id" in plan(shown))
    assert {r.name for r in df.transform(S.where_bool(("id", ">", 9007199254740992), negate=True)).collect()} == {"a", "c"}


def test_windows_that_do_not_divide_the_span(spark):
    df = spark.createDataFrame([(at(s),) for s in range(30)], "ts timestamp")
    ours = df.select(F.explode(window_starts(F.col("ts"), F.lit(10), 3)).alias("w")).groupBy("w").count()
    theirs = df.groupBy(F.window("ts", "10 seconds", "3 seconds").alias("w")).count()
    assert sorted(r["count"] for r in ours.collect()) == sorted(r["count"] for r in theirs.collect())


def test_baseline_window_longer_than_a_block(spark):
    rows = [(i, at(i), "u", float(i % 7) + (500 if i in (900, 1800) else 0)) for i in range(2000)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, entity string, bytes double").withColumn("value", F.col("bytes"))
    small, large = (rolling_anomaly(df, window=1000, block=b) for b in (100, 4000))
    a, b = ({(r.event_id, r.metric): r.deviation for r in d.collect()} for d in (small, large))
    assert a.keys() == b.keys() and a and all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_quota_of_the_null_tenant(spark):
    rows = [(i, None, at(i), 10) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, tenant string, ts timestamp, bytes long")
    one, many = (sorted(map(repr, df.transform(tenant_storage_quota(100, size="bytes", fold_rows=n)).collect())) for n in (2000, 5))
    assert one == many


def test_identities_and_patterns(spark):
    people = spark.createDataFrame([("Alice", "a", "d", 1), ("alice", "b", "e", 2)], "key string, primary_user string, department string, uid int")
    events = spark.createDataFrame([(1, "ALICE", "1.1.1.1")], "event_id long, user string, src_ip string")
    assert [r.owner_user for r in events.transform(E.enrich_identity(people)).collect()] == ["a"]
    known = spark.createDataFrame([("i1", "[ipv4-addr:value = 'x' OR ipv4-addr:value = '1.1.1.1']", "high")], "id string, pattern string, severity string")
    assert [r.indicator_id for r in events.transform(E.match_indicator(known, "src_ip")).collect()] == ["i1"]


def test_audit_hash_counts_repeats(spark):
    found = []
    for rows in ([1, 1, 2], [3, 3, 2], [2, 1, 1]):
        trail = new_path(spark, "trail")
        audited_write(spark.createDataFrame([(r,) for r in rows], "a int"), new_path(spark, "out"), trail, "u", "x")
        found.append(spark.read.parquet(trail).first().result_hash)
    assert found[0] != found[1] and found[0] == found[2]


def test_retention_is_pushed(spark):
    path = new_path(spark, "kept")
    spark.createDataFrame([(1, at(0), True), (2, at(0), False), (3, at(86400 * 9), None)], "event_id long, ts timestamp, audit boolean").write.parquet(path)
    kept = spark.read.parquet(path).transform(Y.expire_events("2024-01-11", 5, 30, F.col("audit")))
    assert sorted(r.event_id for r in kept.collect()) == [1, 3] and "GreaterThanOrEqual(ts" in plan(kept)


def test_stream_dedup_does_not_depend_on_batches(spark):
    path = new_path(spark, "copies")
    rows = [(i, at(3600 * i), "k") for i in range(24)] + [(100 + i, at(3600 * i + 60), "k") for i in range(24)]
    rows.sort(key=lambda r: r[1])
    for a in range(0, 48, 10):
        spark.createDataFrame(rows[a : a + 10], "event_id long, ts timestamp, id string").coalesce(1).write.mode("append").parquet(path)
    want = sorted(r.event_id for r in spark.read.parquet(path).transform(Y.dedup_ttl("5m")).collect())
    for files in ("1", "100"):
        stream = spark.readStream.schema("event_id long, ts timestamp, id string").option("maxFilesPerTrigger", files).parquet(path)
        assert sorted(r.event_id for r in N.run_available(Z.stream_dedup(stream, "5m"), "dd").collect()) == want == list(range(24))
