"""Composed operators, plans without sorts of raw rows, and asset fields of every provider."""

import json

from pyspark.sql import functions as F

from eventlens.functions.ordered import group_sizes
from eventlens.operators import behavior as B
from eventlens.operators import chain as H
from eventlens.operators import cloud as C
from eventlens.operators import enrich as E
from eventlens.operators import graph as G
from eventlens.operators import lifecycle as Y
from eventlens.operators.privacy import token_of
from eventlens.operators.rules import Condition, Rule
from eventlens.session import new_path


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ingest_keeps_every_event_and_rules_see_context(spark):
    rows = [(1, "Bob", "a@x"), (2, None, None), (3, "Eve", "")]
    e = spark.createDataFrame(rows, "event_id long, user string, email string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    users = spark.createDataFrame([("Bob", "Sales")], "key string, department string")
    for c in ("full_name", "email", "role", "manager", "title", "location"):
        users = users.withColumn(c, F.lit("x"))
    rule = Rule("r", "r", "high", (Condition("user_department", "equals", "Sales"),))
    out = {r.event_id: r for r in e.transform(H.ingest([rule], "salt", E.enrich_user(users))).collect()}
    token = spark.range(1).select(token_of(F.lit("a@x"), "salt")).first()[0]
    assert sorted(out) == [1, 2, 3] and [d.rule_id for d in out[1].detections] == ["r"] and out[1].email == token
    assert out[2].detections == [] and out[2].email is None and out[3].email == "" and out[2].tenant_id == "default"
    alerts = H.stored_alerts(e.transform(H.ingest([rule], "salt", E.enrich_user(users))).withColumn("source", F.lit("s")), [])
    assert [(a.kind, a.rule_id, a.entity) for a in alerts.where("kind = 'detection'").collect()] == [("detection", "r", None)]


def test_alert_risk(spark):
    rows = [("anomaly", "high", "u"), ("anomaly", "medium", "u"), ("detection", "high", None)]
    alerts = spark.createDataFrame(rows, "kind string, severity string, entity string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    assert [(r.entity, r.score, r.incidents) for r in H.alert_risk(alerts).collect()] == [("u", 60, 2)]


def test_masked_search_leaves_an_audit_row(spark):
    found = spark.createDataFrame([(1, "a@b.com", "1.2.3.4")], "id long, email string, src_ip string")
    trail = new_path(spark, "trail")
    out = H.masked_search(found, "analyst", "s", new_path(spark, "masked"), trail, "q").collect()
    assert len(out) == 1 and out[0].email != "a@b.com" and out[0].src_ip == "1.2.3.xxx"
    audit = spark.read.parquet(trail).collect()
    assert [(a.actor, a.action, a.status, a.rows, a.details) for a in audit] == [("analyst", "SEARCH", "success", 1, "q")]


def test_no_sort_before_aggregates(spark):
    e = spark.range(100).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), F.concat(F.lit("u"), F.col("id") % 3).alias("user"), F.lit("login").alias("action"), F.lit("s").alias("source"))
    updates = e.select(F.col("user").alias("entity"), F.lit("f").alias("feature"), F.lit("set").alias("op"), F.col("event_id").cast("double").alias("value"), "ts", "event_id")
    for df in (B.extract_features(e), B.feature_ops(updates), G.trust_nodes(e), Y.stage_metrics(e, ("scan", F.lit(True)))):
        assert "SortAggregate" not in plan(df) and "ObjectHash" not in plan(df)
    assert {r.entity: r.value for r in B.feature_ops(updates).collect()} == {"u0": 99.0, "u1": 97.0, "u2": 98.0}


def test_feature_order_with_ties_and_nulls(spark):
    rows = [("a", None, 5, 1.0), ("a", "2024-01-01", 1, 2.0), ("a", "2024-01-01", 2, 3.0), ("b", None, -(2**63), 4.0), ("b", None, 2**63 - 1, 5.0)]
    u = spark.createDataFrame(rows, "entity string, ts string, event_id long, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    out = B.feature_ops(u.withColumn("feature", F.lit("f")).withColumn("op", F.lit("set"))).collect()
    assert {r.entity: r.value for r in out} == {"a": 3.0, "b": 5.0}


def test_trust_nodes_named_alike(spark):
    rows = [(1, "x", "x"), (2, "x", None), (3, "y", "z"), (4, None, "w"), (None, "n", "n")]
    e = spark.createDataFrame(rows, "ts long, source string, user string").withColumn("ts", F.timestamp_seconds("ts"))
    assert {r.id: r.type for r in G.trust_nodes(e).collect()} == {"x": "system", "y": "system", "z": "user", "w": "user", "n": "user"}


def test_group_sizes_are_exact_above_the_limit(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 400, F.lit(None)).otherwise(F.col("id") % 100).alias("k"))
    assert group_sizes(df, ["k"], 5) == (1000, 400)
    assert group_sizes(df, ["k"], 10_000) == (1000, 400)
    assert group_sizes(df.limit(0), ["k"], 5) == (0, 0)
    assert group_sizes(df, [], 5) == (1000, 1000)


def test_stage_metrics(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "n long, s string")
    out = Y.stage_metrics(df, ("scan", F.lit(True)), ("a", F.col("s") == "a"), ("big", F.col("n") > 1)).collect()
    assert [tuple(r) for r in out] == [("scan", 3, 3, 0), ("a", 3, 1, 2), ("big", 1, 0, 1)]
    assert [tuple(r) for r in Y.stage_metrics(df.limit(0), ("scan", F.lit(True))).collect()] == [("scan", 0, 0, 0)]


def test_expiry_reaches_the_scan(spark):
    path = new_path(spark, "expiry")
    spark.range(10).select(F.timestamp_seconds(F.col("id") * 86400).cast("timestamp_ntz").alias("ts"), (F.col("id") % 2 == 0).alias("a")).write.parquet(path)
    stored = spark.read.parquet(path)
    kept = stored.transform(Y.expire_events("1970-01-11", 3))
    assert "GreaterThanOrEqual(ts" in plan(kept) and kept.count() == 3
    assert stored.transform(Y.expire_events("1970-01-11", 3, 6, F.col("a"))).count() == 5


def test_assets_of_every_provider(spark):
    gcp = {
        "id": "1",
        "name": "n",
        "zone": "z",
        "status": "RUNNING",
        "creationTimestamp": "2024-02-03T04:05:06Z",
        "networkInterfaces": [{"networkIP": "10.0.0.2", "accessConfigs": [{"natIP": "4.4.4.4"}]}, {"networkIP": "10.0.0.3"}],
        "serviceAccounts": [{"email": "s@x", "scopes": list("abcdef")}],
    }
    bare = {"id": "2", "networkInterfaces": [], "serviceAccounts": [], "creationTimestamp": "soon"}
    out = {r.id: r for r in C.norm_asset(spark.createDataFrame([(json.dumps(x),) for x in (gcp, bare)], "value string"), "gcp", account="p").transform(C.asset_risk).transform(C.asset_risk_factors).collect()}
    full, empty = out["gcp:compute:1"], out["gcp:compute:2"]
    assert (full.account, full.private_ip, full.public_ip, full.iam_role, full.permissions, full.risk_score) == ("p", "10.0.0.2", "4.4.4.4", "s@x", list("abcdef"), 75)
    assert "Broad IAM Scopes" in full.risk_factors and str(full.created_at) == "2024-02-03 04:05:06"
    assert (empty.private_ip, empty.public_ip, empty.iam_role, empty.created_at, empty.risk_score) == (None, None, None, None, 0)
    azure = [{"id": "v", "tags": {"environment": "Production"}, "properties": {"provisioningState": "Succeeded"}}, {"id": "w"}]
    out = {r.id: r for r in C.norm_asset(spark.createDataFrame([(json.dumps(x),) for x in azure], "value string"), "azure").transform(C.asset_risk).collect()}
    assert out["azure:vm:v"].risk_score == 25 and out["azure:vm:w"].state == "unknown" and out["azure:vm:w"].risk_score == 0


def test_storage_quota_rounds_are_few(spark):
    import random

    from eventlens.operators import tenancy as T

    def greedy(rows, limit):
        room, kept = {}, set()
        for n, t, b in rows:
            left = room.setdefault(t, limit)
            if b is not None and b <= left:
                room[t] -= b
                kept.add(n)
        return kept

    mixed = random.Random(1)
    cases = [
        [(i, "t", 1 if i % 2 == 0 else 300 - i) for i in range(300)],
        [(i, mixed.choice(["a", None]), mixed.choice([0, 1, 2, 40, 90, 200, None])) for i in range(300)],
    ]
    for rows in cases:
        e = spark.createDataFrame(rows, "event_id long, tenant string, bytes long").withColumn("ts", F.timestamp_seconds("event_id"))
        for split in (None, 20):
            out = e.transform(T.tenant_storage_quota(310, fold_rows=3, group_rows=split)).where("accepted").collect()
            assert {r.event_id for r in out} == greedy(rows, 310)
