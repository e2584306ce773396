import random

import pytest
from pyspark.sql import functions as F

from times import at
from eventlens.operators import alerts as L
from eventlens.operators import correlate as C
from eventlens.operators import enrich as E
from eventlens.operators import lifecycle as Y
from eventlens.operators import rules as R
from eventlens.operators import tenancy as T

FAILED = R.Rule("r", "R", "high", (R.Condition("action", "eq", "bad"),), threshold=4, window="100s", risk_score=9)


def make_rows(n=400, seed=1):
    rng = random.Random(seed)
    return [(i, at(rng.randrange(6000)), rng.choice(["bad", "bad", "ok"]), rng.choice(["hot", "hot", "x"]), rng.randrange(1, 100)) for i in range(n)]


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, ts timestamp, action string, tenant string, bytes long").repartition(4)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1], r[0]))


@pytest.mark.parametrize("group_rows,fold_rows", [(None, 10_000), (0, 1)])
@pytest.mark.parametrize("by", [(), ("tenant",)])
def test_reset(events, rows, by, group_rows, fold_rows):
    got = {(r.trigger_id, tuple(r.source_ids)) for r in events.transform(C.correlate_reset(FAILED, by, fold_rows=fold_rows, group_rows=group_rows)).collect()}
    buffers, want = {}, set()
    for i, ts, action, tenant, _ in in_order(rows):
        if action != "bad":
            continue
        key = tenant if by else 0
        kept = [b for b in buffers.get(key, []) if (ts - b[1]).total_seconds() < 100] + [(i, ts)]
        if len(kept) >= 4:
            want.add((i, tuple(b[0] for b in kept)))
            kept = []
        buffers[key] = kept
    assert got == want and want


def test_reset_without_threshold(events, rows):
    rule = R.Rule("r", "R", "high", (R.Condition("action", "eq", "bad"),))
    assert events.transform(C.correlate_reset(rule)).count() == sum(r[2] == "bad" for r in rows)


@pytest.mark.parametrize("group_rows", [None, 0])
def test_idle_window(events, rows, group_rows):
    out = events.transform(C.correlate_idle_window([FAILED], gap="30s", group_rows=group_rows)).collect()
    times = [r[1] for r in in_order(rows) if r[2] == "bad"]
    windows = [[times[0]]]
    for t in times[1:]:
        if (t - windows[-1][-1]).total_seconds() > 30:
            windows.append([])
        windows[-1].append(t)
    want = sorted((w[0], w[-1], len(w)) for w in windows if len(w) >= 4)
    assert sorted((r.first_ts, r.last_ts, r.n) for r in out if r.entity_key == "global") == want and want


@pytest.mark.parametrize("group_rows,fold_rows", [(None, 10_000), (0, 1)])
def test_dedup(events, rows, group_rows, fold_rows):
    out = events.transform(Y.dedup_ttl("200s", event_id="tenant", group_rows=group_rows, fold_rows=fold_rows))
    last, want = {}, set()
    for i, ts, _, tenant, _ in in_order(rows):
        if tenant not in last or (ts - last[tenant]).total_seconds() >= 200:
            want.add(i)
            last[tenant] = ts
    assert {r.event_id for r in out.collect()} == want


@pytest.mark.parametrize("group_rows,fold_rows", [(None, 2_000), (0, 1), (None, 20)])
def test_storage_quota(events, rows, group_rows, fold_rows):
    out = events.transform(T.tenant_storage_quota(2500, group_rows=group_rows, fold_rows=fold_rows))
    got = {r.event_id for r in out.collect() if r.accepted}
    used, want = {}, set()
    for i, _, _, tenant, size in in_order(rows):
        if used.get(tenant, 0) + size <= 2500:
            used[tenant] = used.get(tenant, 0) + size
            want.add(i)
    assert got == want


def test_rate_quota(events, rows):
    out = events.withColumn("ts", F.date_trunc("hour", "ts")).transform(T.tenant_rate_quota(3, group_rows=0))
    assert out.where("accepted").groupBy("tenant", "ts").count().agg(F.max("count")).first()[0] == 3
    assert out.count() == len(rows)


def test_rule_operators(spark):
    df = spark.createDataFrame([(1, "admin user", 5, True), (2, "x", 50, None), (3, None, None, False)], "id long, name string, n int, flag boolean")
    hits = lambda *c: [r.id for r in df.where(R.condition_column(df, R.Condition(*c))).orderBy("id").collect()]
    assert hits("name", "contains", "admin") == [1]
    assert hits("name", "ne", "x") == [1]
    assert hits("n", "gte", 5) == [1, 2]
    assert hits("n", "in", [50, 7]) == [2]
    assert hits("flag", "eq", True) == [1]
    assert hits("name", "regex", "^x$") == [2]
    assert hits("gone", "ne", 1) == []
    with pytest.raises(ValueError):
        R.condition_column(df, R.Condition("n", "between", 1))


def test_rule_file(tmp_path):
    path = tmp_path / "rules.yaml"
    path.write_text("- id: a\n  name: A\n  severity: low\n  conditions:\n  - {field: x, operator: eq, value: 1}\n  mitre_tactics: [T]\n")
    rule = R.load_rules(str(path))[0]
    assert rule.conditions == (R.Condition("x", "eq", 1),) and rule.tactics == ("T",) and rule.enabled


def test_incidents(spark):
    changes = spark.createDataFrame(
        [("i", at(1), 1, "a", "status", "Open"), ("i", at(2), 2, "b", "note", "hm"), ("i", at(3), 3, "a", "status", "Closed"), ("i", at(4), 4, "a", "assign", "bob")],
        "incident_id string, ts timestamp, change_id long, author string, kind string, value string",
    )
    latest = L.incident_latest(changes).collect()[0]
    assert (latest.status, latest.assignee, latest.notes) == ("Closed", "bob", 1)
    for group_rows in (None, 0):
        messages = [r.message for r in L.incident_journal(changes, group_rows=group_rows).orderBy("ts").collect()]
        assert messages == ["Status changed from New to Open", "hm", "Status changed from Open to Closed", "Incident assigned to bob"]


def test_geo_and_threat(spark):
    ranges = spark.createDataFrame([(16777216, 16777471, "AU", "c", "r", 1.0, 2.0), (16777400, 16778000, "CN", "d", "s", 3.0, 4.0)], "start_ip long, end_ip long, country string, city string, region string, lat double, lon double")
    events = spark.createDataFrame([(1, "1.0.0.5"), (2, "1.0.0.250"), (3, "1.0.1.5"), (4, "9.9.9.9"), (5, "nonsense"), (6, "1.0.0.999"), (7, None)], "id long, src_ip string")
    out = {r.id: r.src_ip_geo_country for r in events.transform(E.enrich_geo(ranges)).collect()}
    assert out == {1: "AU", 2: "AU", 3: "CN", 4: None, 5: None, 6: None, 7: None}
    threats = spark.createDataFrame([("h1", True, 1, ["a"], at(0), "f"), ("h2", False, 2, ["b"], at(0), "f"), ("h1", False, 3, ["old"], at(-5000), "f")], "indicator string, is_malicious boolean, reputation int, categories array<string>, last_seen timestamp, source string")
    events = spark.createDataFrame([(1, at(10), "h1", "h2"), (2, at(10), "h1", None), (3, at(4000), "h1", "h2")], "id long, ts timestamp, md5 string, sha256 string")
    for reduce in (False, True):
        out = {r.id: (r.file_threat_malicious, r.file_threat_categories) for r in events.transform(E.enrich_threat(threats, reduce=reduce)).collect()}
        assert out == {1: (False, ["b"]), 2: (True, ["a"]), 3: (None, None)}
