"""Reach of all assets and stored roll-ups against exact counts; trailing windows against a plain loop."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from times import at
from eventlens.operators import correlate as C
from eventlens.operators import graph as G
from eventlens.operators import rollups as U
from eventlens.operators import rules as R
from eventlens.session import new_path


def reach(links, assets, depth):
    out = {}
    for start in assets:
        seen, front = {start}, {start}
        for _ in range(depth):
            front = {b for a in front for b in links[a]} - seen
            seen |= front
        out[start] = len(seen & assets)
    return out


@pytest.mark.parametrize("depth", [1, 3, 10])
def test_severity_of_all_assets_is_exact(spark, depth):
    rng = random.Random(depth)
    edges = []
    for size in (3, 15, 21, 22, 49, 51, 52, 99, 100, 101, 102, 127, 128, 129, 400):  # chains with shortcuts around every limit
        name = f"g{size}-"
        edges += [(f"{name}{i}", f"{name}{rng.randrange(max(0, i - 6), i)}") for i in range(1, size)]
    edges += [("hub", f"leaf{i}") for i in range(300)] + [("hub", "hub"), (None, "hub"), ("leaf1", None)]
    nodes = {n for e in edges for n in e if n}
    assets = {n for n in nodes if hash_free(n)} | {"alone"}
    links = defaultdict(set)
    for a, b in edges:
        if a and b:
            links[a].add(b)
            links[b].add(a)
    want = reach(links, assets, depth)
    got = G.blast_radius_of_all(spark.createDataFrame(edges, "from_id string, to_id string"), spark.createDataFrame([(n,) for n in assets] + [(None,)], "id string"), depth).collect()
    assert {r.start_id for r in got} == assets
    level = lambda n: "critical" if n > 100 else "high" if n > 50 else "medium" if n > 20 else "low"
    for r in got:
        n = want[r.start_id]
        assert r.severity == level(n) and r.exact == (n <= 128), (r, n)
        assert r.blast_radius == n if r.exact else 0.6 * n <= r.blast_radius <= 1.6 * n


def hash_free(name):
    """Most nodes are assets; some are only walked through."""
    return sum(map(ord, name)) % 10 != 0


def test_no_edges(spark):
    got = G.blast_radius_of_all(spark.createDataFrame([], "from_id string, to_id string"), spark.createDataFrame([("a",)], "id string")).collect()
    assert [(r.start_id, r.blast_radius, r.severity) for r in got] == [("a", 1, "low")]
    with pytest.raises(ValueError):
        G.blast_radius_of_all(None, None, lg_entries=6)


def test_day_and_week_from_stored_hours(spark):
    rng = random.Random(4)
    rows = [(k, at(rng.randrange(20 * 86400)), rng.choice(["a", "a", None]), f"u{min(int(rng.expovariate(0.01)), 900)}" if rng.random() < 0.9 else None, rng.random()) for k in range(6000)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, host string, user string, v double")
    path = new_path(spark, "hours")
    df.transform(U.rollup("1h", ("host",), ("user",), ("v",))).write.parquet(path)
    hours = spark.read.parquet(path)
    for span, seconds in (("1d", 86400), ("7d", 604800), (None, None)):
        want = defaultdict(list)
        for _, ts, host, user, v in rows:
            epoch = int((ts - at(0)).total_seconds()) + 1704067200
            want[None if seconds is None else epoch // seconds * seconds, host].append((user, v))
        got = hours.transform(U.coarser(span, ("host",))).transform(U.distinct_counts).collect()
        assert len(got) == len(want)
        for r in got:
            key = None if seconds is None else int((r._time - at(0)).total_seconds()) + 1704067200
            group = want[key, r.host]
            assert (r["count"], r.dc_user) == (len(group), len({u for u, _ in group if u is not None}))
            assert (r.min_v, r.max_v) == (min(v for _, v in group), max(v for _, v in group)) and abs(r.sum_v - sum(v for _, v in group)) < 1e-6


def test_large_counts_within_the_stated_error(spark):
    df = spark.range(300_000).select(F.timestamp_seconds(F.col("id") % 48 * 3600).alias("ts"), (F.col("id") % 120_000).cast("string").alias("user"))
    hours = df.transform(U.rollup("1h", (), ("user",)))
    n = hours.transform(U.coarser(None)).transform(U.distinct_counts).first().dc_user
    assert abs(n - 120_000) < 4 * 0.016 * 120_000
    halves = [U.within(hours, a, b).transform(U.coarser("1d")).withColumn("k", F.lit(1)) for a, b in (("1970-01-01", "1970-01-02"), ("1970-01-02", "1970-01-03"))]
    r = U.overlap(*halves, "user", ["k"]).first()
    first, second = ({k % 120_000 for k in range(300_000) if k % 48 // 24 == h} for h in (0, 1))
    assert abs(r.both_dc - len(first & second)) < 0.1 * len(first | second) and abs(r.left_dc - len(first)) < 0.07 * len(first)


def slow_trailing(rows, rule, span):
    hits = defaultdict(list)
    for i, ts, host, action in sorted(rows, key=lambda r: (r[1], r[0])):
        if action == "bad":
            for key in ([f"hostname:{host}"] if host else []) + ["global"]:
                hits[key].append((ts, i))
    out = set()
    for key, found in hits.items():
        for k, (ts, i) in enumerate(found):
            n = sum((ts - t).total_seconds() < span for t, _ in found[: k + 1])
            if n >= rule.threshold:
                out.add((key, i, n))
    return out


@pytest.mark.parametrize("group_rows", [None, 40])
def test_trailing_windows(spark, group_rows):
    rng = random.Random(6)
    rows = [(k, at(rng.randrange(4000)), rng.choice(["hot", "hot", "hot", "b", None]), rng.choice(["bad", "bad", "ok"])) for k in range(400)]
    rows += [(1000 + k, at(7195 + 2 * k), "edge", "bad") for k in range(5)]  # a burst over the border of any hour
    rule = R.Rule("r", "R", "low", (R.Condition("action", "eq", "bad"),), threshold=5, window="60s")
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, hostname string, action string")
    got = df.transform(C.correlate_trailing([rule], group_rows=group_rows)).collect()
    want = slow_trailing(rows, rule, 60)
    assert {(r.entity_key, r.event_id, r.n) for r in got} == want and len(got) == len(want) > 50
    assert ("hostname:edge", 1004, 5) in want
    assert df.limit(0).transform(C.correlate_trailing([rule])).count() == 0
