"""Retention and tiers on a stored table: what is read, written and left alone."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventlens.operators.lifecycle import expire_events
from eventlens.session import new_path
from eventlens.sources import retention as N
from eventlens.sources import writers as O

NOW = datetime(2024, 3, 1, 12, 30)


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(2)
    rows = [(k, NOW - timedelta(seconds=rng.randrange(12 * 86400)), rng.choice("ab"), rng.choice(["audit", "x", "x"])) for k in range(3000)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp, source string, kind string").cache()


def files(spark, path):
    return {f: os.path.getmtime(f.removeprefix("file://").removeprefix("file:")) for found in N.leaves(spark, path).values() for f in found}


def ids(df):
    return sorted(r.event_id for r in df.select("event_id").collect())


@pytest.mark.parametrize("by", ["day", "hour"])
@pytest.mark.parametrize("audit", [None, 8])
def test_expire_store(spark, events, by, audit):
    path = new_path(spark, "store")
    O.sink_event_store(events, path, by=by)
    is_audit = F.col("kind") == "audit"
    rows = N.leaves(spark, path)
    for step in (0, 0, 1, 36, 24 * 4):
        as_of = str(NOW + timedelta(hours=step))
        before = files(spark, path)
        done = N.expire_store(spark, path, as_of, 3, audit, is_audit).collect()
        want = ids(events.transform(expire_events(as_of, 3, audit, is_audit)))
        assert (ids(spark.read.parquet(path)) if N.leaves(spark, path) else []) == want
        after = files(spark, path)
        touched = {r.leaf for r in done}
        # nothing but the partitions told of changes
        assert {f: t for f, t in before.items() if not any(leaf + "/" in f for leaf in touched)} == {f: t for f, t in after.items() if not any(leaf + "/" in f for leaf in touched)}
        assert sum(r.files for r in done) == sum(any(leaf + "/" in f for leaf in touched) for f in before)
        limits = [datetime.fromisoformat(as_of) - timedelta(days=d) for d in (3, audit) if d is not None]
        for r in done:
            start, end = N.span_of(r.leaf)
            assert r.action == ("dropped" if end <= min(limits) else "rewritten") and start < max(limits)
        again = N.expire_store(spark, path, as_of, 3, audit, is_audit)
        assert again.count() == 0 and files(spark, path) == after  # a rerun changes nothing
        if step and audit is None:
            assert sum(r.action == "rewritten" for r in done) <= 1  # only the partition that the limit cuts through
    assert len(N.leaves(spark, path)) < len(rows)


def test_expired_partitions_are_not_read(spark, events):
    path = new_path(spark, "store")
    O.sink_event_store(events, path, by="day")
    broken = [leaf for leaf in N.leaves(spark, path) if N.span_of(leaf)[1] <= NOW - timedelta(days=3)]
    for leaf in broken:
        for f in N.leaves(spark, path)[leaf]:
            f = f.removeprefix("file://")
            os.remove(os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc"))
            with open(f, "wb") as out:
                out.write(b"not parquet")
    done = N.expire_store(spark, path, str(NOW), 3)
    assert {r.leaf for r in done.where("action = 'dropped'").collect()} == set(broken)
    assert ids(spark.read.parquet(path)) == ids(events.transform(expire_events(str(NOW), 3)))


def test_move_tiers(spark, events):
    stores = {tier: new_path(spark, tier) for tier in ("hot", "warm", "cold")}
    O.sink_event_store(events, stores["hot"])
    for step in (0, 0, 1, 5):
        as_of = str(NOW + timedelta(days=step))
        before = {t: files(spark, p) for t, p in stores.items()}
        done = N.move_tiers(spark, stores, as_of).collect()
        rows = N.read_tiers(spark, stores).select("event_id", "tier", F.col("ts").cast("date").cast("string").alias("date")).collect()
        assert sorted(r.event_id for r in rows) == ids(events)
        assert all(r.tier == N.day_tier(r.date, as_of) for r in rows)
        moved = {r.leaf for r in done}
        for tier, old in before.items():
            now = files(spark, stores[tier])
            assert all(now[f] == t for f, t in old.items() if not any(leaf + "/" in f for leaf in moved))
        assert N.move_tiers(spark, stores, as_of).count() == 0
    assert all("hour=" not in leaf for leaf in N.leaves(spark, stores["warm"]))
    # each day in as few files as its size allows
    assert all(len(f) == 1 for f in N.leaves(spark, stores["cold"]).values())


def test_a_move_that_was_cut_off(spark, events, monkeypatch):
    stores = {tier: new_path(spark, tier) for tier in ("hot", "warm", "cold")}
    O.sink_event_store(events, stores["hot"])
    with monkeypatch.context() as m:
        m.setattr(N, "delete", lambda spark, paths: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            N.move_tiers(spark, stores, str(NOW))
    assert ids(N.read_tiers(spark, stores)) == ids(events)  # written twice, read once
    N.move_tiers(spark, stores, str(NOW))
    assert ids(N.read_tiers(spark, stores)) == ids(events)
    assert sum(len(ids(spark.read.parquet(p))) for p in stores.values() if N.leaves(spark, p)) == events.count()


def test_empty_stores(spark):
    stores = {tier: new_path(spark, tier) for tier in ("hot", "warm", "cold")}
    assert N.read_tiers(spark, stores) is None and N.move_tiers(spark, stores, str(NOW)).count() == 0
    assert N.expire_store(spark, stores["hot"], str(NOW), 3).count() == 0
