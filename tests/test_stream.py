"""Streams over several files give what the batch operators give."""

import random
from collections import namedtuple

import pytest
from pyspark.sql import functions as F

from times import at
from eventlens.operators import behavior as B
from eventlens.operators import correlate as C
from eventlens.operators import rules as R
from eventlens.operators import risk as K
from eventlens.operators import stats as A
from eventlens.session import new_path
from eventlens.sources import writers as O
from eventlens.streaming import runner as N
from eventlens.streaming import stateful as S
from eventlens.streaming import windows as Z
from eventlens.streaming.drops import counted_drops

SCHEMA = "event_id long, ts timestamp, user string, src_ip string, process_name string, source string, action string"


@pytest.fixture(scope="module")
def landed(spark):
    """Three files, each later than the one before."""
    rng = random.Random(9)
    path = new_path(spark, "landed")
    for part in range(3):
        rows = [
            (i, at(i * 97 + rng.randrange(90)), rng.choice(["hot", "hot", "u"]), f"10.0.0.{rng.randrange(3)}", f"p{min(int(rng.expovariate(0.2)), 40)}", "s", rng.choice(["bad", "ok"]))
            for i in range(part * 250, part * 250 + 250)
        ]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, path):
    return N.stream_table(spark, path, files_per_batch=1)


def test_timechart(spark, landed):
    batch = spark.read.parquet(landed).transform(A.timechart("1h", by=("user",)))
    newest = spark.read.parquet(landed).agg(F.max("ts")).first()[0]
    limit = F.lit(newest).cast("timestamp") - F.expr("INTERVAL 10 MINUTES")
    closed = batch.where(F.col("_time") + F.expr("INTERVAL 1 HOUR") <= limit).select("_time", "user", "count")
    got = N.run_available(Z.stream_timechart(stream(spark, landed), "1h", by=("user",)), "t").select("_time", "user", "count")
    assert sorted(got.collect()) == sorted(closed.collect())


def test_ueba(spark, landed):
    batch = B.ueba_anomalies(spark.read.parquet(landed), ("user",)).select("event_id", "entity", "anomaly_type", "severity")
    got = N.run_available(S.stream_ueba(stream(spark, landed), ("user",)), "u")
    assert sorted(got.collect()) == sorted(batch.collect())


def test_reset(spark, landed):
    rule = R.Rule("r", "R", "low", (R.Condition("action", "eq", "bad"),), threshold=4, window="15m")
    batch = spark.read.parquet(landed).transform(C.correlate_reset(rule)).select("trigger_id", "source_ids")
    got = N.run_available(S.stream_reset(stream(spark, landed), rule), "r").select("trigger_id", "source_ids")
    assert sorted(got.collect()) == sorted(batch.collect()) and got.count() > 5


def test_risk(spark, landed):
    scored = lambda df: df.select(F.col("user").alias("entity"), "ts", "event_id", F.when(F.col("action") == "bad", 7).otherwise(0).alias("score"))
    updates = N.run_available(S.stream_risk(scored(stream(spark, landed)), 0.9), "k", "update")
    newest = {r.entity: (r.score, r.slot) for r in N.newest_per_key(updates.groupBy("entity", "batch").agg(F.max_by(F.struct("slot", "score"), "slot").alias("v")).select("entity", "batch", "v.*"), ["entity"]).collect()}
    for entity, (score, slot) in newest.items():
        end = F.timestamp_seconds(F.lit(slot * 3600 + 3599))
        stamp = spark.range(1).select(F.date_format(end, "yyyy-MM-dd HH:mm:ss")).first()[0]
        want = {r.entity: r.score for r in K.risk_decay(scored(spark.read.parquet(landed)), stamp, 0.9).collect()}
        assert score == want[entity]


def test_dedup_and_detect(spark, landed):
    e = stream(spark, landed).withColumn("id", F.concat_ws("-", "user", "src_ip"))
    assert N.run_available(Z.stream_dedup(e, "30d"), "d").count() == spark.read.parquet(landed).select("user", "src_ip").distinct().count()
    rule = R.Rule("r", "R", "low", (R.Condition("action", "eq", "bad"),))
    assert N.run_available(Z.stream_detect(stream(spark, landed), [rule]), "x").count() == spark.read.parquet(landed).where("action = 'bad'").count()


def test_late_rows_and_dead_letters(spark):
    path = new_path(spark, "late-in")
    for rows in ([(1, at(0)), (2, at(5000))], [(3, at(4900)), (4, at(100)), (5, at(9000))]):
        spark.createDataFrame(rows, "event_id long, ts timestamp").coalesce(1).write.mode("append").parquet(path)
    on_time, late, seen = (new_path(spark, n) for n in ("ontime", "late", "seen"))
    writer = stream(spark, path).writeStream.foreachBatch(Z.late_split(on_time, late, seen, "10m"))
    writer.option("checkpointLocation", new_path(spark, "c")).trigger(availableNow=True).start().awaitTermination()
    assert [r.event_id for r in spark.read.parquet(late).collect()] == [4]
    assert spark.read.parquet(on_time).count() == 4

    good, bad = new_path(spark, "good"), new_path(spark, "bad")
    write = O.sink_dead_letter(good, bad, lambda df: F.when(F.col("event_id") == 3, "odd"))
    stream(spark, path).writeStream.foreachBatch(write).option("checkpointLocation", new_path(spark, "c")).trigger(availableNow=True).start().awaitTermination()
    assert [(r.event_id, r.error, r.retries) for r in spark.read.parquet(bad).collect()] == [(3, "odd", 0)]
    assert spark.read.parquet(good).count() == 4


def test_dropped_rows_are_counted(spark):
    path = new_path(spark, "drops-in")
    for rows in ([(1, at(0)), (2, at(5000))], [(3, at(4900)), (4, at(100)), (5, at(9000))], [(6, at(8000)), (7, at(8500)), (8, at(200)), (9, at(8300))]):
        spark.createDataFrame(rows, "event_id long, ts timestamp").coalesce(1).write.mode("append").parquet(path)
    with counted_drops(spark) as counter:
        kept = stream(spark, path).withWatermark("ts", "10 minutes").dropDuplicates(["event_id", "ts"])
        out, checkpoint = new_path(spark, "kept"), new_path(spark, "c")
        started = kept.writeStream.queryName("drops").option("checkpointLocation", checkpoint).format("parquet").option("path", out).trigger(availableNow=True).start()
        started.awaitTermination()
        counter.wait(str(started.runId))
    rows = {r.batch: r.dropped for r in counter.counts(spark).where("query = 'drops'").collect()}
    assert [rows[k] for k in range(3)] == [0, 0, 1]  # as the watermark stood after the first batch
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4, 5, 6, 7, 9]
    stored = new_path(spark, "counts")
    counter.save(spark, stored)
    assert spark.read.parquet(stored).agg(F.sum("dropped")).first()[0] == 1 and counter.counts(spark).count() == 0


def test_event_store_stream(spark, landed):
    out = new_path(spark, "store")
    O.stream_event_store(stream(spark, landed), out, new_path(spark, "c")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(out).count() == 750


def test_processors_need_no_package_on_executors(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    for number, processor in enumerate((S.Profile(5), S.Risk(0.5, 3600), S.Reset(3, 60))):
        path = tmp_path / f"p{number}"
        path.write_bytes(cloudpickle.dumps(processor))
        load = "import pickle, sys; print(type(pickle.load(open(sys.argv[1], 'rb'))).__name__)"
        done = subprocess.run([sys.executable, "-c", load, str(path)], cwd=tmp_path, capture_output=True, text=True)
        assert done.stdout.strip() == type(processor).__name__, done.stderr


class Kept:
    """Map or value state in memory that counts the calls."""

    calls = 0

    def __init__(self):
        self.held = {}

    def __getattr__(self, name):
        Kept.calls += 1
        return {
            "containsKey": lambda k: k in self.held,
            "getValue": lambda k: self.held[k],
            "updateValue": self.held.__setitem__,
            "exists": lambda: None in self.held,
            "get": lambda: self.held[None],
            "update": lambda v: self.held.__setitem__(None, v),
        }[name]


def test_ueba_state_calls():
    """State is asked per distinct hour and name of a batch, not per row."""
    Event = namedtuple("Event", "at event_id hour src_ip process_name")
    rng = random.Random(4)
    events = [Event(i * 10**8, i, i // 36 % 24, f"10.0.0.{rng.randrange(2)}", f"p{min(int(rng.expovariate(0.3)), 30)}") for i in range(4000)]

    def run(batches):
        profile = S.Profile(300)
        profile.hours, profile.processes, profile.last = Kept(), Kept(), Kept()
        return [tuple(r) for b in batches for r in profile.handleInputRows(("t",), iter(b), None)]

    Kept.calls = 0
    whole = run([events[::-1]])
    assert Kept.calls < 200
    assert whole == run([events[:1500], events[1500:1501], events[1501:]]) and len({r[2:] for r in whole}) >= 3
    # no time, address or process: first in order, never travel
    assert run([[Event(None, None, None, f"10.0.0.{k}", None) for k in range(3)] + events]) is not None
