import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from times import at
from eventlens.operators import behavior as B
from eventlens.operators import risk as K


def rows(n=700, seed=2):
    rng = random.Random(seed)
    return [
        (i, at(i * 97 + rng.randrange(90)), rng.choice(["hot", "hot", "u1"]), f"10.0.0.{rng.randrange(3)}" if rng.random() < 0.9 else None, f"p{min(int(rng.expovariate(0.2)), 40)}" if rng.random() < 0.8 else None, "s")
        for i in range(n)
    ]


def expected(data):
    """The behaviour checks, one event at a time."""
    found, state = set(), {}
    for i, ts, entity, ip, proc, _ in data:
        p = state.setdefault(entity, {"hours": [0] * 24, "procs": {}, "ip": None, "at": None})
        total = sum(p["hours"])
        if total > 50 and p["hours"][ts.hour] < total // 48:
            found.add((i, "AfterHoursActivity", "medium"))
        if ip and p["ip"] and p["ip"] != ip and (ts - p["at"]).total_seconds() < 300:
            found.add((i, "ImpossibleTravel", "high"))
        if proc:
            if proc in p["procs"]:
                runs = sum(p["procs"].values())
                if runs > 100 and p["procs"][proc] < runs // 100:
                    found.add((i, "RareProcess", "medium"))
            elif len(p["procs"]) > 10:
                found.add((i, "RareProcess", "high"))
            p["procs"][proc] = p["procs"].get(proc, 0) + 1
        p["hours"][ts.hour] += 1
        p["at"] = ts
        p["ip"] = ip or p["ip"]
    return found


@pytest.mark.parametrize("group_rows", [None, 0])
def test_ueba(spark, group_rows):
    data = rows()
    df = spark.createDataFrame(data, "event_id long, ts timestamp, user string, src_ip string, process_name string, source string").repartition(3)
    got = {(r.event_id, r.anomaly_type, r.severity) for r in B.ueba_anomalies(df, ("user",), group_rows=group_rows).collect()}
    want = expected(data)
    assert got == want
    assert {w[1] for w in want} == {"AfterHoursActivity", "ImpossibleTravel", "RareProcess"}


@pytest.mark.parametrize("group_rows", [None, 0])
@pytest.mark.parametrize("by", [("user",), ()])
def test_rolling(spark, group_rows, by):
    rng = random.Random(4)
    data = [(i, at(i), rng.choice(["hot", "hot", "b"]), rng.gauss(1e6, 10) + (500 if rng.random() < 0.02 else 0)) for i in range(500)]
    df = spark.createDataFrame(data, "event_id long, ts timestamp, user string, bytes double").repartition(3)
    out = B.rolling_anomaly(df, by=by, window=30, block=70, group_rows=group_rows).collect()
    got = {r.event_id: (r.expected, r.deviation, r.severity) for r in out}
    want, seen = {}, {}
    for i, _, user, x in data:
        past = seen.setdefault(user if by else 0, [])
        if len(past) > 10:
            base = np.array(past[-30:])
            deviation = abs(x - base.mean()) / base.std()
            if deviation > 3:
                want[i] = (base.mean(), deviation)
        past.append(x)
    assert got.keys() == want.keys() and want
    for i, (mean, deviation) in want.items():
        assert got[i][0] == pytest.approx(mean) and got[i][1] == pytest.approx(deviation, rel=1e-6)


def test_rolling_constant(spark):
    data = [(i, at(i), "a", 5.0) for i in range(40)] + [(40, at(40), "a", 6.0), (41, at(41), "a", 5.0)]
    df = spark.createDataFrame(data, "event_id long, ts timestamp, user string, bytes double")
    out = B.rolling_anomaly(df, by=("user",), window=10, block=15).collect()
    assert [(r.event_id, math.isinf(r.deviation), r.severity) for r in out] == [(40, True, "critical")]


def test_population(spark):
    values = [(f"e{i}", "f", 1.0) for i in range(20)] + [("odd", "f", 50.0)] + [(f"e{i}", "few", float(i)) for i in range(4)] + [(f"e{i}", "flat", 2.0) for i in range(9)]
    out = B.population_anomaly(spark.createDataFrame(values, "entity string, feature string, value double")).collect()
    assert [(r.entity, r.feature) for r in out] == [("odd", "f")]
    assert out[0].description == f"Value 50.00 is {out[0].score:.2f} sigmas from mean {out[0].baseline:.2f}"


def test_explain(spark):
    df = spark.createDataFrame([("login_count_1h", 12.7), ("bytes_out_1h", 5.0 * 1024 * 1024), ("other", 1.0)], "anomaly_type string, value double")
    out = {(r.anomaly_type, r.factor): (r.weight, r.factor_text) for r in B.explain_anomaly(df).collect()}
    assert len(out) == 5
    assert out["login_count_1h", "Login Frequency"][1].startswith("User logged in 12 times")
    assert out["bytes_out_1h", "Data Volume"] == (0.9, "Data transfer of 5.00 MB exceeds 99th percentile of peer group.")


@pytest.mark.parametrize("group_rows", [None, 0])
def test_clamped_fold(spark, group_rows):
    rng = random.Random(6)
    data = [(rng.choice(["hot", "hot", "b"]), at(i), i, rng.randrange(-40, 45)) for i in range(500)]
    df = spark.createDataFrame(data, "entity string, ts timestamp, event_id long, delta int").repartition(3)
    start = spark.createDataFrame([("hot", 70)], "entity string, score int")
    got = {r.entity: r.score for r in K.entity_risk_adjust(df, start, block=6, group_rows=group_rows).collect()}
    want = {"hot": 70, "b": 0}
    for entity, _, _, delta in data:
        want[entity] = min(100, max(0, want[entity] + delta))
    assert got == want


@pytest.mark.parametrize("factor", [0.5, 0.9])
def test_decay(spark, factor):
    rng = random.Random(7)
    data = [("e", at(rng.randrange(40 * 3600)), rng.randrange(30)) for _ in range(60)]
    df = spark.createDataFrame(data, "entity string, ts timestamp, score int")
    got = K.risk_decay(df, "2024-01-02 18:20:00", factor).collect()[0].score
    score = 0
    for hour in range(43):
        for _, ts, s in data:
            if int((ts - at(0)).total_seconds()) // 3600 == hour:
                score = min(100, score + s)
        if hour < 42:
            score = int(score * factor)
    assert got == score


def test_severity_score(spark):
    df = spark.createDataFrame([("critical", 0.5), ("high", 0.99), ("unknown", 1.0)], "s string, c double")
    assert [r[0] for r in df.select(K.severity_score(F.col("s"), F.col("c"))).collect()] == [25, 29, 0]
