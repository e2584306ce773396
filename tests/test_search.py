from datetime import datetime

import pytest
from pyspark.sql import functions as F

from times import at
from eventlens.functions.spans import span_seconds
from eventlens.operators import search as S
from eventlens.operators import shape as P
from eventlens.operators import stats as A


@pytest.fixture(scope="module")
def events(spark):
    rows = [
        (1, at(0), "srv1", {"message": "error found", "latency": "100", "base": "50"}),
        (2, at(60), "srv2", {"message": "all good"}),
        (3, at(900), "srv_bad", {"latency": "not_a_number", "message": "srv_bad test"}),
    ]
    return spark.createDataFrame(rows, "event_id long, ts timestamp, source string, data map<string,string>")


def ids(df):
    return sorted(r.event_id for r in df.collect())


def test_keyword_and_fields(events):
    assert ids(events.transform(S.search_keyword("ERROR"))) == [1]
    assert ids(events.transform(S.search_keyword("error", "good"))) == []
    assert ids(events.transform(S.search_field(source="srv1", latency=100))) == [1]
    assert ids(events.where(F.lit(True)).transform(S.search_keyword("x", message="nowhere"))) == []


def test_where(events):
    assert ids(events.transform(S.where_compare("source", "=", "srv1"))) == [1]
    assert ids(events.transform(S.where_compare("latency", ">", 50))) == [1]
    assert ids(events.transform(S.where_compare("latency", ">", "1", lexical=True))) == [1, 3]
    assert ids(events.transform(S.where_compare("latency", "!=", "100"))) == [2, 3]
    assert ids(events.transform(S.where_compare("latency", "!=", "100", null_neq=False))) == [3]
    assert ids(events.transform(S.where_field_compare("latency", "!=", "base"))) == [1, 2, 3]
    assert ids(events.transform(S.where_bool(("source", "=", "srv1"), ("source", "=", "srv2"), any_of=True))) == [1, 2]
    assert ids(events.transform(S.where_bool(("latency", "=", "100"), negate=True))) == [2, 3]


def test_eval(events):
    out = events.transform(S.eval_arith("total", "latency", "+", "base")).transform(S.where_compare("total", "=", 150))
    assert ids(out) == [1]
    by_zero = events.transform(S.eval_arith("q", "latency", "/", 0)).collect()
    assert all(r.q is None for r in by_zero)
    kept = events.withColumn("q", F.lit(7.0)).transform(S.eval_arith("q", "latency", "/", "base")).orderBy("event_id").collect()
    assert [r.q for r in kept] == [2.0, 7.0, 7.0]
    copied = events.transform(S.eval_copy("source", "base")).orderBy("event_id").collect()
    assert [r.source for r in copied] == ["50", "srv2", "srv_bad"]


def test_fields(spark, events):
    wide = spark.createDataFrame([("hello", "x", 1)], "msg_text string, other string, event_id long")
    assert wide.transform(S.fields_regex("^msg_.*$")).columns == ["msg_text"]
    assert wide.transform(S.fields_regex("^msg_.*$", drop=True)).columns == ["other", "event_id"]
    assert events.transform(S.fields_keep("event_id", "message")).columns == ["event_id", "message"]
    assert wide.transform(S.fields_drop("other")).columns == ["msg_text", "event_id"]


def test_drill(events):
    assert ids(events.transform(S.drill_exclude({"source": "srv1", "_time": 1}))) == [2, 3]
    assert ids(events.transform(S.drill_timezoom(datetime(2024, 1, 1, 0, 5)))) == [2]


def test_tokens(spark):
    df = spark.createDataFrame([(1, "The Quick-brown fox a quick"), (2, "is it"), (3, None)], "id long, message string")
    assert [r.t for r in df.orderBy("id").select(S.tokens(F.col("message")).alias("t")).collect()] == [["quick", "brown", "fox"], [], None]
    assert [r.id for r in df.transform(S.search_tokens("quick the FOX")).collect()] == [1]
    index = S.token_index(df, "id", "message")
    assert [r.id for r in S.search_index(index, "fox brown", "id").collect()] == [1]


def test_stats(events):
    out = events.transform(A.stats_by("source", aggs=[("count", None), ("sum", "latency"), ("avg", "base", "b")])).collect()
    assert {r.source: (r["count"], r["sum(latency)"], r.b) for r in out} == {"srv1": (1, 100.0, 50.0), "srv2": (1, 0.0, 0.0), "srv_bad": (1, 0.0, 0.0)}
    missing = events.transform(A.stats_by("nothing", aggs=[("count", None)], stringify=True)).collect()
    assert [(r.nothing, r["count"]) for r in missing] == [("(null)", 3)]
    empty = events.where("false").transform(A.stats_global(("count", None))).collect()
    assert [r["count"] for r in empty] == [0]
    with pytest.raises(ValueError):
        A.aggregate_columns(events, [("median", "x")])


def test_spans():
    assert [span_seconds(s) for s in ("30s", "5m", "1h", "7d", "90", "1h30m")] == [30, 300, 3600, 604800, 90, 5400]
    for bad in ("0s", "400d", "-5", "5w", ""):
        with pytest.raises(ValueError):
            span_seconds(bad)


def test_timechart(events):
    chart = events.transform(A.timechart("10m", by=("source",))).collect()
    assert {(r._span, r._type) for r in chart} == {(600, "timechart")}
    assert len({r._time for r in chart}) == 2
    filled = events.transform(A.timechart("5m", fill=True)).orderBy("_time").collect()
    assert [r["count"] for r in filled] == [2, None, None, 1]


def test_shape(spark):
    df = spark.createDataFrame([("d", f"s{i:02d}", float(i)) for i in range(15)], "b string, s string, v double")
    out = {r.s: r.value for r in df.transform(P.top_n_others("b", "s", F.sum("v"))).collect()}
    assert len(out) == 11 and out["others"] == sum(range(5)) and out["s14"] == 14
    cells = spark.createDataFrame([("503", "1500ms", "INFO", "login failed"), ("abc", "600", "ERROR", "fine")], "status string, latency string, level string, note string")
    flags = cells.transform(P.flag_cells("status", "latency", "level", "note")).collect()
    assert [tuple(r)[4:] for r in flags] == [("server_error", "very_slow", None, "anomaly"), (None, "slow", "error_level", None)]
    before = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v long")
    after = spark.createDataFrame([("b", 5), ("c", 1), (None, 3)], "k string, v long")
    delta = {r.k: (r.before, r.after, r.diff, r.status) for r in P.report_delta(before, after, ["k"], "v").collect()}
    assert delta == {"a": (1, None, -1, "removed"), "b": (2, 5, 3, "changed"), "c": (None, 1, 1, "added"), None: (3, 3, 0, "unchanged")}
