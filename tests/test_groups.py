"""Boolean searches in posting lists against a scan; largest groups and the rest against all groups."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from eventlens.operators import heavy as H
from eventlens.operators import postings as G
from eventlens.operators import stats as A
from eventlens.operators.search import STOP_WORDS
from eventlens.session import new_path

QUERIES = ["alpha", "alpha beta", ("or", "alpha", "gamma"), ("not", "alpha"), ("and", "alpha", ("not", "beta")), ("or", ("and", "w1", "w2"), ("not", ("or", "alpha", "nowhere"))), "", "the", "nowhere", ("not", ("not", "beta"))]


def holds(query, words):
    if isinstance(query, str):
        return all(w in words for w in re.findall("[a-z0-9]{2,}", query.lower()) if w not in STOP_WORDS)
    parts = [holds(q, words) for q in query[1:]]
    return not parts[0] if query[0] == "not" else all(parts) if query[0] == "and" else any(parts)


@pytest.mark.parametrize("block", [64, 32_768])
def test_boolean_queries(spark, monkeypatch, block):
    monkeypatch.setattr(G, "BLOCK", block)
    monkeypatch.setattr(G, "SPARSE", block // 16)
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["alpha", "Beta,", "gamma", "the", "x", *[f"w{k}" for k in range(30)]]) for _ in range(rng.randrange(8))) for _ in range(500)] + [None, ""]
    df = spark.createDataFrame([(3 * k, t) for k, t in enumerate(texts)], "event_id long, message string")
    path = new_path(spark, "postings")
    G.write_postings(df, "event_id", "message", path)
    stored = spark.read.parquet(f"{path}/postings")
    assert stored.where("(gaps is null) = (bits is null)").count() == 0
    if block == 64:
        assert stored.where("bits is not null").count() > 0 and stored.where("gaps is not null").count() > 0
    for query in QUERIES:
        want = sorted(3 * k for k, t in enumerate(texts) if holds(query, set(re.findall("[a-z0-9]{2,}", (t or "").lower()))))
        assert sorted(r.key for r in G.search_postings(spark, path, query).collect()) == want, query
    for bad in (("xor", "a", "b"), ("not", "a", "b"), ("and", "a")):
        with pytest.raises(ValueError):
            G.words_of(bad)


def groups(rows, limit):
    counts = Counter(r[1] for r in rows)
    name = lambda k: '{"k":null}' if k is None else f'{{"k":"{k}"}}'
    return dict(sorted(counts.items(), key=lambda c: (-c[1], name(c[0])))[:limit]), counts


@pytest.mark.parametrize("tracked", [10_000, 64])
def test_largest_groups_and_the_rest(spark, tracked):
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot", None]) if rng.random() < 0.4 else f"k{min(int(rng.expovariate(0.002)), 3000)}", rng.random()) for i in range(6000)]
    df = spark.createDataFrame(rows, "event_id long, k string, v double").repartition(6)
    for limit in (2, 7):
        best, counts = groups(rows, limit)
        got = df.transform(H.stats_largest(("k",), [("count", None, "n"), ("sum", "v", "total")], limit, tracked)).collect()
        assert {r.k: r.n for r in got if not r.rest} == best
        rest = [r for r in got if r.rest]
        assert len(rest) == 1 and rest[0].k is None and rest[0].n == len(rows) - sum(best.values())
        whole = df.transform(A.stats_by("k", aggs=[("count", None, "n"), ("sum", "v", "total")])).agg(F.sum("n"), F.sum("total")).first()
        assert sum(r.n for r in got) == whole[0] and abs(sum(r.total for r in got) - whole[1]) < 1e-6


def test_no_rest_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "event_id long, k string")
    assert sorted((r.k, r.rest, r.n) for r in df.transform(H.stats_largest(("k",), [("count", None, "n")], 5)).collect()) == [("a", False, 1), ("b", False, 2)]
    assert df.limit(0).transform(H.stats_largest(("k",), [("count", None, "n")], 5)).count() == 0


def test_a_lost_group_is_bounded():
    assert H.lost_at_most(10**9, 10_000) == int(3.5e9 / 16_384)
