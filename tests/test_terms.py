"""Indicator values inside texts, on both execution paths, against plain containment."""

import random

import pytest

from eventlens.operators import terms as M

INDICATORS = "id string, pattern string, severity string"


def made(n, seed):
    rng = random.Random(seed)
    values = {"".join(rng.choice("ab.") for _ in range(rng.randint(1, 5))) for _ in range(n)} | {"x" * k for k in range(1, 40)}
    return [(f"i{k:06}", f"[t:value = '{v}']", rng.choice("hl")) for k, v in enumerate(sorted(values))] + [("i0", "[t:value = 'é💥']", "h"), ("i1", "no value", "h"), ("i2", None, "h"), ("i3", "[t:value = 'ab'] or [t:value = 'zz']", "l")]


def texts(seed):
    rng = random.Random(seed)
    return [(k, "".join(rng.choice("ab.xz é💥") for _ in range(rng.choice([0, 3, 12, 60])))) for k in range(120)] + [(900, None), (901, ""), *[(1000 + k, "same ab text") for k in range(200)]]


def values(rows):
    found = {}
    for i, pattern, severity in rows:
        for v in (pattern or "").split("= '")[1:]:
            v = v.split("'")[0]
            found[v] = min(found.get(v, (i, severity)), (i, severity))
    return found


@pytest.mark.parametrize("chars", [10**6, 60])
def test_against_plain_containment(spark, chars):
    rows, lines = made(80, 1), texts(2)
    known = values(rows)
    indicators, df = spark.createDataFrame(rows, INDICATORS), spark.createDataFrame(lines, "event_id long, note string")
    every = {k: sorted((-len(v), i, s) for v, (i, s) in known.items() if t and v in t) for k, t in lines}
    got = df.transform(M.match_text(indicators, "note", shard_chars=chars)).collect()
    assert sorted(map(str, ((r.event_id, r.indicator_id, r.indicator_severity) for r in got))) == sorted(str((k, *(f[0][1:] if f else (None, None)))) for k, f in every.items())
    assert {r.event_id for r in df.transform(M.match_text(indicators, "note", "left_anti", chars)).collect()} == {k for k, f in every.items() if not f}
    pairs = df.transform(M.match_all(indicators, "note", chars)).collect()
    assert sorted((r.event_id, r.indicator_id) for r in pairs) == sorted((k, i) for k, f in every.items() for _, i, _ in f)


@pytest.mark.parametrize("chars", [10**6, 20])
def test_artifact_inside_a_pattern(spark, chars):
    rows, wanted = made(60, 3), ["ab", "", None, "value", "zzz", "b.", "'] or", "ab", "é"]
    df = spark.createDataFrame(list(enumerate(wanted)), "event_id long, v string")
    got = df.transform(M.match_artifact(spark.createDataFrame(rows, INDICATORS), "v", shard_chars=chars)).collect()
    assert {r.event_id: r.indicator_id for r in got} == {k: min((i for i, p, _ in rows if v and p and v in p), default=None) for k, v in enumerate(wanted)}


def test_no_indicators(spark):
    df = spark.createDataFrame([(1, "a")], "event_id long, note string")
    none = spark.createDataFrame([], INDICATORS)
    assert df.transform(M.match_text(none, "note")).collect()[0].indicator_id is None
    assert df.transform(M.match_all(none, "note")).count() == 0 and df.transform(M.match_artifact(none, "note")).count() == 1


def test_a_hundred_thousand_values(spark):
    rng = random.Random(5)
    rows = [(f"i{k:06}", f"[t:value = 'host{k * 7919 % 10**6}.example']", "l") for k in range(100_000)]
    lines = [(k, f"from host{rng.randrange(10**6)}.example to host{rng.randrange(10**6)}.example.") for k in range(3_000)]
    known = values(rows)
    want = {k: {known[w.strip(".")][0] for w in t.split() if w.strip(".") in known} for k, t in lines}
    df = spark.createDataFrame(lines, "event_id long, note string")
    for chars in (10**7, 400_000):  # whole, and in four shards
        found = {k: set() for k, _ in lines}
        for r in df.transform(M.match_all(spark.createDataFrame(rows, INDICATORS), "note", chars)).collect():
            found[r.event_id].add(r.indicator_id)
        # no value is part of another here, as each ends with .example and begins with host
        assert found == want


def test_each_text_is_read_once(spark, monkeypatch):
    """However many terms there are, a text leaves its task only with substrings that may be terms."""
    words = spark.range(3_000).selectExpr("concat('host', id, '.example') AS term")
    lines = spark.range(2_000).selectExpr("concat('from host', id * 2, '.example é to nowhere ', id) AS text")
    pairs = M.possible(lines, words, 100).collect()
    assert len({tuple(p) for p in pairs}) == len(pairs) < 2_000 and {p.term for p in pairs} >= {f"host{k}.example" for k in range(0, 3_000, 2)}
    monkeypatch.setattr(M, "MOST_BITS", 16)  # a filter far too small: more substrings, the same pairs
    assert sorted(map(tuple, M.contained(lines, words, 100).collect())) == sorted((f"from host{2 * k}.example é to nowhere {k}", f"host{2 * k}.example") for k in range(1_500))
    assert M.contained(lines, words, 100).count() == 1_500
