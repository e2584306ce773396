"""A tree that grows by appends against one made anew from all leaves."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from eventlens.operators import integrity as I
from eventlens.operators import ledger as J
from eventlens.session import new_path


def levels_of(leaves):
    out = [[hashlib.sha256(x.encode()).hexdigest() for x in leaves]]
    while len(out[-1]) > 1:
        low = out[-1]
        out.append([J.pair(low[k], low[k + 1] if k + 1 < len(low) else low[k]) for k in range(0, len(low), 2)])
    return out


def path_of(levels, i):
    path = []
    for low in levels[:-1]:
        path.append((low[i - 1] if i % 2 else low[min(i + 1, len(low) - 1)], i % 2 == 1))
        i //= 2
    return path


@pytest.mark.parametrize("sizes", [[5, 0, 1, 10, 51], [4, 12, 49], [1], [64]])
def test_appends_like_a_rebuild(spark, sizes):
    rng, path, leaves, roots = random.Random(3), new_path(spark, "ledger"), [], {}
    ledger = J.Ledger(spark, path, levels=2)
    for k, size in enumerate(sizes):
        part = [f"leaf {len(leaves) + j}" for j in range(size)]
        df = spark.createDataFrame([(j, x) for j, x in enumerate(part)], "event_id long, x string").repartition(3)
        leaves += part
        assert ledger.append(df, F.col("x"), ["event_id"], f"day{k}") == len(leaves)
        roots[len(leaves)] = levels_of(leaves)[-1][0]
        assert J.Ledger(spark, path, levels=2).root() == roots[len(leaves)]
    assert ledger.append(df, F.col("x"), ["event_id"], f"day{len(sizes) - 1}") == len(leaves)  # the same batch again
    assert [n for _, n in ledger.sizes()] == [sum(sizes[: k + 1]) for k in range(len(sizes))]
    n = len(leaves)
    for m in sorted(m for m in {1, 3, n // 2, n - 1, n, *roots} if 0 < m <= n):
        older = levels_of(leaves[:m])[-1][0]
        assert ledger.root(m) == older
        proof = ledger.consistency(m)
        assert J.begins(proof, older, m, roots[n])
        assert not J.begins(proof, older[::-1], m, roots[n]) and not J.begins(proof, older, m, older[::-1])
        if m < n:
            assert not J.begins(proof, older, m + 1, roots[n])
    wanted = spark.createDataFrame([(i,) for i in {0, n - 1, n // 2, rng.randrange(n)}], "i long")
    for size in {n, max(1, n * 2 // 3)}:
        tree = levels_of(leaves[:size])
        rows = ledger.proofs(wanted, size).collect()
        assert {r.i for r in rows} == {r.i for r in wanted.collect() if r.i < size}
        for r in rows:
            assert [(p.hash, p.on_left) for p in r.path] == path_of(tree, r.i) and J.climb(r.h, [(p.hash, p.on_left) for p in r.path]) == tree[-1][0]


def test_same_root_as_the_batch_operator(spark):
    df = spark.range(3000).select(F.col("id").alias("event_id"), F.concat(F.lit("x"), "id").alias("x"))
    ledger = J.Ledger(spark, new_path(spark, "ledger"), levels=5)
    ledger.append(df.where("event_id < 1234"), F.col("x"), ["event_id"], "a")
    ledger.append(df.where("event_id >= 1234"), F.col("x"), ["event_id"], "b")
    assert ledger.root() == I.merkle_root(df, F.col("x"), ["event_id"]).first().root


def test_an_append_that_failed_leaves_nothing(spark, monkeypatch):
    path = new_path(spark, "ledger")
    df = spark.range(10).select(F.col("id").alias("event_id"), F.col("id").cast("string").alias("x"))
    ledger = J.Ledger(spark, path, levels=1)
    ledger.append(df.where("event_id < 4"), F.col("x"), ["event_id"], "a")
    with monkeypatch.context() as m:
        m.setattr(J, "_blocks", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            ledger.append(df.where("event_id >= 4"), F.col("x"), ["event_id"], "b")
    assert ledger.root() == levels_of(map(str, range(4)))[-1][0]
    ledger.append(df.where("event_id >= 4"), F.col("x"), ["event_id"], "b")
    assert ledger.root() == levels_of(map(str, range(10)))[-1][0]
    assert J.Ledger(spark, new_path(spark, "none")).root() is None
