import math

import numpy as np
import pytest

import corpus_pipeline
from eventlens.llm.adaptive_scan import nearest
from eventlens.llm.common import stored
from eventlens.llm.components import connected
from eventlens.llm.curriculum import plan_mix
from eventlens.llm.queries import ORACLES, QUERIES


def test_nearest(spark):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((900, 24))
    vectors[300:600] = vectors[7]  # a third of all rows share one vector
    rows = [(i, v.tolist(), i) for i, v in enumerate(vectors)]
    rows += [(2000, None, 0), (2001, [0.0] * 24, 0), (2002, [math.nan] * 24, 0), (2003, [None] * 24, 0), (2004, [1.0], 0), (None, [1.0] * 24, 0), rows[20]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    found = {}
    for r in nearest(df, df.where("vec_id % 20 = 0")).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == set(range(0, 900, 20))
    hit = 0
    for q, got in found.items():
        got.sort()
        score = vectors @ vectors[q]
        score[q] = -np.inf
        want = np.lexsort((np.arange(900), -score))[:20]
        assert [g[0] for g in got] == list(range(1, 21)) and np.allclose([g[2] for g in got], [score[g[1]] for g in got])
        assert got == sorted(got, key=lambda g: (-g[2], g[1]))
        hit += len({g[1] for g in got} & set(want.tolist()))
    assert hit / 20 / len(found) >= 0.9


@pytest.mark.parametrize("rows", [[], [(3, [1.0, 0.0])], [(3, [1.0, 0.0]), (20, [0.5, 0.5])]])
def test_nearest_of_few(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = nearest(df, df).collect()
    assert len(got) == len(rows) * max(0, len(rows) - 1)


def test_nearest_takes_the_tables_dimension(spark):
    """Most queries have another length than the table: those of its length are answered all the same."""
    rng = np.random.default_rng(3)
    table = spark.createDataFrame([(i, rng.standard_normal(16).tolist()) for i in range(50)], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(100 + i, rng.standard_normal(16 if i < 2 else 8).tolist()) for i in range(10)], "vec_id long, embedding array<double>")
    got = nearest(table, queries).groupBy("query_id").count().collect()
    assert {(r.query_id, r["count"]) for r in got} == {(100, 20), (101, 20)}


def test_connected(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (200, 200)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in (100, 101, 102)} | {200: 200}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages(spark, docs, documents, empty):
    folder = "/root/testdata/sf0.001"
    for start in (docs, empty):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, now, folder)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert made.columns == start.columns
                made.count()
                now = made.cache()
            else:
                assert set(made.columns) == {"position", "doc_id", "source", "n_tokens", "ids"} and made.count() == now.count()


def test_pipeline_effects(spark):
    folder = "/root/testdata/sf0.001"
    base = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.keep_quality(spark, base, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    wrong = labels.join(kept, "doc_id", "left_semi").where("quality = 0").count()
    lost = labels.where("quality = 1").join(kept, "doc_id", "left_anti").count()
    assert wrong + lost <= 0.05 * labels.count()
    one = corpus_pipeline.keep_one_of_each(spark, kept, folder)
    assert one.select("text").distinct().count() == one.count() and kept.join(one, "text", "left_anti").count() < 10
    clean = corpus_pipeline.hide_secrets(spark, one, folder)
    assert clean.where(r"text rlike 'token = \"[0-9a-f]{40}'").count() == 0 and clean.count() == one.count()
    assert clean.where("n_chars <> length(text)").count() == 0


def test_training_order_reaches_the_result(spark, docs):
    """The curriculum's order, over several files that Spark reads in another order."""
    planned = plan_mix(docs).selectExpr("_row.doc_id AS doc_id", "explode(_mix.positions) AS at", "xxhash64(_row.doc_id) AS h").orderBy("at", "h").collect()
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.files.maxPartitionBytes")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        mixed = stored(corpus_pipeline.mix_sources(spark, docs, ""), "mixed")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        made = corpus_pipeline.encode_pieces(spark, mixed, "").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(mixed.inputFiles()) > 2
    assert [r.position for r in made] == list(range(len(planned)))
    assert [r.doc_id for r in made] == [r.doc_id for r in planned]


def test_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
