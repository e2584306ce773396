import random

import corpus_pipeline
from eventlens.llm.near_copies import first_of_each, links, meetings, shingle_sets, shingles, sketches

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def edited(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"edit{rng.randrange(10**6)}"
    return out


def test_edited_copies_leave_the_corpus(spark):
    rng = random.Random(6)
    texts = []
    for n in (12, 40, 100, 100, 300, 1000):
        words = [f"w{rng.randrange(5000)}" for _ in range(n)]
        texts += [" ".join(edited(rng, words, k)) for k in (0, 0, 1, n // 60, n // 45, n // 30, n // 12, n // 4)]
    hot = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts += [" ".join(edited(rng, hot, 2)) for _ in range(60)] + ["", " \n", "few words", "Few  Words", "few other words"]
    sets = [brute(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    assert [len(shingles(t.encode())) for t in texts] == list(map(len, sets))
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)] + [(None, texts[0], None, None, 1), (3, texts[3], "en", "a", 1)], SCHEMA)
    one = corpus_pipeline.keep_one_of_each(spark, docs, "")
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(root))
    assert 10 < len(set(root)) < 40


def test_recall_at_the_threshold(spark):
    """Pairs of similarity 0.8 to 0.85 of all lengths, each on its own words: few may stay apart."""
    rng, rows, want = random.Random(8), [], 0
    for k in range(400):
        words = [f"p{k}x{i}" for i in range(rng.choice([9, 14, 30, 60, 150, 400]))]
        other = words + [f"q{k}x{i}" for i in range((len(words) - 4) // 4)]
        assert 5 * len(brute(" ".join(words)) & brute(" ".join(other))) >= 4 * len(brute(" ".join(words)) | brute(" ".join(other)))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        want += 1
    missed = first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).count() - want
    assert missed <= 0.02 * want


def test_rows_grow_with_the_texts_of_a_group(spark):
    """800 texts of one base with 1 to 5 edits each, few pairs of which are similar: no row for each pair, and the exact groups."""
    rng = random.Random(12)
    base = [f"b{rng.randrange(9000)}" for _ in range(200)]
    texts = [" ".join(edited(rng, base, rng.randint(1, 5))) for _ in range(800)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = sketches(docs).cache()
    classes = made.selectExpr("s", "n", "fp", "fp2", "struct(false AS none, doc_id, tie) AS first")
    met = meetings(classes)
    assert met.count() <= 4 * len(texts)
    found = links(met, shingle_sets(met, docs, classes))
    assert found.count() <= 2 * len(texts)
    sets = [brute(t) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    assert sorted(r.doc_id for r in first_of_each(docs).collect()) == sorted({top(i) for i in range(len(texts))})
