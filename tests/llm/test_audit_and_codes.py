"""Filter audit and anchor codes beside plain loops."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from eventlens.llm import anchor_codes, filter_audit


def slow_audit(documents, labels):
    least = {}
    for doc_id, text, *_ in documents:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    marks = defaultdict(lambda: [False, False])
    for doc_id, quality, toxic in labels:
        if doc_id is not None:
            marks[doc_id][0] |= quality == 1
            marks[doc_id][1] |= toxic == 1
    rows = []
    for doc_id, text, lang, *_ in documents:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": doc_id is not None and doc_id > least[t],
        }
        rows.append((lang or "", {k for k, v in fails.items() if v}, *(marks[doc_id] if doc_id is not None else (False, False))))
    out = []
    for part in {r[0] for r in rows}:
        removed_by, here = Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            every = list(left)
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                fail = [r for r in every if f in r[1]]
                left = [r for r in left if f not in r[1]]
                removed_by[f] += len(gone)
                here.append(["".join(order), step, f, len(left), len(gone), len(fail) - len(gone), sum(r[1] == {f} for r in every), sum(r[2] for r in gone), sum(r[3] for r in gone)])
        out += [(part, *row, removed_by[row[2]]) for row in here]
    return out


def test_filter_audit(spark, docs, documents, empty):
    labels = [(0, 1, 0), (1, 0, 1), (2, 1, 1), (2, 0, 0), (None, 1, 1), (3, None, 1), (42, 1, None), (900, 1, 1), (43, 1, 0)]
    extra = [(60, "A B C $ x", "", "s", 1), (61, "A B C $ x", None, "s", 1), (60, "A B C $ x", "", "s", 1), (62, "word " * 120, "en", "s", 1), (63, " ".join(f"W{i} w{i}" for i in range(80)), "en", None, 1)]
    extra = [(*r, *["x"] * 6) for r in extra]
    frame = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    marks = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string")
    columns = ["part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = filter_audit.audit(frame, marks).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(slow_audit(documents + extra, labels))
    assert filter_audit.audit(empty, marks).count() == 0
    no_marks = filter_audit.audit(frame.limit(3), marks.limit(0))
    assert no_marks.where("good_lost + toxic_lost <> 0").count() == 0 and no_marks.count() % 600 == 0


def test_part_without_failures_has_zeros(spark):
    parts = spark.createDataFrame([("a",), ("a",), ("b",)], "part string")
    found = spark.createDataFrame([(1, "a", True, False, "X"), (1, "a", True, False, "Z")], "uid long, part string, good boolean, toxic boolean, filter string")
    rows = filter_audit.audited(parts, filter_audit.id_tables(found, ["X", "Y", "Z"]), ["X", "Y", "Z"]).collect()
    assert len(rows) == 2 * 6 * 3
    assert all((r["kept"], r["removed"], r["redundant"], r["shapley"]) == (1, 0, 0, 0) for r in rows if r["part"] == "b")
    assert {(r["filter_order"], r["removed"], r["redundant"], r["kept"]) for r in rows if r["part"] == "a" and r["filter"] == "Z"} == {(o, int(o.index("Z") < o.index("X")), int(o.index("X") < o.index("Z")), 1) for o in map("".join, itertools.permutations("XYZ"))}
    with pytest.raises(ValueError):
        filter_audit.audited(parts, {}, [])


def test_stored_prefixes_are_one_scan(spark):
    """A join below a union of the rounds was repeated for each of them; plans grew with their square."""
    found = spark.createDataFrame([(1, "a", True, False, "X"), (1, "a", True, False, "Z"), (2, "b", False, False, "Y")], "uid long, part string, good boolean, toxic boolean, filter string")
    tables = filter_audit.id_tables(found, ["X", "Y", "Z"])
    split = filter_audit.prefixes(tables, ["X", "Y", "Z"])
    joined = split.join(tables["X"].select("uid"), "uid", "left_semi")
    assert joined._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    # sets of fewer than three filters, each row alive until one of its own
    assert sorted(map(tuple, split.select("uid", "prefix", "alive").collect())) == sorted((u, p, not p & own) for u, own in ((1, 5), (2, 2)) for p in range(7))


def slow_codes(rows, entries=64, parts=16, rounds=2):
    kept = [(i, label, np.floor(256 * np.array(v, float)).astype(int).reshape(parts, -1)) for i, label, v in rows]
    x = np.array([k[2] for k in kept])
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, list(map(float, rows[k][2]))))[:entries]
    books = x[first].transpose(1, 0, 2).copy()

    def nearest():
        return np.array([[min(range(books.shape[1]), key=lambda j: (int(((v - books[p][j]) ** 2).sum()), j)) for p, v in enumerate(row)] for row in x])

    for _ in range(rounds):
        code = nearest()
        for p in range(parts):
            for j in range(books.shape[1]):
                own = x[code[:, p] == j, p]
                if len(own):
                    books[p, j] = own.sum(0) // len(own)
    code = nearest()
    error = [int(sum(((v - books[p][c]) ** 2).sum() for p, (v, c) in enumerate(zip(row, at, strict=True)))) for row, at in zip(x, code, strict=True)]
    total = Counter()
    for (_, label, _), e in zip(kept, error, strict=True):
        total[label] += e
    return Counter((i, label, bytes(c.tolist()), e, total[label]) for (i, label, _), c, e in zip(kept, code, error, strict=True)), books


def vectors(seed, n, size):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.2, (9, size))
    made = [(int(i), int(rng.integers(0, 4)) if rng.random() < 0.9 else None, (centres[rng.integers(0, 9)] + rng.normal(0, 0.05, size)).tolist()) for i in rng.permutation(n)]
    return made + [(n + k, None, made[0][2]) for k in range(60)] + [(n + 100, 1, [0.0] * size), (n + 101, 1, [0.0] * size), (5, 2, made[1][2]), (5, 2, made[1][2]), (None, 3, made[2][2])]


@pytest.mark.parametrize(("n", "size", "entries", "leaf"), [(150, 32, 64, 24), (220, 64, 16, 4), (30, 16, 64, 2)])
def test_anchor_codes(spark, monkeypatch, n, size, entries, leaf):
    monkeypatch.setattr(anchor_codes, "CHUNK_VALUES", 70 * size)
    monkeypatch.setattr(anchor_codes, "LEAF", leaf)
    good = vectors(n, n, size)
    bad = [(900, 1, None), (901, 1, [None] * size), (902, 1, [float("nan")] * size), (903, 1, [float("inf")] + [0.0] * (size - 1)), (904, 1, [1.0] * (size - 1)), (905, 1, [1.0] * 80), (906, 1, [])]
    frame = spark.createDataFrame([(*r, "x", "y") for r in good + bad], "vec_id long, label int, embedding array<double>, code string, error string").repartition(3)
    codes, books = anchor_codes.compressed(frame, entries=entries)
    want, slow_books = slow_codes(good, entries)
    assert (books == slow_books).all()
    assert Counter((r["vec_id"], r["label"], bytes(r["code"]), r["error"], r["label_error"]) for r in codes.collect()) == want
    assert anchor_codes.digest(books) == hashlib.sha256(",".join(str(v) for p in slow_books for e in p for v in e).encode()).hexdigest()


def test_no_vectors(spark):
    frame = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    codes, books = anchor_codes.compressed(frame)
    assert codes.count() == 0 and books.size == 0
    with pytest.raises(ValueError):
        anchor_codes.compressed(spark.createDataFrame([(1, [1e9] * 16)], "vec_id long, embedding array<double>"))


def test_trees_hold_their_points_and_own_whole_balls():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(-300, 300, (900, 4)), np.tile(rng.integers(-300, 300, (1, 4)), (200, 1))])
    tree = anchor_codes.Tree(x)
    assert sorted(tree.order.tolist()) == list(range(len(x)))
    for node, (a, b) in enumerate(zip(tree.start, tree.stop, strict=True)):
        own = x[tree.order[a:b]]
        assert (tree.total[node] == own.sum(0)).all()
        assert np.sqrt(((own - tree.pivot[node]) ** 2).sum(1)).max() <= tree.radius[node] * (1 + 1e-12)
        if tree.left[node] >= 0:
            assert {(tree.start[k], tree.stop[k]) for k in (tree.left[node], tree.right[node])} == {(a, tree.stop[tree.left[node]]), (tree.stop[tree.left[node]], b)}
    owner = anchor_codes.anchors(x.astype(float), 20)
    at = [x[0]]
    while len(at) < 20:  # the point worst served, by all distances
        at.append(x[np.min([((x - a) ** 2).sum(1) for a in at], axis=0).argmax()])
    far = np.array([((x - a) ** 2).sum(1) for a in at])
    assert (far[owner, np.arange(len(x))] == far.min(0)).all()
