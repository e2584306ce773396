"""Each operator beside a brute-force version, on rows with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
import xxhash
from pyspark.sql import functions as F

from eventlens.llm import language_codes, quality_machine, secret_forest, suffix_dedup, token_files
from eventlens.llm.curriculum import SCHEDULES, mixed, plan_mix, position, source_targets
from eventlens.llm.pieces import Vocabulary, encoded
from eventlens.llm.queries import BYTES, PIECES
from eventlens.llm.simhash import fingerprint, links, simhash_groups
from eventlens.llm.weighted_sampling import edited_fingerprints

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def held(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 3 == 1


def slow_fingerprint(text):
    words = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = WORD.findall(words)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_groups(docs, documents, empty):
    made = [slow_fingerprint(r[1]) for r in documents]
    root = list(range(len(made)))
    for i in range(len(made)):
        for j in range(i):
            if (made[i] ^ made[j]).bit_count() <= 2:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    least = {r: min([documents[i][0] for i in range(len(made)) if root[i] == r and documents[i][0] is not None], default=None) for r in root}
    want = Counter((d[0], f"{f:016x}", least[r]) for d, f, r in zip(documents, made, root, strict=True))
    assert Counter(map(tuple, simhash_groups(docs).collect())) == want
    assert simhash_groups(empty).count() == 0


def test_simhash_tiles_find_every_link():
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = np.unique(np.concatenate([seeds, *(seeds ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) for _ in range(12))]))
    a, b = near[: len(near) // 2], near[len(near) // 2 :]

    def parts(x, y):
        root = {int(v): int(v) for v in near}

        def top(v):
            while root[v] != v:
                v = root[v]
            return v

        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            i, j = top(i), top(j)
            root[max(i, j)] = min(i, j)
        return {v: top(v) for v in root}

    found = [links(a, None, 2), links(b, None, 2), links(a, b, 2)]
    i, j = np.nonzero(np.bitwise_count(near[:, None] ^ near[None, :]) <= 2)
    assert parts(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) == parts(near[i], near[j])
    assert sum(len(f[0]) for f in found) <= 3 * len(near)
    assert fingerprint(b"") == 0 and fingerprint("É A b".encode()) == slow_fingerprint("É A b")


def test_language_codes(docs, documents, empty):
    model = language_codes.learned(docs)
    found = language_codes.identified(docs, model).collect()
    assert len(found) == len(documents)
    lang = {r[0]: (r[1], r[2]) for r in documents if r[0] is not None}
    known = [r for r in found if r.doc_id is not None and lang[r.doc_id][0] and len(lang[r.doc_id][0]) > 60 and r.held_out and r.doc_id < 42]
    assert np.mean([r.lang_pred == lang[r.doc_id][1] for r in known]) > 0.9
    for r in found:
        assert r.held_out == held(r.doc_id) and 0 <= r.score <= 1
        text = lang.get(r.doc_id, ("letters", None))[0]
        assert (r.lang_pred == "und") == (text is None or not any(c.isalpha() for c in text))
    assert language_codes.learned(empty) is None
    assert {r.lang_pred for r in language_codes.identified(docs, None).collect()} == {"und"}


def test_language_features_of_a_long_text(monkeypatch):
    text = np.frombuffer(("the queue und " * 700).encode(), np.uint8)
    whole = language_codes.features(text, np.array([0, len(text)]))
    monkeypatch.setattr(language_codes, "PIECE", 1000)
    assert np.allclose(language_codes.features(text, np.array([0, len(text)])), whole)


def test_quality_machine(spark, docs, documents, empty):
    shape = quality_machine.features(np.zeros(0, np.uint8), np.zeros(3, np.int64), np.array([0.0, np.nan]))
    assert shape.shape == (2, quality_machine.BUCKETS + len(quality_machine.SHAPE)) and np.isfinite(shape).all()
    labels = spark.createDataFrame([(r[0], int(i % 3 > 0), 0) for i, r in enumerate(documents)] + [(0, None, 0), (1, 7, 0)], "doc_id long, quality int, toxic int")
    model = quality_machine.learned(docs, labels)
    rows = quality_machine.scored(docs, model).collect()
    assert len(rows) == len(documents) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    none = quality_machine.learned(empty, labels)
    assert {r.score for r in quality_machine.scored(docs, none).collect()} == {0.5}


def test_factorisation_identity_and_learning():
    rng = np.random.default_rng(0)
    x = rng.random((400, quality_machine.BUCKETS + len(quality_machine.SHAPE))).astype(np.float32)
    y = (x[:, -3] > 0.5).astype(np.float32)
    model = quality_machine.train(x, y)
    z = x[:5] * model.scale
    slow = [model.w0 + z[i] @ model.w + sum(0.5 * ((z[i] @ model.v[:, f]) ** 2 - (z[i] ** 2 @ model.v[:, f] ** 2)) for f in range(model.v.shape[1])) for i in range(5)]
    assert np.allclose(model.margin(x[:5]), slow, atol=1e-3)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.9


def test_mix(docs, documents, empty):
    size = [len(WORD.findall(r[1] or "")) for r in documents]
    rows = plan_mix(docs, keep=["doc_id"]).select("_row.doc_id", "_mix.*").collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((d[0], s) for d, s in zip(documents, size, strict=True))
    by, total = Counter(), sum(size)
    for d, s in zip(documents, size, strict=True):
        by[d[3]] += s
    order = sorted(by, key=lambda s: (s is None, s))
    weight, target, left = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {}, set(order)
    while True:
        room = (1.5 * total - sum(target.values())) / sum(weight[s] for s in left)
        over = {s for s in left if weight[s] * room > 2 * by[s]}
        if not over:
            break
        target |= {s: 2 * by[s] for s in over}
        left -= over
    target |= {s: weight[s] * room for s in left}
    taken = Counter()
    for r in rows:
        assert r.taken in (0, r.size, 2 * r.size) and list(r.positions) == sorted(r.positions) and all(0 <= p <= 1 for p in r.positions)
        assert any(r.source_size == by[s] and abs(r.target - target[s]) < 1e-6 for s in order)
        taken[next(s for s in order if by[s] == r.source_size)] += r.taken
    assert all(abs(taken[s] - target[s]) <= max(size) for s in order)
    again = plan_mix(docs.repartition(5), keep=["doc_id"]).select("_row.doc_id", "_mix.*").collect()
    assert Counter(map(repr, again)) == Counter(map(repr, rows))
    assert mixed(docs).count() == sum(len(r.positions) for r in rows) and mixed(docs).columns == docs.columns
    assert mixed(empty).count() == 0 and source_targets(empty.selectExpr("source", "1 AS size")).count() == 0


@pytest.mark.parametrize("sizes", [(8 << 20, 4 << 20, 64, 4 << 20), (400, 500, 1, 300)])
def test_suffix_dedup(docs, documents, empty, monkeypatch, sizes):
    for name, value in zip(("SHARD_BYTES", "BUCKET_BYTES", "HOT_DOCS", "BLOCK_BYTES"), sizes, strict=True):
        monkeypatch.setattr(suffix_dedup, name, value)
    text = [((d[0] if d[0] is not None else 1 << 62), d[0], (d[1] or "").encode()) for d in documents]
    first = {}
    for i, _, b in text:
        for s in range(len(b) - 49):
            first[b[s : s + 50]] = min(i, first.get(b[s : s + 50], i))
    want = Counter()
    for i, doc_id, b in text:
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < i:
                gone[s : s + 50] = b"\1" * 50
        want[doc_id, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(b, gone, strict=True) if not g)] += 1
    assert Counter((r[0], r[1], r[2], r[3], bytes(r[4])) for r in suffix_dedup.removed(docs).collect()) == want
    assert sum(k[2] for k in want) > 1000 and suffix_dedup.removed(empty).count() == 0


def test_suffix_dedup_stores_no_names(docs, monkeypatch):
    """Names go from shards to buckets once, and only what two jobs read is stored."""
    kept, store = [], suffix_dedup.stored
    monkeypatch.setattr(suffix_dedup, "stored", lambda df, name: kept.append(name) or store(df, name))
    assert suffix_dedup.removed(docs).count() == docs.count() and kept == ["known", "verdicts"]


def test_contents_of_segments():
    """Hashes from the bytes alone: equal for equal contents, wherever they lie."""
    rng, n = np.random.default_rng(3), np.array([1, 7, 1, 30, 7])
    parts = [rng.integers(0, 256, k + 49).astype(np.uint8) for k in n.tolist()]
    parts[2], parts[4] = parts[0], parts[1]
    body = np.concatenate(parts)
    made = suffix_dedup.content(body, n, *suffix_dedup.powers(len(body))).tolist()
    assert made[0] == made[2] and made[1] == made[4] and len(set(made)) == 3
    names = np.array([5 << 61 | 3 << 40, 5 << 61 | 3 << 40 | 1], np.uint64)
    assert suffix_dedup.below(names, 3).max() < 1 << 32


def test_suffix_array():
    rng = random.Random(2)
    for text in (bytes(rng.choice(b"ab") for _ in range(700)), b"a" * 200, b"abc", bytes(rng.randrange(256) for _ in range(300))):
        at = suffix_dedup.suffix_array(np.frombuffer(text, np.uint8), 64).tolist()
        assert sorted(at) == list(range(len(text)))
        cut = [text[i : i + 50] for i in at if i + 50 <= len(text)]
        assert cut == sorted(cut)


def test_secret_forest(docs, documents, empty):
    model = secret_forest.learned(docs)
    rows = secret_forest.scanned(docs, model).collect()
    assert len(rows) == len(documents)
    secret = next(d[0] for d in documents if d[1] and "token =" in d[1])
    text = {d[0]: d[1] for d in documents}
    for r in rows:
        if r.doc_id is not None:
            body = (text[r.doc_id] or "").encode()
            for s in reversed(r.secrets):
                body = body[: s.start] + b"[SECRET]" + body[s.end :]
            assert r.clean_text == (None if text[r.doc_id] is None else body.decode())
    assert [r.secrets[0].end - r.secrets[0].start for r in rows if r.doc_id == secret] == [40]
    assert secret_forest.scanned(empty, model).count() == 0
    assert sum(bool(r.secrets) for r in secret_forest.scanned(docs, secret_forest.learned(empty)).collect()) <= 2


def test_findings_have_both_classes(spark):
    rng = random.Random(7)
    dump = " ".join(f'token = "{rng.randbytes(20).hex()}"' for _ in range(300))
    texts = [dump, *(f'a{i} token = "{rng.randbytes(20).hex()}" in /usr/share/lib{i}/some_long_name{i}' for i in range(40))]
    rows = secret_forest.labelled_findings(spark.createDataFrame([(t,) for t in texts], "text string"), findings=60).collect()
    assert Counter(r.label for r in rows) == {0: 30, 1: 30}
    everything = secret_forest.labelled_findings(spark.createDataFrame([(t,) for t in texts], "text string")).distinct().collect()
    assert sum(r.label for r in everything) == 40 + secret_forest.PER_TEXT
    alone = spark.createDataFrame([(1, dump)], "doc_id long, text string")  # secrets only
    assert secret_forest.scanned(alone, secret_forest.learned(alone)).first().clean_text.count("[SECRET]") == 300


SHORT = ['password = "S3cr3t9x" end', "db_password: p4$$w0rd!x7 end", "pwd='Zk8!qR#2v@Lp' end", "at postgres://admin:q7!Rt@host/db end", 'token = "hQzKvXwPjRtBnMdL" end', "API_KEY=Xq%7Jz:9Kw!3Vb$5"]
VALUES = ["S3cr3t9x", "p4$$w0rd!x7", "Zk8!qR#2v@Lp", "q7!Rt", "hQzKvXwPjRtBnMdL", "Xq%7Jz:9Kw!3Vb$5"]


def planted(rng, words):
    """Texts with one value each, and whether it is a secret."""
    mixed = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789"
    talk = lambda: " ".join(rng.choices(words, k=8))
    key = lambda n: "".join(rng.choice(mixed) for _ in range(n))
    out = []
    for _ in range(40):
        h = rng.randbytes(32).hex()
        no = [f"digest sha256 = {h}", f"in commit {h[:40]} we", f'sha1 "{h[:40]}"', f"request {h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}", "the token: 2024-01-01", f"password: {rng.choice(['changeme', 'example', '<password>', 'xxxxxxxxxx'])}", f"key = {rng.randrange(10**5)}", f"see https://a.example/{rng.choice(words)}/{rng.randrange(99)}", f"the secret: {rng.choice(words)}"]
        yes = [f'token = "{h[:40]}"', f"api_key: {key(32)}", f"password = '{key(10)}'", f"auth_token={h}", f"postgres://admin:{key(9)}@host/db"]
        out += [(f"{talk()} {t} {talk()}", False) for t in no] + [(f"{talk()} {t} {talk()}", True) for t in yes]
    return out


def test_planted_secrets(spark):
    """Precision and recall on values of known kinds, with a forest that has met only hexadecimal tokens in its table."""
    rng = random.Random(19)
    words = ["river", "station", "window", "garden", "python", "server", "winter", "paper", "people", "question"]
    known = spark.createDataFrame([(f'{" ".join(rng.choices(words, k=30))} token = "{rng.randbytes(20).hex()}" in /usr/share/lib{i}/{"_".join(rng.choices(words, k=3))}{i}',) for i in range(60)], "text string")
    texts = planted(rng, words)
    rows = secret_forest.scanned(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id long, text string"), secret_forest.learned(known)).collect()
    hit = {r.doc_id for r in rows if r.secrets}
    secrets = {k for k, (_, s) in enumerate(texts) if s}
    print("precision", len(hit & secrets) / len(hit), "recall", len(hit & secrets) / len(secrets))
    assert len(hit & secrets) >= 0.95 * len(hit) and len(hit & secrets) >= 0.95 * len(secrets)


def test_what_is_no_secret_stays(spark):
    texts = ["digest sha256 = 2c26b46b68ffc68ff99b453c1d30413413422d706483bfa0f98a5e886266e7ae", "we saw 4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e between plain words", "the token: 2024-01-01", "password: changeme"]
    base = spark.createDataFrame([(f'some words token = "{random.Random(i).randbytes(20).hex()}" follow',) for i in range(50)], "text string")
    rows = secret_forest.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), secret_forest.learned(base)).collect()
    assert [r.clean_text for r in sorted(rows, key=lambda r: r.doc_id)] == texts


def test_short_and_broken_secrets_are_candidates(spark):
    for text, value in zip(SHORT, VALUES, strict=True):
        body = text.encode()
        assert value.encode() in [body[a:b] for a, b in secret_forest.spans_of(body, [])]
    rng = random.Random(9)
    words = ["river", "station", "window", "garden", "python", "server", "winter", "paper"]
    texts = [f'{" ".join(rng.choices(words, k=30))} token = "{rng.randbytes(20).hex()}" in /usr/share/lib{i}/{"_".join(rng.choices(words, k=3))}{i}' for i in range(60)]
    model = secret_forest.learned(spark.createDataFrame([(t,) for t in texts], "text string"))
    rows = {r.doc_id: r for r in secret_forest.scanned(spark.createDataFrame(list(enumerate(SHORT)), "doc_id long, text string"), model).collect()}
    assert all(rows[i].n_candidates >= 1 for i in rows)
    assert len([v for i, v in enumerate(VALUES) if v in rows[i].clean_text]) <= 1  # the forest has only met hexadecimal secrets


def test_dictionary_counts_all_texts(spark, documents):
    rows = [(f"the usual words of text {i}",) for i in range(4000)] + [(f"zxqwk rare language {i}",) for i in range(8)]
    known = secret_forest.dictionary(spark.createDataFrame(rows, "text string").repartition(3))
    assert {b"zx", b"zxq", b"qwk", b"wk"} <= known and b"of" not in known
    texts = [(r[1] or "").encode() for r in documents]
    made = secret_forest.letter_groups(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), 7)
    want = Counter()
    for t in texts:
        words = [w for w in re.split(b"[^a-z]+", t.lower()) if len(w) >= 3]
        want.update({w[i : i + k] for w in words for k in (2, 3) for i in range(len(w) - k + 1)})
    assert {secret_forest._group(i): n for i, n in enumerate(made.tolist()) if n} == want


def test_pieces(docs, documents, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = Counter((d[0], tuple(ids := library.encode(d[1] or "")), library.decode(ids)) for d in documents)
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in encoded(docs, PIECES).collect()) == want
    assert encoded(empty, PIECES).count() == 0


def test_pieces_like_the_library():
    model, rng = Vocabulary(PIECES), random.Random(1)
    parts = ["a", "the", "  ", " ", "\n", "\t", "é", "🤖", "▁", "<s>", "<0x41>", "ing", "\x00", "中", "ﬁ", "1", "\r\n", "\xa0", ",", "...", "'s"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(5000)] + ["ab" * 20000]
    for text, ids in zip(texts, model.encode(texts), strict=True):
        assert ids == model.library.encode(text) and model.decode(ids) == model.library.decode(ids)


def test_token_files(docs, documents, empty):
    library = tokenizers.Tokenizer.from_file(BYTES)
    ids = {d[0]: library.encode(d[1] or "", add_special_tokens=False).ids + [2] for d in documents if d[0] is not None}
    rows = token_files.round_trip(docs, BYTES).orderBy("start").collect()
    assert len(rows) == len(documents)
    at = 0
    for r in rows:
        assert r.start == at and (r.doc_id is None or np.frombuffer(r.ids, "<u4").tolist() == ids[r.doc_id])
        at += r.n_tokens
    assert [r.doc_id for r in rows] == sorted((d[0] for d in documents), key=lambda i: (i is not None, i))
    assert token_files.round_trip(empty, BYTES).count() == 0


def test_codes():
    rng = np.random.default_rng(0)
    for n, v in ((1, 1), (5, 3), (2000, 40000), (50000, 50)):
        ids = np.minimum(rng.zipf(1.3, n) - 1, v - 1).astype(np.int64)
        lengths = token_files.code_lengths(np.bincount(ids, minlength=v))
        assert lengths.max() <= 16 and (2.0 ** -lengths[lengths > 0]).sum() <= 1
        bits, at = token_files.packed_bits(ids, token_files.canonical(lengths), lengths)
        assert (token_files.unpacked([bits], [n], [at], *token_files.decode_table(lengths))[0] == ids).all()
    fibonacci = [1, 1]
    while len(fibonacci) < 30:
        fibonacci.append(sum(fibonacci[-2:]))
    assert token_files.code_lengths(np.array(fibonacci)).max() == 16


def test_tokens_like_the_library():
    model, rng = token_files.Tokenizer(public_tokenizers.path("byte_bpe_50k.json")), random.Random(2)
    parts = ["a", "the", "  ", " ", "\n", "\t", "é", "🤖", "'s", "don't", "<|endoftext|>", "_", "22", "½", "\x1c", "\x85", "\xa0", "中", "—", ".", "$$$"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(5000)]
    assert [x.tolist() for x in model.encode(texts)] == model.whole(texts)


def test_punctuation_after_symbols_like_the_library():
    model = token_files.Tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    words = [' wait…"', "…)", '—"', "—-", "®,", "™:", " […]", "e\u0301,", "½.", "é,", "中.", "x\u200d,", "don't.", "l',", "Ⅷ,", "ª.", "²)", "²)…)", "a…).", "_.", "×,", "÷)"]
    texts = ["plain first text", *words, *(f"so{a}{b} end" for a in words for b in words)]
    assert [x.tolist() for x in model.encode(texts)] == model.whole(texts)


def test_weighted_sampling(docs, documents, empty):
    ordered = [r for r in sorted(documents, key=lambda r: -1 if r[0] is None else r[0]) if r[0] is not None]
    rows = edited_fingerprints(docs).collect()
    assert len(rows) == len(documents)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for d, following in zip(ordered, ordered[1:], strict=False):
        if documents.count(d) > 1 or documents.count(following) > 1:
            continue
        text, after = d[1] or "", following[1] or ""
        half = len(text) // 2
        (r,) = by[d[0]]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    same = {}
    for r in rows:
        if r.doc_id is not None:
            text = next(d[1] for d in documents if d[0] == r.doc_id) or ""
            assert same.setdefault(text, r.fingerprint) == r.fingerprint
    assert edited_fingerprints(empty).count() == 0


def test_weighted_sampling_estimates_weighted_jaccard(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(60)) for _ in range(120)]
    rows = {r.doc_id: r for r in edited_fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    error = []
    for i, text in enumerate(texts):
        a, b = Counter(text.split()), Counter(texts[(i + 1) % len(texts)].split())
        error.append(rows[i].near_next - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(error)) < 0.03 and np.mean(np.abs(error)) < 0.1


def test_factorisation_against_all_pairs():
    """The linear-time margin beside the double loop over pairs that it stands for."""
    rng = np.random.default_rng(8)
    size, factors = 12, 3
    machine = quality_machine.Machine(0.3, rng.normal(size=size), rng.normal(size=(size, factors)), rng.uniform(0.5, 2, size))
    for x in rng.normal(size=(20, size)) * (rng.random((20, size)) < 0.6):
        z = x * machine.scale
        slow = machine.w0 + sum(machine.w[i] * z[i] for i in range(size)) + sum(float(machine.v[i] @ machine.v[j]) * z[i] * z[j] for i in range(size) for j in range(i))
        assert abs(machine.margin(x[None, :])[0] - slow) < 1e-9


def slow_grams(text):
    """Hashed n-grams of a text's bytes, A to Z in lower case, one after another."""
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    out = np.zeros(language_codes.BUCKETS)
    for n in language_codes.GRAMS:
        for i in range(len(low) - n + 1):
            gram = int.from_bytes(low[i : i + n])
            out[((gram + (n << 40)) * int(language_codes.MULTIPLIER) & (1 << 64) - 1) >> 52] += 1
    x = np.sqrt(out)
    return x / max(np.linalg.norm(x), 1e-9)


def test_ngrams_against_a_loop():
    texts = ["", "a", "The CAT", "déjà vu, Ünï", "x" * 300, "tiếng Việt"]
    data = [t.encode() for t in texts]
    x = language_codes.features(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    for row, t in zip(x, texts, strict=True):
        assert np.allclose(row, slow_grams(t), atol=1e-6), t


def test_decoding_against_a_loop():
    """Loss-weighted decoding, its score and the ambiguity flag, language by language and bit by bit."""
    rng = np.random.default_rng(4)
    code = language_codes.codewords(5)
    assert all(sum(code[i] != code[j]) >= 3 for i in range(5) for j in range(i))  # one wrong bit changes nothing
    model = language_codes.Codes(list("abcde"), code, rng.normal(size=(6, code.shape[1])), rng.normal(size=code.shape[1]), rng.uniform(0.2, 2, code.shape[1]))
    x = rng.normal(size=(40, 6))
    best, score, close = model.decode(x)
    seen = set()
    for k in range(len(x)):
        margins = [float(x[k] @ model.weights[:, b] + model.offset[b]) for b in range(code.shape[1])]
        losses = [sum(model.trust[b] * np.log1p(np.exp(-margins[b] * code[i][b])) for b in range(code.shape[1])) for i in range(5)]
        order = sorted(range(5), key=lambda i: losses[i])
        assert best[k] == order[0]
        assert abs(score[k] - np.exp(-losses[order[0]]) / sum(np.exp(-v) for v in losses)) < 1e-9
        assert close[k] == (losses[order[1]] - losses[order[0]] < language_codes.AMBIGUOUS * model.trust.sum())
        seen.add(bool(close[k]))
    assert len(seen) == 2 or not any(close)


def test_positions_invert_the_integral(spark):
    """A copy's training position is where the integral of its source's schedule, added up in small steps, reaches its share."""
    grid = np.linspace(0, 1, 200_001)
    shares = [0.0, 0.001, 0.1, 0.25, 0.3, 0.5, 0.9, 1.0]
    frame = spark.createDataFrame([(s,) for s in shares], "share double")
    for schedule in (*SCHEDULES, ((0.0, 2.0), (0.25, 0.0), (1.0, 1.0))):
        weight = np.interp(grid, *zip(*schedule, strict=True))
        area = np.concatenate(([0], np.cumsum((weight[1:] + weight[:-1]) / 2 * np.diff(grid))))
        got = [r[0] for r in frame.select(position(F.col("share"), schedule)).collect()]
        assert np.allclose(np.interp(got, grid, area / area[-1]), shares, atol=1e-6), schedule
