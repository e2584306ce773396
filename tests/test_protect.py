import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from times import at
from eventlens.operators import cloud as C
from eventlens.operators import enrich as E
from eventlens.operators import graph as G
from eventlens.operators import integrity as I
from eventlens.operators import privacy as V


def sha(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def tree_root(leaves):
    level = [sha(x.encode()) for x in leaves]
    while len(level) > 1:
        level = [sha(level[i] + level[min(i + 1, len(level) - 1)]) for i in range(0, len(level), 2)]
    return level[0].hex()


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8, 9, 16, 17, 33, 64, 65])
def test_merkle(spark, n):
    df = spark.range(n).withColumn("leaf", F.concat(F.lit("x"), F.col("id").cast("string"))).repartition(3)
    out = I.merkle_root(df, F.col("leaf"), ["id"], levels=2).collect()
    assert [(r.root, r.leaves) for r in out] == [(tree_root([f"x{i}" for i in range(n)]), n)]


@pytest.mark.parametrize("n", [1, 5, 17])
def test_merkle_proofs(spark, n):
    df = spark.range(n).withColumn("leaf", F.concat(F.lit("x"), F.col("id").cast("string")))
    proofs = I.merkle_proofs(df, F.col("leaf"), ["id"], F.lit(True), levels=2)
    roots = [r[0] for r in proofs.select(I.proof_root(F.col("h"), F.col("path"))).collect()]
    assert roots == [tree_root([f"x{i}" for i in range(n)])] * n


@pytest.mark.parametrize("group_rows", [None, 0])
def test_chain(spark, group_rows):
    df = spark.range(23).withColumn("k", F.when(F.col("id") < 3, "a").otherwise("hot")).withColumn("d", F.col("id").cast("string"))
    got = {(r.k, r.segment): r.head for r in I.hash_chain(df, F.col("d"), ["k"], ["id"], block=8, group_rows=group_rows).collect()}
    want = {}
    for k, ids in (("a", range(3)), ("hot", range(3, 23))):
        ids = list(ids)
        for s in range(0, len(ids), 8):
            head = sha(str(ids[s]).encode())
            for i in ids[s + 1 : s + 8]:
                head = sha(head + str(i).encode())
            want[k, s // 8] = head.hex()
    assert got == want


@pytest.mark.parametrize("secret", [b"short", b"k" * 100])
def test_hmac_and_lineage(spark, secret):
    df = spark.createDataFrame([("é message",), ("",)], "m string")
    got = [r[0] for r in df.select(I.hmac_sha256(F.col("m"), secret)).collect()]
    assert got == [hmac.new(secret, m.encode(), hashlib.sha256).hexdigest() for m in ("é message", "")]
    signed = df.transform(I.lineage_sign("a", "b", "n", secret, F.col("m"), F.lit(at(0)))).transform(I.lineage_sign("c", "d", "n", secret, F.col("m"), F.lit(at(5))))
    assert [r.lineage_valid for r in signed.transform(I.lineage_verify(secret)).collect()] == [True, True]
    assert [r.lineage_valid for r in signed.transform(I.lineage_verify(b"other")).collect()] == [False, False]


def test_masking(spark):
    df = spark.createDataFrame([("mail bob@example.com from 10.1.2.3, 123-45-6789, 4111 1111 1111 1111, api_key = abcdefghij0123456789",)], "t string")
    masked = df.select(V.mask_patterns(F.col("t"))).first()[0]
    assert masked == "mail [MASKED_EMAIL] from [MASKED_IPV4], [MASKED_SSN], [MASKED_CC], api_key =********"
    parts = spark.createDataFrame([("1.2.3.4",), ("a.b",), ("longvalue",), ("short",), (None,)], "v string")
    assert [r[0] for r in parts.select(V.mask_partial(F.col("v"))).collect()] == ["1.2.3.xxx", "[MASKED_IP]", "lo...ue", "[MASKED]", None]
    row = spark.createDataFrame([("u", "s@x.org", 5)], "user string, email string, n int")
    assert tuple(row.transform(V.mask_by_role("auditor", "s")).first()) == ("u", "[REDACTED]", 5)
    assert tuple(row.transform(V.mask_by_role("nobody", "s")).first()) == tuple(row.transform(V.mask_by_role("ANALYST", "s")).first())


def test_tokens_and_encryption(spark):
    df = spark.createDataFrame([(1, "a@x.org", "1"), (2, "", None)], "id long, email string, phone string")
    vault = V.token_vault(df, "email", "phone", salt="s")
    back = df.transform(V.tokenize_pii("email", "phone", salt="s")).transform(E.detokenize(vault, "email", "phone"))
    assert sorted(back.collect()) == sorted(df.collect())
    sealed = df.transform(V.encrypt_fields("00" * 16))
    assert sealed.where("id = 1").first().email.startswith("encrypted:")
    opened = sealed.transform(V.decrypt_fields("00" * 16, {"phone": "int"})).orderBy("id").collect()
    assert [(r.email, r.phone) for r in opened] == [("a@x.org", 1), ("", None)]


def test_policies(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "who string, n int")
    rules = [I.Policy("p", "go", "deny", (I.Condition("who", "eq", "a"), I.Condition("n", "neq", 2)))]
    assert [(r.allowed, r.denied_by) for r in df.transform(I.policy_decide(rules, "go")).collect()] == [(False, "p"), (True, None)]
    assert all(r.allowed for r in df.transform(I.policy_decide(rules, "stay")).collect())


def test_asset_edge_cases(spark):
    raw = spark.createDataFrame([('{"InstanceId":"i","Tags":[{"Key":"Name","Value":"a"},{"Key":"Name","Value":"b"},{"Key":"x"}]}',), ("junk",)], "value string")
    out = C.norm_asset(raw, "aws").collect()
    assert out[0].name == "b" and out[0].tags == {"Name": "b"} and out[1].id is None


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("x", "y")], "from_id string, to_id string")
    starts = spark.createDataFrame([("a",), ("x",)], "id string")
    assets = spark.createDataFrame([("a",), ("c",), ("d",), ("x",)], "id string")
    reach = {(r.start_id, r.id): r.distance for r in G.graph_connected(starts, edges, 5, assets).collect()}
    assert reach == {("a", "a"): 0, ("a", "d"): 1, ("a", "c"): 2, ("x", "x"): 0}
    pairs = spark.createDataFrame([("a", "c"), ("a", "y"), ("b", "b")], "from_id string, to_id string")
    paths = sorted(tuple(r.path) for r in G.graph_paths(pairs, edges, 4).collect())
    assert paths == [("a", "b", "c"), ("a", "d", "c"), ("b",)]
    assert G.graph_paths(pairs, edges, 2).count() == 1
