"""Driver queries for privacy and integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlens.operators import enrich as E
from eventlens.operators import integrity as I
from eventlens.operators import ledger as J
from eventlens.operators import privacy as V
from eventlens.operators.rules import Condition
from eventlens.plans.catalog import query
from eventlens.plans.tables import SEC, sec_events, table
from eventlens.session import new_path

W = f"WITH {SEC} "
MASK_SALT, TOKEN_SALT = "salt of the masks", "salt of the tokens"

PII_COLUMNS = {
    "doc_id": "doc_id",
    "email": "concat('user', CAST(doc_id AS VARCHAR(20)), '@example.com')",
    "ssn": "concat('123-45-', CAST(1000 + doc_id % 9000 AS VARCHAR(20)))",
    "src_ip": "concat('10.0.', CAST(doc_id % 200 AS VARCHAR(20)), '.7')",
    "dst_ip": "CASE WHEN doc_id % 3 = 0 THEN 'host.local' WHEN doc_id % 3 = 1 THEN 'gateway9' ELSE 'gw' END",
    "phone": "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE '555-0100' END",
    "user": "source",
    "action": "lang",
    "message": "replace(text, '\"', '')",
}
PII = "pii AS (SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in PII_COLUMNS.items()) + " FROM documents)"


def pii_rows(spark, sf):
    return table(spark, sf, "documents").selectExpr(*[f"{e} AS `{n}`" for n, e in PII_COLUMNS.items()])


def masked_sql(col):
    for name, pattern in V.PATTERNS.items():
        col = f"regexp_replace({col}, '{pattern}', '[MASKED_{name}]', 'g')"
    return f"regexp_replace({col}, '{V.API_KEY}', '\\1********', 'g')"


def hash_sql(col, salt=MASK_SALT):
    return f"substring(sha256({col} || '{salt}'), 1, 16)"


PARTIAL = """CASE WHEN contains({c}, '.') THEN CASE WHEN len(string_split({c}, '.')) = 4 THEN array_to_string(string_split({c}, '.')[1:3], '.') || '.xxx' ELSE '[MASKED_IP]' END
 WHEN length({c}) > 6 THEN left({c}, 2) || '...' || right({c}, 2) WHEN {c} IS NOT NULL THEN '[MASKED]' END"""


@query(
    "mask_by_role",
    f"""WITH {PII} SELECT 'analyst' AS role, doc_id, {hash_sql('email')} AS email, '[REDACTED]' AS ssn, {PARTIAL.format(c='src_ip')} AS src_ip, {PARTIAL.format(c='dst_ip')} AS dst_ip, {hash_sql('phone')} AS phone,
    {masked_sql('"user"')} AS "user", {masked_sql('action')} AS action, {masked_sql('message')} AS message FROM pii
    UNION ALL SELECT 'auditor', doc_id, '[REDACTED]', '[REDACTED]', '[REDACTED]', '[REDACTED]', CASE WHEN phone IS NOT NULL THEN '[REDACTED]' END, "user", action, '[REDACTED]' FROM pii
    UNION ALL SELECT 'admin', * FROM pii""",
)
def _(spark, sf):
    views = [pii_rows(spark, sf).transform(V.mask_by_role(r, MASK_SALT)).withColumn("role", F.lit(r)) for r in ("Analyst", "auditor", "admin")]
    return views[0].union(views[1]).union(views[2]).withColumn("role", F.lower("role"))


@query("mask_hash", f"WITH {PII} SELECT doc_id, {hash_sql('email')} AS masked FROM pii")
def _(spark, sf):
    return pii_rows(spark, sf).select("doc_id", V.mask_hash(F.col("email"), MASK_SALT).alias("masked"))


@query("mask_partial", f"WITH {PII} SELECT doc_id, {PARTIAL.format(c='src_ip')} AS a, {PARTIAL.format(c='dst_ip')} AS b, {PARTIAL.format(c='phone')} AS c FROM pii")
def _(spark, sf):
    return pii_rows(spark, sf).select("doc_id", *[V.mask_partial(F.col(c)).alias(n) for n, c in (("a", "src_ip"), ("b", "dst_ip"), ("c", "phone"))])


@query("mask_patterns", f"WITH {PII} SELECT doc_id, {masked_sql('message')} AS masked FROM pii")
def _(spark, sf):
    return pii_rows(spark, sf).select("doc_id", V.mask_patterns(F.col("message")).alias("masked"))


@query("tokenize_pii", f"WITH {PII} SELECT doc_id, 'detok_' || {hash_sql('email', TOKEN_SALT)} AS email, 'detok_' || {hash_sql('ssn', TOKEN_SALT)} AS ssn FROM pii")
def _(spark, sf):
    return pii_rows(spark, sf).transform(V.tokenize_pii(salt=TOKEN_SALT)).select("doc_id", "email", "ssn")


@query("detokenize", f"WITH {PII} SELECT doc_id, email, ssn FROM pii")
def _(spark, sf):
    rows = pii_rows(spark, sf)
    vault = V.token_vault(rows, salt=TOKEN_SALT)
    return rows.transform(V.tokenize_pii(salt=TOKEN_SALT)).transform(E.detokenize(vault, "email", "ssn")).select("doc_id", "email", "ssn")


KEY = "000102030405060708090a0b0c0d0e0f"


@query("encrypt_fields", f"WITH {PII} SELECT doc_id, true AS email_encrypted, phone IS NOT NULL AS phone_encrypted, true AS hidden, src_ip FROM pii")
def _(spark, sf):
    rows = pii_rows(spark, sf)
    sealed = rows.withColumn("plain", F.col("email")).transform(V.encrypt_fields(KEY))
    hidden = F.col("email").startswith("encrypted:") & ~F.col("email").contains("@") & (F.col("email") != F.col("plain"))
    return sealed.select("doc_id", "email_encrypted", "phone_encrypted", hidden.alias("hidden"), "src_ip")


@query("decrypt_fields", f"WITH {PII} SELECT doc_id, email, ssn, phone FROM pii")
def _(spark, sf):
    return pii_rows(spark, sf).transform(V.encrypt_fields(KEY)).transform(V.decrypt_fields(KEY)).select("doc_id", "email", "ssn", "phone")


# integrity ---------------------------------------------------------------
@query("hash_sign_verify", "SELECT doc_id, sha256(text) AS signature, doc_id % 9 <> 0 AS valid FROM documents")
def _(spark, sf):
    signed = table(spark, sf, "documents").transform(I.hash_sign("text"))
    tampered = signed.withColumn("text", F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return tampered.transform(I.hash_verify("text")).select("doc_id", "signature", "valid")


CHAIN = """rows_ AS (SELECT tenant, date_trunc('day', ts) AS day, row_number() OVER (PARTITION BY tenant, date_trunc('day', ts) ORDER BY ts, event_id) - 1 AS rn, concat(event_id, '|', message) AS d FROM sec),
 seg AS (SELECT tenant, day, rn // 50 AS segment, count(*) AS n, list(d ORDER BY rn) AS ds FROM rows_ GROUP BY 1, 2, 3)"""


@query(
    "hash_chain",
    W + f""", {CHAIN} SELECT tenant, strftime(day, '%Y-%m-%d') AS day, segment, n, list_reduce(ds[2:], lambda a, d: sha256(unhex(a) || encode(d)), sha256(ds[1])) AS head FROM seg""",
)
def _(spark, sf):
    e = sec_events(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    payload = F.concat(F.col("event_id").cast("string"), F.lit("|"), "message")
    return I.hash_chain(e, payload, ["tenant", "day"], ["ts", "event_id"], block=50).withColumn("n", F.col("n").cast("bigint"))


MERKLE = """WITH RECURSIVE sec0 AS (SELECT event_id, ts, concat(event_type, '-', strftime(ts, '%Y-%m-%dT%H:%M:%SZ')) AS leaf FROM events),
 t AS (SELECT 0 AS lvl, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, sha256(leaf) AS h, count(*) OVER () AS n FROM sec0
 UNION ALL SELECT a.lvl + 1, a.i // 2, sha256(unhex(a.h) || unhex(coalesce(b.h, a.h))), (a.n + 1) // 2 FROM t a LEFT JOIN t b ON b.i = a.i + 1 WHERE a.i % 2 = 0 AND a.n > 1)
 SELECT h AS root, (SELECT count(*) FROM events) AS leaves FROM t WHERE n = 1"""


@query("merkle_root", MERKLE)
def _(spark, sf):
    e = table(spark, sf, "events")
    leaf = F.concat("event_type", F.lit("-"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return I.merkle_root(e.select("event_id", "ts", "event_type"), leaf, ["ts", "event_id"])


@query("merkle_proofs", "SELECT event_id, true AS proven FROM events WHERE event_type = 'signup'")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", "event_type")
    leaf = F.concat("event_type", F.lit("-"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    root = I.merkle_root(e, leaf, ["ts", "event_id"]).select("root").scalar()
    proofs = I.merkle_proofs(e, leaf, ["ts", "event_id"], F.col("event_type") == "signup", levels=5)
    return proofs.select("event_id", (I.proof_root(F.col("h"), F.col("path")) == root).alias("proven"))


@query("merkle_ledger", MERKLE.replace("SELECT h AS root,", "SELECT h AS root, true AS grown,"))
def _(spark, sf):
    """The same root from thirty days appended in three parts, each proven to be the beginning of the whole."""
    e = table(spark, sf, "events").select("event_id", "ts", "event_type")
    leaf = F.concat("event_type", F.lit("-"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    ledger = J.Ledger(spark, new_path(spark, "ledger"), levels=6)
    roots = {}
    for k in range(3):
        part = e.where(F.floor((F.dayofmonth("ts") - 1) / 14) == k)
        n = ledger.append(part, leaf, ["ts", "event_id"], f"part{k}")
        roots[n] = ledger.root()
    whole = ledger.root()
    grown = all(J.begins(ledger.consistency(n), root, n, whole) for n, root in roots.items())
    return spark.createDataFrame([(whole, grown, n)], "root string, grown boolean, leaves bigint")


SECRET = b"shared-signing-secret"


def hmac_sql(message):
    key = SECRET.ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in key).hex() for pad in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


def _signed(spark, sf):
    e = sec_events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.transform(I.lineage_sign("ingestion", "receival", "node-1", SECRET, F.col("message"), F.col("ts")))
    return e.transform(I.lineage_sign("enrichment", "enforce", "node-1", SECRET, F.concat("message", "source"), F.col("ts")))


STAMP = "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"


@query(
    "lineage_sign",
    W + f"""SELECT event_id, 2 AS steps, sha256(message) AS hash1, {hmac_sql("'ingestion' || 'node-1' || " + STAMP + " || 'receival' || sha256(message)")} AS sig1,
    {hmac_sql("'enrichment' || 'node-1' || " + STAMP + " || 'enforce' || sha256(message || source)")} AS sig2 FROM sec""",
)
def _(spark, sf):
    first, second = F.get("lineage", 0), F.get("lineage", 1)
    return _signed(spark, sf).select("event_id", F.size("lineage").alias("steps"), first["data_hash"].alias("hash1"), first["signature"].alias("sig1"), second["signature"].alias("sig2"))


@query("lineage_verify", "SELECT event_id, event_id % 10 <> 3 AS lineage_valid FROM events")
def _(spark, sf):
    forged = F.transform("lineage", lambda s: s.withField("action", F.lit("forged")))
    e = _signed(spark, sf).withColumn("lineage", F.when(F.col("event_id") % 10 == 3, forged).otherwise(F.col("lineage")))
    return e.transform(I.lineage_verify(SECRET)).select("event_id", "lineage_valid")


@query(
    "policy_decide",
    W + """SELECT event_id, CASE WHEN tenant = 't1' AND direction = 'outbound' THEN 'P1' WHEN status <> 'success' THEN 'P2' END AS denied_by, NOT ((tenant = 't1' AND direction = 'outbound') OR status <> 'success') AS allowed FROM sec""",
)
def _(spark, sf):
    policies = [
        I.Policy("P0", "export", "allow"),
        I.Policy("P1", "export", "deny", (Condition("tenant", "eq", "t1"), Condition("direction", "eq", "outbound"))),
        I.Policy("P2", "export", "deny", (Condition("status", "neq", "success"),)),
        I.Policy("P3", "export", "deny", (Condition("no_such_field", "neq", "x"),)),
        I.Policy("P4", "delete", "deny"),
    ]
    return sec_events(spark, sf).transform(I.policy_decide(policies, "export")).select("event_id", "denied_by", "allowed")
