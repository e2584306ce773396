"""The registered query of each operator, next to its SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm import anchor_codes, filter_audit, license_scan
from eventlens.llm.adaptive_scan import nearest
from eventlens.llm.common import held_out, table
from eventlens.llm.curriculum import plan_mix
from eventlens.llm.language_codes import identified, learned
from eventlens.llm.pieces import digests, encoded
from eventlens.llm import quality_machine, secret_forest
from eventlens.llm.simhash import simhash_groups
from eventlens.llm.suffix_dedup import removed
from eventlens.llm.token_files import round_trip
from eventlens.llm.weighted_sampling import edited_fingerprints

#: Vocabulary files are parameters; a worker opens them by this path.
PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


@query
def op4_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also the training positions (0 to 1) of a document's first and last copy, null where none is taken."""
    at = F.col("_mix.positions")
    mix = plan_mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mix.select("_row.doc_id", "_mix.size", "_mix.source_size", "_mix.target", "_mix.taken", F.get(at, F.lit(0)).alias("first_position"), F.get(at, F.size(at) - 1).alias("last_position"))


#: Where the integral of a schedule reaches a share of its whole; a heavy source's falls from 1.5 to 0.5, a middle one's is 1, a light one's rises from 0.25 by 0.75 to 2.25.
_CURRICULUM = """CASE rank % 3
  WHEN 0 THEN 0.0::DOUBLE + (sqrt(greatest(1.5::DOUBLE * 1.5 - 2 * share, 0)) - 1.5) / -1.0
  WHEN 1 THEN share
  ELSE CASE WHEN share <= 0.25 THEN sqrt(greatest(0.25::DOUBLE * 0.25 + 2 * share, 0)) - 0.25 ELSE 0.5::DOUBLE + (sqrt(greatest(0.75::DOUBLE * 0.75 + 6 * greatest(share - 0.25, 0), 0)) - 0.75) / 3.0 END END"""
ORACLES["op4_curriculum_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h, text FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source
), w AS (
  SELECT *, [5.0, 2.0, 1.0][(rank % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS top FROM s
), l AS (
  SELECT *, top / weight AS ratio,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(top) OVER (ORDER BY top / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY top / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), f AS (SELECT ratio AS fr, rank AS fk, level AS fl FROM l WHERE ratio > level ORDER BY ratio, rank LIMIT 1),
t AS (
  SELECT source, source_size, rank, CASE WHEN fl IS NOT NULL AND (ratio > fr OR ratio = fr AND rank >= fk) THEN weight * fl ELSE top END AS target
  FROM l LEFT JOIN f ON true
), o AS (
  SELECT d.doc_id, size, source_size, target, rank,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, size = 0 OR start + size / 2.0::DOUBLE <= target AS once, size > 0 AND start + source_size + size / 2.0::DOUBLE <= target AS twice,
    CASE WHEN target > 0 THEN least((start + source_size * 0.0::DOUBLE) / target, 1.0::DOUBLE) ELSE 0.0::DOUBLE END AS a, CASE WHEN target > 0 THEN least((start + source_size::DOUBLE) / target, 1.0::DOUBLE) ELSE 0.0::DOUBLE END AS b FROM o
), p AS (SELECT *, {at_a} AS pa, {at_b} AS pb FROM c)
SELECT doc_id, size, source_size, target,
  (size * (once::INT + twice::INT))::BIGINT AS taken,
  CASE WHEN once THEN pa WHEN twice THEN pb END AS first_position, CASE WHEN twice THEN pb WHEN once THEN pa END AS last_position
FROM p
""".replace("{at_a}", _CURRICULUM.replace("share", "a")).replace("{at_b}", _CURRICULUM.replace("share", "b"))


@query
def op9_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


@query
def op10_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


@query
def op7_piece_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encoded(table(spark, sf_dir, "documents"), PIECES))


@query
def op2_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identified(docs, learned(docs))


@query
def op3_quality_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_machine.learned(docs, table(spark, sf_dir, "labels"))
    return quality_machine.scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query
def op6_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_candidates, n_secrets, their byte spans, and the hash of the text without them."""
    docs = table(spark, sf_dir, "documents")
    return secret_forest.scanned(docs, secret_forest.learned(docs)).select(
        "doc_id",
        "n_candidates",
        F.size("secrets").cast("long").alias("n_secrets"),
        F.array_join(F.transform("secrets", lambda s: F.concat_ws("-", s["start"], s["end"])), ",").alias("spans"),
        F.sha2(F.coalesce("clean_text", F.lit("")).cast("binary"), 256).alias("clean_sha256"),
    )


@query
def op5_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op8_huffman_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), BYTES).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op11_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(license_scan.scanned(table(spark, sf_dir, "documents")))


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("filter")


ORACLES["op12_filter_audit"] = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false)::INT AS good, coalesce(toxic, false)::INT AS toxic, [
    len(words) < 100,
    100 * len(list_distinct(words)) < 80 * len(words),
    100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text),
    regexp_matches(text, '[#$%&*|]'),
    coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false)
  ] AS fails FROM w LEFT JOIN l ON w.doc_id = l.doc_id
),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
n AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS ord FROM n a, n b, n c, n d, n e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
),
s AS (SELECT ord, n.i AS step, ord[n.i] AS filter, ord[1 : n.i - 1] AS before FROM o, n),
r AS (
  SELECT part, ord, step, filter,
    sum(CASE WHEN NOT fails[filter] AND NOT gone THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN fails[filter] AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails[filter] AND gone THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails[filter] AND len(list_filter(fails, lambda x: x)) = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails[filter] AND NOT gone THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN fails[filter] AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM (SELECT *, len(list_filter(before, lambda x: fails[x])) > 0 AS gone FROM g, s) GROUP BY part, ord, step, filter
)
SELECT part, array_to_string(list_transform(ord, lambda x: 'ABCDE'[x]), '') AS filter_order, step::INTEGER AS step,
  kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM r
"""


@query
def op13_anchor_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = anchor_codes.compressed(table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(anchor_codes.digest(books)).alias("codebooks_sha256"))


_MOVED = """(
  SELECT b.p, b.j, coalesce(m.c, b.c) AS c FROM {books} b LEFT JOIN (
    SELECT p, j, list(floor(t / n)::BIGINT ORDER BY i) AS c FROM (
      SELECT p, a.j AS j, i, sum(v[i])::DOUBLE AS t, count(*) AS n FROM {assigned}, unnest(range(1, len(v) + 1)) u(i) GROUP BY ALL
    ) GROUP BY p, j
  ) m ON b.p = m.p AND b.j = m.j
)"""
_ASSIGNED = """(
  SELECT row, s.p, any_value(v) AS v, min({{'d': list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i]))), 'j': j}}) AS a
  FROM s JOIN {books} b ON s.p = b.p GROUP BY row, s.p
)"""
ORACLES["op13_anchor_codes"] = f"""
WITH k AS (
  SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) AS row FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT row, p, list_transform(embedding[p * (len(embedding) // 16) + 1 : (p + 1) * (len(embedding) // 16)], lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM k, unnest(range(16)) u(p)
), b0 AS (SELECT p, row - 1 AS j, v AS c FROM s WHERE row <= 64),
a0 AS {_ASSIGNED.format(books="b0")},
b1 AS {_MOVED.format(books="b0", assigned="a0")},
a1 AS {_ASSIGNED.format(books="b1")},
b2 AS {_MOVED.format(books="b1", assigned="a1")},
a2 AS {_ASSIGNED.format(books="b2")},
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, j)) AS codebooks_sha256 FROM b2),
e AS (SELECT row, string_agg(printf('%02x', a.j), '' ORDER BY p) AS code, sum(a.d)::BIGINT AS error FROM a2 GROUP BY row)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM k JOIN e ON k.row = e.row, h
"""
