"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text is a multiset of words; a word's weight is its count. For each sample k and word, a hash
of both gives r and c from Gamma(2, 1) and b uniform in (0, 1); with t = floor(ln(weight) / r + b) the word
scores ln(c) - r * (t - b + 1), and the least score of the text is its sample k. Two texts have the
same sample with a probability that equals their generalised Jaccard similarity, the sum of
lesser weights over the sum of greater ones. A score tells word and t, so it stands for both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 32
RANGES = 128
RANGE_ROWS = 1_000
MAX_STEPS = 1_024
ODD = 0x9E3779B97F4A7C15
HALF = 1 << 32


def _constant(n: int) -> Column:
    x = n * ODD % (1 << 64)
    return F.lit(x - (1 << 64) if x >= 1 << 63 else x)


def _gamma(h: Column) -> Column:
    """Gamma(2, 1) from the two halves of a 64-bit hash."""
    high, low = F.shiftrightunsigned(h, 32) + F.lit(0.5), h.bitwiseAND(F.lit(HALF - 1)) + F.lit(0.5)
    return -F.log(high * low * F.lit(1.0 / HALF / HALF))


def _score(term: Column, log_weight: Column, k: int) -> Column:
    r = _gamma(F.xxhash64(term.bitwiseXOR(_constant(3 * k + 1))))
    c = _gamma(F.xxhash64(term.bitwiseXOR(_constant(3 * k + 2))))
    b = (F.shiftrightunsigned(F.xxhash64(term.bitwiseXOR(_constant(3 * k + 3))), 32) + F.lit(0.5)) * F.lit(1.0 / HALF)
    return F.log(c) - r * (F.floor(log_weight / r + b).cast("double") - b + 1)


def weighted_terms(text: Column) -> tuple[Column, Column]:
    """Sorted word hashes, and the places in them (from 1) where another word begins."""
    words = F.sort_array(F.transform(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w)))
    starts = F.filter(F.sequence(F.lit(1), F.size("_words")), lambda i: (i == 1) | (F.element_at("_words", i) != F.get("_words", i - 2)))
    return words, starts


def signatures(rows: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """`keys` and `signature` (int array, null where a text has no word) for each row's `text`.

    Rows stay where `keys` place them: if they are already partitioned by a column of `keys`, nothing is shuffled.
    """
    words, starts = weighted_terms(F.col("text"))
    terms = (
        rows.select(*keys, words.alias("_words"))
        .select(*keys, "_words", F.when(F.size("_words") > 0, starts).otherwise(F.array().cast("array<int>")).alias("_starts"))
        .select(
            *keys,
            F.explode_outer(
                F.transform(
                    "_starts",
                    lambda s, j: F.struct(
                        F.element_at("_words", s).alias("term"),
                        (F.coalesce(F.get("_starts", j + 1), F.size("_words") + 1) - s).alias("weight"),
                    ),
                )
            ).alias("_t"),
        )
        .select(*keys, F.col("_t.term").alias("_term"), F.log("_t.weight").alias("_log"))
    )
    scored = terms.groupBy(*keys).agg(*[F.min(_score(F.col("_term"), F.col("_log"), k)).alias(f"_s{k}") for k in range(samples)])
    each = [F.when(F.col(f"_s{k}").isNotNull(), F.xxhash64(f"_s{k}").bitwiseAND(F.lit(HALF - 1)) - F.lit(HALF >> 1)).cast("int") for k in range(samples)]
    return scored.select(*keys, F.array(*each).alias("signature"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; two texts without words are alike."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x.eqNullSafe(y), 1).otherwise(0)), F.lit(0), lambda n, x: n + x) / F.size(a)


def as_text(signature: Column) -> Column:
    """Eight hex digits for each sample; x marks a text without words."""
    return F.concat_ws("", F.transform(signature, lambda x: F.coalesce(F.lower(F.lpad(F.hex(x.cast("long") + F.lit(HALF >> 1)), 8, "0")), F.lit("xxxxxxxx"))))


def in_ranges(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`docs` with `bucket`, which rises with doc_id, and the first doc_id of each bucket.

    Quantiles of doc_id, cut further in even steps, bound the buckets; RANGES * MAX_STEPS + 2 at most.
    """
    found = docs.agg(F.percentile_approx("doc_id", [i / RANGES for i in range(RANGES + 1)], 10_000), F.count("*")).first()
    splits = sorted(set(found[0] or [0]))
    steps = max(1, min(MAX_STEPS, found[1] // (RANGES * RANGE_ROWS)))
    bounds = F.array(*[F.lit(s).cast("long") for s in splits])
    i = F.size(F.filter(bounds, lambda s: s <= F.col("doc_id")))
    low, high = F.get(bounds, F.col("_i") - 1).cast("double"), F.get(bounds, F.col("_i")).cast("double")
    step = F.least(F.floor((F.col("doc_id").cast("double") - low) * steps / (high - low)), F.lit(steps - 1))
    placed = docs.withColumn("_i", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(i)).withColumn("bucket", F.col("_i").cast("long") * steps + F.coalesce(step, F.lit(0))).drop("_i")
    return placed, placed.groupBy("bucket").agg(F.min("doc_id").alias("doc_id"))


def edited_fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose later half comes from the next document.

    The last floor(n_chars / 2) code points are replaced by the first as many (or all) of the next text by
    doc_id; after the last comes the first, and a single document follows itself. Null texts are
    empty. Null ids come first; rows with the same id stand by the text's hash. Repeated rows are
    rows like others. Further columns are ignored. An empty table gives no rows.

    One shuffle carries the texts, to ranges of doc_id. Each range also gets the first document of the
    next one, so that everything else, the next document's fingerprint too, happens inside a range.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    placed, firsts = in_ranges(plain)
    around = Window.partitionBy(F.lit(0)).orderBy("bucket")
    ahead = firsts.select("doc_id", F.coalesce(F.lag("bucket").over(around), F.max("bucket").over(Window.partitionBy(F.lit(0)))).alias("bucket"))
    guests = (
        plain.withColumnRenamed("doc_id", "id")
        .join(F.broadcast(ahead), F.col("id").eqNullSafe(F.col("doc_id")))
        .groupBy("bucket")
        .agg(F.min(F.struct("tie", "text")).alias("_f"))
        .select(F.lit(None).cast("long").alias("doc_id"), F.col("_f.text").alias("text"), F.lit(0).cast("long").alias("tie"), "bucket", F.lit(1).alias("guest"))
    )
    order = Window.partitionBy("bucket").orderBy("guest", "doc_id", "tie")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    keys = ["bucket", "place", "which", "doc_id", "n_chars", "edited_sha256"]
    versions = F.when(F.col("guest") == 0, F.array(F.struct(F.lit(0).alias("which"), "text"), F.struct(F.lit(1).alias("which"), F.col("_edited").alias("text"))))
    lined = (
        placed.withColumn("guest", F.lit(0))
        .unionByName(guests)
        .select("bucket", "guest", "doc_id", "text", n.cast("long").alias("n_chars"), F.row_number().over(order).alias("place"), F.lead("text", 1, "").over(order).alias("_next"))
        .withColumn("_edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("_next", F.lit(1), half)))
        .withColumn("edited_sha256", F.sha2(F.col("_edited").cast("binary"), 256))
        .withColumn("_v", F.explode(versions.otherwise(F.array(F.struct(F.lit(2).alias("which"), "text")))))
        .select("bucket", "place", "doc_id", "n_chars", "edited_sha256", "_v.which", "_v.text")
    )
    # in each bucket: a text, its edited text, the next text, ...; last the guest, marked 2
    along = Window.partitionBy("bucket").orderBy("place", "which")
    signed = signatures(lined, keys, samples).select(*keys, "signature", F.lead("signature", 1).over(along).alias("_edited"), F.lead("signature", 2).over(along).alias("_next"))
    return signed.where("which = 0").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("signature")).alias("fingerprint"),
        as_text(F.col("_edited")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("_edited")).alias("near_edited"),
        likeness(F.col("signature"), F.col("_next")).alias("near_next"),
    )
