"""Posting lists by block: which rows of a block hold a token, as a bitmap or, where few do, as a list.

Rows are numbered and cut into blocks of `BLOCK`. The index has one row per token and block, so a boolean query moves a row for each of its
tokens and each block, not one for each row that holds a token. Blocks are combined apart from each other, by AND, OR and NOT on bitmaps, and
only the numbers of rows that are left are turned into keys.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.functions.ordered import ordinal
from eventlens.operators.search import STOP_WORDS, tokens

# executors may lack this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 32_768
#: A list of two bytes a row is smaller than a bitmap of a bit a row up to here.
SPARSE = BLOCK // 16
#: The token of all rows of a block.
ALL = ""


def bitmap_of(places: np.ndarray) -> np.ndarray:
    bits = np.zeros(BLOCK, bool)
    bits[places] = True
    return np.packbits(bits)


def numbered(df: DataFrame, key: str, body: str) -> DataFrame:
    """block, place, key and body of every row, in the order of the key."""
    placed = ordinal(df.select(F.col(key).alias("key"), F.col(body).cast("string").alias("body")), [], ["key"], "_n")
    return placed.select(F.floor((F.col("_n") - 1) / BLOCK).alias("block"), ((F.col("_n") - 1) % BLOCK).cast("int").alias("place"), "key", "body")


def posting_lists(rows: DataFrame) -> DataFrame:
    """token, block, n and either `gaps` or `bits` of `numbered` rows; the token `ALL` stands for every row. A group is a block at most.

    Gaps are the steps from one place to the next, small numbers that Parquet packs well.
    """

    @F.arrow_udf("binary")
    def packed(places: pa.Array) -> pa.Array:
        return pa.array([None if p is None else bitmap_of(np.array(p)).tobytes() for p in places.to_pylist()], pa.binary())

    each = rows.select("block", "place", F.explode(F.concat(F.array(F.lit(ALL)), F.coalesce(tokens(F.col("body")), F.array().cast("array<string>")))).alias("token"))
    lists = each.groupBy("token", "block").agg(F.sort_array(F.collect_list(F.col("place").cast("int"))).alias("_p"))
    dense = F.size("_p") > SPARSE
    gaps = F.transform("_p", lambda p, i: (p - F.coalesce(F.get("_p", i - 1), F.lit(0))).cast("smallint"))
    return lists.select("token", "block", F.size("_p").alias("n"), F.when(~dense, gaps).alias("gaps"), packed(F.when(dense, F.col("_p"))).alias("bits"))


def write_postings(df: DataFrame, key: str, body: str, path: str) -> None:
    """Store the index of `df`: `postings`, ordered by token with Bloom filters, and `rows`, the keys by number. `key` must be unique."""
    rows_path = f"{path}/rows"
    numbered(df, key, body).write.mode("overwrite").parquet(rows_path)
    rows = df.sparkSession.read.parquet(rows_path)
    placed = posting_lists(rows).repartitionByRange("token", "block").sortWithinPartitions("token", "block")
    placed.write.mode("overwrite").option("parquet.bloom.filter.enabled#token", "true").parquet(f"{path}/postings")


Query = str | tuple


def words_of(query: Query) -> list[str]:
    """The tokens of a query: a text, all of whose tokens must occur, or ("and" | "or" | "not", query, ...)."""
    if isinstance(query, str):
        found = "".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split()
        return [w for w in dict.fromkeys(found) if len(w) >= 2 and w not in STOP_WORDS]
    if query[0] not in ("and", "or", "not") or (query[0] == "not") != (len(query) == 2):
        raise ValueError(f"not a query: {query!r}")
    return list(dict.fromkeys(w for part in query[1:] for w in words_of(part)))


def evaluated(query: Query, held: dict[str, np.ndarray]) -> np.ndarray:
    """Bitmap of the rows of a block that satisfy the query; `held` has the bitmaps of its tokens and of `ALL`."""
    none = np.zeros(BLOCK // 8, np.uint8)
    if isinstance(query, str):
        return reduce(np.bitwise_and, [held.get(w, none) for w in words_of(query)], held[ALL])
    parts = [evaluated(q, held) for q in query[1:]]
    if query[0] == "not":
        return held[ALL] & ~parts[0]
    return reduce(np.bitwise_and if query[0] == "and" else np.bitwise_or, parts)


def matching_rows(postings: DataFrame, query: Query) -> DataFrame:
    """block and place of the rows that satisfy the query; a text without tokens is satisfied by all."""
    wanted = [*words_of(query), ALL]

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}

        def done() -> Iterator[pa.RecordBatch]:
            if at is not None and ALL in held:
                places = np.nonzero(np.unpackbits(evaluated(query, held)))[0].astype(np.int32)
                if len(places):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), at)), pa.array(places)], ["block", "place"])

        for batch in batches:
            for token, block, gaps, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != at:
                    yield from done()
                    at, held = block, {}
                held[token] = bitmap_of(np.cumsum(np.array(gaps, np.int64))) if bits is None else np.frombuffer(bits, np.uint8)
        yield from done()

    chosen = postings.where(F.col("token").isin(wanted)).select("token", "block", "gaps", "bits")
    return chosen.repartition("block").sortWithinPartitions("block").mapInArrow(of_batches, "block long, place int")


def search_postings(spark: SparkSession, path: str, query: Query) -> DataFrame:
    """Keys of the rows that satisfy a boolean query, from a stored index; texts are not read."""
    found = matching_rows(spark.read.parquet(f"{path}/postings"), query)
    return spark.read.parquet(f"{path}/rows").select("block", "place", "key").join(found, ["block", "place"], "left_semi").select("key")
