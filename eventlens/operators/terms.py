"""Many terms searched in free text at once, by an automaton of bounded size or by a bitmap and a join.

A term set whose characters are within `SHARD_CHARS` goes as an Aho-Corasick automaton to every task, where the texts are. Of a larger one
every task has a Bloom filter of bounded size: substrings as long as some term that it may hold meet the terms in an equality join, so
each text is read once, however many terms there are. Time grows with the number of different lengths of terms.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.functions.fields import field
from eventlens.operators.enrich import indicator_values
from eventlens.session import cut_lineage

# executors may lack this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHARD_CHARS = 2_000_000
SLICE_BYTES = 4 << 20
OUT_BYTES = 32 << 20
#: Bits of the filter: so many for each term, up to a limit; beyond it more substrings are joined in vain.
TERM_BITS, MOST_BITS, BLOCK_BITS = 32, 29, 16
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
PROBES = [np.uint64(n) for n in (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F)]


def automaton(terms: Iterable[str]) -> ahocorasick.Automaton | None:
    made = ahocorasick.Automaton()
    for term in terms:
        made.add_word(term, term)
    if not len(made):
        return None
    made.make_automaton()
    return made


def found_in(made: ahocorasick.Automaton | None, text: str | None) -> list[str]:
    """The different terms in a text, longest first, then by code point."""
    if made is None or not text:
        return []
    return sorted({term for _, term in made.iter(text)}, key=lambda t: (-len(t), t))


def contained(texts: DataFrame, terms: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Distinct pairs (text, term) in which the text contains the term; `texts` has the column text, `terms` the column term.

    Nulls and empty terms match nothing.
    """
    words = cut_lineage(terms.where("term is not null and term <> ''").select("term").distinct())
    return possible(texts, words, shard_chars).join(words, "term", "left_semi").select("text", "term")


def possible(texts: DataFrame, words: DataFrame, shard_chars: int) -> DataFrame:
    """Distinct pairs (text, substring) with all substrings that are among `words` (distinct, not empty), and perhaps others."""
    lines = texts.where("text is not null and text <> ''").select("text").distinct()
    n, chars = words.agg(F.count("*"), F.coalesce(F.sum(F.length("term")), F.lit(0))).first()
    if chars <= shard_chars:
        found = _finder([r.term for r in words.toLocalIterator()])
        return lines.select("text", F.explode(found("text")).alias("term"))
    lengths = sorted(r.n for r in words.select(F.octet_length("term").alias("n")).distinct().collect())
    power = min(MOST_BITS, max(BLOCK_BITS, (n * TERM_BITS - 1).bit_length()))
    shared = words.sparkSession.sparkContext.broadcast(bloom_filter(words, power))

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            yield from _substrings(batch.column(0), lengths, bits, power)

    return lines.mapInArrow(of_batches, "text string, term string")


def bloom_filter(words: DataFrame, power: int) -> bytes:
    """Filter of 2**power bits with all terms; its blocks are made in the tasks that get their bits."""
    size = 1 << (BLOCK_BITS - 3)

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _bytes_of(batch.column(0))
            total, back = _sums(data)
            at = np.unique(np.concatenate([_probe((total[offsets[1:]] - total[offsets[:-1]]) * back[offsets[:-1]], k, power) for k in range(len(PROBES))]))
            block, first = np.unique(at >> BLOCK_BITS, return_index=True)
            parts = [p.astype("<u4").tobytes() for p in np.split(at & ((1 << BLOCK_BITS) - 1), first[1:])] if len(at) else []
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(parts, pa.binary())], ["block", "bits"])

    def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = blocks.setdefault(block, np.zeros(size, np.uint8))
                at = np.frombuffer(places, "<u4")
                np.bitwise_or.at(own, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        for block, own in blocks.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([own.tobytes()], pa.binary())], ["block", "bits"])

    whole = bytearray(1 << (power - 3))
    for row in words.select("term").mapInArrow(placed, "block long, bits binary").repartition("block").mapInArrow(merged, "block long, bits binary").toLocalIterator():
        whole[row.block * size : (row.block + 1) * size] = row.bits
    return bytes(whole)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of bytes times powers, and inverse powers: (total[b] - total[a]) * back[a] depends on the bytes of [a, b) only."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * np.cumprod(np.full(len(data), BASE, np.uint64), dtype=np.uint64), out=total[1:])
    return total, np.cumprod(np.full(len(data) + 1, INVERSE, np.uint64), dtype=np.uint64)


def _probe(h: np.ndarray, k: int, power: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * PROBES[k]
    h = (h ^ (h >> np.uint64(29))) * BASE
    return (h >> np.uint64(64 - power)).astype(np.int64)


def _substrings(column: pa.Array, lengths: list[int], bits: np.ndarray, power: int) -> Iterator[pa.RecordBatch]:
    """Distinct (text, substring) whose substring passes the filter."""
    whole, offsets = _bytes_of(column)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE_BYTES, side="right")) - 1)
        data, ends = whole[offsets[a] : offsets[b]], offsets[a + 1 : b + 1] - offsets[a]
        size = np.diff(offsets[a : b + 1])
        total, back = _sums(data)
        left = np.repeat(ends, size) - np.arange(len(data))
        # substrings begin and end with characters
        begins = np.append((data & 0xC0) != 0x80, True)
        rows, found = [], []
        for length in lengths:
            at = np.nonzero(begins[:-1] & (left >= length))[0]
            if not len(at):
                break
            at = at[begins[at + length]]
            h = (total[at + length] - total[at]) * back[at]
            for k in range(len(PROBES)):
                place = _probe(h, k, power)
                hit = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
                at, h = at[hit], h[hit]
            text = data.tobytes() if len(at) else b""
            each = dict.fromkeys(zip(np.searchsorted(ends, at, side="right").tolist(), (text[p : p + length] for p in at.tolist()), strict=True))
            rows += [r for r, _ in each]
            found += [t for _, t in each]
        row = np.array(rows, np.int64)
        cut = np.searchsorted(np.cumsum(size[row]) // OUT_BYTES, np.arange(1 + size[row].sum() // OUT_BYTES)).tolist() + [len(row)]
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            if i < j:
                yield pa.RecordBatch.from_arrays([column.slice(a, b - a).take(pa.array(row[i:j])).cast(pa.string()), pa.array(found[i:j], pa.binary()).cast(pa.string())], ["text", "term"])
        a = b


def _finder(terms: list[str]):
    """A column function: the terms in a text, longest first."""
    made: list = []

    @F.arrow_udf("array<string>")
    def found(column: pa.Array) -> pa.Array:
        if not made:
            made.append(automaton(terms))
        return pa.array([found_in(made[0], t) for t in column.to_pylist()], pa.list_(pa.string()))

    return found


def _first_of(terms: list[str]):
    """A column function: of `terms`, the earliest one that a text holds."""
    made: list = []

    @F.arrow_udf("string")
    def first(column: pa.Array) -> pa.Array:
        if not made:
            found = ahocorasick.Automaton()
            for rank, term in enumerate(terms):
                found.add_word(term, rank)
            found.make_automaton()
            made.append(found)
        ranks = (min((rank for _, rank in made[0].iter(t)), default=None) if t else None for t in column.to_pylist())
        return pa.array([None if r is None else terms[r] for r in ranks], pa.string())

    return first


def values_of(indicators: DataFrame) -> DataFrame:
    return cut_lineage(indicator_values(indicators).where("value <> ''").select(F.col("value").alias("term"), F.col("id").alias("indicator_id"), F.col("severity").alias("indicator_severity")))


def match_text(indicators: DataFrame, name: str, how: str = "left", shard_chars: int = SHARD_CHARS):
    """Join events to the indicator whose quoted value their text holds (`left`, `inner`), or keep or drop such events (`semi`, `anti`).

    Of several values in a text the longest counts, of equally long ones that of the lowest indicator id. Case matters. Within `shard_chars` the values are
    searched where the events are, without a shuffle; beyond, substrings of distinct texts meet the values and come back by an equality join.
    """

    def apply(df: DataFrame) -> DataFrame:
        valued, text = values_of(indicators), field(df, name).cast("string")
        chars = valued.agg(F.coalesce(F.sum(F.length("term")), F.lit(0))).first()[0]
        if 0 < chars <= shard_chars:
            terms = [r.term for r in valued.orderBy(F.desc(F.length("term")), "indicator_id", "term").select("term").toLocalIterator()]
            found = df.withColumn("_t", _first_of(terms)(text))
            return found.join(valued.withColumnRenamed("term", "_v"), F.col("_t") == F.col("_v"), how).drop("_v", "_t")
        pairs = possible(df.select(text.alias("text")), valued.select("term"), shard_chars).join(valued, "term")
        best = pairs.groupBy("text").agg(F.min_by(F.struct("indicator_id", "indicator_severity"), F.struct(-F.length("term"), F.col("indicator_id"), F.col("term"))).alias("_i"))
        best = best.select(F.col("text").alias("_text"), "_i.*")
        return df.join(best, text == best["_text"], how).drop("_text")

    return apply


def match_all(indicators: DataFrame, name: str, shard_chars: int = SHARD_CHARS):
    """A row for each event and indicator whose value its text holds; of indicators with equal values the lowest id."""

    def apply(df: DataFrame) -> DataFrame:
        valued, text = values_of(indicators), field(df, name).cast("string")
        pairs = possible(df.select(text.alias("text")), valued.select("term"), shard_chars).join(valued, "term").select(F.col("text").alias("_text"), "indicator_id", "indicator_severity")
        return df.join(pairs, text == pairs["_text"]).drop("_text")

    return apply


def match_artifact(indicators: DataFrame, name: str, how: str = "left", shard_chars: int = SHARD_CHARS):
    """Join events to the lowest indicator whose pattern contains the field's value, wherever in it. Empty values match nothing."""

    def apply(df: DataFrame) -> DataFrame:
        value = field(df, name).cast("string")
        patterns = indicators.select(F.col("pattern").alias("text"), F.struct("id", "severity").alias("_i"))
        pairs = contained(patterns, df.select(value.alias("term")), shard_chars)
        first = pairs.join(patterns.groupBy("text").agg(F.min("_i").alias("_i")), "text").groupBy("term").agg(F.min("_i").alias("_i"))
        first = first.select(F.col("term").alias("_v"), F.col("_i.id").alias("indicator_id"), F.col("_i.severity").alias("indicator_severity"))
        return df.join(first, value == first["_v"], how).drop("_v")

    return apply
