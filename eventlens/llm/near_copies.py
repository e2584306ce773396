"""One text of each group of near copies: SimHash finds pairs, exact shingle sets confirm them.

Texts with the same set of word shingles are one class. A Jaccard similarity of `LIKE` needs set sizes that differ by
at most 1 / `LIKE`, so classes are dealt by the logarithm of their set's size, and a piece meets only pieces of its own
and the next size. Inside, numpy compares fingerprints of 128 bits, skipping blocks whose bit counts differ by more than the
radius. Only classes with a candidate in a meeting of two pieces go on, each with its shingle set, to a task of that meeting, which compares
the sets of all candidate pairs not yet connected there. A meeting returns a spanning forest of the links that hold, so rows grow with
the classes that have candidates, never with their pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import stored, texts
from eventlens.llm.components import connected
from eventlens.llm.simhash import SHINGLES

WORDS = 5
LIKE = (4, 5)
#: At similarity 0.8 a bit differs with probability 0.15 to 0.19: 20 to 24 bits of 128 on average, 10 to 12 of the first 64.
RADIUS, RADIUS_64 = 36, 20
PIECE, HASHES = 4_096, 4_000_000
ROWS = 256
#: A little above 5 / 4, so that rounding never puts similar sizes two steps apart.
STEP = math.log(LIKE[1] / LIKE[0]) * (1 + 1e-6)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the different lower-cased word shingles of a text; with fewer words, of the whole sequence."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    k = min(words, len(found))
    first, last = starts[: len(found) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(first, last, strict=True)), np.uint64, len(first)))


def simhash128(hashes: np.ndarray) -> tuple[int, int]:
    """SimHash of a set of hashes as two signed longs; the second takes its bits from the hashes mixed again."""
    out = []
    for second in (False, True):
        counts = np.zeros(64, np.int64)
        for i in range(0, len(hashes), SHINGLES):
            h = hashes[i : i + SHINGLES]
            if second:
                h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                h = h ^ (h >> np.uint64(31))
            counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0]))
    return out[0], out[1]


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, `tie` (hash of the text), `s` (hash of the shingle set), its size `n` and SimHash (`fp`, `fp2`) of every row."""

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.zeros((4, batch.num_rows), np.int64)
            for i, t in enumerate(texts(batch.column(2))):
                found = shingles(t)
                made[:, i] = (np.uint64(xxhash.xxh64_intdigest(found.tobytes())).view(np.int64), len(found), *simhash128(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, made)], ["doc_id", "tie", "s", "n", "fp", "fp2"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tie"), F.col("text").cast("string"))
    return rows.mapInArrow(of_batches, "doc_id long, tie long, s long, n long, fp long, fp2 long")


def _near(a: list[np.ndarray], b: list[np.ndarray], same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates (places in a, places in b) of two pieces with columns fp and fp2, by blocks of a."""
    bits_a, bits_b = (np.bitwise_count(x[0]).astype(np.int16) + np.bitwise_count(x[1]) for x in (a, b))
    order, column = np.argsort(bits_a, kind="stable"), np.argsort(bits_b, kind="stable")
    sorted_b = bits_b[column]
    for i in range(0, len(order), ROWS):
        row = order[i : i + ROWS]
        # counts that differ by more than the radius can't be near
        lo, hi = np.searchsorted(sorted_b, bits_a[row[0]] - RADIUS), np.searchsorted(sorted_b, bits_a[row[-1]] + RADIUS, side="right")
        near = column[lo:hi]
        r, c = np.nonzero(np.bitwise_count(a[0][row][:, None] ^ b[0][near][None, :]) <= RADIUS_64)
        r, c = row[r], near[c]
        good = np.bitwise_count(a[0][r] ^ b[0][c]) + np.bitwise_count(a[1][r] ^ b[1][c]) <= RADIUS
        if same:
            good &= r < c
        if good.any():
            yield r[good], c[good]


def meetings(classes: DataFrame) -> DataFrame:
    """A row for each class (`s`) that has a candidate in a meeting of two pieces: the meeting, the class's fingerprint and its place there.

    `classes` has s, n, fp, fp2. Fewer than four shingles can't be similar to another set. A piece has `PIECE` classes and `HASHES` shingles at most,
    about; the table of pieces has one row for each step of size.
    """
    sized = classes.where("n >= 4").withColumn("step", F.floor(F.log("n") / STEP).cast("int"))
    counts = sized.groupBy("step").agg(F.greatest(F.ceil(F.count("*") / PIECE), F.ceil(F.sum("n") / HASHES)).cast("int").alias("pieces"))
    pieces = stored(
        sized.join(F.broadcast(counts), "step")
        .groupBy("step", F.pmod(F.xxhash64("s"), F.col("pieces")).cast("int").alias("piece"))
        .agg(F.collect_list(F.struct("s", "fp", "fp2")).alias("m"))
        .select("step", "piece", *[F.col("m")[c].alias(c) for c in ("s", "fp", "fp2")]),
        "pieces",
    )
    a = pieces.select(*[F.col(c).alias(f"{c}_a") for c in pieces.columns], F.explode(F.array(F.col("step"), F.col("step") + 1)).alias("step"))
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = a.join(pieces, "step").where("step > step_a OR piece >= piece_a")
    met = met.select(F.xxhash64("step_a", "piece_a", "step", "piece").alias("meeting"), (F.col("step") == F.col("step_a")).__and__(F.col("piece") == F.col("piece_a")).alias("same"), *[F.col(c + e) for e in ("_a", "") for c in ("s", "fp", "fp2")])

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                got = [batch.column(j)[k].values.to_numpy() for j in range(2, 8)]
                bits = [got[j].view(np.uint64) for j in (1, 2, 4, 5)]  # numpy counts the bits of a signed number's absolute value
                same = batch.column(1)[k].as_py()
                hit = np.zeros(len(got[0]), bool), np.zeros(len(got[3]), bool)
                for r, c in _near(bits[:2], bits[2:], same):
                    hit[0][r], hit[1][c] = True, True
                if same:
                    hit = hit[0] | hit[1], np.zeros(len(got[3]), bool)
                side = np.repeat([0, 1], [hit[0].sum(), hit[1].sum()])
                if len(side):
                    columns = [np.concatenate((got[j][hit[0]], got[j + 3][hit[1]])) for j in range(3)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(side), batch.column(0)[k].as_py()), np.where(same, 2, side), *columns)], ["meeting", "side", "s", "fp", "fp2"])

    return stored(met.repartition(parts).mapInArrow(of_batches, "meeting long, side long, s long, fp long, fp2 long"), "meetings")


def shingle_sets(wanted: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """s and `hashes` (sorted, 8 bytes each) of the classes whose `s` is in `wanted`, made from one text of each."""
    first = classes.join(wanted.select("s").distinct(), "s", "left_semi").select("s", F.col("first.doc_id").alias("id"), F.col("first.tie").alias("_t"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text").cast("string").alias("text"))
    found = rows.join(first, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tie") == F.col("_t")))

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t).tobytes() for t in texts(batch.column(1))], pa.binary())], ["s", "hashes"])

    made = found.select("s", "text").mapInArrow(of_batches, "s long, hashes binary")
    return stored(made.groupBy("s").agg(F.min("hashes").alias("hashes")), "sets")


def linked(s: np.ndarray, bits: list[np.ndarray], side: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the candidate pairs of a meeting whose sets are similar."""
    a, b = (np.nonzero(side != 1)[0], np.nonzero(side != 0)[0])
    pairs = [(a[r], b[c]) for r, c in _near([x[a] for x in bits], [x[b] for x in bits], bool(side[0] == 2))]
    if not pairs:
        return s[:0], s[:0]
    left, right = (np.concatenate(x) for x in zip(*pairs, strict=True))
    by = np.argsort(left, kind="stable")
    left, right = left[by], right[by]
    # a hash that only one set holds is in no intersection
    every, count = np.unique(np.concatenate(sets), return_counts=True)
    size = np.array(list(map(len, sets)))
    common = [(at := np.searchsorted(every, x))[count[at] > 1] for x in sets]
    flat, length = np.concatenate(common), np.array(list(map(len, common)))
    start = np.cumsum(length) - length
    held = np.zeros(len(every), bool)
    root = np.arange(len(s))
    out: list[tuple[int, int]] = []
    cuts = np.concatenate(([0], np.nonzero(np.diff(left))[0] + 1, [len(left)]))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        i = int(left[lo])
        held[common[i]] = True
        for at in range(lo, hi, ROWS):
            others = right[at : min(at + ROWS, hi)]
            others = others[root[others] != root[i]]
            if not len(others):
                continue
            n = length[others]
            where = np.repeat(np.arange(len(others)), n)
            place = np.arange(len(where)) + np.repeat(start[others] - (np.cumsum(n) - n), n)
            both = np.bincount(where[held[flat[place]]], minlength=len(others))
            for j in others[LIKE[1] * both >= LIKE[0] * (size[i] + size[others] - both)].tolist():
                if root[i] != root[j]:
                    out.append((i, j))
                    root[root == root[j]] = root[i]
        held[common[i]] = False
    pair = np.array(out, np.int64).reshape(-1, 2)
    return s[pair[:, 0]], s[pair[:, 1]]


def links(met: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of `s` that connect all candidates of similarity LIKE or more; a task holds the sets of one meeting at a time."""
    rows = met.join(sets, "s").select("meeting", "side", "s", "fp", "fp2", "hashes")

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                side, s, fp, fp2 = (np.array([h[j] for h in held], np.int64) for j in range(1, 5))
                pair = linked(s, [fp.view(np.uint64), fp2.view(np.uint64)], side, [np.frombuffer(h[5], np.uint64) for h in held])
                held.clear()
                if len(pair[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in pair], ["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    yield from done()
                held.append(row)
        yield from done()

    return stored(rows.repartition("meeting").sortWithinPartitions("meeting", "s").mapInArrow(of_batches, "a long, b long"), "links")


def first_of_each(docs: DataFrame) -> DataFrame:
    """doc_id and `tie` (xxhash64 of the text) of one row of each group: the smallest doc_id, null ids last.

    A group is what pairs of similarity LIKE or more connect. Texts without words are one group.
    """
    made = stored(sketches(docs), "sketches")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    classes = stored(made.groupBy("s").agg(F.min("n").alias("n"), F.min("fp").alias("fp"), F.min("fp2").alias("fp2"), F.min(order).alias("first")), "classes")
    met = meetings(classes)
    roots = connected(links(met, shingle_sets(met, docs, classes)))
    rooted = classes.join(roots, F.col("s") == F.col("node"), "left").withColumn("root", F.coalesce("root", "s"))
    return rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.tie")
