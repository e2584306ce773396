"""Near-duplicate groups by SimHash: tiled exact comparison of fingerprints.

Equal fingerprints are one class before anything is compared. Classes are dealt into tiles by
the population counts of the fingerprint's parts. Two fingerprints that differ in r bits have
counts that differ by r at most in sum, so a tile meets only the tiles within that distance; all
other pairs of tiles are skipped unseen. A tile above `TILE` members is split by hash, and each
pair of pieces is compared once, in the task of one of them, by exclusive-or and bit counts in
numpy. A task returns a spanning forest of the links it finds, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import stored, texts
from eventlens.llm.components import connected

TILE = 32_768
ROWS, COLUMNS = 128, 2_048
SHINGLES = 65_536


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash of the lower-cased word shingles of a text, as an unsigned 64-bit integer.

    Fewer words than a shingle has: the whole sequence is the only shingle. No word: 0.
    """
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    k = min(words, len(found))
    first, last = starts[: len(found) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist()
    counts = np.zeros(64, np.int64)
    for i in range(0, len(first), SHINGLES):
        hashes = [xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(first[i : i + SHINGLES], last[i : i + SHINGLES], strict=True)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(first), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and `fp`, the SimHash as a signed long, of every row; other columns are ignored."""

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((fingerprint(t, words) for t in texts(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(of_batches, "doc_id long, fp long")


def star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes as (a, b), at most one for each node."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != label[label]).any():
            label = label[label]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _ordered(values: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values in the order of their bytes' bit counts, with the least and the largest counts of each block."""
    counts = np.bitwise_count(values.view(np.uint8).reshape(-1, 8)).astype(np.int16)
    order = np.lexsort(counts.T[::-1])
    values, counts = values[order], counts[order]
    cuts = np.arange(0, len(values), step)
    return values, np.minimum.reduceat(counts, cuts), np.maximum.reduceat(counts, cuts)


def links(home: np.ndarray, visitors: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles, or inside one (visitors: None).

    Blocks of a tile pair whose bit counts by byte differ by more than the radius are skipped too.
    """
    found_a, found_b = [], []
    rows, lo, hi = _ordered(home, ROWS)
    columns, lo_v, hi_v = _ordered(home if visitors is None else visitors, COLUMNS)
    for i in range(len(lo)):
        apart = np.maximum(0, np.maximum(lo[i] - hi_v, lo_v - hi[i])).sum(axis=1)
        x = rows[i * ROWS : (i + 1) * ROWS]
        for j in np.nonzero(apart <= radius)[0].tolist():
            y = columns[j * COLUMNS : (j + 1) * COLUMNS]
            near = np.bitwise_count(x[:, None] ^ y[None, :]) <= radius
            if visitors is None:
                near &= x[:, None] < y[None, :]
            if near.any():
                r, c = np.nonzero(near)
                a, b = star(x[r], y[c])
                found_a.append(a)
                found_b.append(b)
    if not found_a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return star(np.concatenate(found_a), np.concatenate(found_b))


def near(classes: DataFrame, radius: int, parts: int) -> DataFrame:
    """Links (a, b) that connect every pair of different `fp` of `classes` within `radius` bits.

    The table of tile sizes has (64 / parts + 1) ** parts rows at most, whatever the input
    (83,521 for four parts), which bounds its broadcast.
    """
    width, base = 64 // parts, 128
    key = sum(F.bit_count(F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit((1 << width) - 1))).cast("long") * base**i for i in range(parts)) if parts > 1 else F.bit_count("fp").cast("long")
    keyed = classes.select("fp", key.alias("tile"))
    sizes = keyed.groupBy("tile").agg(F.ceil(F.count("*") / TILE).cast("int").alias("pieces"))
    tiles = (
        keyed.join(F.broadcast(sizes), "tile")
        .withColumn("piece", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int"))
        .groupBy("tile", "piece")
        .agg(F.collect_list("fp").alias("members"))
    )
    steps = sorted({s for d in product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, d)) <= radius and (s := sum(x * base**i for i, x in enumerate(d))) >= 0})
    met = (
        tiles.select("tile", "piece", "members", F.explode(F.array(*[F.lit(s) for s in steps])).alias("step"))
        .withColumn("to", F.col("tile") + F.col("step"))
        .join(F.broadcast(sizes.withColumnRenamed("tile", "to").withColumnRenamed("pieces", "to_pieces")), "to")
        .withColumn("to_piece", F.explode(F.sequence(F.lit(0), F.col("to_pieces") - 1)))
        .where((F.col("step") > 0) | (F.col("to_piece") >= F.col("piece")))
        .select("to", "to_piece", ((F.col("step") == 0) & (F.col("to_piece") == F.col("piece"))).alias("home"), "members")
    )

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, home = None, np.zeros(0, np.uint64)
        for batch in batches:
            keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)])
            first = batch.column(2).to_numpy(zero_copy_only=False)
            members = batch.column(3)
            offsets = members.offsets.to_numpy().astype(np.int64)
            values = members.values.to_numpy().view(np.uint64)
            cuts = np.nonzero(np.any(keys[:, 1:] != keys[:, :-1], axis=0))[0] + 1
            a_all, b_all = [], []
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), keys.shape[1]], strict=True):
                here = (int(keys[0, s]), int(keys[1, s]))
                if first[s]:
                    at, home = here, values[offsets[s] : offsets[s + 1]].copy()
                    found = links(home, None, radius)
                    a_all.append(found[0])
                    b_all.append(found[1])
                    s += 1
                if s < e and at == here:  # a piece that no fingerprint fell into has no home row
                    found = links(home, values[offsets[s] : offsets[e]], radius)
                    a_all.append(found[0])
                    b_all.append(found[1])
            if a_all and sum(map(len, a_all)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a_all, b_all)], ["a", "b"])

    return met.repartition("to", "to_piece").sortWithinPartitions("to", "to_piece", F.desc("home")).mapInArrow(of_batches, "a long, b long")


def simhash_groups(docs: DataFrame, words: int = 3, radius: int = 2, parts: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of every row.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows stay
    repeated. A null doc_id keeps its row; it counts for component_id only if all of its component are
    null. An empty table gives no rows. Further columns are ignored.
    """
    made = stored(fingerprints(docs, words), "simhash")
    classes = made.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = connected(near(classes, radius, parts))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    merged = rooted.join(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("fp", "component_id")
    return made.join(merged, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
