"""A Merkle tree that grows by appending: stored hashes, roots of any earlier size, and proofs.

Leaves are numbered through all appends. Whenever 2 ** LEVELS neighbours of one group (leaves, or nodes of a lower group) are complete, their
common node joins the next group; complete nodes never change. So an append reads, of what is stored, the unfinished block of each group. Roots are
those of `integrity.merkle_root` over all leaves: pairs hashed together, an odd last node doubled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.functions.ordered import ordinal
from eventlens.operators.integrity import _blocks, _parents, climbed
from eventlens.session import cut_lineage
from eventlens.sources.retention import exists

LEVELS = 10
HASHES = "g int, i bigint, h string, batch string"
SIZES = "batch string, seq bigint, leaves bigint"


def pair(a: str, b: str) -> str:
    return hashlib.sha256(bytes.fromhex(a) + bytes.fromhex(b)).hexdigest()


def folded(nodes: list[str], levels: int | None) -> list[list[str]]:
    """The nodes and all levels above, `levels` of them or up to a single node; an odd last node is doubled."""
    out = [nodes]
    while len(out[-1]) > 1 if levels is None else len(out) <= levels:
        low = out[-1]
        out.append([pair(low[k], low[k + 1] if k + 1 < len(low) else low[k]) for k in range(0, len(low), 2)])
    return out


class Ledger:
    """The tree stored at `path`; `levels` must be the same for all uses of it."""

    def __init__(self, spark: SparkSession, path: str, levels: int = LEVELS):
        self.spark, self.path, self.levels, self.width = spark, path, levels, 1 << levels
        self._sizes: list[tuple[str, int]] | None = None

    def sizes(self) -> list[tuple[str, int]]:
        """(batch, leaves after it) of all appends, in order; a row each. Read again before each append only."""
        if self._sizes is None:
            self._sizes = self._read_sizes()
        return self._sizes

    def _read_sizes(self) -> list[tuple[str, int]]:
        if not exists(self.spark, f"{self.path}/sizes"):
            return []
        rows = self.spark.read.schema(SIZES).parquet(f"{self.path}/sizes").orderBy("seq").collect()
        return [(r.batch, r.leaves) for r in rows]

    def _stored(self) -> DataFrame:
        """Hashes of finished appends; what a failed one left behind doesn't count."""
        done = [batch for batch, _ in self.sizes()]
        if not done:
            return self.spark.createDataFrame([], HASHES).drop("batch")
        return self.spark.read.schema(HASHES).parquet(f"{self.path}/hashes").where(F.col("batch").isin(done)).drop("batch")

    def append(self, df: DataFrame, leaf: Column, order: Sequence[str], batch: str) -> int:
        """Add the rows of `df`, in `order`, behind what is there; the number of leaves then. A batch that was added already is not added again."""
        self._sizes = None
        sizes = self.sizes()
        if batch in dict(sizes):
            return dict(sizes)[batch]
        old = sizes[-1][1] if sizes else 0
        named = df.select(*order, F.sha2(leaf, 256).alias("h"))
        nodes = cut_lineage(ordinal(named, [], list(order), "_rn").select((F.col("_rn") - 1 + old).alias("i"), "h"))
        new = old + nodes.count()
        stored, g, written = self._stored(), 0, f"{self.path}/hashes/batch={batch}"
        mode = "overwrite"
        first, last = old, new  # nodes of the group before and after
        while last > first or g == 0:
            nodes.select(F.lit(g).alias("g"), "i", "h").repartitionByRange("i").sortWithinPartitions("i").write.mode(mode).parquet(written)
            mode = "append"
            low, high = first // self.width, last // self.width
            if high == low:
                break
            begun = stored.where((F.col("g") == g) & (F.col("i") >= low * self.width) & (F.col("i") < first)).select("i", "h")
            whole = nodes.unionByName(begun).where(F.col("i") < high * self.width)
            up = F.aggregate(F.sequence(F.lit(1), F.lit(self.levels)), F.col("hs"), lambda a, _: _parents(a))
            nodes = cut_lineage(_blocks(whole, self.width).select(F.col("b").alias("i"), F.element_at(up, 1).alias("h")))
            g, first, last = g + 1, low, high
        self.spark.createDataFrame([(batch, len(sizes), new)], SIZES).coalesce(1).write.mode("append").parquet(f"{self.path}/sizes")
        self._sizes = None
        return new

    def _ranges(self, n: int, at: int) -> list[tuple[int, int, int]]:
        """Per group, bottom up, the numbers [low, high) of the nodes that `n` leaves make complete in the block where the first `at` leaves end."""
        out = []
        while True:
            g = len(out)
            count, block = n // self.width**g, at // self.width ** (g + 1)
            out.append((g, block * self.width, max(block * self.width, min((block + 1) * self.width, count))))
            if count < self.width:
                return out

    def _nodes(self, ranges: Sequence[tuple[int, int, int]]) -> list[list[str]]:
        """Hashes of each range, 2 ** levels at most, read at once."""
        test = F.lit(False)
        for g, low, high in ranges:
            test = test | ((F.col("g") == g) & (F.col("i") >= low) & (F.col("i") < high))
        found = {(r.g, r.i): r.h for r in self._stored().where(test).collect()}
        try:
            return [[found[g, i] for i in range(low, high)] for g, low, high in ranges]
        except KeyError as missing:
            raise ValueError(f"hash {missing} is not there") from None

    def _carries(self, n: int) -> list[str | None]:
        """Per group the node that stands for what is unfinished in the groups below, and last the root."""
        return self._carried(n, self._nodes(self._ranges(n, n)))

    def _carried(self, n: int, tails: list[list[str]]) -> list[str | None]:
        out: list[str | None] = [None]
        for g, tail in enumerate(tails):
            nodes = tail + ([out[-1]] if out[-1] else [])
            if g == len(tails) - 1:
                out.append(folded(nodes, None)[-1][0])
            else:
                out.append(folded(nodes, self.levels)[-1][0] if nodes else None)
        return out

    def root(self, n: int | None = None) -> str | None:
        """Root over the first `n` leaves (all, by default); None without leaves."""
        n = self.sizes()[-1][1] if n is None and self.sizes() else n
        return self._carries(n)[-1] if n else None

    def proofs(self, wanted: DataFrame, n: int | None = None) -> DataFrame:
        """`i`, `h` and `path` (hash, on_left) to the root over `n` leaves, for the leaf numbers `i` in `wanted`; only their blocks are read."""
        n = self.sizes()[-1][1] if n is None else n
        carries, stored = self._carries(n), self._stored()
        leaves = stored.where("g = 0").select("i", "h")
        proofs = leaves.join(wanted.select("i").where(F.col("i") < n).distinct(), "i", "left_semi")
        proofs = cut_lineage(proofs.withColumn("_at", F.col("i")).withColumn("path", F.array().cast("array<struct<hash:string,on_left:boolean>>")))
        for g, carry in enumerate(carries[:-1]):
            count = n // self.width**g
            needed = proofs.select(F.floor(F.col("_at") / self.width).alias("b")).distinct()
            nodes = stored.where((F.col("g") == g) & (F.col("i") < count)).select("i", "h")
            if carry:
                nodes = nodes.unionByName(self.spark.createDataFrame([(count, carry)], "i bigint, h string"))
            nodes = nodes.withColumn("b", F.floor(F.col("i") / self.width)).join(needed, "b", "left_semi").select("i", "h")
            proofs, _ = climbed(proofs, _blocks(nodes, self.width), self.levels, last=g == len(carries) - 2)
            proofs = cut_lineage(proofs)
        return proofs.drop("_at")

    def consistency(self, m: int, n: int | None = None) -> list[tuple[str, int, list[tuple[str, bool]]]]:
        """Proof that the tree of the first `m` leaves is the beginning of that of `n`: for each of the full subtrees that `m` is made of, largest
        first, its hash, its height and its path to the newer root. Check it with `begins`."""
        n = self.sizes()[-1][1] if n is None else n
        if not 0 < m <= n:
            raise ValueError(f"{m} leaves are not among {n}")
        mine, ends = self._ranges(n, m), self._ranges(n, n)
        nodes = self._nodes([*mine, *ends])
        carries = self._carried(n, nodes[len(mine) :])
        # blocks in which the first m leaves end, group by group: every path passes through them
        paths = []
        for (g, low, _), block, carry in zip(mine, nodes, carries[:-1], strict=False):
            if carry and n // self.width**g // self.width == low // self.width:
                block = [*block, carry]
            last = g == len(carries) - 2
            paths.append((folded(block, None if last else self.levels) if block else [], m // self.width**g - low, low // self.width))
        found = []
        for g, (tree, tail, _) in enumerate(paths):
            for r in range(self.levels):
                if not tail >> r & 1:
                    continue
                place, path, level = (tail >> r) - 1, [], r
                hash_ = tree[level][place]
                for up in range(g, len(paths)):
                    tree_up, _, block = paths[up]
                    for k in range(level, len(tree_up) - 1):
                        other = place - 1 if place % 2 else min(place + 1, len(tree_up[k]) - 1)
                        path.append((tree_up[k][other], place % 2 == 1))
                        place //= 2
                    place, level = block % self.width, 0
                found.append((hash_, g * self.levels + r, path))
        return sorted(found, key=lambda f: -f[1])


def root_of(peaks: Sequence[tuple[str, int]]) -> str:
    """Root of a tree from its full subtrees (hash, height), largest first: the last node of a level is paired with the subtree before it, or with itself."""
    rest = list(peaks)
    hash_, height = rest.pop()
    while rest:
        if rest[-1][1] == height:
            hash_ = pair(rest.pop()[0], hash_)
        else:
            hash_ = pair(hash_, hash_)
        height += 1
    return hash_


def climb(hash_: str, path: Sequence[tuple[str, bool]]) -> str:
    """Root that a node and its path lead to."""
    for other, on_left in path:
        hash_ = pair(other, hash_) if on_left else pair(hash_, other)
    return hash_


def begins(proof: Sequence[tuple[str, int, Sequence[tuple[str, bool]]]], older: str, m: int, newer: str) -> bool:
    """Whether a `consistency` proof shows that `older`, the root over `m` leaves, is the beginning of the tree with root `newer`."""
    heights = [k for k in range(m.bit_length() - 1, -1, -1) if m >> k & 1]
    return [h for _, h, _ in proof] == heights and root_of([(h, k) for h, k, _ in proof]) == older and all(climb(h, path) == newer for h, _, path in proof)
