"""Hashes, chains, Merkle trees, signed lineage and policy decisions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.functions.fields import field, has_field, text
from eventlens.functions.ordered import ordinal
from eventlens.operators.rules import Condition
from eventlens.session import cut_lineage

LEVELS = 10


def hash_sign(column: str = "payload", target: str = "signature"):
    return lambda df: df.withColumn(target, F.sha2(F.col(column), 256))


def hash_verify(column: str = "payload", signature: str = "signature", target: str = "valid"):
    return lambda df: df.withColumn(target, F.coalesce(F.sha2(F.col(column), 256) == F.col(signature), F.lit(False)))


def hash_chain(df: DataFrame, payload: Column, keys: list[str], order: list[str], block: int = 1000, group_rows: int | None = None) -> DataFrame:
    """Chain heads: h0 = H(d0), hi = H(h(i-1) bytes followed by di), over the rows of each key in order.

    A chain is serial by nature, so it restarts after `block` rows: a busy key gives several
    segments that are folded side by side. `merkle_root` over the heads covers the whole.
    """
    placed = ordinal(df.select(*dict.fromkeys([*keys, *order]), payload.alias("_d")), keys, order, "_rn", group_rows)
    rows = placed.select(*keys, F.floor((F.col("_rn") - 1) / block).alias("segment"), "_rn", "_d")
    segments = rows.groupBy(*keys, "segment").agg(F.array_sort(F.collect_list(F.struct("_rn", "_d"))).alias("_s"))
    start = F.sha2(F.element_at("_s", 1)["_d"], 256)
    head = F.aggregate(F.slice("_s", 2, block), start, lambda acc, x: F.sha2(F.concat(F.unhex(acc), F.encode(x["_d"], "utf-8")), 256))
    return segments.select(*keys, "segment", F.size("_s").alias("n"), head.alias("head"))


def _parents(nodes: Column) -> Column:
    """One level up: hashes of neighbouring pairs, the last one doubled if it is alone."""
    pairs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int"))
    return F.transform(pairs, lambda i: F.sha2(F.concat(F.unhex(F.get(nodes, i * 2)), F.unhex(F.coalesce(F.get(nodes, i * 2 + 1), F.get(nodes, i * 2)))), 256))


def _blocks(nodes: DataFrame, width: int) -> DataFrame:
    grouped = nodes.groupBy(F.floor(F.col("i") / width).alias("b")).agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("_s"))
    return grouped.select("b", F.col("_s.h").alias("hs"))


def leaf_nodes(df: DataFrame, leaf: Column, order: list[str]) -> DataFrame:
    """Numbered leaf hashes (i, h) in global order."""
    placed = ordinal(df.withColumn("h", F.sha2(leaf, 256)), [], order, "_rn")
    return placed.select(*df.columns, (F.col("_rn") - 1).alias("i"), "h")


def merkle_root(df: DataFrame, leaf: Column, order: list[str], levels: int = LEVELS) -> DataFrame:
    """Root of the tree over SHA-256 leaves, pairs hashed together, an odd last node doubled.

    Each round folds aligned blocks of 2^levels nodes to one, so a billion leaves take
    three rounds and no task holds more than a block. One row: root, leaves.
    """
    width = 1 << levels
    nodes = cut_lineage(leaf_nodes(df.select(*order, leaf.alias("_leaf")), F.col("_leaf"), order).select("i", "h"))
    leaves = count = nodes.count()
    while count > 1:
        last = count <= width
        step = lambda a, _: F.when(F.size(a) > 1, _parents(a)).otherwise(a) if last else _parents(a)
        folded = F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.col("hs"), step)
        nodes = _blocks(nodes, width).select(F.col("b").alias("i"), F.element_at(folded, 1).alias("h"))
        count = -(-count // width)
    return nodes.select(F.col("h").alias("root"), F.lit(leaves).cast("long").alias("leaves"))


def merkle_proofs(df: DataFrame, leaf: Column, order: list[str], wanted: Column, levels: int = LEVELS) -> DataFrame:
    """Audit paths for the leaves that satisfy `wanted`: (columns, i, h, path of (hash, on_left))."""
    width = 1 << levels
    numbered = cut_lineage(leaf_nodes(df, leaf, order))
    count, nodes = numbered.count(), numbered.select("i", "h")
    proofs = numbered.where(wanted).withColumn("_at", F.col("i")).withColumn("path", F.array().cast("array<struct<hash:string,on_left:boolean>>"))
    while count > 1:
        proofs, blocks = climbed(proofs, _blocks(nodes, width), levels, last=count <= width)
        nodes = blocks.select(F.col("b").alias("i"), F.element_at(F.element_at("_tree", -1), 1).alias("h"))
        count = -(-count // width)
    return proofs.drop("_at")


def climbed(proofs: DataFrame, blocks: DataFrame, levels: int, last: bool) -> tuple[DataFrame, DataFrame]:
    """`proofs` with the siblings that their blocks (b, hs) add to `path`, `_at` becoming the block's number, and the blocks' trees; `last`: the block holds the root."""
    width = 1 << levels
    # all levels of a block, the leaves first
    grow = lambda a, _: F.concat(a, F.array(_parents(F.element_at(a, -1))))
    step = lambda a, i: F.when(F.size(F.element_at(a, -1)) > 1, grow(a, i)).otherwise(a) if last else grow(a, i)
    tree = F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.array("hs"), step)
    blocks = cut_lineage(blocks.select("b", tree.alias("_tree")))
    joined = proofs.withColumn("_b", F.floor(F.col("_at") / width)).join(blocks, F.col("_b") == F.col("b"))
    inner = (F.col("_at") % width).cast("int")
    heights = F.when(F.size("_tree") > 1, F.sequence(F.lit(0), F.size("_tree") - 2)).otherwise(F.array().cast("array<int>"))

    def sibling(level):
        place = F.floor(inner / F.pow(F.lit(2), level)).cast("int")
        other = F.when(place % 2 == 0, place + 1).otherwise(place - 1)
        row = F.get(F.col("_tree"), level)
        return F.struct(F.coalesce(F.get(row, other), F.get(row, place)).alias("hash"), (place % 2 == 1).alias("on_left"))

    return joined.withColumn("path", F.concat("path", F.transform(heights, sibling))).withColumn("_at", F.col("_b")).drop("_b", "b", "_tree"), blocks


def proof_root(leaf_hash: Column, path: Column) -> Column:
    """Root that a leaf and its path lead to."""
    join = lambda a, b: F.sha2(F.concat(F.unhex(a), F.unhex(b)), 256)
    return F.aggregate(path, leaf_hash, lambda acc, p: F.when(p["on_left"], join(p["hash"], acc)).otherwise(join(acc, p["hash"])))


def hmac_sha256(message: Column, secret: bytes) -> Column:
    """HMAC-SHA-256 in hex; the padded keys are computed once on the driver."""
    import hashlib

    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "utf-8")), 256))), 256)


LINEAGE = "array<struct<stage:string,node_id:string,ts:timestamp,action:string,data_hash:string,signature:string>>"


def _lineage_payload(stage, node, ts, action, data_hash) -> Column:
    return F.concat(stage, node, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), action, data_hash)


def lineage_sign(stage: str, action: str, node: str, secret: bytes, data: Column, at: Column):
    """Append a signed step to the `lineage` array of every event."""

    def apply(df: DataFrame) -> DataFrame:
        s, n, a, t = F.lit(stage), F.lit(node), F.lit(action), at.cast("timestamp")
        data_hash = F.sha2(data, 256)
        signature = hmac_sha256(_lineage_payload(s, n, t, a, data_hash), secret)
        step = F.struct(s.alias("stage"), n.alias("node_id"), t.alias("ts"), a.alias("action"), data_hash.alias("data_hash"), signature.alias("signature"))
        so_far = F.coalesce(F.col("lineage"), F.array().cast(LINEAGE)) if "lineage" in df.columns else F.array().cast(LINEAGE)
        return df.withColumn("lineage", F.concat(so_far, F.array(step).cast(LINEAGE)))

    return apply


def lineage_verify(secret: bytes, target: str = "lineage_valid"):
    """True where every step carries the right signature."""

    def good(s):
        return s["signature"] == hmac_sha256(_lineage_payload(s["stage"], s["node_id"], s["ts"], s["action"], s["data_hash"]), secret)

    return lambda df: df.withColumn(target, F.coalesce(F.forall("lineage", good), F.lit(False)))


@dataclass(frozen=True)
class Policy:
    id: str
    action: str
    effect: str
    conditions: tuple[Condition, ...] = ()


def policy_decide(policies: list[Policy], action: str):
    """Deny if a deny policy for the action matches on all conditions, else allow; names the first denying policy."""

    def holds(df: DataFrame, c: Condition) -> Column:
        if not has_field(df, c.field) or c.operator not in ("eq", "neq"):
            return F.lit(False)
        same = text(field(df, c.field)) == F.lit(str(c.value))
        return F.coalesce(same if c.operator == "eq" else ~same, F.lit(False))

    def apply(df: DataFrame) -> DataFrame:
        denying = [
            F.when(reduce(and_, [holds(df, c) for c in p.conditions], F.lit(True)), F.lit(p.id))
            for p in policies
            if p.action == action and p.effect == "deny"
        ]
        denied = F.coalesce(*denying) if denying else F.lit(None).cast("string")
        return df.withColumn("denied_by", denied).withColumn("allowed", F.col("denied_by").isNull())

    return apply
