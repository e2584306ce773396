"""Product codes of vectors by exact k-means, with metric trees made middle-out by anchors.

Vectors become integers and are cut into equal parts; each part position has a codebook. Rows are held in chunks. For
each chunk and part position a tree of balls is made once: about sqrt(n) anchors take the points nearest to
them (a new anchor starts at the point worst served, and looks only at points that lie further than half way
from their anchor to it), anchors are merged pairwise into a tree above, and cut the same way below, down to leaves. A ball
caches count and sum of its points. A round walks the trees from the top with a list of entries that may win. A ball inherits its
parent's list and drops an entry if another one is nearer to every point of the ball; when one entry is left the
ball's cached sum goes to it and nothing below is visited. Leaves compare their points with what is left of the list.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import stored
from eventlens.llm.adaptive_scan import matrix

ENTRIES, PARTS, ROUNDS, SCALE = 64, 16, 2, 256
CHUNK_VALUES = 262_144
LEAF = 24
AT_ONCE = 4_096
SLACK = 1e-9
#: Larger components would let a squared distance leave the range of a long.
LARGEST = 1 << 24
ARRAYS = ("order", "part", "left", "right", "start", "stop", "pivot", "radius", "total")


def usable(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE) -> tuple[DataFrame, int]:
    """vec_id, label and embedding (doubles) of the rows that are coded, and their length.

    Vectors that are null or hold null or non-finite components are dropped. Only lengths that are multiples of `parts` can be
    cut; of these the most frequent one (the greater one, if several are) is coded and others are dropped. Without rows the length is zero.
    """
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int").alias("label")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label, F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("embedding").isNotNull() & whole)
    size = F.size("embedding")
    most = F.max(F.greatest(F.abs(F.array_max("embedding")), F.abs(F.array_min("embedding"))))
    lengths = rows.where((size > 0) & (size % parts == 0)).groupBy(size.alias("size")).agg(F.count("*").alias("n"), most.alias("most")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    if not lengths:
        return rows.where(F.lit(False)), 0
    if lengths[0]["most"] * scale > LARGEST:
        raise ValueError(f"components up to {lengths[0]['most']:g} are beyond {LARGEST / scale:g}, where distances no longer fit a long")
    return rows.where(size == lengths[0]["size"]), lengths[0]["size"]


def whole_numbers(column, scale: int) -> np.ndarray:
    return np.floor(matrix(column) * scale).astype(np.int64)


def anchors(x: np.ndarray, k: int) -> np.ndarray:
    """The anchor of each point, numbered in the order they are set; fewer than k where points coincide."""
    owner, far = np.zeros(len(x), np.int64), np.sqrt(((x - x[0]) ** 2).sum(1))
    at = [x[0]]
    while len(at) < k and far[new := int(far.argmax())] > 0:
        gap = np.sqrt(((np.array(at) - x[new]) ** 2).sum(1))
        # nearer to its anchor than half the anchors' distance: the triangle inequality keeps it there
        open_ = np.nonzero(far > gap[owner] / 2)[0]
        dist = np.sqrt(((x[open_] - x[new]) ** 2).sum(1))
        won = dist < far[open_]
        owner[open_[won]], far[open_[won]] = len(at), dist[won]
        at.append(x[new])
    return owner


class Tree:
    """Balls over the points of one part of one chunk, children before parents; the last one is the root."""

    def __init__(self, x: np.ndarray):
        self.x = x.astype(np.float64)
        self.left, self.right, self.members = [], [], []
        self.root = self.grown(np.arange(len(x)))
        order, start, stop = [], [0] * len(self.left), [0] * len(self.left)
        stack, n = [(self.root, False)], 0
        while stack:
            node, done = stack.pop()
            if done:
                stop[node] = n
            elif self.left[node] < 0:
                start[node], stop[node] = n, n + len(self.members[node])
                order.append(self.members[node])
                n = stop[node]
            else:
                start[node] = n
                stack += [(node, True), (self.right[node], False), (self.left[node], False)]
        self.order, self.start, self.stop = np.concatenate(order), np.array(start), np.array(stop)
        rows = x[self.order]
        sums = np.vstack((np.zeros((1, x.shape[1]), np.int64), rows.cumsum(0)))
        self.total = sums[self.stop] - sums[self.start]
        self.pivot = self.total / (self.stop - self.start)[:, None]
        self.radius = np.array([np.sqrt(((rows[a:b] - p) ** 2).sum(1).max()) for a, b, p in zip(self.start, self.stop, self.pivot, strict=True)])

    def node(self, left: int, right: int, members) -> int:
        self.left.append(left)
        self.right.append(right)
        self.members.append(members)
        return len(self.left) - 1

    def grown(self, at: np.ndarray) -> int:
        if len(at) <= LEAF:
            return self.node(-1, -1, at)
        owner = anchors(self.x[at], max(2, int(len(at) ** 0.5)))
        by = np.argsort(owner, kind="stable")
        own = np.split(at[by], np.nonzero(np.diff(owner[by]))[0] + 1)
        if len(own) == 1:  # all points coincide
            return self.node(-1, -1, at)
        return self.merged([self.grown(o) for o in own], [self.x[o] for o in own])

    def merged(self, nodes: list[int], points: list[np.ndarray]) -> int:
        """One tree over `nodes`: again and again the two whose common ball is smallest become one."""
        count = np.array([len(p) for p in points], float)
        centre = np.array([p.mean(0) for p in points])
        radius = np.array([np.sqrt(((p - c) ** 2).sum(1).max()) for p, c in zip(points, centre, strict=True)])
        ball = lambda i: np.maximum(np.maximum(radius, radius[i]), (np.sqrt(((centre - centre[i]) ** 2).sum(1)) + radius + radius[i]) / 2)
        cost = np.array([ball(i) for i in range(len(nodes))])
        np.fill_diagonal(cost, np.inf)
        nodes = list(nodes)
        for _ in range(len(nodes) - 1):
            i, j = divmod(int(cost.argmin()), len(nodes))
            nodes[i] = self.node(nodes[i], nodes[j], None)
            mean = (centre[i] * count[i] + centre[j] * count[j]) / (count[i] + count[j])
            radius[i] = max(np.sqrt(((centre[k] - mean) ** 2).sum()) + radius[k] for k in (i, j))
            centre[i], count[i] = mean, count[i] + count[j]
            new = ball(i)
            new[np.isinf(cost[i])] = np.inf
            new[j] = np.inf
            cost[i], cost[:, i] = new, new
            cost[j], cost[:, j] = np.inf, np.inf
        return nodes[i]


def packed(x: np.ndarray, parts: int) -> bytes:
    """Points of a chunk and the trees of all its parts, nodes of later parts behind those of earlier ones."""
    width, made, base = x.shape[1] // parts, {name: [] for name in ARRAYS}, 0
    roots = []
    for p in range(parts):
        tree = Tree(x[:, p * width : (p + 1) * width])
        for name in ("left", "right"):
            child = np.array(getattr(tree, name))
            made[name].append(np.where(child < 0, -1, child + base))
        for name in ("order", "start", "stop", "pivot", "radius", "total"):
            made[name].append(getattr(tree, name))
        made["part"].append(np.full(len(tree.left), p))
        roots.append(base + tree.root)
        base += len(tree.left)
    out = io.BytesIO()
    arrays = {name: np.stack(made[name]) if name == "order" else np.concatenate(made[name]) for name in ARRAYS}
    np.savez(out, x=x.astype(np.int32), roots=np.array(roots), **{name: a.astype(np.int32) if a.dtype == np.int64 and name != "total" else a for name, a in arrays.items()})
    return out.getvalue()


def assign(trees, books: np.ndarray, codes: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Sums and counts per part and entry of a chunk's points, and with `codes` each point's entries (points x parts).

    `books` holds parts x entries x width integers. The nearest entry wins, ties the lower index; of equal entries only the first takes part.
    """
    parts, entries, width = books.shape
    x, order, part = trees["x"].astype(np.int64), trees["order"], trees["part"]
    first = np.array([[not (book[:j] == book[j]).all(1).any() for j in range(entries)] for book in books])
    flat = books.astype(np.float64)
    gaps = np.sqrt(((flat[:, :, None, :] - flat[:, None, :, :]) ** 2).sum(3))
    sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
    code = np.zeros((len(x), parts), np.uint8) if codes else None

    def settle(at: np.ndarray, winner: np.ndarray, slots: list[np.ndarray] | None) -> None:
        np.add.at(sums, part[at] * entries + winner, trees["total"][at])
        np.add.at(counts, part[at] * entries + winner, trees["stop"][at] - trees["start"][at])
        if code is not None:
            for node, w in zip(at.tolist(), winner.tolist(), strict=True):
                code[order[part[node], trees["start"][node] : trees["stop"][node]], part[node]] = w

    def compared(at: np.ndarray, may: np.ndarray) -> None:
        size = trees["stop"][at] - trees["start"][at]
        which = np.repeat(np.arange(len(at)), size)
        place = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + trees["start"][at][which]
        for a in range(0, len(which), AT_ONCE):
            w = which[a : a + AT_ONCE]
            p = part[at[w]]
            rows = order[p, place[a : a + AT_ONCE]]
            points = x[rows[:, None], p[:, None] * width + np.arange(width)]
            least = np.full((len(w),), np.iinfo(np.int64).max)
            winner = np.zeros(len(w), np.int64)
            for j in np.nonzero(may[w].any(0))[0].tolist():
                open_ = np.nonzero(may[w, j])[0]
                dist = ((points[open_] - books[p[open_], j]) ** 2).sum(1)
                better = dist < least[open_]
                least[open_[better]], winner[open_[better]] = dist[better], j
            np.add.at(sums, p * entries + winner, points)
            np.add.at(counts, p * entries + winner, 1)
            if code is not None:
                code[rows, p] = winner

    at, may = trees["roots"], first.copy()
    while len(at):
        nodes, lists = [], []
        for a in range(0, len(at), AT_ONCE // 4):
            here, allowed = at[a : a + AT_ONCE // 4], may[a : a + AT_ONCE // 4]
            p = part[here]
            dist = ((trees["pivot"][here][:, None, :] - flat[p]) ** 2).sum(2)
            open_ = np.where(allowed, dist, np.inf)
            best = open_.argmin(1)
            # the half space nearer to `best` than to an entry holds the whole ball
            lead = dist - dist[np.arange(len(here)), best][:, None]
            reach = 2 * trees["radius"][here][:, None] * gaps[p, best]
            allowed = allowed & ~(lead > reach * (1 + SLACK) + SLACK * (1 + dist.max(1)[:, None] + reach))
            alone, leaf = allowed.sum(1) == 1, trees["left"][here] < 0
            settle(here[alone], best[alone], None)
            if (rest := leaf & ~alone).any():
                compared(here[rest], allowed[rest])
            if (more := ~leaf & ~alone).any():
                nodes += [trees["left"][here[more]], trees["right"][here[more]]]
                lists += [allowed[more], allowed[more]]
        at, may = (np.concatenate(nodes), np.concatenate(lists)) if nodes else (np.zeros(0, np.int64), first[:0])
    return sums.reshape(parts, entries, width), counts.reshape(parts, entries), code


def forest(rows: DataFrame, size: int, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """vec_id and label (arrays) and trees (binary) of each chunk of `usable` rows, stored; rows stay where they were read."""
    most = max(1, CHUNK_VALUES // size)

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def cut(least: int) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            a = 0
            while table.num_rows - a >= least:
                one = table.slice(a, most)
                a += one.num_rows
                lists = [pa.ListArray.from_arrays(pa.array([0, one.num_rows], pa.int32()), one.column(k).combine_chunks()) for k in (0, 1)]
                trees = packed(whole_numbers(one.column(2).combine_chunks(), scale), parts)
                yield pa.RecordBatch.from_arrays([*lists, pa.array([trees], pa.binary())], ["vec_id", "label", "trees"])
            if a < table.num_rows:
                held.extend(table.slice(a).to_batches())

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= most:
                yield from cut(most)
        if held:
            yield from cut(1)

    kind = rows.schema["label"].dataType.simpleString()
    return stored(rows.select("vec_id", "label", "embedding").mapInArrow(of_batches, f"vec_id array<bigint>, label array<{kind}>, trees binary"), "forest")


def unpacked(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as found:
        return {name: found[name].astype(np.int64) if found[name].dtype == np.int32 and name != "x" else found[name] for name in found.files}


def moved(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after a round: each entry the floor of its parts' mean, unused entries as they were.

    A task gives a sum for each part, entry and position, whatever its rows; so does the driver get.
    """
    parts, entries, width = books.shape

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros((parts * entries, width + 1), np.int64)
        for batch in batches:
            for blob in batch.column(0):
                sums, counts, _ = assign(unpacked(blob.as_py()), books, False)
                whole += np.column_stack((sums.reshape(-1, width), counts.reshape(-1)))
        slot, place = np.nonzero(whole[:, -1:] * np.ones(width + 1, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(whole[slot, place])], ["slot", "place", "total"])

    found = trees.select("trees").mapInArrow(of_batches, "slot int, place int, total long").groupBy("slot", "place").agg(F.sum("total").alias("total")).toArrow()
    whole = np.zeros((parts * entries, width + 1), np.int64)
    whole[found.column("slot").to_numpy(), found.column("place").to_numpy()] = found.column("total").to_numpy()
    used = whole[:, -1] > 0
    out = books.reshape(-1, width).copy()
    out[used] = whole[used, :-1] // whole[used, -1:]
    return out.reshape(books.shape)


def coded(trees: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (a byte for each part) and error (squared distance to what the code stands for) of every row."""
    parts, _, width = books.shape

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held = unpacked(batch.column(2)[i].as_py())
                code = assign(held, books, True)[2]
                error = np.zeros(len(code), np.int64)
                for p in range(parts):
                    error += ((held["x"][:, p * width : (p + 1) * width] - books[p][code[:, p]]) ** 2).sum(1)
                flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(parts), len(code), [None, pa.py_buffer(np.ascontiguousarray(code))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, batch.column(1)[i].values, flat, pa.array(error)], ["vec_id", "label", "code", "error"])

    kind = trees.schema["label"].dataType.elementType.simpleString()
    return trees.mapInArrow(of_batches, f"vec_id bigint, label {kind}, code binary, error bigint")


def fitted(vectors: DataFrame, entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """The stored `forest` of `vectors` and the codebooks (parts x entries x width integers) after `rounds` rounds.

    A codebook starts as the parts of the `entries` smallest vec_ids (null ids last, equal ids by vector); with fewer rows it has as many entries.
    """
    if entries > 256:
        raise ValueError("a code is one byte for each part")
    rows, size = usable(vectors, parts, scale)
    trees = forest(rows, max(size, parts), parts, scale)
    start = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").select("embedding").limit(entries).toArrow().column(0).combine_chunks()
    width = size // parts
    books = whole_numbers(start, scale).reshape(len(start), parts, width).transpose(1, 0, 2).copy() if size else np.zeros((parts, 0, 0), np.int64)
    for _ in range(rounds if size else 0):
        books = moved(trees, books)
    return trees, books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def with_label_error(codes: DataFrame, shares: int = 1_000) -> DataFrame:
    """`codes` with label_error, the sum of error over equal labels, nulls together.

    Fewer than `shares` labels can hold more than that part of all rows each: these totals are broadcast. The
    others' rows meet theirs in a shuffle where no label is frequent.
    """
    rows = stored(codes, "codes")
    totals = stored(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "labels")
    often = F.col("n") > F.lit(rows.count() // shares)
    same = F.col("label").eqNullSafe(F.col("_label"))
    known = totals.select(F.col("label").alias("_label"), "label_error", often.alias("often"))
    heavy = F.broadcast(known.where("often"))
    near = rows.join(heavy, same, "left").withColumn("found", F.coalesce("often", F.lit(False))).drop("_label", "often")
    rest = near.where("NOT found").drop("label_error").join(known.where("NOT often").drop("often"), same).drop("_label")
    return near.where("found").unionByName(rest).drop("found")


def compressed(vectors: DataFrame, entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error and label_error of every usable row, and the codebooks.

    `usable` says which rows are coded. Components become floor(scale * x). Ties go to the lower entry. Repeated rows are rows like others and weigh as
    such; a null vec_id is coded like any other. Without a column `label` all labels are null. Further columns are ignored. An empty table gives no rows.
    """
    trees, books = fitted(vectors, entries, parts, rounds, scale)
    return with_label_error(coded(trees, books)), books
