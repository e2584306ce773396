"""Nearest neighbours by largest inner product: probed lists, scanned by blocks of rotated dimensions.

Vectors get one more dimension that makes all norms equal, so that the largest inner product is
the least distance, and are turned by a random rotation, so that the distance over the first d of D
dimensions estimates the whole. k-means centres, fitted on a bounded sample, deal all vectors into
lists. A query first scans its nearest lists whole. The k-th score found there bounds it in the other lists it
probes: after each block of dimensions a candidate goes if its partial distance, scaled by D / d, exceeds the
bound by more than `EPSILON` / sqrt(d) allows. Survivors are scored on the original vectors.

Of equal vectors only the k + 1 smallest ids can be among a query's k nearest; no more are kept. Equal
query vectors search once. So a vector that a third of all rows share costs no more than others.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm.common import stored

SAMPLE = 16_384
SAMPLE_VALUES = 8_000_000
MAX_LISTS = 1_024
CHUNK = 4_096
BLOCK = 16
EPSILON = 2.1
WHOLE = 2
ASKED = 256
SLACK = 1e-9


def usable(vectors: DataFrame, size: int | None = None, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part.

    Rows without id and vectors that are null, zero, or hold null or non-finite components don't. The
    dimension is `size`, or the most frequent length among the rest (the greater one, if several are);
    vectors of another length don't take part either.
    """
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole)
    if size is not None:
        return rows.where(F.size("embedding") == size)
    common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("embedding") == (common[0]["n"] if common else 0))


def matrix(column) -> np.ndarray:
    """Rows of an Arrow column of equally long lists."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(np.float64)


def fit_centres(sample: np.ndarray, lists: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Centres of `sample` by k-means; an empty centre moves to the point worst served."""
    centres = sample[np.random.default_rng(seed).choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        far = (centres**2).sum(1) - 2 * sample @ centres.T
        at = far.argmin(1)
        count = np.bincount(at, minlength=lists)
        total = np.zeros_like(centres)
        np.add.at(total, at, sample)
        centres = total / np.maximum(count, 1)[:, None]
        if (empty := np.nonzero(count == 0)[0]).size:
            worst = np.argsort(-(far[np.arange(len(sample)), at] + (sample**2).sum(1)))[: len(empty)]
            centres[empty] = sample[worst]
    return centres


class Space:
    """Equal norms, rotation and lists; a few megabytes at most, sent to the tasks."""

    def __init__(self, sample: np.ndarray, norm: float, lists: int):
        self.norm = norm
        size = sample.shape[1] + 1
        self.rotation = np.linalg.qr(np.random.default_rng(11).standard_normal((size, size)))[0]
        self.centres = fit_centres(self.turned(sample), lists)

    def turned(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, self.norm**2 - (x**2).sum(1)))
        return np.column_stack((x, last)) @ self.rotation

    def ranked(self, turned: np.ndarray, first: int) -> np.ndarray:
        """The `first` nearest lists of each row, nearest first."""
        return np.argsort((self.centres**2).sum(1) - 2 * turned @ self.centres.T, axis=1, kind="stable")[:, :first]


def survivors(query: np.ndarray, bound: np.ndarray, turned: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) that may be among the k nearest; bound: squared distance or infinity."""
    size = turned.shape[1]
    slack = SLACK * ((query**2).sum(1) + (turned**2).sum(1).max())
    qi, xi = [], []
    if (free := np.nonzero(np.isinf(bound))[0]).size:
        far = (query[free] ** 2).sum(1)[:, None] + (turned**2).sum(1)[None, :] - 2 * query[free] @ turned.T
        last = np.partition(far, min(k, far.shape[1]) - 1, axis=1)[:, min(k, far.shape[1]) - 1]
        a, b = np.nonzero(far <= (last + slack[free])[:, None])
        qi.append(free[a])
        xi.append(b)
    if (held := np.nonzero(~np.isinf(bound))[0]).size:
        allowed = lambda d: d / size * (1 + EPSILON / np.sqrt(d)) ** 2 if d < size else 1.0
        d = min(BLOCK, size)
        first = (query[held, :d] ** 2).sum(1)[:, None] + (turned[:, :d] ** 2).sum(1)[None, :] - 2 * query[held, :d] @ turned[:, :d].T
        alive = first <= (bound[held] * allowed(d) + slack[held])[:, None]
        for row in np.nonzero(alive.any(1))[0].tolist():
            i, at = held[row], np.nonzero(alive[row])[0]
            far = first[row, at]
            for d in range(BLOCK, size, BLOCK):
                to = min(d + BLOCK, size)
                gap = turned[at, d:to] - query[i, d:to]
                far = far + np.einsum("ij,ij->i", gap, gap)
                keep = far <= bound[i] * allowed(to) + slack[i]
                at, far = at[keep], far[keep]
                if not at.size:
                    break
            qi.append(np.full(len(at), i))
            xi.append(at)
    return np.concatenate(qi) if qi else np.zeros(0, int), np.concatenate(xi) if xi else np.zeros(0, int)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of row pairs, added up from the first component to the last."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def scanned(index: DataFrame, asks: DataFrame, space: Space, k: int) -> DataFrame:
    """qkey, vec_id and score of up to k candidates for each query and chunk it asks for.

    `index` has list, chunk, vec_id, embedding; `asks` has list, chunk, qkey, embedding, least. A task holds a
    chunk at a time and `ASKED` of its queries.
    """
    both = index.select("list", "chunk", F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "embedding", F.lit(None).cast("double").alias("least")).unionByName(
        asks.select("list", "chunk", F.lit(1).alias("kind"), F.col("qkey").alias("id"), "embedding", "least")
    )

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, held = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)])
            ids, vectors = batch.column(3).to_numpy(), matrix(batch.column(4))
            least = batch.column(5).to_numpy(zero_copy_only=False).astype(np.float64)
            cuts = [0, *(np.nonzero(np.any(keys[:, 1:] != keys[:, :-1], axis=0))[0] + 1).tolist(), keys.shape[1]]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                here = (int(keys[0, s]), int(keys[1, s]))
                if keys[2, s] == 0:
                    if here != at:
                        at, parts = here, []
                    parts.append((ids[s:e], vectors[s:e]))
                    held = None
                    continue
                if here != at:
                    continue  # no vector fell into this chunk
                if held is None:
                    own, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                    held = own, x, space.turned(x)
                own, x, turned = held
                for a in range(s, e, ASKED):
                    q, low = vectors[a : min(a + ASKED, e)], least[a : min(a + ASKED, e)]
                    bound = np.where(np.isnan(low), np.inf, (q**2).sum(1) + space.norm**2 - 2 * low)
                    qi, xi = survivors(space.turned(q, query=True), bound, turned, k)
                    score = scores(q[qi], x[xi])
                    order = np.lexsort((own[xi], -score, qi))
                    qi, xi, score = qi[order], xi[order], score[order]
                    place = np.arange(len(qi)) - np.searchsorted(qi, qi)
                    keep = place < k
                    if keep.any():
                        yield pa.RecordBatch.from_arrays([pa.array(ids[a + qi[keep]]), pa.array(own[xi[keep]]), pa.array(score[keep])], ["qkey", "vec_id", "score"])

    return both.repartition("list", "chunk").sortWithinPartitions("list", "chunk", "kind").mapInArrow(of_batches, "qkey long, vec_id long, score double")


def best(found: DataFrame, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, probe_share: float = 0.75, least_probes: int = 12) -> DataFrame:
    """query_id, rank, vec_id and score of the k rows of `vectors` nearest to each row of `queries`.

    Both have vec_id and embedding; `usable` says which rows take part, queries with the table's dimension. A query's own row (the same
    vec_id) is no candidate. Nearness is the largest inner product in double precision, ties to the
    smaller vec_id; fewer candidates than k give as many rows. Rows that repeat an id and a vector count once,
    and where an id has several vectors each is a candidate; of query rows that share an id the one
    with the least vector asks. Empty tables give no rows. Every row is indexed; the centres come from
    `SAMPLE` rows at most. A query probes `probe_share` of the lists, `least_probes` at least.
    """
    rows = usable(vectors)
    found = rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("size"), F.max(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)).alias("square")).first()
    spark = vectors.sparkSession
    if not found["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = matrix(rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("embedding").limit(max(1, min(SAMPLE, SAMPLE_VALUES // found["size"]))).toArrow().column(0).combine_chunks())
    lists = max(1, min(MAX_LISTS, len(sample) // 4, int(found["n"] ** 0.5)))
    space = Space(sample, float(found["square"]) ** 0.5, lists)
    probes = min(lists, max(least_probes, round(lists * probe_share)))

    def listed(batches):
        for batch in batches:
            at = space.ranked(space.turned(matrix(batch.column(1))), 1)[:, 0] if batch.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], ["vec_id", "embedding", "list"])

    def probed(batches):
        for batch in batches:
            at = space.ranked(space.turned(matrix(batch.column(1)), query=True), probes) if batch.num_rows else np.zeros((0, probes), int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(at.astype(np.int32)), pa.list_(pa.int32()))], ["qkey", "embedding", "probes"])

    same = ["embedding", F.pmod(F.xxhash64("vec_id"), F.lit(64))]
    few = rows.distinct().withColumn("p", F.row_number().over(Window.partitionBy(*same).orderBy("vec_id"))).where(F.col("p") <= k + 1)
    few = few.withColumn("p", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("p") <= k + 1)
    index = stored(few.select("vec_id", "embedding").mapInArrow(listed, "vec_id long, embedding array<double>, list int"), "lists")
    # at most MAX_LISTS rows
    chunks = index.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    index = index.join(F.broadcast(chunks), "list").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int"))

    asking = usable(queries, found["size"]).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    groups = asking.groupBy("embedding").agg(F.min("vec_id").alias("qkey"))
    members = asking.join(groups, "embedding").select(F.col("vec_id").alias("query_id"), "qkey")
    asks = stored(groups.select("qkey", "embedding").mapInArrow(probed, "qkey long, embedding array<double>, probes array<int>"), "asks")

    def dealt(df: DataFrame, which) -> DataFrame:
        one = df.withColumn("list", F.explode(which)).join(F.broadcast(chunks), "list")
        return one.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))

    near = stored(best(scanned(index, dealt(asks.withColumn("least", F.lit(None).cast("double")), F.slice("probes", 1, WHOLE)), space, k + 1), "qkey", k + 1), "near")
    least = near.groupBy("qkey").agg(F.when(F.count("*") > k, F.min("score")).alias("least"))
    rest = asks.join(least, "qkey", "left")
    far = scanned(index, dealt(rest, F.slice("probes", WHOLE + 1, lists)), space, k + 1)
    top = best(near.select("qkey", "vec_id", "score").unionByName(far), "qkey", k + 1)
    return best(members.join(top.drop("rank"), "qkey").where("vec_id <> query_id"), "query_id", k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
