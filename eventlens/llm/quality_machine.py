"""Quality scores by a factorisation machine over hashed words, structure and metadata.

score = logistic(w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j); the pair sum is taken in linear time as
half of |sum v_i x_i|^2 - sum |v_i|^2 x_i^2.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.llm.common import held_out, runs, text_buffer

BUCKETS = 2_048
FACTORS = 8
SAMPLE = 4_000
RUN_BYTES, RUN_ROWS = 1 << 19, 128
REACH = 64

SPACE, LOWER, UPPER, DIGIT, MARK, HIGH = range(6)
CLASS = np.full(256, MARK, np.uint8)
CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[128:] = LOWER, UPPER, DIGIT, HIGH
POWERS = np.cumprod(np.full(REACH, 0x100000001B3, np.uint64), dtype=np.uint64)
SHAPE = ("length", "words", "word length", "upper", "digits", "marks", "marks after words", "mark runs", "upper words", "lines", "words a line", "repeated words", "repeated lines", "non-ASCII", "stated length")


def _segments(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else np.zeros(0, values.dtype)


def _hashed(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, own: np.ndarray) -> np.ndarray:
    """64-bit hashes of pieces; `own` gives each byte's place in its piece. Bytes beyond REACH repeat the powers."""
    terms = (x.astype(np.uint64) + np.uint64(1)) * POWERS[own % REACH]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
    h = total[ends] - total[starts]
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _pieces(inside: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that stay in one row."""
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    cut = np.nonzero((row[1:] != row[:-1]) & inside[1:] & inside[:-1])[0] + 1
    return np.sort(np.concatenate((np.nonzero(edge == 1)[0], cut))), np.sort(np.concatenate((np.nonzero(edge == -1)[0], cut)))


def _repeated(rows: int, row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Share of the pieces of each row that an equal piece of the row precedes."""
    order = np.lexsort((h, row))
    same = (row[order][1:] == row[order][:-1]) & (h[order][1:] == h[order][:-1])
    return np.bincount(row[order][1:][same], minlength=rows) / np.maximum(np.bincount(row, minlength=rows), 1)


def features(data: np.ndarray, offsets: np.ndarray, stated: np.ndarray) -> np.ndarray:
    """One row of BUCKETS word features and the statistics of SHAPE for each text."""
    rows, n = len(offsets) - 1, np.diff(offsets)
    x = data[offsets[0] : offsets[-1]]
    row = np.repeat(np.arange(rows), n)
    kind = CLASS[x]
    by = np.bincount(row * 6 + kind, minlength=rows * 6).reshape(rows, 6).astype(float)
    starts, ends = _pieces(kind != SPACE, row)
    words = np.bincount(row[starts], minlength=rows) if len(x) else np.zeros(rows)
    own = np.arange(len(x)) - np.repeat(starts, np.diff(np.append(starts, len(x)))) if len(starts) and starts[0] == 0 else np.arange(len(x)) - np.concatenate((np.zeros(starts[0] if len(starts) else len(x), np.int64), np.repeat(starts, np.diff(np.append(starts, len(x))))))
    lower = np.where(kind == UPPER, x + 32, x)
    h = _hashed(lower, starts, ends, own)
    word_row = row[starts] if len(x) else np.zeros(0, int)
    counts = np.bincount(word_row * BUCKETS + (h >> np.uint64(64 - 11)).astype(np.int64), minlength=rows * BUCKETS).reshape(rows, BUCKETS)
    hashed = np.sqrt(counts).astype(np.float32)
    hashed /= np.maximum(np.linalg.norm(hashed, axis=1, keepdims=True), 1e-9)
    marked = kind == MARK
    after = np.bincount(row[1:][marked[1:] & ~marked[:-1] & (kind[:-1] != SPACE) & (row[1:] == row[:-1])], minlength=rows) if len(x) else np.zeros(rows)
    doubled = np.bincount(row[1:][marked[1:] & marked[:-1] & (row[1:] == row[:-1])], minlength=rows) if len(x) else np.zeros(rows)
    total = np.concatenate(([0], np.cumsum(kind == UPPER)))
    small = np.concatenate(([0], np.cumsum(kind == LOWER)))
    loud = (total[ends] - total[starts] > 1) & (small[ends] == small[starts])
    line_start, line_end = _pieces(x != 10, row)
    if len(x):
        line_own = np.arange(len(x)) - np.maximum.accumulate(np.where(np.isin(np.arange(len(x)), line_start), np.arange(len(x)), 0))
        line_hash = _hashed(x, line_start, line_end, line_own)
        lines, again = np.bincount(row[line_start], minlength=rows), _repeated(rows, row[line_start], line_hash)
    else:
        lines, again = np.zeros(rows), np.zeros(rows)
    size, many = np.maximum(n, 1), np.maximum(words, 1)
    shape = np.column_stack(
        (
            np.log1p(n) / 10,
            np.log1p(words) / 10,
            (n - by[:, SPACE]) / many / 10,
            by[:, UPPER] / size,
            by[:, DIGIT] / size * 4,
            by[:, MARK] / size * 4,
            after / many,
            doubled / many,
            np.bincount(word_row[loud], minlength=rows) / many,
            np.log1p(lines) / 5,
            np.log1p(words / np.maximum(lines, 1)) / 5,
            _repeated(rows, word_row, h),
            again,
            by[:, HIGH] / size,
            np.log1p(np.maximum(np.nan_to_num(stated), 0)) / 10,
        )
    )
    return np.concatenate((hashed, shape.astype(np.float32)), axis=1)


def batches_of(text, stated) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end row, features) of Arrow columns of texts and stated lengths, a few rows at a time."""
    data, offsets = text_buffer(text)
    stated = stated.cast(pa.float64()).to_numpy(zero_copy_only=False)
    for a, b in runs(offsets, RUN_BYTES):
        for i in range(a, b, RUN_ROWS):
            j = min(i + RUN_ROWS, b)
            yield i, j, features(data, offsets[i : j + 1], stated[i:j])


@dataclass
class Machine:
    w0: float
    w: np.ndarray
    v: np.ndarray
    scale: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        x = x * self.scale
        return self.w0 + x @ self.w + 0.5 * (((x @ self.v) ** 2).sum(1) - (x**2) @ (self.v**2).sum(1))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30).astype(float)))


def train(x: np.ndarray, y: np.ndarray, passes: int = 40, size: int = 200, rate: float = 0.02, decay: float = 1e-4, seed: int = 3) -> Machine:
    """Adam on the logistic loss in small batches; y is 0 or 1. One class only: its constant."""
    rng = np.random.default_rng(seed)
    scale = np.ones(x.shape[1], np.float32)
    scale[BUCKETS:] = 1 / np.maximum(x[:, BUCKETS:].std(0), 0.02)
    x = x * scale
    mean = float(np.clip(y.mean(), 0.001, 0.999))
    p = [np.array([np.log(mean / (1 - mean))], np.float32), np.zeros(x.shape[1], np.float32), rng.normal(0, 0.01, (x.shape[1], FACTORS)).astype(np.float32)]
    m, s, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    if 0 < y.mean() < 1:
        for _ in range(passes):
            order = rng.permutation(len(x))
            for a in range(0, len(x), size):
                t += 1
                b, z = x[order[a : a + size]], y[order[a : a + size]]
                inner, square = b @ p[2], b**2
                margin = p[0] + b @ p[1] + 0.5 * ((inner**2).sum(1) - square @ (p[2] ** 2).sum(1))
                slope = ((1 / (1 + np.exp(-np.clip(margin, -30, 30))) - z) / len(b)).astype(np.float32)
                g = [slope.sum(keepdims=True), slope @ b + decay * p[1], b.T @ (slope[:, None] * inner) - (slope @ square)[:, None] * p[2] + decay * p[2]]
                for i in range(3):
                    m[i] += 0.1 * (g[i] - m[i])
                    s[i] += 0.01 * (g[i] ** 2 - s[i])
                    p[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.99**t)) + 1e-8)
    return Machine(float(p[0][0]), p[1], p[2], scale)


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, x in batches_of(batch.column(1), batch.column(2)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(3).slice(i, j - i), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], ["quality", "h", "x"])


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Trained on at most `sample` labelled documents outside the held-out fold, lowest hashes of their ids first.

    Labels other than 0 and 1, or null, teach nothing; an id with several labels has the least. Without any
    label every score is 0.5. The tasks count the sampled texts; the driver gets their features.
    """
    rows = labels.where(~held_out() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("n_chars").cast("double").alias("n_chars")).join(F.broadcast(chosen), "doc_id")
    # an id with several texts teaches with the one of the lowest hash
    one = texts.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("doc_id", "text").alias("h"), "text", "n_chars", "quality")).alias("r"))
    made = one.select("r.quality", "r.text", "r.n_chars", "r.h").mapInArrow(_counted, "quality int, h long, x binary").toArrow()
    if not made.num_rows:
        return Machine(0.0, np.zeros(BUCKETS + len(SHAPE), np.float32), np.zeros((BUCKETS + len(SHAPE), 1), np.float32), np.ones(BUCKETS + len(SHAPE), np.float32))
    order = np.argsort(made.column("h").to_numpy(), kind="stable")
    x = np.frombuffer(b"".join(made.column("x").to_pylist()), np.float16).reshape(made.num_rows, -1).astype(np.float32)
    return train(x[order], made.column("quality").to_numpy()[order].astype(np.float32))


def scored(docs: DataFrame, model: Machine, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep`, `score` (0 to 1; nearer 1: of quality) and `predicted` (1 from 0.5 on) of every row.

    Only text and n_chars are looked at. Null and empty texts are scored by their statistics like any
    other; a null n_chars counts as 0. Repeated rows get equal scores; an empty table gives no rows. Columns
    named score or predicted are replaced.
    """
    keep = tuple(c for c in keep if c not in ("score", "predicted"))
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = len(keep)
            for i, j, x in batches_of(batch.column(k), batch.column(k + 1)):
                score = model.score(x)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns[:k], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    fields = T.StructType([*kept.schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("_text"), F.col("n_chars").cast("double").alias("_stated")).mapInArrow(of_batches, fields)
