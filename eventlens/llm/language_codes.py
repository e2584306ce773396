"""Language identification by error-correcting output codes.

Each learned language gets a codeword of +1 and -1. One logistic classifier over hashed byte n-grams for each
position predicts that bit. A text's language is the codeword with the least loss, summed over the bits with the
logistic loss of their margins; each bit counts by the accuracy it reached in training. If the next codeword's
loss is close, the text is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import held_out, runs, text_buffer

BUCKETS = 4_096
GRAMS = (1, 2, 3, 4)
SAMPLE = 3_000
RUN_BYTES, RUN_ROWS, PIECE = 1 << 18, 64, 1 << 21
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
AMBIGUOUS = 0.1
UNKNOWN = "und"


def _counts(data: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Counts of the n-grams of the bytes, by row and bucket. `row` gives each byte's row."""
    x = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint64)
    out = np.zeros(rows * BUCKETS, np.int64)
    gram = np.zeros(len(x), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        if len(x) < n:
            break
        gram = (gram[: len(x) - n + 1] << np.uint64(8)) | x[n - 1 :]
        if n in GRAMS:
            inside = row[: len(gram)] == row[n - 1 :]
            hashed = ((gram + np.uint64(n << 40)) * MULTIPLIER) >> np.uint64(64 - 12)
            out += np.bincount(row[: len(gram)][inside] * BUCKETS + hashed[inside].astype(np.int64), minlength=len(out))
    return out.reshape(rows, BUCKETS)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Unit vectors of the square roots of n-gram counts, for texts that follow each other in `data`.

    A very long text is counted in pieces, which share the bytes that n-grams need across a cut.
    """
    rows = len(offsets) - 1
    if rows == 1 and offsets[1] - offsets[0] > PIECE:
        counts = np.zeros((1, BUCKETS), np.int64)
        for a in range(int(offsets[0]), int(offsets[1]), PIECE):
            begin = max(int(offsets[0]), a - max(GRAMS) + 1)
            piece = data[begin : min(a + PIECE, int(offsets[1]))]
            counts += _counts(piece, np.zeros(len(piece), np.int64), 1)
            if begin < a:  # counted with the piece before
                shared = data[begin:a]
                counts -= _counts(shared, np.zeros(len(shared), np.int64), 1)
    else:
        row = np.repeat(np.arange(rows), np.diff(offsets))
        counts = _counts(data[offsets[0] : offsets[-1]], row, rows)
    x = np.sqrt(counts).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def batches_of(column) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end row, features) of an Arrow text column, a few rows at a time."""
    data, offsets = text_buffer(column)
    for a, b in runs(offsets, RUN_BYTES):
        for i in range(a, b, RUN_ROWS):
            j = min(i + RUN_ROWS, b)
            yield i, j, features(data, offsets[i : j + 1])


def codewords(languages: int, seed: int = 5) -> np.ndarray:
    """One row of +1 and -1 for each language, about 10 log2 positions, chosen for the largest least distance."""
    length = max(7, int(np.ceil(10 * np.log2(max(languages, 2)))))
    rng, best, apart = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (languages, length))
        split = (np.abs(code.sum(0)) < languages) if languages > 1 else np.ones(length, bool)
        least = min(((code[i] != code[j]) & split).sum() for i in range(languages) for j in range(i)) if languages > 1 else 0
        if least > apart:
            best, apart = code[:, split], least
    return best


@dataclass
class Codes:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    offset: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language index, score and ambiguity of each row."""
        margin = x @ self.weights + self.offset
        loss = np.log1p(np.exp(-np.clip(margin[:, None, :] * self.code[None, :, :], -30, 30))) @ self.trust
        weight = np.exp(loss.min(1, keepdims=True) - loss)
        share = weight / weight.sum(1, keepdims=True)
        ordered = np.sort(loss, axis=1)
        close = (ordered[:, 1] - ordered[:, 0] < AMBIGUOUS * self.trust.sum()) if loss.shape[1] > 1 else np.zeros(len(x), bool)
        return loss.argmin(1), share.max(1), close


def train(x: np.ndarray, languages: list[str], steps: int = 150, rate: float = 0.3) -> Codes:
    """Logistic classifiers for every bit, together, by Adam on the whole sample."""
    names = sorted(set(languages))
    y = np.array([names.index(v) for v in languages])
    code = codewords(len(names)) if len(names) > 1 else np.ones((1, 1))
    target = code[y].astype(np.float32)
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, steps + 1):
        slope = -target / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30))) / len(x)
        g, gb = x.T @ slope + 1e-6 * w, slope.sum(0)
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    right = ((x @ w + b) * target > 0).mean(0)
    trust = np.maximum(2 * right - 1, 0.01)
    return Codes(names, code, w, b, trust / trust.mean())


def learned(docs: DataFrame, sample: int = SAMPLE) -> Codes | None:
    """Trained on at most `sample` rows outside the held-out fold that have a language, lowest hashes of (id, text) first.

    None if there is no such row. The sampled texts are counted in tasks; the driver gets their features.
    """
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", F.xxhash64("doc_id", "text").alias("h"))
    chosen = rows.orderBy("h", "doc_id", "lang").limit(sample)

    texts = docs.withColumn("h", F.xxhash64("doc_id", "text")).join(F.broadcast(chosen.select("h").distinct()), "h").where(~held_out() & F.col("lang").isNotNull())
    # rows that repeat an id and a text teach once, with the least language
    one = texts.groupBy("h").agg(F.min(F.struct("lang", F.col("text").cast("string").alias("text"))).alias("r")).select("r.lang", "r.text")
    found = one.mapInArrow(as_blobs, "lang string, x binary").toArrow()
    if not found.num_rows:
        return None
    x = np.frombuffer(b"".join(found.column("x").to_pylist()), np.float16).reshape(found.num_rows, -1).astype(np.float32)
    langs = found.column("lang").to_pylist()
    order = np.lexsort((np.array(langs), x[:, 0], x[:, 1]))
    return train(x[order], [langs[i] for i in order])


def as_blobs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, x in batches_of(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], ["lang", "x"])


def identified(docs: DataFrame, model: Codes | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1) and ambiguous of every row.

    Only the text decides. A text that is null or has no letter is `und` with score 0, and so is every text if
    nothing was learned. Repeated rows get equal results; an empty table gives no rows; null ids count as held out.
    """

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            pred, score, close = np.zeros(n, int), np.zeros(n), np.zeros(n, bool)
            letters = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            if model is not None:
                for i, j, x in batches_of(batch.column(2)):
                    pred[i:j], score[i:j], close[i:j] = model.decode(x)
            else:
                letters[:] = False
            names = [model.languages[p] if ok else UNKNOWN for p, ok in zip(pred.tolist(), letters.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(close & letters)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"]
            )

    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(of_batches, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double, ambiguous boolean")
