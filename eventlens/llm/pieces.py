"""SentencePiece encoding and decoding for vocabularies of merges.

A text starts as single characters. An agenda holds every adjacent pair whose joined string is a piece,
highest score first, leftmost first among equals; the best is merged and its new neighbours enter, until
the agenda is empty. What is left are pieces or, by fallback, bytes.

No piece of such a vocabulary has a space mark after another character, so that merges never cross from one
word into the next one's mark: words are segmented one by one, and a bounded table keeps those met before.
"""

from __future__ import annotations

import heapq
import re
import string
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.llm.common import runs, text_buffer
from eventlens.llm.worker import kept

MARK = "▁"
WORDS_KEPT = 160_000
SHORT = 32
NEVER = float("-inf")
RUN_BYTES = 2 << 20
NORMAL, USER, UNUSED, BYTE = 1, 4, 5, 6


class Vocabulary:
    """Pieces, scores and the word table of a model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only merge-type models that leave texts as they are can be used")
        if any(p.type in (USER, UNUSED) for p in model.pieces):
            raise ValueError("models with user-defined or unused pieces can't be used")
        self.prefix = spec.add_dummy_prefix
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.byte = [0] * 256
        self.output: list[bytes] = []
        self.unknown = self.library.unk_id()
        self.fallback = model.trainer_spec.byte_fallback
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                value = int(p.piece[3:-1], 16)
                self.byte[value] = i
                self.output.append(bytes([value]))
            elif p.type == NORMAL:
                self.output.append(p.piece.replace(MARK, " ").encode())
            else:
                self.output.append(model.trainer_spec.unk_surface.encode() if i == self.unknown else b"")
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece has a space mark after another character")
        joined = "".join(p for p in self.score if len(p) > 1)
        alone = re.escape("".join(c for c in "\n\r\t" if c not in joined))
        self.splitter = re.compile(f" *[^ {alone}]+| +" + f"|[{alone}]" * bool(alone))
        self.beside = {a + b for p in self.score for a, b in zip(p.replace(MARK, " "), p[1:].replace(MARK, " "), strict=False)}
        # words met lately; a full table becomes the one before
        self.known: dict[str, tuple[int, ...]] = {}
        self.before: dict[str, tuple[int, ...]] = {}

    def looked_up(self, word: str) -> tuple[int, ...]:
        """Ids of a word that the table lacks. Trailing punctuation that no piece has after the letter before it is cut off."""
        found = self.before.get(word)
        if found is None:
            stem = word.rstrip(string.punctuation)
            n = len(stem)
            if 0 < n < len(word) and word[n - 1 : n + 1] not in self.beside:
                known, tail = self.known, word[n:]
                found = (known.get(stem) or self.looked_up(stem)) + (known.get(tail) or self.looked_up(tail))
            else:
                found = self.segment(word)
        self.known[word] = found
        return found

    def segment(self, word: str) -> tuple[int, ...]:
        """Ids of a word, its spaces given as spaces."""
        symbols = list(word.replace(" ", MARK))
        symbols = self.merged(symbols) if len(symbols) <= SHORT else self.merged_by_heap(symbols)
        out: list[int] = []
        for s in symbols:
            if (i := self.ids.get(s)) is not None:
                out.append(i)
            elif self.fallback:
                out.extend([self.byte[x] for x in s.encode()])
            elif out[-1:] != [self.unknown]:
                out.append(self.unknown)
        return tuple(out)

    def merged(self, symbols: list[str]) -> list[str]:
        """For short words the agenda is a list of the pairs' scores in the order of the text."""
        score = self.score.get
        agenda = [score(a + b, NEVER) for a, b in zip(symbols, symbols[1:], strict=False)]
        while agenda and (best := max(agenda)) != NEVER:
            i = agenda.index(best)
            symbols[i] += symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = score(symbols[i] + symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = score(symbols[i - 1] + symbols[i], NEVER)
        return symbols

    def merged_by_heap(self, symbols: list) -> list[str]:
        n, score = len(symbols), self.score
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[float, int, int, str]] = []

        def propose(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (found := score.get(pair := symbols[a] + symbols[b])) is not None:
                heapq.heappush(agenda, (-found, a, b, pair))

        for i in range(n - 1):
            propose(i, i + 1)
        while agenda:
            _, a, b, pair = heapq.heappop(agenda)
            if symbols[a] is None or symbols[b] is None or len(symbols[a]) + len(symbols[b]) != len(pair) or right[a] != b:
                continue  # a symbol of the pair has been merged since
            symbols[a], symbols[b] = pair, None
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            propose(left[a], a)
            propose(a, right[a])
        return [s for s in symbols if s is not None]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; words are looked up once for all of them."""
        first = " " if self.prefix else ""
        words = [self.splitter.findall(first + t.replace(MARK, " ")) if t else [] for t in texts]
        if len(self.known) >= WORDS_KEPT:
            self.known, self.before = {}, self.known
        for word in set().union(*words).difference(self.known):
            self.looked_up(word)
        ids = self.known.__getitem__
        return [list(chain.from_iterable(map(ids, w))) for w in words]

    def decode(self, ids: Iterable[int]) -> str:
        made = b"".join(map(self.output.__getitem__, ids))
        return (made[1:] if self.prefix and made[:1] == b" " else made).decode("utf-8", "replace")

    def check(self, text: str, ids: list[int], decoded: str) -> None:
        """Raise unless the sentencepiece library does the same with the text."""
        if self.library.encode(text) != ids or self.library.decode(ids) != decoded:
            raise ValueError(f"segmentation differs from the library's for a text of {len(text)} characters")


def vocabulary(path: str) -> Vocabulary:
    return kept(("pieces", path), lambda: Vocabulary(path))


def encoded(docs: DataFrame, model_file: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep`, the token `ids` of each text, and `decoded`, the text those ids give.

    Null texts are empty and have no ids. No begin or end ids. Repeated rows are rows like others; an empty
    table gives no rows. `ids` and `decoded` replace columns of that name. In each Arrow batch, the first text
    of every run of `RUN_BYTES` is checked against the library; the task fails if they differ.
    """
    keep = tuple(c for c in keep if c not in ("ids", "decoded"))
    fields = docs.select(*[F.col(f"`{c}`") for c in keep]).schema

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary(model_file)
        for batch in batches:
            data, offsets = text_buffer(batch.column(len(keep)))
            view = memoryview(data)
            for a, b in runs(offsets, RUN_BYTES):
                run = [str(view[x:y], "utf-8", "replace") for x, y in zip(offsets[a:b].tolist(), offsets[a + 1 : b + 1].tolist(), strict=True)]
                ids = model.encode(run)
                decoded = [model.decode(x) for x in ids]
                model.check(run[0], ids[0], decoded[0])
                bounds = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.fromiter(chain.from_iterable(ids), np.int32, bounds[-1])))
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(keep)], lists, pa.array(decoded, pa.string())], [*keep, "ids", "decoded"])

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("_text")).mapInArrow(of_batches, T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]))


def digests(tokens: DataFrame) -> DataFrame:
    """Number and hash of each row's ids, and the hash of its decoded text."""
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
