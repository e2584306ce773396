"""Token ids in compressed files: canonical length-limited Huffman codes from global counts.

Files hold blocks of whole documents in ascending doc_id order. A block decodes without any other: it has its documents'
ids and lengths, the bits, and the bit offset of every `STEP`-th id, so that a reader can begin there. All stretches
between such offsets decode side by side, by a table that maps the next 16 bits to an id and its code's length. The
code lengths are stored beside the blocks.

Spark writes and commits both as Parquet, so that a lost executor leaves no half-written file.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm.common import runs, stored, text_buffer
from eventlens.llm.worker import kept
from eventlens.session import new_path

LONGEST = 16
STEP = 256
BLOCK_IDS = 1 << 18
RUN_BYTES = 4 << 20
WORDS_KEPT = 600_000
ASKED, LINE = 8_192, 256
WORDS = re.compile(r"\s+(?!\S)| ?\S+|\s")
JOINED = re.compile(r" [!-~¡-¬®-ɏ]+")


class Tokenizer:
    """A byte-level tokenizer of the tokenizers library, asked once for each word.

    Its pre-tokenizer cuts at white space, of which at most one space joins the next word, between letters and digits, and between either and punctuation
    that follows. So words are encoded apart; a bounded table keeps those met lately. Texts with
    special tokens or with characters on which ideas of white space differ go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        spec = json.loads(self.library.to_str())
        cutter = spec["pre_tokenizer"] or {}
        self.by_word = cutter.get("type") == "ByteLevel" and cutter.get("use_regex") and not cutter.get("add_prefix_space") and spec["normalizer"] is None and not spec["model"].get("ignore_merges")
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        #: Bytes that each id stands for: the vocabulary spells every byte as one character.
        self.bytes_of = np.zeros(self.library.get_vocab_size(), np.int64)
        for token, i in self.library.get_vocab().items():
            self.bytes_of[i] = len(token)
        self.known, self.before = Words(), Words()

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learned(self, words: pa.Array) -> np.ndarray:
        """Numbers in the table of different words; those it lacks are entered, from the table before or by asking the library."""
        number = self.known.find(words)
        lacking = np.nonzero(number < 0)[0]
        if len(lacking):
            old = self.before.find(words.take(pa.array(lacking)))
            again, new = np.nonzero(old >= 0)[0], np.nonzero(old < 0)[0]
            first = len(self.known)
            self.known.put(words.take(pa.array(lacking[again])), *self.before.ids(old[again]))
            asked = words.take(pa.array(lacking[new])).cast(pa.string()).to_pylist()
            # behind a solid end, a single space before a solid character begins a word, so such words can be asked for in one text
            joined = np.fromiter((JOINED.fullmatch(w) is not None for w in asked), bool, len(asked))
            order = np.concatenate((new[joined], new[~joined]))
            for apart, some in self.portions([w for w, j in zip(asked, joined, strict=True) if j], [w for w, j in zip(asked, joined, strict=True) if not j]):
                data = [w.encode() for w in some]
                if apart:
                    ids = self.whole(some)
                    size, ids = np.fromiter(map(len, ids), np.int64, len(ids)), np.fromiter(chain.from_iterable(ids), np.uint32)
                else:
                    ids = np.fromiter(chain.from_iterable(self.whole(["".join(some[k : k + LINE]) for k in range(0, len(some), LINE)])), np.uint32)
                    ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(list(map(len, data)))) + 1
                    size = np.diff(ends, prepend=0)
                self.known.put(pa.array(data, pa.binary()), size, ids)
            number[lacking[np.concatenate((again, order))]] = np.arange(first, len(self.known))
        return number

    @staticmethod
    def portions(joined: list[str], apart: list[str]) -> Iterator[tuple[bool, list[str]]]:
        """Words in portions, as the library's answers are large."""
        for alone, words in ((False, joined), (True, apart)):
            for i in range(0, len(words), ASKED):
                yield alone, words[i : i + ASKED]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        data = [t.encode() for t in texts]
        return self.encode_bytes(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))

    def encode_bytes(self, data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """Ids of the texts data[bounds[i] : bounds[i + 1]], UTF-8.

        Words of texts whose only white space is ASCII are cut and numbered all at once, and only the different ones become Python strings.
        """
        n = len(bounds) - 1
        view = memoryview(data)
        text = lambda i: str(view[bounds[i] : bounds[i + 1]], "utf-8", "replace")
        whole, spaced = self.exceptions(data, bounds)
        fast = np.ones(n, bool)
        fast[[*whole, *spaced]] = False
        if len(self.known) >= WORDS_KEPT:
            self.known, self.before = Words(), self.known
        pos = word_starts(data, bounds)
        doc = np.searchsorted(bounds, pos, side="right") - 1
        counts = np.bincount(doc[fast[doc]], minlength=n) if len(pos) else np.zeros(n, np.int64)
        cut = pa.Array.from_buffers(pa.binary(), len(pos), [None, pa.py_buffer(np.append(pos, len(data)).astype(np.int32)), pa.py_buffer(data)])
        if not fast.all():
            cut = cut.filter(pa.array(fast[doc]))
        coded = cut.dictionary_encode()
        number, sizes = self.learned(coded.dictionary)[coded.indices.to_numpy()], counts
        if spaced:
            lists = [WORDS.findall(text(i)) for i in spaced]
            different = sorted(set().union(*lists))
            at = dict(zip(different, self.learned(pa.array([w.encode() for w in different], pa.binary())).tolist(), strict=True))
            numbers = np.split(number, np.cumsum(counts)[:-1])
            for i, words in zip(spaced, lists, strict=True):
                numbers[i] = np.fromiter(map(at.__getitem__, words), np.int64, len(words))
            number, sizes = np.concatenate(numbers), np.fromiter(map(len, numbers), np.int64, n)
        size, ids = self.known.ids(number)
        ends = np.cumsum(size)
        out = np.split(ids, np.concatenate(([0], ends))[np.cumsum(sizes)[:-1]]) if n else []
        for i, found in zip(whole, self.whole([text(i) for i in whole]), strict=True):
            out[i] = np.array(found, np.uint32)
        if n and out[0].tolist() != self.whole([text(0)])[0]:
            raise ValueError("ids differ from the library's")
        return out

    def exceptions(self, data: np.ndarray, bounds: np.ndarray) -> tuple[list[int], list[int]]:
        """Texts for the library as a whole (special tokens, white space that is none elsewhere, broken UTF-8), and those with white space beyond ASCII."""
        n = len(bounds) - 1
        if not self.by_word:
            return list(range(n)), []
        odd = [np.nonzero((data >= 0x1C) & (data <= 0x1F))[0]]
        raw = data.tobytes()
        for special in self.special:
            at = raw.find(special)
            while at >= 0:
                odd.append(np.array([at]))
                at = raw.find(special, at + 1)
        lead = np.nonzero(LEADS[data])[0]
        first, second, third = (np.append(data, [0, 0]).astype(np.int64)[lead + k] for k in range(3))
        two, three = first << 8 | second, first << 16 | second << 8 | third
        odd.append(lead[(two == 0xC285) | (three == 0xE1A08E)])
        wide = lead[(two == 0xC2A0) | np.isin(three, WIDE_SPACES)]
        texts = lambda places: set((np.searchsorted(bounds, places, side="right") - 1).tolist())
        whole = set().union(*map(texts, odd))
        try:
            str(raw, "utf-8")
        except UnicodeDecodeError:
            for i in range(n):
                try:
                    str(raw[bounds[i] : bounds[i + 1]], "utf-8")
                except UnicodeDecodeError:
                    whole.add(i)
        return sorted(whole), sorted(texts(wide) - whole)


#: First bytes of white space beyond ASCII, and its characters of three bytes.
LEADS = np.isin(np.arange(256), (0xC2, 0xE1, 0xE2, 0xE3))
WIDE_SPACES = [int.from_bytes(chr(c).encode()) for c in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
BLANK = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))


def word_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """First bytes of the words that `WORDS` finds in each text, where all white space is ASCII, cut further where the pre-tokenizer surely does.

    Of a run of white space before other characters, the last one joins them if it is a space, or else is a word; what precedes it is another
    word. Between a letter and a digit, and after either before ASCII punctuation, a new word begins: no token of the pre-tokenizer holds both.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    blank = BLANK[data]
    first = np.zeros(len(data), bool)
    first[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    after = np.append(False, blank[:-1]) & ~first  # white space precedes, in the same text
    start = first | (blank & ~after)
    solid = np.nonzero(after & ~blank)[0]
    start[solid - 1] = True
    start[solid[data[solid - 1] != 32]] = True
    kind = KINDS[data]
    # the last byte of a letter of two bytes is as good as a letter, but for the signs of multiplication and division
    pair = np.nonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC8) & (kind[1:] == OTHER))[0]
    kind[pair[(data[pair] != 0xC3) | ((data[pair + 1] != 0x97) & (data[pair + 1] != 0xB7))] + 1] = LETTER
    a, b = kind[:-1], kind[1:]
    start[1:] |= ((a == LETTER) & ((b == MARK) | (b == DIGIT))) | ((a == DIGIT) & ((b == MARK) | (b == LETTER) & (data[1:] < 128)))
    return np.nonzero(start)[0]


#: Kinds of bytes: ASCII letters, digits and punctuation, and all others.
OTHER, LETTER, DIGIT, MARK = range(4)
KINDS = np.array([OTHER if not 32 < c < 127 else LETTER if chr(c).isalpha() else DIGIT if chr(c).isdigit() else MARK for c in range(256)], np.uint8)


class Words:
    """Different words and the ids of each, one word after another in one array."""

    def __init__(self):
        self.words = pa.array([], pa.binary())
        self.bounds, self.pool = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def __len__(self) -> int:
        return len(self.words)

    def find(self, words: pa.Array) -> np.ndarray:
        """Number of each word, -1 for those that are not there."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)

    def put(self, words: pa.Array, size: np.ndarray, ids: np.ndarray) -> None:
        """Enter words that are not there yet."""
        if len(size) != len(words) or size.sum() != len(ids):
            raise ValueError("ids don't add up to the words")
        self.words = pa.concat_arrays([self.words, words])
        self.bounds = np.concatenate((self.bounds, self.bounds[-1] + np.cumsum(size)))
        self.pool = np.concatenate((self.pool, ids))

    def ids(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of these words has, and all of them in order."""
        size = self.bounds[number + 1] - self.bounds[number]
        ends = np.cumsum(size)
        return size, self.pool[np.repeat(self.bounds[number] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def tokens(docs: DataFrame, tokenizer_file: str, end_id: int) -> DataFrame:
    """Rows of kind 0: doc_id, n ids, compressed ids of every text and `end_id`; of kind 1: a task's count of each id."""

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = kept(("tokenizer", tokenizer_file), lambda: Tokenizer(tokenizer_file))
        squeeze, counts = zstandard.ZstdCompressor(level=1), np.zeros(1 << 17, np.int64)
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b in runs(offsets, RUN_BYTES):
                ids = [np.append(x, np.uint32(end_id)) for x in model.encode_bytes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]
                got = np.bincount(np.concatenate(ids))
                if len(got) > len(counts):
                    counts = np.concatenate((counts, np.zeros(len(got), np.int64)))
                counts[: len(got)] += got
                rows = batch.slice(a, b - a)
                wide = max(int(x.max()) for x in ids) >= 1 << 16
                blobs = [squeeze.compress(x.astype("<u4" if wide else "<u2").tobytes()) for x in ids]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, 4 if wide else 2, np.int32)), rows.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(blobs, pa.binary())], KEPT_NAMES)
        used = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([None], pa.int64()), pa.array([len(used)], pa.int64()), pa.array([np.stack((used, counts[used])).astype("<i8").tobytes()], pa.binary())], KEPT_NAMES)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(of_batches, "kind int, doc_id long, n long, ids binary")


KEPT_NAMES = ["kind", "doc_id", "n", "ids"]


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts added up, as (id, count) rows."""
    total: dict[int, int] = {}
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            ids, counts = np.frombuffer(blob, "<i8").reshape(2, -1)
            for i, c in zip(ids.tolist(), counts.tolist(), strict=True):
                total[i] = total.get(i, 0) + c
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["id", "count"])


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `longest` bits, by package-merge; 0 for ids that don't occur."""
    used = np.nonzero(counts)[0]
    lengths = np.zeros(len(counts), np.int64)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} ids need codes of more than {longest} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    coins = counts[order].astype(np.int64)
    n, levels, current = len(coins), [], coins
    leaf = np.ones(n, bool)
    for _ in range(longest - 1):
        levels.append(leaf)
        packages = current[: len(current) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate((coins, packages))
        at = np.argsort(both, kind="stable")
        current, leaf = both[at], at < n
    levels.append(leaf)
    take, out = 2 * n - 2, np.zeros(n, np.int64)
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        out[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = out
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, id)."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    for length in np.unique(lengths[order]).tolist():
        code <<= length - last
        same = order[lengths[order] == length]
        codes[same] = code + np.arange(len(same), dtype=np.uint64)
        code, last = code + len(same), length
    return codes


def packed_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The ids' codes one after another, highest bit first, and the bit offset of every STEP-th id."""
    n = lengths[ids]
    end = np.cumsum(n)
    at = end - n
    # each code lies in at most two 32-bit words; their parts never overlap, so adding them sets the bits
    part = codes[ids] << (np.uint64(64) - n.astype(np.uint64) - (at & 31).astype(np.uint64))
    words = np.zeros(int(end[-1] if len(end) else 0) // 32 + 3, np.uint64)
    slot = at >> 5
    first = np.nonzero(np.concatenate(([True], slot[1:] != slot[:-1])))[0][: len(slot)]
    if len(slot):
        words[slot[first]] += np.add.reduceat(part >> np.uint64(32), first)
        words[slot[first] + 1] += np.add.reduceat(part & np.uint64(0xFFFFFFFF), first)
    return words.astype(">u4").tobytes(), at[::STEP].astype("<u4")


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id and code length for every value of the next LONGEST bits."""
    codes = canonical(lengths)
    used = np.nonzero(lengths)[0]
    used = used[np.argsort(codes[used] << (np.uint64(LONGEST) - lengths[used].astype(np.uint64)), kind="stable")]
    span = 1 << (LONGEST - lengths[used])
    ids = np.zeros(1 << LONGEST, np.uint32)
    size = np.ones(1 << LONGEST, np.int64)
    ids[: span.sum()], size[: span.sum()] = np.repeat(used, span), np.repeat(lengths[used], span)
    return ids, size


def unpacked(bits: list[bytes], counts: list[int], offsets: list[np.ndarray], ids: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Ids of several blocks. All stretches of all blocks advance together, an id at a time."""
    words = [np.frombuffer(b, ">u4") for b in bits]
    base = np.cumsum([0, *map(len, words)])
    text = np.concatenate([*words, np.zeros(1, ">u4")]).astype(np.uint64)
    pair = (text[:-1] << np.uint64(32)) | text[1:]
    at = np.concatenate([o.astype(np.int64) + 32 * b for o, b in zip(offsets, base[:-1].tolist(), strict=True)])
    out = np.zeros((STEP, len(at)), np.uint32)
    for k in range(STEP):
        peek = (pair[at >> 5] >> (np.uint64(64 - LONGEST) - (at & 31).astype(np.uint64))).astype(np.int64) & ((1 << LONGEST) - 1)
        out[k] = ids[peek]
        at = np.minimum(at + size[peek], 32 * (len(pair) - 1))
    flat, made, first = out.T, [], 0
    for n, o in zip(counts, offsets, strict=True):
        made.append(np.ascontiguousarray(flat[first : first + len(o)]).ravel()[:n])
        first += len(o)
    return made


def written(docs: DataFrame, tokenizer_file: str, end_id: int, path: str) -> None:
    """Token files of all documents under `path`: `blocks` and `codes`.

    Null texts are empty and have the end id alone. Null ids come first; rows of equal ids stand by the hash of their
    ids. Repeated rows are rows like others; an empty table gives empty files.
    """
    made = stored(tokens(docs, tokenizer_file, end_id), "tokens")
    counted = made.where("kind = 1").select("ids").coalesce(64).mapInArrow(_pairs, "id long, count long")
    rows = counted.groupBy("id").agg(F.sum("count").alias("count")).collect()  # a row for each id of the vocabulary at most
    counts = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["count"]
    lengths = code_lengths(counts)
    codes = canonical(lengths)

    def coded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, number, open_ = TaskContext.get().partitionId(), 0, zstandard.ZstdDecompressor()
        docs_, ids = [], []

        def block() -> pa.RecordBatch:
            nonlocal number, docs_, ids
            whole = np.concatenate(ids)
            bits, offsets = packed_bits(whole, codes, lengths)
            row = [file, number, [d for d in docs_], [len(x) for x in ids], offsets.tobytes(), bits]
            number, docs_, ids = number + 1, [], []
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()), strict=True)], ["file", "block", "doc_ids", "lengths", "offsets", "bits"])

        held = 0
        for batch in batches:
            for kind, doc, n, blob in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                docs_.append(doc)
                ids.append(np.frombuffer(open_.decompress(blob, max_output_size=n * kind), "<u4" if kind == 4 else "<u2").astype(np.int64))
                held += n
                if held >= BLOCK_IDS:
                    yield block()
                    held = 0
        if docs_:
            yield block()

    parts = max(1, made.rdd.getNumPartitions())
    rows_ = made.where("kind <> 1").select("kind", "doc_id", "n", "ids")
    ordered = rows_.repartitionByRange(parts, "doc_id", F.xxhash64("ids")).sortWithinPartitions("doc_id", F.xxhash64("ids"))
    ordered.mapInArrow(coded, "file int, block int, doc_ids array<long>, lengths array<long>, offsets binary, bits binary").write.option("compression", "none").parquet(f"{path}/blocks")
    spark = docs.sparkSession
    used = np.nonzero(lengths)[0]
    spark.createDataFrame(list(zip(used.tolist(), lengths[used].tolist(), strict=True)), "id int, bits int").coalesce(1).write.parquet(f"{path}/codes")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and `ids` (little-endian 32-bit) of each document in the files."""
    blocks = spark.read.parquet(f"{path}/blocks")
    book = spark.read.parquet(f"{path}/codes").collect()  # a row for each id of the vocabulary at most
    lengths = np.zeros(max((r["id"] for r in book), default=0) + 1, np.int64)
    for r in book:
        lengths[r["id"]] = r["bits"]
    # one row for each block, without its bits
    sizes = blocks.select("file", "block", F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x).alias("n"))
    files = sizes.groupBy("file").agg(F.sum("n").alias("n"))
    starts = files.select(F.col("file").alias("_file"), F.expr("coalesce(sum(n) over (order by file rows between unbounded preceding and 1 preceding), 0)").alias("_start"))
    inside = sizes.select(F.col("file").alias("_f"), F.col("block").alias("_b"), F.expr("coalesce(sum(n) over (partition by file order by block rows between unbounded preceding and 1 preceding), 0)").alias("_inside"))
    placed = inside.join(starts, F.col("_f") == F.col("_file")).select("_f", "_b", (F.col("_start") + F.col("_inside")).alias("start"))
    joined = blocks.join(placed, (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b"))).select("start", "doc_ids", "lengths", "offsets", "bits")

    def decoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, size = decode_table(lengths)
        for batch in batches:
            for i in range(0, batch.num_rows, 8):
                rows = batch.slice(i, 8)
                start, docs, counts, offsets, bits = (c.to_pylist() for c in rows.columns)
                made = unpacked(bits, [sum(c) for c in counts], [np.frombuffer(o, "<u4") for o in offsets], ids, size)
                out = []
                for s, d, c, x in zip(start, docs, counts, made, strict=True):
                    cut = np.cumsum([0, *c])
                    out += [(doc, s + int(a), int(b - a), x[a:b].astype("<u4").tobytes()) for doc, a, b in zip(d, cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64() if k < 3 else pa.binary()) for k in range(4)], ["doc_id", "start", "n_tokens", "ids"])

    return joined.mapInArrow(decoded, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer_file: str, end_id: int = 2) -> DataFrame:
    """The documents as read back from files written to the shared folder."""
    spark = docs.sparkSession
    path = new_path(spark, "token-files")
    written(docs, tokenizer_file, end_id, path)
    return read(spark, path)
