"""Removal of passages that an earlier document has: suffix arrays over the text that can match at all.

Whole suffix arrays of a corpus would compare every shard with every other. So every 50-byte string is named by the least
hash of its 26-byte pieces; equal strings have equal names, and neighbouring strings mostly share one. Neighbours of one
name make a segment.

1. Each shard of documents sends its different names to buckets of names. A bucket answers which names occur in two or
   more documents, and which are common ("hot").
2. Each shard sends its segments with such names, identical ones once with their smallest doc_id. Strings of hot names go
   one by one, dealt by their content, so that no bucket gets a common passage with all its surroundings. A bucket
   builds suffix arrays, by Larsson-Sadakane refinement, of blocks of its differing segments, takes common prefixes of
   neighbours, joins the blocks' equal strings by binary search, and answers which strings a smaller doc_id has.
3. Each shard puts its answers together and cuts the bytes out.

Texts travel compressed, and are bounded: a shard has about `SHARD_BYTES`, or one longer document. Names and
contents of segments are compared by 64-bit hashes of each, together with the length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import runs, stored, text_buffer

LENGTH = 50
PIECE = 26
SPAN = LENGTH - PIECE + 1
SHARD_BYTES = 8 << 20
BUCKET_BYTES = 4 << 20
RUN_BYTES = 1 << 20
BLOCK_BYTES = 4 << 20
HOT_DOCS, HOT_SHARDS = 64, 4_096
NO_ID = np.iinfo(np.int64).max
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX = np.uint64(0xD6E8FEB86659FD93)


def packed(docs: DataFrame, shards: int) -> DataFrame:
    """Rows (shard, kind 1, ids, lengths, compressed texts); null texts are empty, null ids count as the largest."""

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            shard, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            out = []
            for s in np.unique(shard).tolist():
                rows = np.nonzero(shard == s)[0]
                body = b"".join(data[offsets[r] : offsets[r + 1]].tobytes() for r in rows.tolist())
                out.append((s, 1, ids[rows].astype("<i8").tobytes(), (offsets[rows + 1] - offsets[rows]).astype("<i8").tobytes(), squeeze.compress(body)))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int32() if k < 2 else pa.binary()) for k in range(5)], ["shard", "kind", "a", "b", "c"])

    rows = docs.select(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(shards)).cast("int"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.col("text").cast("string"))
    return rows.mapInArrow(of_batches, SENT)


SENT = "shard int, kind int, a binary, b binary, c binary"


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2**64."""
    return np.cumprod(np.full(n, BASE, np.uint64), dtype=np.uint64), np.cumprod(np.full(n, INVERSE, np.uint64), dtype=np.uint64)


class Shard:
    """The documents of one shard, ordered by id, then text."""

    def __init__(self, parts: list[tuple[bytes, bytes, bytes]]):
        open_ = zstandard.ZstdDecompressor()
        docs = []
        for ids, lengths, body in parts:
            n = np.frombuffer(lengths, "<i8")
            body = open_.decompress(body, max_output_size=int(n.sum()) + 1) if n.sum() else b""
            ends = np.cumsum(n)
            docs += [(i, body[e - k : e]) for i, k, e in zip(np.frombuffer(ids, "<i8").tolist(), n.tolist(), ends.tolist(), strict=True)]
        docs.sort()
        self.ids = np.array([d[0] for d in docs], np.int64)
        self.offsets = np.concatenate(([0], np.cumsum([len(d[1]) for d in docs]))).astype(np.int64)
        self.data = np.frombuffer(b"".join(d[1] for d in docs), np.uint8)

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(name, row, first string's place in `data`, number of strings) of every segment, and contents' hashes."""
        out, power, back = [], *powers(0)
        for a, b in runs(self.offsets, RUN_BYTES):
            base, end = int(self.offsets[a]), int(self.offsets[b])
            x = self.data[base:end]
            if len(x) < LENGTH:
                continue
            if len(x) > len(power):
                power, back = powers(max(len(x), RUN_BYTES))
            total = np.zeros(len(x) + 1, np.uint64)
            np.cumsum((x.astype(np.uint64) + np.uint64(1)) * power[: len(x)], out=total[1:])
            h = (total[PIECE:] - total[:-PIECE]) * back[: len(x) - PIECE + 1]
            h = (h ^ (h >> np.uint64(32))) * MIX
            h ^= h >> np.uint64(29)
            reach = 1
            while 2 * reach <= SPAN:
                h = np.minimum(h[:-reach], h[reach:])
                reach *= 2
            rest = SPAN - reach
            name = np.minimum(h[: len(h) - rest], h[rest:]) if rest else h
            # least hashes are small numbers; mixed again, they spread over the buckets
            name = (name ^ (name >> np.uint64(32))) * MIX
            name = (name ^ (name >> np.uint64(29))) * BASE
            edge = np.ones(len(name) + 1, bool)
            np.not_equal(name[1:], name[:-1], out=edge[1:-1])
            ends = self.offsets[a + 1 : b + 1] - base
            edge[ends[ends < len(name)]] = True
            whole = np.ones(len(name), bool)
            for e in ends.tolist():  # no string begins in the last bytes of a document
                whole[max(0, e - LENGTH + 1) : e] = False
            edge[1:-1] |= whole[1:] != whole[:-1]
            first, stop = np.nonzero(edge[:-1] & whole)[0], np.nonzero(edge[1:] & whole)[0] + 1
            row = np.searchsorted(self.offsets, first + base, side="right") - 1
            n = stop - first
            text = (total[stop + LENGTH - 1] - total[first]) * back[first]
            out.append((name[first], row, first + base, n, (text ^ (text >> np.uint64(32))) * MIX))
        return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, t) for k, t in enumerate((np.uint64, np.int64, np.int64, np.int64, np.uint64)))

    def strings(self, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The single strings of segments: (segment, place, hash of the content)."""
        of = np.repeat(np.arange(len(n)), n)
        place = start[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        weights = np.cumprod(np.full(LENGTH, BASE, np.uint64), dtype=np.uint64)
        h = np.zeros(len(of), np.uint64)
        for k in range(LENGTH):
            h += (self.data[place + k].astype(np.uint64) + np.uint64(1)) * weights[k]
        return of, place, (h ^ (h >> np.uint64(32))) * MIX

    def cut(self, start: np.ndarray, n: np.ndarray) -> bytes:
        """Bytes of segments, one after another."""
        return b"".join(self.data[s : s + k + LENGTH - 1].tobytes() for s, k in zip(start.tolist(), n.tolist(), strict=True))


def leading(order_keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For rows grouped by equal keys (the last one is the order in a group): each row's first of its group."""
    order = np.lexsort(order_keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in order_keys[:-1]:
        new[1:] |= k[order][1:] != k[order][:-1]
    head = np.empty(len(order), np.int64)
    head[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    return head, order[new]


def members(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)] == values


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of `text` in the order of the `depth` or more bytes from there on, by Larsson-Sadakane refinement.

    The first sort is by eight bytes. Then each group that is still together is sorted by the ranks `step` further on, and
    `step` doubles.
    """
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, np.uint8))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + n]
    at = np.argsort(key, kind="stable")
    new = np.concatenate(([True], key[at][1:] != key[at][:-1]))[:n]
    rank = np.full(n + 1, -1, np.int64)
    rank[at] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    step = 8
    while step < depth:
        slots = np.nonzero(~(new & np.append(new[1:], True)))[0]
        if not len(slots):
            break
        s = at[slots]
        further = rank[np.minimum(s + step, n)]
        order = np.lexsort((further, rank[s]))
        s, further = s[order], further[order]
        group = rank[s]
        at[slots] = s
        new[slots] = np.concatenate(([True], (group[1:] != group[:-1]) | (further[1:] != further[:-1])))
        rank[s] = np.maximum.accumulate(np.where(new, np.arange(n), 0))[slots]
        step *= 2
    return at


def prefixes_reach(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the common prefix of the suffixes at a and b has `length` bytes or more.

    Kasai's pass gives whole lengths but is sequential; here pairs drop out at their first differing bytes.
    """
    out = np.zeros(len(a), bool)
    left = np.arange(len(a))
    for k in range(length):
        left = left[text[a[left] + k] == text[b[left] + k]]
        if not len(left):
            return out
    out[left] = True
    return out


def least_owner(blob: np.ndarray, start: np.ndarray, n: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For every string of the segments (in order), the least owner of an equal string.

    Segments are cut into blocks of `BLOCK_BYTES`; each block has its suffix array, and equal strings of different blocks
    find each other by binary search.
    """
    size = n + LENGTH - 1
    blocks = np.cumsum(size) // BLOCK_BYTES
    least, heads = np.empty(int(n.sum()), np.int64), []
    shift = np.cumsum(n) - n
    for block in np.unique(blocks).tolist():
        rows = np.nonzero(blocks == block)[0]
        text = np.concatenate([blob[s : s + k] for s, k in zip(start[rows].tolist(), size[rows].tolist(), strict=True)])
        begin = np.cumsum(size[rows]) - size[rows]
        string = np.full(len(text), -1, np.int64)  # number of the string that begins here
        of = np.repeat(np.arange(len(rows)), n[rows])
        inner = np.arange(len(of)) - np.repeat(np.cumsum(n[rows]) - n[rows], n[rows])
        string[begin[of] + inner] = shift[rows][of] + inner
        own = np.full(len(text), NO_ID, np.int64)
        own[begin[of] + inner] = owner[rows][of]
        at = suffix_array(text, LENGTH)
        at = at[string[at] >= 0]
        same = prefixes_reach(text, at[:-1], at[1:], LENGTH) if len(at) else np.zeros(0, bool)
        new = np.concatenate(([True], ~same))
        first = np.nonzero(new)[0]
        low = np.minimum.reduceat(own[at], first)
        group = np.cumsum(new) - 1
        least[string[at]] = low[group]
        words = np.lib.stride_tricks.sliding_window_view(text, LENGTH)[at[first]]
        heads.append((np.ascontiguousarray(words).view(f"S{LENGTH}").ravel(), low, string[at], group))
    for i in range(len(heads)):
        words, low, string, group = heads[i]
        joint = low.copy()
        for j in range(len(heads)):
            if i != j:
                other, their = heads[j][0], heads[j][1]
                k = np.minimum(np.searchsorted(other, words), len(other) - 1)
                joint = np.where(other[k] == words, np.minimum(joint, their[k]), joint)
        least[string] = joint[group]
    return least


def per_key(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of equal first column, which come together, as (key, rows)."""
    at, rows = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            if row[0] != at and rows:
                yield at, rows
                rows = []
            at = row[0]
            rows.append(row)
    if rows:
        yield at, rows


def emitted(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = [(f.split()[0], pa.int32() if f.split()[1] == "int" else pa.binary()) for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], [n for n, _ in kinds])


def grouped(df: DataFrame, key: str, then: str, f, schema: str, parts: int) -> DataFrame:
    """`f(key, rows)` gives rows of `schema` for the rows of each key, which are sorted by `then`."""

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, rows in per_key(batches):
            if out := f(k, rows):
                yield emitted(out, schema)

    return df.repartition(parts, key).sortWithinPartitions(key, then).mapInArrow(of_batches, schema)


def by_bucket(name: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of names by bucket, and where each bucket begins."""
    bucket = (name >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(name), np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange((1 << bits) + 1))


def six(values: np.ndarray) -> bytes:
    """48 bits of each name: enough to tell names of a bucket apart; a mistake only adds a candidate."""
    return np.ascontiguousarray(((values << np.uint64(16)) >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unsix(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def low48(name: np.ndarray) -> np.ndarray:
    return (name << np.uint64(16)) >> np.uint64(16)


def below(name: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits of each name that follow those of its bucket; names that share them are compared string by string."""
    return (name << np.uint64(bits)) >> np.uint64(32)


def content(body: np.ndarray, n: np.ndarray, power: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Hashes of the contents of segments that lie one after another in `body`; `n` is their number of strings."""
    total = np.zeros(len(body) + 1, np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * power[: len(body)], out=total[1:])
    stop = np.cumsum(n + LENGTH - 1)
    first = stop - (n + LENGTH - 1)
    text = (total[stop] - total[first]) * back[first]
    return (text ^ (text >> np.uint64(32))) * MIX


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary, the remaining bytes) of every row.

    A byte goes if a 50-byte string that covers it also starts anywhere in a document with a smaller doc_id. Rows of the same
    doc_id are not smaller than each other; null ids are larger than all. Null texts are empty; texts under 50 bytes
    lose nothing. Repeated rows are rows like others; an empty table gives no rows. Further columns are ignored.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    bits = max(0, int(-(-total // BUCKET_BYTES)) - 1).bit_length()
    wide, many = int(shards), max(1, (1 << bits) // 2)

    def names(shard: int, rows: list[tuple]) -> list[tuple]:
        own = Shard([r[2:5] for r in rows])
        name, row = own.segments()[:2]
        order = np.argsort(name, kind="stable")  # ids rise along a name
        name, ids = name[order], own.ids[row[order]]
        new = np.concatenate(([True], name[1:] != name[:-1]))[: len(name)]
        fresh = new | np.concatenate(([True], ids[1:] != ids[:-1]))[: len(name)]
        values, count = name[new], np.diff(np.append(np.cumsum(fresh)[new] - 1, fresh.sum()))
        _, cut = by_bucket(values, bits)
        out = []
        for b in range(1 << bits):
            v, c = values[cut[b] : cut[b + 1]], count[cut[b] : cut[b + 1]]
            if len(v):
                out.append((b, shard, six(v[c == 1]), six(v[(c > 1) & (c <= HOT_DOCS)]), six(v[c > HOT_DOCS])))
        return out

    def known(bucket: int, rows: list[tuple]) -> list[tuple]:
        each = [[unsix(x) for x in r[2:5]] for r in rows]
        values, count = np.unique(np.concatenate([v for e in each for v in e]), return_counts=True)
        several = np.unique(np.concatenate([v for e in each for v in e[1:]] + [values[count > 1]]))
        hot = np.unique(np.concatenate([e[2] for e in each] + [values[count > HOT_SHARDS]]))
        out = []
        for r, e in zip(rows, each, strict=True):
            mine = np.concatenate(e)
            mine = np.sort(mine[members(several, mine)])
            if len(mine):
                warm = members(hot, mine)
                out.append((r[1], 0, np.array([bucket], "<i8").tobytes(), six(mine[~warm]), six(mine[warm])))
        return out

    asked = grouped(packed(docs, shards), "shard", "kind", names, "bucket int, shard int, a binary, b binary, c binary", wide)
    answers = stored(grouped(asked, "bucket", "shard", known, SENT, many), "known")

    def matched(own: Shard, rows: list[tuple]) -> tuple:
        """The shard's segments, and which have a name that several documents have, and which of those are hot."""
        found = own.segments()
        name = found[0]
        some, hot = np.zeros(len(name), bool), np.zeros(len(name), bool)
        order, cut = by_bucket(name, bits)
        for r in rows:
            b = int(np.frombuffer(r[2], "<i8")[0])
            at = order[cut[b] : cut[b + 1]]
            some[at] |= members(unsix(r[3]), low48(name[at]))
            hot[at] |= members(unsix(r[4]), low48(name[at]))
        return (*found, some & ~hot, hot)

    def candidates(own: Shard, rows: list[tuple]) -> tuple:
        """Segments and single strings that may match: (name, row, start, n, content), and the first of each identical group."""
        name, row, start, n, text, some, hot = matched(own, rows)
        warm = np.nonzero(hot)[0]
        of, place, single = own.strings(start[warm], n[warm])
        name = np.concatenate((name[some], single))
        row = np.concatenate((row[some], row[warm][of]))
        start = np.concatenate((start[some], place))
        n = np.concatenate((n[some], np.ones(len(of), np.int64)))
        text = np.concatenate((text[some], single))
        head, firsts = leading((name, n, text, row))
        return name, row, start, n, text, head, firsts

    def sent(shard: int, rows: list[tuple]) -> list[tuple]:
        own = Shard([r[2:5] for r in rows if r[1] == 1])
        name, row, start, n, text, _, firsts = candidates(own, [r for r in rows if r[1] == 0])
        firsts = np.sort(firsts)
        order, cut = by_bucket(name[firsts], bits)
        squeeze, out = zstandard.ZstdCompressor(level=3), []
        for b in range(1 << bits):
            at = firsts[order[cut[b] : cut[b + 1]]]
            if len(at):
                at = at[np.lexsort((text[at], name[at]))]
                head = np.stack((below(name[at], bits), own.ids[row[at]].view(np.uint64), n[at].astype(np.uint64), at.astype(np.uint64)))
                out.append((b, shard, squeeze.compress(head.T.copy().view(np.uint8).reshape(len(at), -1).T.tobytes()), squeeze.compress(own.cut(start[at], n[at]))))
        return out

    def judged(bucket: int, rows: list[tuple]) -> list[tuple]:
        open_, heads, bodies, contents, weights = zstandard.ZstdDecompressor(), [], [], [], powers(0)
        for r in rows:
            flat = open_.decompress(r[2])
            heads.append(np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(32, -1).T).view(np.uint64))
            bodies.append(np.frombuffer(open_.decompress(r[3]), np.uint8))
            if len(bodies[-1]) > len(weights[0]):
                weights = powers(len(bodies[-1]))
            contents.append(content(bodies[-1], heads[-1][:, 2].astype(np.int64), *weights))
        head, text = np.concatenate(heads), np.concatenate(contents)
        of = np.repeat(np.arange(len(rows)), [len(h) for h in heads])
        name, n, at = head[:, 0], head[:, 2].astype(np.int64), head[:, 3]
        owner = head[:, 1].copy().view(np.int64)
        blob = np.concatenate(bodies)
        start = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)
        lead, firsts = leading((name, n, text, owner))
        low = owner[lead]
        # only names with differing segments need their strings compared
        order = firsts[np.argsort(name[firsts], kind="stable")]
        edge = np.concatenate(([True], name[order][1:] != name[order][:-1], [True]))
        mixed = order[~(edge[:-1] & edge[1:])]
        inside = np.full(len(n), -1, np.int64)
        least = np.zeros(0, np.int64)
        if len(mixed):
            least = least_owner(blob, start[mixed], n[mixed], low[mixed])
            inside[mixed] = np.cumsum(n[mixed]) - n[mixed]
        whole = np.nonzero((inside[lead] < 0) & (low < owner))[0]
        runs_ = [(whole, np.zeros(len(whole), np.int64), n[whole])]
        part = np.nonzero(inside[lead] >= 0)[0]
        if len(part):
            item = np.repeat(part, n[part])
            step = np.arange(len(item)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
            gone = least[inside[lead][item] + step] < owner[item]
            begin = gone & np.concatenate(([True], ~gone[:-1] | (item[1:] != item[:-1])))
            end = gone & np.concatenate((~gone[1:] | (item[1:] != item[:-1]), [True]))
            runs_.append((item[begin], step[begin], step[end] - step[begin] + 1))
        seg, first, count = (np.concatenate([r[k] for r in runs_]) for k in range(3))
        out = []
        for i, r in enumerate(rows):
            mine = of[seg] == i
            if mine.any():
                out.append((r[1], 2, at[seg[mine]].astype("<i8").tobytes(), first[mine].astype("<i4").tobytes(), count[mine].astype("<i4").tobytes()))
        return out

    segments = grouped(packed(docs, shards).unionByName(answers), "shard", "kind", sent, "bucket int, shard int, a binary, b binary", wide)
    verdicts = stored(grouped(segments, "bucket", "shard", judged, SENT, many), "verdicts")

    def cleaned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in per_key(batches):
            own = Shard([r[2:5] for r in rows if r[1] == 1])
            _, row, start, n, _, head, _ = candidates(own, [r for r in rows if r[1] == 0])
            gone = np.zeros(len(own.data) + LENGTH + 1, np.int32)

            def mark(a: np.ndarray, k: np.ndarray, gone=gone) -> None:
                np.add.at(gone, a, 1)
                np.add.at(gone, a + k + LENGTH - 1, -1)

            later = own.ids[row] > own.ids[row[head]]
            mark(start[later], n[later])
            for r in (r for r in rows if r[1] == 2):
                at, first, count = np.frombuffer(r[2], "<i8"), np.frombuffer(r[3], "<i4"), np.frombuffer(r[4], "<i4")
                mark(start[at] + first, count.astype(np.int64))
                # other places of the same segment in the document that stands for it
            same = np.nonzero((head != np.arange(len(head))) & ~later)[0]
            if len(same):
                answers_ = [(np.frombuffer(r[2], "<i8"), np.frombuffer(r[3], "<i4"), np.frombuffer(r[4], "<i4")) for r in rows if r[1] == 2]
                at, first, count = (np.concatenate([x[k] for x in answers_]) if answers_ else np.zeros(0, np.int64) for k in range(3))
                order = np.argsort(at, kind="stable")
                lo, hi = np.searchsorted(at[order], head[same]), np.searchsorted(at[order], head[same], side="right")
                of = np.repeat(np.arange(len(same)), hi - lo)
                pick = order[np.repeat(lo, hi - lo) + np.arange(len(of)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]
                mark(start[same][of] + first[pick], count[pick].astype(np.int64))
            keep = np.cumsum(gone)[: len(own.data)] == 0
            out = []
            for i, (a, b) in enumerate(zip(own.offsets[:-1].tolist(), own.offsets[1:].tolist(), strict=True)):
                k = keep[a:b]
                spans = int((~k[:1]).sum() + (k[:-1] & ~k[1:]).sum())
                out.append((None if own.ids[i] == NO_ID else int(own.ids[i]), b - a, int((~k).sum()), spans, own.data[a:b][k].tobytes()))
            for i in range(0, len(out), 512):
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out[i : i + 512]], pa.int64() if k < 4 else pa.binary()) for k in range(5)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    every = packed(docs, shards).unionByName(answers).unionByName(verdicts)
    return every.repartition(wide, "shard").sortWithinPartitions("shard", "kind").mapInArrow(cleaned, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
