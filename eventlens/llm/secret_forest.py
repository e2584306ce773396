"""Secret scans: a random forest removes false positives among strings that look like credentials.

Candidates are runs of 16 or more of the characters keys are written in, whole values assigned to names such as token or
password, and passwords in addresses, of any printable characters. The forest judges each by its length,
its character transitions, how much of it a dictionary covers, whether it stands in a path or address, and the
words next to it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.llm.common import runs, stored, text_buffer

LEAST = 16
RUN_BYTES = 4 << 20
AROUND = 48
SAMPLE = 1_500
FINDINGS = 6_000
PER_TEXT = 32
#: A group of letters is known if this share of all texts has it.
SHARE = 1 / 2_000
GROUPS = 26**2 + 26**3
LETTER = np.full(256, -1)
LETTER[97:123] = LETTER[65:91] = np.arange(26)
MASK = b"[SECRET]"
TOKEN = np.zeros(256, bool)
TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_=.-"]] = True
NAMED = re.compile(rb"(?i)(key|token|secret|passw|pwd|auth|bearer|credential|api|private)")
ASSIGNED = re.compile(rb"(?i)(?:key|token|secret|passw(?:or)?d|pwd|auth|bearer|credential)\w*[\"']?\s*[=:]\s*[\"']?$")
#: The value after such a name: quoted, or up to white space. Bounds on the name keep the search linear.
VALUE = re.compile(rb"(?i)(?:key|token|secret|passw(?:or)?d|pwd|auth|bearer|credential)\w{0,32}[\"']?\s{0,16}(?:=>|:=|[=:])\s{0,16}(?:(?:bearer|basic)\s{1,16})?(?:\"([^\"\r\n]{4,})\"|'([^'\r\n]{4,})'|([^\s\"'][^\s]{3,}))")
ADDRESS = re.compile(rb"://[^\s/:@]{0,256}:([^\s/]{4,})@")
HINT = r"(?i)(key|token|secret|passw(or)?d|pwd|auth|bearer|credential)\w*[\"']?\s*[=:]"
SEEN = ("length", "digits", "upper", "lower", "symbols", "entropy", "class changes", "known pairs", "covered", "hex", "slashes", "dots", "address", "named before", "assigned", "quoted", "words before", "words after")


def candidates(data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int]]]:
    """Byte spans of the candidates of each text, relative to its start: LEAST or more token bytes with a digit, or twice as many without."""
    x = data[offsets[0] : offsets[-1]]
    inside = TOKEN[x]
    bounds = (offsets - offsets[0])[1:-1]
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    cuts = bounds[(bounds > 0) & (bounds < len(x))]
    cuts = np.unique(cuts[inside[cuts] & inside[cuts - 1]]) if len(cuts) else cuts
    starts, ends = np.sort(np.concatenate((np.nonzero(edge == 1)[0], cuts))), np.sort(np.concatenate((np.nonzero(edge == -1)[0], cuts)))
    digits = np.concatenate(([0], np.cumsum((x >= 48) & (x <= 57))))
    good = (ends - starts >= LEAST) & ((digits[ends] > digits[starts]) | (ends - starts >= 2 * LEAST))
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(offsets) - 1)]
    first = offsets - offsets[0]
    for s, e in zip(starts[good].tolist(), ends[good].tolist(), strict=True):
        r = int(np.searchsorted(first, s, side="right")) - 1
        out[r].append((s - int(first[r]), e - int(first[r])))
    return out


def trimmed(text: bytes, start: int, end: int) -> tuple[int, int]:
    """The span without sentence marks and padding at its ends."""
    while end > start and text[end - 1] in b".-_/+":
        end -= 1
    while start < end and text[start] in b".-_/+=":
        start += 1
    return start, end


def assigned(text: bytes) -> list[tuple[int, int]]:
    """Spans of whole values after names of secrets, and of passwords in addresses."""
    out = []
    for m in VALUE.finditer(text) if NAMED.search(text) else ():
        a, b = m.span(m.lastindex)
        if m.lastindex == 3:
            while b > a and text[b - 1] in b",;\"'":
                b -= 1
        if b - a >= 4:
            out.append((a, b))
    return out + ([m.span(1) for m in ADDRESS.finditer(text)] if b"://" in text else [])


def spans_of(text: bytes, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """All different candidates of a text: its runs without marks at their ends, and assigned values as they stand."""
    return sorted({*(trimmed(text, *s) for s in found), *assigned(text)})


def merged(found: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Findings that overlap become one."""
    out: list[tuple[int, int, float]] = []
    for s, e, p in found:
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]), max(p, out[-1][2]))
        else:
            out.append((s, e, p))
    return out


def shorter(value: bytes) -> bytes:
    """The first 6 to 20 bytes, by the value's hash."""
    return value[: 6 + xxhash.xxh64_intdigest(value) % 15]


def password(value: bytes) -> bytes:
    """A made password of 5 to 20 printable characters, letters and digits, or letters, by the value's hash."""
    h = xxhash.xxh64_intdigest(value, 1)
    alphabet = (bytes(range(33, 127)).replace(b'"', b""), b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
    chosen = (alphabet[0], alphabet[1] + b"0123456789", alphabet[1])[h % 3]
    rng = np.random.default_rng(h)
    return bytes(rng.choice(np.frombuffer(chosen, np.uint8), 5 + h // 3 % 16))


def kind(b: int) -> int:
    return 0 if 48 <= b <= 57 else 1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 else 3


def seen(value: bytes, before: bytes, after: bytes, words: set[bytes]) -> list[float]:
    """Features of a candidate, in the order of SEEN. `words` holds pairs and triples of letters of known words."""
    n = max(len(value), 1)
    kinds = [kind(b) for b in value]
    share = Counter(kinds)
    low = value.lower()
    pairs = [low[i : i + 2] for i in range(n - 1)]
    triples = [low[i : i + 3] for i in range(n - 2)]
    last, following = before.split()[-3:], after.split()[:2]
    return [
        math.log(n),
        share[0] / n,
        share[1] / n,
        share[2] / n,
        share[3] / n,
        -sum(c / n * math.log2(c / n) for c in Counter(value).values()),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        sum(p in words for p in pairs) / max(len(pairs), 1),
        sum(t in words for t in triples) / max(len(triples), 1),
        sum(b in b"0123456789abcdefABCDEF" for b in value) / n,
        value.count(b"/") + (before[-1:] == b"/"),
        value.count(b"."),
        float(before[-1:] == b"@" or after[:1] == b"@" or b"://" in before[-12:]),
        float(any(NAMED.search(w) for w in last)),
        float(bool(ASSIGNED.search(before))),
        float(before[-1:] in (b'"', b"'") and after[:1] in (b'"', b"'")),
        sum(w.lower().strip(b".,") [:3] in words for w in last) / 3,
        sum(w.lower().strip(b".,\"'")[:3] in words for w in following) / 2,
    ]


#: What stands before values that are no secrets, and before secrets; values that only stand for one; plain words.
PUBLIC_NAMES = ("digest sha256 = ", 'sha256: "', "checksum = ", "commit ", "md5 ", 'etag: "', "revision ", "id = ", 'request_id: "', "the file ", "and ", "tree ", 'build = "', "fingerprint: ")
SECRET_NAMES = ('token = "', "token: ", "api_key = ", 'secret = "', "password: ", 'pwd="', "auth_token=", "credential: ", "Authorization: Bearer ", 'private_key = "')
STAND_INS = ("changeme", "example", "your-api-key", "your_token_here", "xxxxxxxx", "XXXXXXXXXXXX", "********", "<token>", "${TOKEN}", "{{ secret }}", "null", "none", "None", "true", "password", "secret", "placeholder", "TODO", "redacted", "[hidden]", "os.environ", "getenv('KEY')", "undefined", "default", "test", "dummy")
PLAIN_WORDS = ("everyone", "knows", "river", "station", "window", "garden", "server", "winter", "paper", "required", "expires", "optional", "string", "value", "never", "always", "people", "nothing", "holder", "between", "question", "answer")
HEX, MIXED, PRINTED = b"0123456789abcdef", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", bytes(range(33, 127)).replace(b'"', b"").replace(b"'", b"")
MADE = 80


def made_findings(n: int = MADE, seed: int = 23) -> list[tuple[bytes, bytes, bytes, int]]:
    """Findings (value, before, after, label) of kinds that no table need hold: `n` of each, the same on every run.

    Hashes, ids, dates, links, numbers, stand-ins and plain words are no secrets, the last five even after a secret's name;
    keys and passwords after such a name are.
    """
    rng = np.random.default_rng(seed)
    pick = lambda choices: choices[int(rng.integers(len(choices)))]
    run = lambda alphabet, length: bytes(rng.choice(np.frombuffer(alphabet, np.uint8), length))
    around = lambda names: (f"{pick(PLAIN_WORDS)} {pick(PLAIN_WORDS)} {pick(names)}".encode(), f'" {pick(PLAIN_WORDS)} '.encode())
    out = []
    for _ in range(n):
        h = run(HEX, 32)
        uuid = b"-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))
        date = f"20{rng.integers(10, 40)}-{rng.integers(1, 13):02}-{rng.integers(1, 29):02}"
        for value in (run(HEX, pick((32, 40, 40, 64))), run(HEX, pick((7, 12, 40))), uuid):
            out.append((value, *around(PUBLIC_NAMES), 0))
        for value in (date, f"{date}T{rng.integers(10, 24)}:00:00Z", f"https://{pick(PLAIN_WORDS)}.example/{pick(PLAIN_WORDS)}?id={rng.integers(1000)}", str(rng.integers(10**6)), f"{rng.integers(30)}.{rng.integers(30)}.{rng.integers(30)}"):
            out.append((value.encode(), *around(SECRET_NAMES), 0))
        for value in (pick(STAND_INS), pick(PLAIN_WORDS), f"{pick(PLAIN_WORDS)}_{pick(PLAIN_WORDS)}_{rng.integers(20)}", f"/{pick(PLAIN_WORDS)}/{pick(PLAIN_WORDS)}{rng.integers(9)}"):
            out.append((value.encode(), *around(SECRET_NAMES), 0))
        for value in (run(HEX, pick((32, 40, 64))), run(MIXED, int(rng.integers(20, 64))), pick((b"sk_live_", b"ghp_", b"AKIA", b"xoxb-", b"eyJ")) + run(MIXED, int(rng.integers(16, 40))), run(PRINTED, int(rng.integers(8, 20))), run(MIXED, int(rng.integers(8, 16)))):
            out.append((value, *around(SECRET_NAMES), 1))
        out.append((run(MIXED, int(rng.integers(32, 64))), *around(PLAIN_WORDS), 1))  # mixed case and digits without a name
    return out


@dataclass
class Forest:
    """Trees as arrays: feature (-1 at a leaf), threshold, left child (right is next to it) and share of secrets."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    words: set[bytes]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, share in self.trees:
            at = np.zeros(len(x), int)
            while (inner := feature[at] >= 0).any():
                f = np.maximum(feature[at], 0)
                at = np.where(inner, left[at] + (x[np.arange(len(x)), f] > threshold[at]), at)
            total += share[at]
        return total / max(len(self.trees), 1)


def _tree(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, tried: int, least: int) -> tuple:
    feature, threshold, left, share = [-1], [0.0], [0], [float(y.mean())]
    open_ = [(0, np.arange(len(y)), depth)]
    while open_:
        node, rows, deep = open_.pop()
        z = y[rows]
        if not deep or len(rows) < 2 * least or z.min() == z.max():
            continue
        best = (0.0, -1, 0.0)
        pure = z.mean() * (1 - z.mean())
        for f in rng.choice(x.shape[1], tried, replace=False):
            order = np.argsort(x[rows, f], kind="stable")
            v, got = x[rows[order], f], np.cumsum(z[order])
            cut = np.nonzero(v[1:] > v[:-1])[0]
            cut = cut[(cut + 1 >= least) & (len(rows) - cut - 1 >= least)]
            if not len(cut):
                continue
            n, a = cut + 1, got[cut] / (cut + 1)
            b = (got[-1] - got[cut]) / (len(rows) - n)
            gain = pure - (n * a * (1 - a) + (len(rows) - n) * b * (1 - b)) / len(rows)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), int(f), float((v[cut[k]] + v[cut[k] + 1]) / 2))
        if best[1] < 0:
            continue
        feature[node], threshold[node], left[node] = best[1], best[2], len(feature)
        right = x[rows, best[1]] > best[2]
        for part in (rows[~right], rows[right]):
            open_.append((len(feature), part, deep - 1))
            for values, value in ((feature, -1), (threshold, 0.0), (left, 0), (share, float(y[part].mean()))):
                values.append(value)
    return np.array(feature), np.array(threshold), np.array(left), np.array(share)


def grown(x: np.ndarray, y: np.ndarray, words: set[bytes], trees: int = 40, depth: int = 8, least: int = 3, seed: int = 17) -> Forest:
    """Trees on bootstrap samples, each class drawn equally often; every split tries a third of the features."""
    rng = np.random.default_rng(seed)
    classes = [np.nonzero(y == c)[0] for c in (0, 1)]
    if min(map(len, classes)) == 0:  # nothing to tell apart
        return Forest([(np.array([-1]), np.zeros(1), np.zeros(1, int), np.array([0.0]))], words)
    out = []
    for _ in range(trees):
        rows = np.concatenate([rng.choice(c, min(len(y) // 2 + 1, 1500)) for c in classes])
        out.append(_tree(x[rows], y[rows], rng, depth, max(1, x.shape[1] // 3), least))
    return Forest(out, words)


def sampled(docs: DataFrame, n: int) -> DataFrame:
    """`text` of the `n` different texts with the lowest hashes among those with a secret's name, and of the `n` lowest among all.

    Each text is hashed and tested once; only hashes are sorted, and at most 2 * `n` are broadcast.
    """
    rows = docs.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL").withColumn("h", F.xxhash64("text"))
    marks = stored(rows.select("h", F.col("text").rlike(HINT).alias("named")), "marks")
    lows = [part.select("h").distinct().orderBy("h").limit(n) for part in (marks.where("named"), marks)]
    return rows.join(F.broadcast(lows[0].union(lows[1]).distinct()), "h").groupBy("h").agg(F.min("text").alias("text"))


def labelled_findings(docs: DataFrame, sample: int = SAMPLE, findings: int = FINDINGS) -> DataFrame:
    """Findings with value, before, after and label from at most 2 * `sample` documents.

    The tables have no reviewed findings. So a candidate assigned to a name such as token or key is taken as a confirmed
    secret, if it has letters and digits mixed; every other candidate is a false positive. Half of the documents
    have such a name, the others are any; the lowest hashes come first. Each class has half of `findings` to itself, and
    of one text at most PER_TEXT of a class.
    """
    chosen = sampled(docs, sample)

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            found = []
            for i in range(batch.num_rows):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                of_text: tuple[list, list] = ([], [])
                for a, b in spans_of(text, candidates(data, offsets[i : i + 2])[0]):
                    value, before = text[a:b], text[max(0, a - AROUND) : a]
                    if (ASSIGNED.search(before) or before[-1:] == b":") and not any(48 <= c <= 57 for c in value):
                        continue  # a password or a word: no label
                    secret = bool(ASSIGNED.search(before)) and any(48 <= c <= 57 for c in value) and any(c >= 65 for c in value)
                    of_text[secret].append((value, before, text[b : b + AROUND], int(secret)))
                for both in of_text:
                    found += sorted(both, key=lambda f: xxhash.xxh64_intdigest(f[0] + f[1]))[:PER_TEXT]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary() if k < 3 else pa.int32()) for k in range(4)], ["value", "before", "after", "label"])

    made = stored(chosen.select("text").mapInArrow(of_batches, "value binary, before binary, after binary, label int"), "findings")
    of_class = [made.where(F.col("label") == k).orderBy(F.xxhash64("value", "before")).limit(findings // 2) for k in (0, 1)]
    return of_class[0].unionByName(of_class[1])


def letter_groups(data: np.ndarray, offsets: np.ndarray, docs: int = 128) -> np.ndarray:
    """The number of texts that have each pair (first, second) and triple of letters in a word of three letters or more."""
    total = np.zeros(GROUPS, np.int64)
    for i in range(0, len(offsets) - 1, docs):
        cut = offsets[i : i + docs + 1]
        letter = LETTER[data[cut[0] : cut[-1]]]
        if len(letter) < 3:
            continue
        of = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        at = np.nonzero((letter[:-2] >= 0) & (letter[1:-1] >= 0) & (letter[2:] >= 0) & (of[:-2] == of[2:]))[0]
        x, y, z = (letter[at + k] for k in range(3))
        met = np.zeros((len(cut) - 1, GROUPS), bool)
        met[of[at], x * 26 + y] = met[of[at], y * 26 + z] = met[of[at], 26**2 + (x * 26 + y) * 26 + z] = True
        total += met.sum(axis=0)
    return total


def dictionary(docs: DataFrame, share: float = SHARE) -> set[bytes]:
    """Pairs and triples of letters in the lower-cased words of at least `share` of all texts, two at least; at most 26**2 + 26**3."""

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(GROUPS, np.int64), 0
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for a, b in runs(offsets, RUN_BYTES):
                total += letter_groups(data, offsets[a : b + 1])
            n += batch.num_rows
        used = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(total[used], n))], ["g", "n"])

    counts = docs.select(F.col("text").cast("string")).where("text IS NOT NULL").mapInArrow(of_batches, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()
    n = sum(r["n"] for r in counts if r["g"] < 0)
    return {_group(r["g"]) for r in counts if r["g"] >= 0 and r["n"] >= max(2, share * n)}


def _group(g: int) -> bytes:
    return bytes([97 + g // 26, 97 + g % 26]) if g < 26**2 else bytes([97 + (g - 26**2) // 26**2, 97 + (g - 26**2) // 26 % 26, 97 + (g - 26**2) % 26])


def is_hex(value: bytes) -> bool:
    return all(c in b"0123456789abcdefABCDEF-" for c in value)


def examples(value: bytes, before: bytes, after: bytes, label: int) -> list[tuple[bytes, bytes, bytes, int]]:
    """What one finding teaches. A secret's form counts without its neighbours too, unless hashes and ids have that form; a false positive's also as if
    assigned, so that the name alone doesn't decide. Both are shown cut short after a name, so that length doesn't, and for a secret a made password.
    """
    out = [(value, before, after, label)]
    if not is_hex(value):
        out += [(value, b" ", b" ", 1) if label else (value, b'token = "', b'" ', 0), (shorter(value), b'password = "', b'" ', label)]
    elif label:
        out += [(value, b" ", b" ", 0), (shorter(value), b'password = "', b'" ', 1)]
    return out + ([(password(value), b'password = "', b'" ', 1)] if label else [])


def learned(docs: DataFrame, findings: DataFrame | None = None) -> Forest:
    """A forest from labelled findings (value, before, after, label), by default those of `labelled_findings`, and `made_findings`.

    Values are turned into features where they are; only features come to the driver, at most about `FINDINGS` times four rows of them. Without
    any finding, from an empty table too, the made ones alone teach.
    """
    words = dictionary(docs)

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = [], []
            for value, before, after, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for *found, y_one in examples(value, before, after, label):
                    x.append(seen(*found, words))
                    y.append(y_one)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.int32())], ["x", "y"])

    rows = labelled_findings(docs) if findings is None else findings
    binary = [F.col(c).cast("binary") for c in ("value", "before", "after")]
    taught = rows.select(*binary, F.col("label").cast("int")).mapInArrow(of_batches, "x array<double>, y int").collect()
    taught = sorted((list(r["x"]), r["y"]) for r in taught) + [(seen(*found, words), y) for *found, y in made_findings()]
    return grown(np.array([t[0] for t in taught], float), np.array([t[1] for t in taught]), words)


def scanned(docs: DataFrame, model: Forest, keep: tuple[str, ...] = ("doc_id",), least: float = 0.5) -> DataFrame:
    """The columns in `keep`, n_candidates, `secrets` (start, end, score) and `clean_text` of every row.

    Spans are bytes of the UTF-8 text; in `clean_text` each secret is `[SECRET]`. Null texts give null, empty ones
    stay empty; neither has candidates. Repeated rows get equal results; an empty table gives no rows.
    Columns of those names are replaced.
    """
    keep = tuple(c for c in keep if c not in ("n_candidates", "secrets", "clean_text"))
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
    schema = T.StructType([*kept.schema, T.StructField("n_candidates", T.LongType()), T.StructField("secrets", T.ArrayType(span)), T.StructField("clean_text", T.StringType())])
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(len(keep)))
            null = batch.column(len(keep)).is_null().to_numpy(zero_copy_only=False)
            for a, b in runs(offsets, RUN_BYTES):
                counts, secrets, clean = [], [], []
                for i, spans in enumerate(candidates(data, offsets[a : b + 1]), a):
                    text = data[offsets[i] : offsets[i + 1]].tobytes()
                    found = []
                    spans = spans_of(text, spans)
                    if spans:
                        x = np.array([seen(text[s:e], text[max(0, s - AROUND) : s], text[e : e + AROUND], model.words) for s, e in spans])
                        found = [(s, e, float(p)) for (s, e), p in zip(spans, model.score(x).tolist(), strict=True) if p >= least]
                        found = merged(found)
                        for s, e, _ in reversed(found):
                            text = text[:s] + MASK + text[e:]
                    counts.append(len(spans))
                    secrets.append([{"start": s, "end": e, "score": p} for s, e, p in found])
                    clean.append(None if null[i] else text.decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[: len(keep)], pa.array(counts, pa.int64()), pa.array(secrets, arrow), pa.array(clean, pa.string())], [*keep, "n_candidates", "secrets", "clean_text"])

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("_text")).mapInArrow(of_batches, schema)
