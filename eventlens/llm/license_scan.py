"""License scans: ordered signature rules over whole texts.

A text becomes its lower-cased words with one space between them. Rules whose gate words occur in it are tried. What they find is
resolved in order of priority: a find that overlaps one of a higher tier goes, and within a tier one that lies inside another
(of two equal spans the later rule's). Base phrases stand apart and always stay.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import texts
from eventlens.llm.license_rules import BASE, WEIGHTS, Rule, rules
from eventlens.llm.worker import kept

#: A to Z in lower case; all other bytes but digits, a to z and those beyond ASCII become spaces.
AS_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
FOUND = "array<struct<rule:string,label:string,start:int,stop:int,first_byte:long,last_byte:long,weight:double>>"
FOUND_TYPE = pa.list_(pa.struct([("rule", pa.string()), ("label", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("first_byte", pa.int64()), ("last_byte", pa.int64()), ("weight", pa.float64())]))


class Signatures:
    """Compiled rules and which of them each gate word opens."""

    def __init__(self, made: Sequence[Rule]):
        self.rules = list(made)
        # a pattern begins at the space before its first word and ends before the space after its last one
        self.patterns = [re.compile(f" (?:{r.pattern})(?= )".encode()) for r in self.rules]
        self.opened: dict[bytes, list[int]] = {}
        for i, r in enumerate(self.rules):
            for word in r.gate:
                self.opened.setdefault(word.encode(), []).append(i)
        self.gate = frozenset(self.opened)

    def found(self, words: list[bytes], gated: bool = True) -> list[tuple[int, int, int]]:
        """(rule, start, stop) of every match, in words."""
        at = self.gate.intersection(words) if gated else self.gate
        if not at:
            return []
        line = b" %b " % b" ".join(words)
        spaces = None
        out = []
        for i in sorted({i for word in at for i in self.opened[word]}):
            for m in self.patterns[i].finditer(line):
                if spaces is None:
                    spaces = np.nonzero(np.frombuffer(line, np.uint8) == 32)[0]
                out.append((i, int(np.searchsorted(spaces, m.start())), int(np.searchsorted(spaces, m.end()))))
        return out

    def resolved(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """What stays of the finds beside the base phrases', in order of place."""
        out: list[tuple[int, int, int]] = []
        taken: list[tuple[int, int]] = []  # apart from each other, in order
        tiers: dict[int, list[tuple[int, int, int]]] = {}
        for f in found:
            if self.rules[f[0]].tier != BASE:
                tiers.setdefault(self.rules[f[0]].tier, []).append(f)
        for tier in sorted(tiers, reverse=True):
            furthest, stay = -1, []
            for i, start, stop in sorted(tiers[tier], key=lambda f: (f[1], -f[2], f[0])):
                k = bisect_left(taken, (stop,)) - 1
                if k >= 0 and taken[k][1] > start:
                    continue
                if stop > furthest:
                    furthest = stop
                    stay.append((i, start, stop))
            out += stay
            joined: list[tuple[int, int]] = []
            for start, stop in sorted(taken + [(s, e) for _, s, e in stay]):
                if joined and start < joined[-1][1]:
                    joined[-1] = (joined[-1][0], max(stop, joined[-1][1]))
                else:
                    joined.append((start, stop))
            taken = joined
        return sorted(out, key=lambda f: (f[1], f[2], f[0]))


def signatures() -> Signatures:
    return kept(("license rules",), lambda: Signatures(rules()))


def word_spans(low: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word and the one behind its last."""
    inside = np.concatenate(([False], np.frombuffer(low, np.uint8) != 32, [False]))
    return np.nonzero(inside[1:] & ~inside[:-1])[0], np.nonzero(inside[:-1] & ~inside[1:])[0]


def scanned(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """`keep`, n_words, base and found of every row: places of base phrases, and the rules' finds that stay.

    A find has rule, label, start and stop (words from 0, stop excluded), first_byte and last_byte (in the UTF-8 text, the latter excluded)
    and weight. Null and empty texts have no word and no find. Repeated rows stay repeated, null ids keep their rows;
    further columns are ignored, whatever their names. An empty table gives no rows.
    """

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = signatures()

        def finds(low: bytes, got: list[tuple[int, int, int]]) -> list[dict]:
            if not got:
                return []
            first, last = word_spans(low)
            return [
                {"rule": (r := known.rules[i]).name, "label": r.label, "start": a, "stop": b, "first_byte": int(first[a]), "last_byte": int(last[b - 1]), "weight": WEIGHTS[r.tier]}
                for i, a, b in got
            ]

        for batch in batches:
            count, base, found = [], [], []
            for t in texts(batch.column(len(keep))):
                low = t.translate(AS_WORDS)
                words = low.split()
                got = known.found(words)
                count.append(len(words))
                base.append(finds(low, sorted((f for f in got if known.rules[f[0]].tier == BASE), key=lambda f: (f[1], f[0]))))
                found.append(finds(low, known.resolved(got)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(count, pa.int64()), pa.array(base, FOUND_TYPE), pa.array(found, FOUND_TYPE)], [*keep, "n_words", "base", "found"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col(text).cast("string")).mapInArrow(of_batches, f"{kinds}, n_words long, base {FOUND}, found {FOUND}")


def summary(scans: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """`keep`, n_words, n_base, first_word, last_word, base_labels, labels and score (the greatest weight of any find) of `scanned` rows."""
    joined = lambda *parts: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(p)["label"] for p in parts])))), ",")
    return scans.select(
        *keep,
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.col("base")["start"]).cast("long").alias("first_word"),
        F.array_max(F.col("base")["start"]).cast("long").alias("last_word"),
        joined("base").alias("base_labels"),
        joined("base", "found").alias("labels"),
        F.coalesce(F.array_max(F.concat(F.col("base")["weight"], F.col("found")["weight"])), F.lit(0.0)).alias("score"),
    )
