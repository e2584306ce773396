"""Stored roll-ups whose distinct counts can be merged again, so that no coarser span reads the events.

A roll-up has a row for each span and group, with counts, sums, extremes and a theta sketch for each field that is to be counted distinctly.
A sketch is of bounded size (8 bytes for each of 2 ** `LG_ENTRIES` values at most); it counts exactly up to that many values, and beyond with a standard
error of about 2 ** (-LG_ENTRIES / 2), 1.6 % for 12. Sketches of different rows can be united and intersected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.functions.fields import field, number
from eventlens.functions.spans import bucket, span_seconds
from eventlens.operators.stats import bucket_time, group_key

LG_ENTRIES = 12


def rollup(span: str | int, by: Sequence[str] = (), distinct: Sequence[str] = (), values: Sequence[str] = (), ts: str = "ts", lg_entries: int = LG_ENTRIES):
    """Events per span and group: `_time`, `by`, `count`, `sum_`, `min_` and `max_` of each of `values`, `sketch_` of each of `distinct`."""

    def apply(df: DataFrame) -> DataFrame:
        cut = bucket_time(span, ts)(df)
        numbers = [(v, number(field(cut, v))) for v in values]
        return cut.groupBy("_time", *[group_key(cut, b) for b in by]).agg(
            F.count(F.lit(1)).alias("count"),
            *[f(c).alias(f"{name}_{v}") for v, c in numbers for name, f in (("sum", F.sum), ("min", F.min), ("max", F.max))],
            *[F.theta_sketch_agg(field(cut, d).cast("string"), F.lit(lg_entries)).alias(f"sketch_{d}") for d in distinct],
        )

    return apply


def coarser(span: str | int | None, by: Sequence[str] = (), lg_entries: int = LG_ENTRIES):
    """A roll-up over a longer span (None: over all time) and fewer groups, made from a roll-up alone. The span must be made up of whole finer ones."""

    def merged(name: str) -> Column:
        if name.startswith("sketch_"):
            return F.theta_union_agg(name, F.lit(lg_entries)).alias(name)
        return {"min": F.min, "max": F.max}.get(name.split("_")[0], F.sum)(name).alias(name)

    def apply(rolled: DataFrame) -> DataFrame:
        measures = [c for c in rolled.columns if c == "count" or c.split("_")[0] in ("sum", "min", "max", "sketch") and "_" in c and c != "_time"]
        keys = ([] if span is None else [bucket(F.col("_time"), span_seconds(span)).alias("_time")]) + [F.col(b) for b in by]
        return rolled.groupBy(*keys).agg(*[merged(m) for m in measures])

    return apply


def distinct_counts(rolled: DataFrame) -> DataFrame:
    """The roll-up with `dc_` counts in place of its sketches."""
    return rolled.select(*[F.theta_sketch_estimate(c).alias("dc_" + c.removeprefix("sketch_")) if c.startswith("sketch_") else F.col(c) for c in rolled.columns])


def overlap(left: DataFrame, right: DataFrame, source: str, keys: Sequence[str]) -> DataFrame:
    """`keys`, and of the values of `source` how many are in `left`, in `right`, in both, and in `left` only; rows that either side has.

    Both are roll-ups with at most one row per key. What a side lacks counts as empty.
    """
    name = f"sketch_{source}"
    a = left.select(*keys, F.col(name).alias("_a"))
    b = right.select(*[F.col(k).alias("_r_" + k) for k in keys], F.col(name).alias("_b"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col("_r_" + k))
    both = a.join(b, on, "full")
    size = lambda c: F.coalesce(F.theta_sketch_estimate(c), F.lit(0))
    return both.select(
        *[F.coalesce(F.col(k), F.col("_r_" + k)).alias(k) for k in keys],
        size("_a").alias("left_dc"),
        size("_b").alias("right_dc"),
        size(F.theta_intersection("_a", "_b")).alias("both_dc"),
        F.coalesce(F.theta_sketch_estimate(F.theta_difference("_a", "_b")), size("_a")).alias("only_left_dc"),
    )


def within(rolled: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of the roll-up whose span begins in [start, end)."""
    return rolled.where((F.col("_time") >= F.lit(start).cast("timestamp")) & (F.col("_time") < F.lit(end).cast("timestamp")))
