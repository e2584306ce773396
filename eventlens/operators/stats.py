"""Aggregation, time buckets and time charts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.functions.fields import field, number, text
from eventlens.functions.spans import bucket, span_seconds

Aggregate = tuple[str, str | None] | tuple[str, str | None, str]

AGGREGATES: dict[str, Callable[[Column | None], Column]] = {
    "count": lambda c: F.count(F.lit(1)),
    "sum": lambda c: F.coalesce(F.sum(number(c)), F.lit(0.0)),
    "avg": lambda c: F.coalesce(F.avg(number(c)), F.lit(0.0)),
    "min": lambda c: F.coalesce(F.min(number(c)), F.lit(0.0)),
    "max": lambda c: F.coalesce(F.max(number(c)), F.lit(0.0)),
    "dc": lambda c: F.count_distinct(c),
    "estdc": lambda c: F.approx_count_distinct(c),
}


def register_aggregate(name: str, build: Callable[[Column | None], Column]) -> None:
    """Make a Column aggregate (built in or a grouped-aggregate pandas UDF) usable by name."""
    AGGREGATES[name] = build


def aggregate_columns(df: DataFrame, aggregates) -> list[Column]:
    """Columns for `(function, field[, alias])`; the default alias is the call text, e.g. `sum(latency)`."""
    columns = []
    for entry in aggregates:
        name, source, *alias = entry
        if name not in AGGREGATES:
            raise ValueError(f"unknown aggregate {name!r}")
        default = name if source is None else f"{name}({source})"
        columns.append(AGGREGATES[name](None if source is None else field(df, source)).alias(alias[0] if alias else default))
    return columns


def group_key(df: DataFrame, name: str, stringify: bool = False) -> Column:
    col = field(df, name)
    return (F.coalesce(text(col), F.lit("(null)")) if stringify else col).alias(name)


def stats_by(*by: str, aggs, stringify: bool = False):
    """Grouped aggregates. Keys keep their type unless `stringify`, which also labels NULL as `(null)`."""
    return lambda df: df.groupBy(*[group_key(df, b, stringify) for b in by]).agg(*aggregate_columns(df, aggs))


def stats_global(*aggs):
    """Aggregates over all rows: always one row, with count 0 for empty input."""
    return lambda df: df.agg(*aggregate_columns(df, aggs))


def stats_values(source: str, *by: str):
    """Distinct values per group, one row each with its multiplicity.

    Rows instead of an array per group: a group may hold any number of values, and the
    partial aggregation on (group, value) spreads a hot group over the cluster.
    """

    def apply(df: DataFrame) -> DataFrame:
        kept = df.where(field(df, source).isNotNull())
        return kept.groupBy(*[group_key(df, b) for b in by], field(df, source).alias("value")).agg(F.count(F.lit(1)).alias("n"))

    return apply


def stats_list(source: str, *by: str):
    """All values per group as rows, duplicates kept."""
    return lambda df: df.where(field(df, source).isNotNull()).select(*[group_key(df, b) for b in by], field(df, source).alias("value"))


def bucket_time(span: str | int = "1m", column: str = "ts", target: str = "_time"):
    """Floor the time to the span in UTC; rows without a readable time are dropped."""
    seconds = span_seconds(span)

    def apply(df: DataFrame) -> DataFrame:
        at = field(df, column).try_cast("timestamp")
        return df.where(at.isNotNull()).withColumn(target, bucket(at, seconds))

    return apply


def timechart(span: str | int = "1h", aggs=(("count", None),), by: tuple[str, ...] = (), column: str = "ts", fill: bool = False, stringify: bool = False):
    """Aggregates per time bucket and series, with `_span` in seconds and `_type`.

    `fill=True` adds the empty buckets between the first and last one of the whole result,
    for every series, with NULL aggregates.
    """
    seconds = span_seconds(span)

    def apply(df: DataFrame) -> DataFrame:
        cut = bucket_time(span, column)(df)
        chart = cut.groupBy("_time", *[group_key(cut, b, stringify) for b in by]).agg(*aggregate_columns(cut, aggs))
        if fill:
            chart = _fill(chart, seconds, list(by))
        return chart.withColumn("_span", F.lit(seconds)).withColumn("_type", F.lit("timechart"))

    return apply


def _fill(chart: DataFrame, seconds: int, by: list[str]) -> DataFrame:
    """Bucket grid per series: the grid is made by `sequence` inside each series row."""
    lowest, highest = chart.agg(F.min("_time")).scalar(), chart.agg(F.max("_time")).scalar()
    series = chart.select(*by).distinct() if by else chart.sparkSession.range(1).select()
    grid = series.select(*by, F.explode(F.sequence(lowest, highest, F.make_dt_interval(secs=F.lit(seconds)))).alias("_time"))
    keys = ["_time", *by]
    right = chart.select(*[F.col(k).alias("_r_" + k) for k in keys], *[c for c in chart.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col("_r_" + k)) for k in keys])
    return grid.join(right, same, "left").drop(*["_r_" + k for k in keys])
