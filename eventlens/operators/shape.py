"""Sorting, limits, rankings and the result shapes that charts and reports need."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.functions.fields import field, number, text


def limit_rows(n: int, *order):
    """First n rows; with an order key the choice is deterministic (a top-k, no full sort)."""
    return lambda df: (df.orderBy(*order) if order else df).limit(n)


def sort_rows(*fields: str):
    """Global sort; a leading `-` means descending, `+` or nothing ascending."""

    def key(df: DataFrame, name: str) -> Column:
        col = field(df, name.lstrip("+-"))
        return col.desc_nulls_last() if name.startswith("-") else col.asc_nulls_last()

    return lambda df: df.orderBy(*[key(df, f) for f in fields])


def head_rows(n: int, *fields: str):
    """First n rows in the order given as for `sort_rows`."""
    return lambda df: sort_rows(*fields)(df).limit(n)


def merge_latest(*parts: DataFrame | None, limit: int, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Newest rows of several partial results; missing parts are skipped."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p for p in parts if p is not None])
    return whole.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(limit)


def merge_ordered(*parts: DataFrame, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """All rows of several scans in time order."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).orderBy(ts, tie)


def top_entities(n: int, score: str = "score", entity: str = "entity"):
    """Entities of highest risk, ties by name."""
    return lambda df: df.orderBy(F.col(score).desc(), F.col(entity)).limit(n)


def recent_indicators(n: int = 50, created: str = "created", tie: str = "id"):
    return lambda df: df.orderBy(F.col(created).desc(), F.col(tie)).limit(n)


def top_n_others(bucket: str, series: str, value: Column, n: int = 10, others: str = "others"):
    """Per bucket the n largest series, and the sum of the rest as one series.

    The rank filter becomes a partial top-n before the shuffle, so a bucket with many series
    is not gathered in one task; the n-th place of each bucket then tells which sums to merge.
    """

    def apply(df: DataFrame) -> DataFrame:
        sums = df.groupBy(bucket, series).agg(value.alias("value"))
        place = F.row_number().over(Window.partitionBy(bucket).orderBy(F.col("value").desc(), F.col(series).asc_nulls_first()))
        last = sums.withColumn("_rank", place).where(F.col("_rank") <= n).where(F.col("_rank") == n)
        last = last.select(F.col(bucket).alias("_b"), F.col("value").alias("_v"), F.col(series).alias("_s"))
        ranked = sums.join(last, sums[bucket].eqNullSafe(F.col("_b")), "left")
        tied = (F.col("value") == F.col("_v")) & (F.col(series).isNull() | F.coalesce(F.col(series) <= F.col("_s"), F.lit(False)))
        kept = F.col("_v").isNull() | (F.col("value") > F.col("_v")) | tied
        named = ranked.select(bucket, F.when(kept, F.col(series)).otherwise(F.lit(others)).alias(series), "value")
        return named.groupBy(bucket, series).agg(F.sum("value").alias("value"))

    return apply


def top_values(name: str, n: int = 10, rare: bool = False):
    """Most (or least) frequent values with count and percentage of all rows."""

    def apply(df: DataFrame) -> DataFrame:
        counts = df.groupBy(field(df, name).alias(name)).agg(F.count(F.lit(1)).alias("count"))
        total = counts.agg(F.sum("count")).scalar()
        order = F.col("count").asc() if rare else F.col("count").desc()
        kept = counts.orderBy(order, F.col(name)).limit(n)
        return kept.select(name, "count", (F.col("count") * 100.0 / total).alias("percent"))

    return apply


def rare_values(name: str, n: int = 10):
    return top_values(name, n, rare=True)


def series_unpivot(time: str = "_time"):
    """Wide rows to one row per numeric column, skipping names that start with `_`."""

    def apply(df: DataFrame) -> DataFrame:
        numeric = [f.name for f in df.schema.fields if f.dataType.typeName() in NUMERIC and not f.name.startswith("_") and f.name != time]
        cast = df.select(time, *[F.col(c).cast("double").alias(c) for c in numeric])
        return cast.unpivot(time, numeric, "series", "value")

    return apply


NUMERIC = ("byte", "short", "integer", "long", "float", "double", "decimal")


def series_pivot(series: str, value: Column, values: list[str], time: str = "_time"):
    """One column per named series."""
    return lambda df: df.groupBy(time).pivot(series, values).agg(value)


def classify_threshold(column: str, thresholds: list[tuple[float, str]], target: str = "label", default: str | None = None):
    """Label of the highest threshold that the value reaches."""

    def apply(df: DataFrame) -> DataFrame:
        value = number(field(df, column))
        label = F.lit(default).cast("string")
        for limit, name in sorted(thresholds):
            label = F.when(value >= limit, F.lit(name)).otherwise(label)
        return df.withColumn(target, label)

    return apply


# Words that mark a cell as anomalous.
ANOMALY_WORDS = ("error", "fail", "deny", "critical", "exception", "unauthorized")


def cell_flag(name: str, col: Column) -> Column:
    """Highlight class of one cell, or NULL: by HTTP status, latency, log level, then anomaly words."""
    shown = text(col)
    none = F.lit(None).cast("string")
    style = none
    if name == "status":
        code = F.nullif(F.regexp_extract(shown, r"^\s*([+-]?\d+)", 1), F.lit("")).try_cast("long")
        style = F.when(code >= 500, "server_error").when(code >= 400, "client_error").when(code >= 200, "ok")
    elif name in ("latency", "duration"):
        lead = F.nullif(F.regexp_extract(shown, r"^\s*([+-]?\d*\.?\d+(?:[eE][+-]?\d+)?)", 1), F.lit("")).try_cast("double")
        style = F.when(lead > 1000, "very_slow").when(lead > 500, "slow")
    elif "level" in name.lower():
        style = F.when(shown == "ERROR", "error_level").when(shown == "WARN", "warn_level")
    return F.coalesce(style, F.when(F.lower(shown).rlike("|".join(ANOMALY_WORDS)), F.lit("anomaly")), none)


def flag_cells(*names: str):
    """Add `<name>_flag` for each named column."""
    return lambda df: df.select("*", *[cell_flag(n, field(df, n)).alias(f"{n}_flag") for n in names])


def report_delta(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Two results side by side: before, after, difference and status per key."""
    b = before.select(*[F.col(k).alias("_b_" + k) for k in keys], F.col(value).alias("before"), F.lit(1).alias("_in_b"))
    a = after.select(*keys, F.col(value).alias("after"), F.lit(1).alias("_in_a"))
    same = reduce(lambda x, y: x & y, [b["_b_" + k].eqNullSafe(a[k]) for k in keys])
    joined = b.join(a, same, "full_outer")
    status = (
        F.when(F.col("_in_b").isNull(), "added")
        .when(F.col("_in_a").isNull(), "removed")
        .when(F.col("before").eqNullSafe(F.col("after")), "unchanged")
        .otherwise("changed")
    )
    named = [F.coalesce(F.col(k), F.col("_b_" + k)).alias(k) for k in keys]
    diff = F.coalesce(F.col("after"), F.lit(0)) - F.coalesce(F.col("before"), F.lit(0))
    return joined.select(*named, "before", "after", diff.alias("diff"), status.alias("status"))
