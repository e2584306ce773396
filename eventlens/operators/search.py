"""Filters, predicates and projections over events."""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.functions.fields import field, number, text, whole_number

# Words that full-text search ignores.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no",
    "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to",
    "was", "will", "with",
]

COMPARE = {
    "=": lambda a, b: a == b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
}


class FieldRef:
    """Marks the right side of a comparison as a field name."""

    def __init__(self, name: str):
        self.name = name


def search_keyword(*keywords: str, message: str = "message"):
    """Keep rows whose message holds every keyword, ignoring case; no message never matches."""

    def apply(df: DataFrame) -> DataFrame:
        body = F.lower(text(field(df, message)))
        return df.where(reduce(and_, [body.contains(k.lower()) for k in keywords], F.lit(True)))

    return apply


def equals_text(df: DataFrame, name: str, value) -> Column:
    """Whether the field, as text, equals the value; whole numbers compare as such so that the scan can skip data."""
    shown = str(value)
    if name in df.columns and isinstance(df.schema[name].dataType, T.IntegralType) and re.fullmatch(r"0|-?[1-9]\d{0,17}", shown):
        return field(df, name) == F.lit(int(shown))
    return text(field(df, name)) == F.lit(shown)


def search_field(**wanted):
    """Keep rows where every field, as text, equals the value. Envelope fields count too."""
    return lambda df: df.where(reduce(and_, [equals_text(df, k, v) for k, v in wanted.items()], F.lit(True)))


def tokens(col: Column) -> Column:
    """Distinct lower-case alphanumeric words of two or more letters, without stop words."""
    words = F.split(F.lower(col), "[^a-zA-Z0-9]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(STOP_WORDS)))


def token_index(df: DataFrame, key: str, body: str) -> DataFrame:
    """One row per (token, key)."""
    return df.select(F.explode(tokens(F.col(body))).alias("token"), F.col(key))


def write_token_index(index: DataFrame, key: str, path: str) -> None:
    """Write the index ordered by token, with Bloom filters, so that a lookup reads few row groups.

    Ranges over (token, key) spread a frequent token over several files.
    """
    placed = index.repartitionByRange("token", key).sortWithinPartitions("token", key)
    placed.write.mode("overwrite").option("parquet.bloom.filter.enabled#token", "true").parquet(path)


def search_tokens(query: str, body: str = "message"):
    """Keep rows that hold every token of `query` (no index needed)."""
    wanted = [w for w in dict.fromkeys(re.split("[^a-zA-Z0-9]+", query.lower())) if len(w) >= 2 and w not in STOP_WORDS]

    def apply(df: DataFrame) -> DataFrame:
        if not wanted:
            return df
        # the plain substring test is cheap and drops most rows before their text is split
        rough = reduce(and_, [F.lower(field(df, body)).contains(w) for w in wanted])
        return df.where(rough).where(F.size(F.array_except(F.array(*map(F.lit, wanted)), tokens(field(df, body)))) == 0)

    return apply


def search_index(index: DataFrame, query: str, key: str) -> DataFrame:
    """Keys whose indexed tokens include every token of `query`."""
    wanted = [w for w in dict.fromkeys(re.split("[^a-zA-Z0-9]+", query.lower())) if len(w) >= 2 and w not in STOP_WORDS]
    hits = index.where(F.col("token").isin(wanted)).groupBy(key).agg(F.count_distinct("token").alias("_n"))
    return hits.where(F.col("_n") == len(wanted)).select(key)


def compare(df: DataFrame, name: str, op: str, value, lexical: bool = False, null_neq: bool = True) -> Column:
    """One comparison. `value` may be a literal or a `FieldRef`.

    Values compare by type: numeric text compares as a number when the literal is a
    number; integers compare with integral columns exactly, on the raw column. `lexical=True` compares text renderings instead. With `null_neq`, `!=` holds
    when either side is missing; every other operator then fails.
    """
    left = field(df, name)
    right = field(df, value.name) if isinstance(value, FieldRef) else F.lit(value)
    if lexical:
        left, right = text(left), text(right)
    elif isinstance(value, (int, float)) and not isinstance(value, bool) and not (isinstance(value, int) and whole_number(df, name)):
        left = number(left)
    if op == "!=" and null_neq:
        return (left != right) | left.isNull() | right.isNull()
    return COMPARE[op](left, right)


def where_compare(name: str, op: str, value, lexical: bool = False, null_neq: bool = True):
    """Keep rows for which the comparison holds."""
    return lambda df: df.where(compare(df, name, op, value, lexical, null_neq))


def where_field_compare(left: str, op: str, right: str, **options):
    """Compare two fields of the same row."""
    return where_compare(left, op, FieldRef(right), **options)


def where_bool(*predicates, any_of: bool = False, negate: bool = False):
    """AND (or OR) of `(name, op, value)` triples or DataFrame→Column functions, optionally negated."""

    def apply(df: DataFrame) -> DataFrame:
        parts = [p(df) if callable(p) else compare(df, *p) for p in predicates]
        if not negate:  # a filter drops NULL by itself, and raw predicates reach the scan
            return df.where(reduce(or_ if any_of else and_, parts))
        return df.where(~reduce(or_ if any_of else and_, [F.coalesce(p, F.lit(False)) for p in parts]))

    return apply


def fields_keep(*names: str):
    """Keep the listed fields that exist."""
    return lambda df: df.select(*[field(df, n).alias(n) for n in names if n in df.columns or "data" in df.columns])


def fields_drop(*names: str):
    return lambda df: df.drop(*names)


def fields_regex(pattern: str, drop: bool = False):
    """Keep or drop the columns whose name matches the pattern."""
    matcher = re.compile(pattern)

    def apply(df: DataFrame) -> DataFrame:
        hits = [c for c in df.columns if matcher.search(c)]
        return df.drop(*hits) if drop else df.select(*hits)

    return apply


def eval_copy(target: str, source: str):
    """Copy a field; a missing source leaves the target as it was."""

    def apply(df: DataFrame) -> DataFrame:
        src = field(df, source)
        if target not in df.columns:
            return df.withColumn(target, src)
        kind = df.schema[target].dataType
        return df.withColumn(target, F.coalesce(src.cast(kind), F.col(target)))

    return apply


def eval_arith(target: str, left: str, op: str, right):
    """`left op right` in doubles; missing or non-numeric counts as 0; division by 0 leaves the target as it was.

    `right` is a field name or a number.
    """

    def apply(df: DataFrame) -> DataFrame:
        zero = F.lit(0.0)
        a = F.coalesce(number(field(df, left)), zero)
        b = F.lit(float(right)) if isinstance(right, (int, float)) else F.coalesce(number(field(df, right)), zero)
        result = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b)}[op]()
        if op == "/" and target in df.columns:
            result = F.coalesce(result, number(F.col(target)))
        return df.withColumn(target, result)

    return apply


def eval_expr(target: str, expression: str | Column):
    """Any Spark SQL expression as a new field."""
    return lambda df: df.withColumn(target, F.expr(expression) if isinstance(expression, str) else expression)


def drill_include(clicked: dict):
    """Keep rows equal to the clicked row in every field whose name does not start with `_`."""
    return search_field(**{k: v for k, v in clicked.items() if not k.startswith("_")})


def drill_exclude(clicked: dict):
    """Keep rows different from the clicked row in every such field."""
    pairs = [(k, "!=", str(v)) for k, v in clicked.items() if not k.startswith("_")]

    def apply(df: DataFrame) -> DataFrame:
        return df.where(reduce(and_, [compare(df, *p, lexical=True) for p in pairs], F.lit(True)))

    return apply


def drill_timezoom(point: datetime, minutes: int = 5, column: str = "_time"):
    """Keep rows strictly within `minutes` of a point in time."""

    def apply(df: DataFrame) -> DataFrame:
        at = field(df, column).cast("timestamp")
        lower, upper = (F.lit((point + timedelta(minutes=s * minutes)).isoformat(sep=" ")).cast("timestamp") for s in (-1, 1))
        return df.where((at > lower) & (at < upper))

    return apply


def drill_pivot(clicked: dict, default: str = "host"):
    """Count by the first clicked field."""
    name = next((k for k in clicked if not k.startswith("_")), default)
    return lambda df: df.groupBy(field(df, name).alias(name)).agg(F.count(F.lit(1)).alias("count"))


def text_find(query: str, columns: list[str], labels: str | None = None):
    """Case-insensitive substring in any of the columns or labels; an empty query finds nothing."""
    needle = query.lower()

    def apply(df: DataFrame) -> DataFrame:
        if not needle:
            return df.where(F.lit(False))
        tests = [F.coalesce(F.lower(text(field(df, c))).contains(needle), F.lit(False)) for c in columns]
        if labels:
            tests.append(F.coalesce(F.exists(F.col(labels), lambda x: F.lower(x).contains(needle)), F.lit(False)))
        return df.where(reduce(or_, tests))

    return apply


def scope_filter(role: str, index: str = "index"):
    """Rows of the indexes a role may see: the audit index for auditors, all for analysts and admins."""

    def apply(df: DataFrame) -> DataFrame:
        if role in ("analyst", "admin"):
            return df
        return df.where(field(df, index) == "_audit") if role == "auditor" else df.where(F.lit(False))

    return apply
