"""Parsers over a raw-text column: typed columns plus a `bad_record` flag."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.functions.fields import field, has_field


def parse_json(raw: str = "value", schema: str | None = None):
    """JSON text into a struct `data`, or a variant when no schema is given."""

    def apply(df: DataFrame) -> DataFrame:
        parsed = F.try_parse_json(F.col(raw)) if schema is None else F.when(F.try_parse_json(F.col(raw)).isNotNull(), F.from_json(raw, schema))
        return df.withColumn("data", parsed).withColumn("bad_record", F.col("data").isNull())

    return apply


def parse_xml(schema: str, raw: str = "value"):
    """XML text into a struct `data`; malformed text gives a NULL struct and a flag."""

    def apply(df: DataFrame) -> DataFrame:
        parsed = F.from_xml(F.col(raw), f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
        rows = df.withColumn("data", parsed)
        bad = F.col("data").isNull() | F.col("data._corrupt").isNotNull()
        return rows.withColumn("bad_record", bad).withColumn("data", F.when(~bad, F.col("data").dropFields("_corrupt")))

    return apply


def parse_csv(schema: str, raw: str = "value", **options: str):
    """One CSV record per row into a struct `data`."""

    def apply(df: DataFrame) -> DataFrame:
        parsed = F.from_csv(F.col(raw), f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", **options})
        rows = df.withColumn("data", parsed)
        bad = F.col("data").isNull() | F.col("data._corrupt").isNotNull()
        return rows.withColumn("bad_record", bad).withColumn("data", F.col("data").dropFields("_corrupt"))

    return apply


def read_csv(spark, path: str, headers: list[str] | None = None) -> DataFrame:
    """CSV files with the given column names, or with names from each file's first row."""
    reader = spark.read.option("quote", '"').option("escape", '"').option("multiLine", "true")
    if headers is None:
        return reader.option("header", "true").csv(path)
    return reader.schema(", ".join(f"`{h}` string" for h in headers)).csv(path)


def parse_regex(patterns: dict[str, str], raw: str = "value"):
    """One column per named pattern: group 1 of the first match, or the match itself; NULL without a match."""

    def extract(pattern: str) -> Column:
        group = 1 if re.compile(pattern).groups else 0
        return F.when(F.col(raw).rlike(pattern), F.regexp_extract(raw, pattern, group))

    def apply(df: DataFrame) -> DataFrame:
        rows = df.withColumns({name: extract(p) for name, p in patterns.items()})
        return rows.withColumn("bad_record", F.coalesce(*[F.col(n) for n in patterns]).isNull())

    return apply


# Fields that may hold the time, and the formats tried on each.
TIME_FIELDS = ("timestamp", "time", "@timestamp", "ts", "date")
TIME_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX",
    "dd MMM yyyy HH:mm:ss z",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy/MM/dd HH:mm:ss",
    "MMM dd HH:mm:ss",
)


def parse_time(col: Column) -> Column:
    """Timestamp from RFC 3339, RFC 1123 or one of the plain formats; NULL if none fits."""
    shown = F.regexp_replace(col.cast("string"), "^[A-Z][a-z]{2}, ", "")
    return F.coalesce(*[F.try_to_timestamp(shown, F.lit(f)) for f in TIME_FORMATS])


def normalize_event(mappings: dict[str, str] | None = None, default: Column | None = None):
    """Add `@timestamp` from the first readable time field (else now) and copies under mapped names."""

    def apply(df: DataFrame) -> DataFrame:
        found = [parse_time(field(df, n)) for n in TIME_FIELDS if n in df.columns or ("data" in df.columns and has_field(df, n))]
        now = F.current_timestamp() if default is None else default
        renamed = {to: field(df, source) for source, to in (mappings or {}).items() if has_field(df, source)}
        return df.withColumns({"@timestamp": F.coalesce(*found, now), **renamed})

    return apply
