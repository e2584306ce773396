"""Field resolution and coercion over events with typed columns and a dynamic payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENVELOPE_ALIASES = {"_time": "ts", "timestamp": "ts"}


def field(df: DataFrame, name: str) -> Column:
    """Column `name` if present, else the path into `data`, else a NULL string.

    Envelope names `timestamp` and `_time` fall back to `ts`.
    """
    if name in df.columns:
        return F.col(f"`{name}`")
    alias = ENVELOPE_ALIASES.get(name)
    if alias and alias in df.columns:
        return F.col(alias)
    if "data" in df.columns:
        kind = df.schema["data"].dataType
        if isinstance(kind, T.MapType):
            return F.col("data")[name]
        if isinstance(kind, T.VariantType):
            return F.try_variant_get("data", f"$['{name}']", "string")
        if isinstance(kind, T.StructType) and name in kind.fieldNames():
            return F.col("data")[name]
        if isinstance(kind, T.StringType):
            return F.get_json_object("data", f"$['{name}']")
    return F.lit(None).cast("string")


def has_field(df: DataFrame, name: str) -> bool:
    """Whether `name` can be resolved at plan time (dynamic payloads can hold any name)."""
    if name in df.columns or ENVELOPE_ALIASES.get(name) in df.columns:
        return True
    if "data" not in df.columns:
        return False
    kind = df.schema["data"].dataType
    return not isinstance(kind, T.StructType) or name in kind.fieldNames()


def whole_number(df: DataFrame, name: str) -> bool:
    """Whether `name` is a column of an integral type, which compares with an integer exactly."""
    return name in df.columns and isinstance(df.schema[name].dataType, T.IntegralType)


def number(col: Column) -> Column:
    """Double value of numbers and numeric text, NULL for everything else."""
    return col.try_cast("double")


def text(col: Column) -> Column:
    return col.cast("string")


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def first_text(df: DataFrame, names: list[str], skip_empty: bool = False) -> Column:
    """First non-NULL (optionally non-empty) of several fields as text."""
    cols = [text(field(df, n)) for n in names if has_field(df, n)]
    if skip_empty:
        cols = [F.nullif(c, F.lit("")) for c in cols]
    return F.coalesce(*cols) if cols else F.lit(None).cast("string")


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Events with a zoned timestamp, which watermarks need."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def pair_order(df: DataFrame, ts: str, tie: str) -> Column:
    """A value that orders rows by (ts, tie), nulls first.

    For a whole-numbered `tie` it is one decimal, which a hash aggregate can hold; a pair makes Spark sort every row.
    """
    if not isinstance(df.schema[tie].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.struct(ts, tie)
    micros = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(-(1 << 62)))
    step = F.lit(str(2 * 10**19)).cast("decimal(20,0)")  # above the range of a long
    return micros.cast("decimal(19,0)") * step + F.coalesce(F.col(tie).cast("long"), F.lit(-(1 << 63))).cast("decimal(19,0)")
