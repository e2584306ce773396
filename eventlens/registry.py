"""Named extensions: transforms, aggregates and parsers that user code can add.

A transform is any DataFrame→DataFrame function, an aggregate any Column aggregate
(built in or a grouped-aggregate pandas UDF; see `stats.register_aggregate`), a parser a
Column→Column function, and a record parser a Python table function for text that holds
several records.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.operators.stats import AGGREGATES, register_aggregate

TRANSFORMS: dict[str, Callable[..., DataFrame]] = {}
PARSERS: dict[str, Callable[[Column], Column]] = {}
RECORD_PARSERS: dict[str, object] = {}

__all__ = ["AGGREGATES", "PARSERS", "TRANSFORMS", "parse", "parse_records", "register_aggregate", "register_parser", "register_record_parser", "register_transform", "transform"]


def register_transform(name: str, step: Callable[..., DataFrame]) -> None:
    TRANSFORMS[name] = step


def transform(name: str, **options):
    """The named step for `df.transform`."""
    return lambda df: TRANSFORMS[name](df, **options)


def register_parser(name: str, build: Callable[[Column], Column]) -> None:
    PARSERS[name] = build


def parse(name: str, raw: str = "value", target: str = "data"):
    """Parse the raw column into `target`, with a flag for NULL results."""
    return lambda df: df.withColumn(target, PARSERS[name](F.col(raw))).withColumn("bad_record", F.col(target).isNull())


def register_record_parser(name: str, table_function) -> None:
    """A user-defined table function that yields the records of one text."""
    RECORD_PARSERS[name] = table_function


def parse_records(name: str, raw: str = "value", keep: list[str] | None = None):
    """One row per record, joined laterally to the kept columns of its source row."""

    def apply(df: DataFrame) -> DataFrame:
        joined = df.lateralJoin(RECORD_PARSERS[name](F.col(raw).outer()))
        added = [c for c in joined.columns if c not in df.columns]
        return joined.select(*(df.columns if keep is None else keep), *added)

    return apply
