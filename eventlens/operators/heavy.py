"""The largest groups of an aggregation and one row for all others, so that totals stay whole.

One pass keeps a frequent-items summary of bounded size (merged map side and across tasks); a second one aggregates exactly, under their own keys for
the candidates and under one key for the rest. A group the summary lost can have at most a known share of the rows: if the last
group shown has more than that, no larger one can be missing. Otherwise all groups are counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.operators.stats import aggregate_columns, group_key
from eventlens.session import cut_lineage

TRACKED = 10_000


def lost_at_most(rows: int, tracked: int) -> int:
    """Most rows of a group that a summary of `tracked` items may have lost."""
    size = 1
    while size * 3 // 4 < tracked:
        size *= 2
    return int(3.5 * rows / size)


def largest_groups(df: DataFrame, by: Sequence[str], limit: int, tracked: int = TRACKED) -> DataFrame:
    """`by` (as `_item`, their JSON) and `n` of the `limit` largest groups exactly, ties to the lesser `_item`; `limit` rows at most."""
    keyed = df.select(F.to_json(F.struct(*[group_key(df, b) for b in by]), {"ignoreNullFields": "false"}).alias("_item"))
    asked = min(tracked, max(4 * limit, 64))
    found = keyed.agg(F.count(F.lit(1)).alias("rows"), F.expr(f"approx_top_k(_item, {asked}, {tracked})").alias("top")).first()
    spark = df.sparkSession
    if not found.rows:
        return spark.createDataFrame([], "_item string, n bigint")
    names = [(t["item"],) for t in found.top]
    # `asked` rows at most
    counted = keyed.join(F.broadcast(spark.createDataFrame(names, "_item string")), "_item").groupBy("_item").agg(F.count(F.lit(1)).alias("n"))
    best = counted.orderBy(F.desc("n"), "_item").limit(limit).collect()
    unseen = max(lost_at_most(found.rows, tracked), found.top[-1]["count"] if len(found.top) == asked else 0)
    sure = len(best) == limit and best[-1].n > unseen or len(found.top) < asked and lost_at_most(found.rows, tracked) < 1
    if sure:
        return spark.createDataFrame([(r["_item"], r.n) for r in best], "_item string, n bigint")
    return cut_lineage(keyed.groupBy("_item").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "_item").limit(limit))


def stats_largest(by: Sequence[str], aggs, limit: int, tracked: int = TRACKED):
    """`stats_by` for the `limit` groups with most rows, and one row with `rest` true and null keys for everything else.

    The aggregates of the rest are those of all its rows. Without other groups there is no rest row.
    """

    def apply(df: DataFrame) -> DataFrame:
        keys = [group_key(df, b) for b in by]
        item: Column = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
        shown = F.broadcast(largest_groups(df, by, limit, tracked).select(F.col("_item").alias("_shown")))
        marked = df.withColumn("_item", item).join(shown, F.col("_item") == F.col("_shown"), "left")
        rest = F.col("_shown").isNull()
        names = [f"_k{i}" for i in range(len(by))]
        grouped = marked.groupBy(rest.alias("rest"), *[F.when(~rest, k).alias(n) for n, k in zip(names, keys, strict=True)]).agg(*aggregate_columns(marked, aggs))
        return grouped.select(*[F.col(n).alias(b) for n, b in zip(names, by, strict=True)], "rest", *[c for c in grouped.columns if c not in (*names, "rest")])

    return apply
