"""Mixing sources to target weights along a curriculum that changes over training time.

A source has a weight over training time t in [0, 1], piecewise linear between knots. Its
integral, scaled to the source's target, is the demand for its words up to t. The documents of a
source stand in a fixed pseudo-random order, one epoch after another; a copy whose words begin
where the demand reaches them gets the t at which it does, by inverting the integral. Sorting by t
gives the training order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm.common import WORD

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2.0
#: By position of the weight: heavy sources fade, the middle ones hold, light ones rise.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 0.75), (1.0, 2.25)))
PIECES = 4_096

Schedule = Sequence[tuple[float, float]]


def position(share: Column, schedule: Schedule) -> Column:
    """Training time at which a schedule's integral reaches `share` (0 to 1) of its whole."""
    areas = [(w0 + w1) / 2 * (t1 - t0) for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False)]
    whole, passed, out = sum(areas), 0.0, None
    for ((t0, w0), (t1, w1)), area in zip(zip(schedule, schedule[1:], strict=False), areas, strict=True):
        slope, need = (w1 - w0) / (t1 - t0), F.greatest(share * whole - passed, F.lit(0.0))
        at = t0 + (need / w0 if slope == 0 else (F.sqrt(F.greatest(w0 * w0 + 2 * slope * need, F.lit(0.0))) - w0) / slope)
        passed += area
        inside = share * whole <= passed
        out = F.when(inside, at) if out is None else out.when(inside, at)
    return out.otherwise(F.lit(schedule[-1][0]))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """source, source_size, rank and target of every source; `sizes` has source and size.

    Sources stand by code point, null last, and weigh `weights`, repeating. They share `share` times
    all sizes by weight; no target exceeds `limit` times its source's size, and the excess goes to
    the others by weight until none is above. All documents empty: every target is 0.
    One row for each source passes through one task; the documents don't.
    """
    every = Window.partitionBy(F.lit(0))
    up = every.orderBy(F.col("ratio"), F.col("rank"))
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    ranked = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
        .withColumn("top", F.col("source_size") * F.lit(float(limit)))
        .withColumn("ratio", F.col("top") / F.col("weight"))
        .withColumn("level", (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    )
    # the first source, by ratio, that its limit does not stop sets the level of all after it
    free = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "rank", "level"))).over(every)
    return ranked.withColumn("free", free).select("source", "source_size", "rank", F.when(F.col("free").isNotNull() & (F.struct("ratio", "rank") >= F.struct("free.ratio", "free.rank")), F.col("weight") * F.col("free.level")).otherwise(F.col("top")).alias("target"))


def plan_mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, schedules: Sequence[Schedule] = SCHEDULES, keep: Sequence[str] | None = None
) -> DataFrame:
    """`_row`, the columns of `docs` in `keep` (all, if None), and `_mix`: size, source_size, target, taken, and the `positions` of each copy.

    The order within a source is that of md5(doc_id), then doc_id, then the text's hash. A copy is
    taken if half of it or more lies below the target, so what a source gives misses its target by half a
    document at most. A document is taken `limit` times at most. Null text has size 0; a document of
    size 0 is taken once, as it costs no words. Null ids, sources and repeated rows are rows like others.

    A source is cut into `PIECES` pieces by that order; running sums go over the pieces, then inside
    each piece, so that no task gets a whole source.
    """
    hashed = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]).alias("_d"),
        F.col("source").alias("_source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
        hashed.alias("_hash"),
        F.col("doc_id").alias("_id"),
        F.xxhash64("text").alias("_tie"),
        F.conv(F.substring(hashed, 1, 3), 16, 10).cast("int").alias("_piece"),
    )
    pieces = sized.groupBy("_source", "_piece").agg(F.sum("_size").alias("_piece_size"))
    targets = source_targets(pieces.select(F.col("_source").alias("source"), F.col("_piece_size").alias("size")), weights, share, limit)
    along = Window.partitionBy("_source").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        pieces.withColumn("_before", F.coalesce(F.sum("_piece_size").over(along), F.lit(0)))
        .join(targets, F.col("_source").eqNullSafe(F.col("source")))
        .select(F.col("_source").alias("_s"), F.col("_piece").alias("_p"), "_before", "source_size", "target", "rank")
    )
    within = Window.partitionBy("_source", "_piece").orderBy("_hash", "_id", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        sized.withColumn("_inside", F.coalesce(F.sum("_size").over(within), F.lit(0)))
        .join(starts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_piece") == F.col("_p")))
        .withColumn("_start", F.col("_before") + F.col("_inside"))
    )
    copies, late = [], F.col("source_size").cast("double")
    for epoch in range(int(limit)):
        begin = F.col("_start") + epoch * late
        taken = begin + F.col("_size") / 2 <= F.col("target") if epoch else (F.col("_size") == 0) | (begin + F.col("_size") / 2 <= F.col("target"))
        if epoch:
            taken = taken & (F.col("_size") > 0)
        share_of = F.when(F.col("target") > 0, F.least(begin / F.col("target"), F.lit(1.0))).otherwise(0.0)
        at = None
        for k, schedule in enumerate(schedules):
            here = F.col("rank") % len(schedules) == k
            at = F.when(here, position(share_of, schedule)) if at is None else at.when(here, position(share_of, schedule))
        copies.append(F.when(taken, at))
    placed = placed.withColumn("_positions", F.filter(F.array(*copies), lambda x: x.isNotNull()))
    return placed.select(
        F.col("_d").alias("_row"),
        F.struct(F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.size("_positions")).alias("taken"), F.col("_positions").alias("positions")).alias("_mix"),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The training set in training order: the columns of `docs`, a row for each copy taken."""
    rows = plan_mix(docs, **options).select("_row", F.explode("_mix.positions").alias("_position"))
    order = F.col("_position"), F.xxhash64("_row.doc_id")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("_row.*")
