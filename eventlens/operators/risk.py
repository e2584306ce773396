"""Risk scores: capped sums, hourly decay, and clamped adjustments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.functions.ordered import ordinal
from eventlens.functions.spans import span_seconds

CAP = 100
# Base score per severity.
BASE_SCORES = {"critical": 50, "high": 30, "medium": 15, "low": 5}


def severity_score(severity: Column, confidence: Column) -> Column:
    """Base score of the severity times the confidence, truncated."""
    base = F.lit(0)
    for name, score in BASE_SCORES.items():
        base = F.when(severity == name, score).otherwise(base)
    return (base * confidence).cast("int")


def anomaly_increments(anomalies: DataFrame) -> DataFrame:
    """Risk per behaviour anomaly: 40 if high, else 20."""
    return anomalies.select("entity", "ts", F.when(F.col("severity") == "high", 40).otherwise(20).alias("score"))


def risk_score(increments: DataFrame) -> DataFrame:
    """Score and incident count per entity. Increments are never negative, so capping the sum equals capping each step."""
    return increments.groupBy("entity").agg(
        F.least(F.lit(CAP), F.sum("score")).cast("int").alias("score"), F.count(F.lit(1)).alias("incidents"), F.max("ts").alias("last_update")
    )


def risk_decay(increments: DataFrame, as_of: str, factor: float = 0.5, interval: str = "1h") -> DataFrame:
    """Score per entity at `as_of` when every interval ends with `score = trunc(score * factor)`.

    Increments are summed per interval first, which is exact because they are never negative;
    an entity's array is then as long as its active intervals, not its events. With a factor
    below 1 a whole score reaches 0 within 101 steps, which bounds the decay over a gap.
    """
    step = span_seconds(interval)
    at = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / step)
    end = F.floor(F.unix_seconds(F.lit(as_of).cast("timestamp")) / step)
    past = increments.where(F.col("ts").cast("timestamp") <= F.lit(as_of).cast("timestamp"))
    slots = past.groupBy("entity", at.alias("slot")).agg(F.sum("score").alias("added"))
    history = slots.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("slot", "added"))).alias("h"))

    def decay(score: Column, times: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.least(times, F.lit(CAP + 1))), score, lambda s, _: F.floor(s * factor).cast("long"))

    def fold(state: Column, item: Column) -> Column:
        gap = item["slot"] - state["slot"]
        left = F.when(gap > 0, decay(state["score"], gap)).otherwise(state["score"])
        score = F.least(F.lit(CAP).cast("long"), left + item["added"])
        return F.struct(item["slot"].alias("slot"), score.alias("score"))

    start = F.struct(F.element_at("h", 1)["slot"].alias("slot"), F.lit(0).cast("long").alias("score"))
    final = F.aggregate("h", start, fold)
    folded = history.select("entity", final.alias("s"))
    rest = end - F.col("s.slot")
    return folded.select("entity", F.when(rest > 0, decay(F.col("s.score"), rest)).otherwise(F.col("s.score")).cast("int").alias("score"))


def entity_risk_adjust(deltas: DataFrame, start: DataFrame | None = None, tie: str = "event_id", block: int = 1000, group_rows: int | None = None) -> DataFrame:
    """Final `clamp(score + delta, 0, 100)` per entity over its signed deltas in order.

    "Add, then clamp" steps compose into one step of the same form, so an entity's deltas are
    composed block by block: each round shrinks the rows by `block`, and no task ever
    holds more than `block` of them per entity. Entities absent from `start` begin at 0.
    """
    placed = ordinal(deltas.select("entity", "ts", tie, "delta"), ["entity"], ["ts", tie], "_rn", group_rows)
    steps = placed.select("entity", (F.col("_rn") - 1).alias("i"), F.col("delta").cast("long").alias("add"), F.lit(0).cast("long").alias("lo"), F.lit(CAP).cast("long").alias("hi"))

    def compose(first: Column, then: Column) -> Column:
        through = lambda x: F.least(F.greatest(x + then["add"], then["lo"]), then["hi"])
        return F.struct((first["add"] + then["add"]).alias("add"), through(first["lo"]).alias("lo"), through(first["hi"]).alias("hi"))

    longest = placed.agg(F.max("_rn")).first()[0] or 0
    while True:
        packed = F.array_sort(F.collect_list(F.struct("i", "add", "lo", "hi")))
        grouped = steps.groupBy("entity", F.floor(F.col("i") / block).alias("i")).agg(packed.alias("s"))
        first = F.element_at("s", 1)
        whole = F.aggregate(
            F.slice("s", 2, block), F.struct(first["add"].alias("add"), first["lo"].alias("lo"), first["hi"].alias("hi")), compose
        )
        steps = grouped.select("entity", "i", whole.alias("w")).select("entity", "i", "w.*")
        longest = -(-longest // block)
        if longest <= 1:
            break
    base = F.lit(0)
    if start is not None:
        steps = steps.join(start.select("entity", F.col("score").alias("_start")), "entity", "left")
        base = F.coalesce(F.col("_start"), F.lit(0))
    final = F.least(F.greatest(base + F.col("add"), F.col("lo")), F.col("hi"))
    return steps.select("entity", final.cast("int").alias("score"))
