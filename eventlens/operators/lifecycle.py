"""Deduplication, storage tiers, retention and stage counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from eventlens.functions.fields import field
from eventlens.functions.ordered import FOLD_ROWS, greedy_spaced
from eventlens.functions.spans import span_seconds

DAY = 86400


def dedup_key(df: DataFrame, event_id: str = "id") -> Column:
    """Event id, or a hash of timestamp, source and message where there is none."""
    parts = [F.coalesce(field(df, n).cast("string"), F.lit("")) for n in ("@timestamp", "source", "message")]
    return F.coalesce(F.nullif(field(df, event_id).cast("string"), F.lit("")), F.sha2(F.concat(*parts), 256))


def dedup_ttl(ttl: str = "5m", event_id: str = "id", ts: str = "ts", tie: str = "event_id", fold_rows: int = FOLD_ROWS, group_rows: int | None = None):
    """Drop events whose key was last accepted less than `ttl` before."""

    def apply(df: DataFrame) -> DataFrame:
        keyed = df.withColumn("_key", dedup_key(df, event_id)).withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp")))
        flagged = greedy_spaced(keyed, ["_key"], "_at", span_seconds(ttl) * 1_000_000, [tie], "_accepted", fold_rows, group_rows)
        return flagged.where("_accepted").select(*df.columns)

    return apply


def tier_of(age_seconds: Column, cold: bool = True) -> Column:
    """Delete after 30 days, cold after 7 (if used), warm after 24 hours, else hot."""
    tier = F.when(age_seconds > 30 * DAY, "delete")
    if cold:
        tier = tier.when(age_seconds > 7 * DAY, "cold")
    return tier.when(age_seconds > DAY, "warm").otherwise("hot")


def assign_tier(as_of: str, ts: str = "ts", cold: bool = True, target: str = "tier"):
    """Tier by the age of the hour partition an event lies in."""

    def apply(df: DataFrame) -> DataFrame:
        hour = F.unix_seconds(F.date_trunc("hour", F.col(ts).cast("timestamp")))
        return df.withColumn(target, tier_of(F.unix_seconds(F.lit(as_of).cast("timestamp")) - hour, cold))

    return apply


def expire_events(as_of: str, days: int, audit_days: int | None = None, is_audit: Column | None = None, ts: str = "ts"):
    """Keep events within the retention period; audit rows may have their own."""

    def apply(df: DataFrame) -> DataFrame:
        # the limit takes the column's type, so that the column stays raw and the test reaches the scan
        limit = lambda d: F.col(ts) >= (F.lit(as_of).cast("timestamp") - F.make_dt_interval(days=F.lit(d))).cast(df.schema[ts].dataType)
        if is_audit is None or audit_days is None:
            return df.where(limit(days))
        audit = F.coalesce(is_audit, F.lit(False))
        return df.where(limit(max(days, audit_days)) & ((audit & limit(audit_days)) | (~audit & limit(days))))

    return apply


def drop_tombstones(df: DataFrame, marker: str = "_is_tombstone") -> DataFrame:
    return df.where(~F.coalesce(field(df, marker).cast("boolean"), F.lit(False)))


def stage_metrics(df: DataFrame, *stages: tuple[str, Column]) -> DataFrame:
    """Events in, out and dropped per stage, each keeping the rows of the stage before that pass its test.

    All stages are counted in one pass; where a stage is more than a test, count its frame with `observed`.
    """
    passed, counts = F.lit(True), []
    for _, test in stages:
        before, passed = passed, passed & F.coalesce(test, F.lit(False))
        counts += [F.count_if(before), F.count_if(passed)]
    counted = df.agg(*[c.alias(f"_{i}") for i, c in enumerate(counts)])
    rows = [
        F.struct(F.lit(n).alias("stage"), F.col(f"_{2 * i}").alias("events_in"), F.col(f"_{2 * i + 1}").alias("events_out"), (F.col(f"_{2 * i}") - F.col(f"_{2 * i + 1}")).alias("dropped"))
        for i, (n, _) in enumerate(stages)
    ]
    return counted.select(F.inline(F.array(*rows)))


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The frame with a row counter that is filled by whatever action runs next: no extra job."""
    watch = Observation(name)
    return df.observe(watch, F.count(F.lit(1)).alias("rows")), watch
