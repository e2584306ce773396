"""Tenants, quotas, priorities and load shedding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.functions.fields import field, first_text
from eventlens.functions.ordered import Runs, largest_group, ordinal
from eventlens.functions.spans import bucket, span_seconds
from eventlens.session import cut_lineage

# Fields that may name the tenant, in order.
TENANT_FIELDS = ("tenant_id", "tenant", "organization_id", "org_id", "customer_id")


def tenant_id(df: DataFrame, target: str = "tenant_id") -> DataFrame:
    """First non-empty tenant field, else `default`."""
    return df.withColumn(target, F.coalesce(first_text(df, list(TENANT_FIELDS), skip_empty=True), F.lit("default")))


def tenant_rate_quota(per_second: int, tenant: str = "tenant", ts: str = "ts", tie: str = "event_id", group_rows: int | None = None):
    """Accept at most `per_second` events per tenant and calendar second; 0 means no limit."""

    def apply(df: DataFrame) -> DataFrame:
        if per_second <= 0:
            return df.withColumn("accepted", F.lit(True))
        seconds = df.withColumn("_second", F.unix_seconds(F.col(ts).cast("timestamp")))
        placed = ordinal(seconds, [tenant, "_second"], [ts, tie], "_rn", group_rows)
        return placed.withColumn("accepted", F.col("_rn") <= per_second).select(*df.columns, "accepted")

    return apply


def tenant_storage_quota(
    limit: int, tenant: str = "tenant", size: str = "bytes", ts: str = "ts", tie: str = "event_id", fold_rows: int = 2_000, group_rows: int | None = None
):
    """Accept events in order while the accepted bytes of a tenant stay within `limit`; rejected bytes do not count.

    A size is small if it is at most half the room left. A round goes on to the first small event that
    does not fit or the first big one that does, by a running sum of the small ones; before it the small ones
    are accepted and the big ones rejected. Either leaves less than half the room, so that there are at
    most log2(`limit`) + 1 rounds. What exceeds the room left is dropped for good, and tenants with few
    candidates left are finished as arrays. Sizes must not be negative; a null size is rejected.
    """

    def apply(df: DataFrame) -> DataFrame:
        base = df.select(F.col(tie).alias("_id"), F.col(tenant).alias("_t"), F.col(ts).alias("_ts"), F.col(size).cast("long").alias("_b"))
        open_rows = cut_lineage(base.withColumn("_room", F.lit(limit).cast("long")).where("_b <= _room"))
        taken = None
        while largest_group(open_rows, ["_t"]) > fold_rows:
            small = F.col("_b") <= F.col("_room") - F.col("_b")
            runs = Runs(open_rows, ["_t"], ["_ts", "_id"], group_rows).before(_sum=("sum", F.when(small, F.col("_b")).otherwise(0)))
            fits = F.col("_sum") <= F.col("_room") - F.col("_b")
            runs.frame = runs.frame.withColumn("_fits", fits).withColumn("_turn", small != fits)
            seen = cut_lineage(runs.before(_past=("max", F.when(F.col("_turn"), F.lit(1)))).done())
            accepted = seen.where("_past is null and _fits")
            taken = accepted.select("_id") if taken is None else taken.union(accepted.select("_id"))
            used = seen.groupBy("_t").agg(F.sum(F.when(F.col("_past").isNull() & F.col("_fits"), F.col("_b")).otherwise(0)).alias("_used")).withColumnRenamed("_t", "_u")
            rest = seen.where("_past is not null").select("_id", "_t", "_ts", "_b", "_room").join(used, F.col("_t").eqNullSafe(F.col("_u"))).drop("_u")
            rest = rest.withColumn("_room", F.col("_room") - F.col("_used")).drop("_used")
            open_rows = cut_lineage(rest.where("_b <= _room"))
        queued = open_rows.groupBy("_t").agg(F.first("_room").alias("_room"), F.array_sort(F.collect_list(F.struct("_ts", "_id", "_b"))).alias("_q"))
        kind = base.schema["_id"].dataType.simpleString()
        start = F.struct(F.col("_room").alias("room"), F.array().cast(f"array<{kind}>").alias("ids"))

        def admit(state: Column, item: Column) -> Column:
            fit = item["_b"] <= state["room"]
            room = F.when(fit, state["room"] - item["_b"]).otherwise(state["room"])
            ids = F.when(fit, F.concat(state["ids"], F.array(item["_id"]))).otherwise(state["ids"])
            return F.struct(room.alias("room"), ids.alias("ids"))

        folded = queued.select(F.explode(F.aggregate("_q", start, admit)["ids"]).alias("_id"))
        taken = (folded if taken is None else taken.union(folded)).withColumn("_ok", F.lit(True))
        joined = df.join(taken, df[tie] == taken["_id"], "left")
        return joined.select(*df.columns, F.coalesce("_ok", F.lit(False)).alias("accepted"))

    return apply


def tenant_usage(df: DataFrame, tenant: str = "tenant", outcome: str = "outcome", size: str = "bytes") -> DataFrame:
    """Events and bytes per tenant and outcome (`accepted` or the reason for dropping)."""
    return df.groupBy(tenant, outcome).agg(F.count(F.lit(1)).alias("events"), F.coalesce(F.sum(F.col(size).cast("long")), F.lit(0)).alias("bytes"))


def event_priority(df: DataFrame, target: str = "priority") -> DataFrame:
    """Given priority, else the severity if critical, high or medium, else medium."""
    severity = field(df, "severity").cast("string")
    from_severity = F.when(severity.isin("critical", "high", "medium"), severity)
    return df.withColumn(target, F.coalesce(field(df, "priority").cast("string"), from_severity, F.lit("medium")))


def sample_events(probability: float | Column, key: str = "event_id"):
    """Keep events with a given probability, decided by a hash of the key so that reruns agree."""
    p = probability if isinstance(probability, Column) else F.lit(float(probability))
    return lambda df: df.where(F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 1_000_000 < p * 1_000_000)
