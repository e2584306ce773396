"""Behaviour baselines per entity, features and anomaly scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.functions.fields import field, first_text, has_field, number, pair_order
from eventlens.functions.ordered import Runs, ordinal
from eventlens.functions.spans import bucket, span_seconds

ENTITY_FIELDS = ("user", "user_name", "src_ip")


def with_entity(df: DataFrame, names=ENTITY_FIELDS) -> DataFrame:
    """Events that name an entity: the first present of the given fields."""
    return df.withColumn("entity", first_text(df, list(names))).where("entity is not null and entity <> ''")


def _state(df: DataFrame, names, group_rows: int | None) -> DataFrame:
    """What is known of the entity just before each event.

    The pass per entity comes first: the finer keys (hour, process) are then already
    co-located, so that all of it costs one shuffle, of only the columns the checks need.
    """
    rows = with_entity(df, names)
    rows = rows.select(
        "event_id",
        "entity",
        "ts",
        field(rows, "source").cast("string").alias("source"),
        field(rows, "src_ip").cast("string").alias("_ip"),
        field(rows, "process_name").cast("string").alias("_proc"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("_at"),
        F.hour("ts").alias("_hour"),
    )
    order = ["ts", "event_id"]
    runs = Runs(rows, ["entity"], order, group_rows)
    small = not runs.split
    seen = runs.before(
        _total=("count", F.lit(1)), _last_ip=("last", F.col("_ip")), _last_at=("last", F.col("_at")), _processes=("count", F.col("_proc"))
    ).done()
    seen = ordinal(seen, ["entity", "_hour"], order, "_nth_in_hour", group_rows, small)
    seen = ordinal(seen, ["entity", "_proc"], order, "_nth_run", group_rows, small)
    first_run = F.col("_proc").isNotNull() & (F.col("_nth_run") == 1)
    known = Runs(seen, ["entity"], order, group_rows, small).before(_known=("sum", F.when(first_run, 1).otherwise(0)))
    return known.done()


def _found(kind: str, severity: Column, description: Column, test: Column) -> Column:
    return F.when(test, F.struct(F.lit(kind).alias("anomaly_type"), severity.alias("severity"), description.alias("description")))


def _after_hours() -> Column:
    quiet = (F.col("_total") > 50) & (F.col("_nth_in_hour") - 1 < F.floor(F.col("_total") / 48))
    return _found("AfterHoursActivity", F.lit("medium"), F.lit("Activity detected during atypical hours for this user."), quiet)


def _travel(window: str) -> Column:
    moved = (F.col("_last_ip") != F.col("_ip")) & (F.col("_at") - F.col("_last_at") < span_seconds(window) * 1_000_000)
    return _found("ImpossibleTravel", F.lit("high"), F.lit("Rapid location change detected between disparate IP addresses."), moved)


def _rare_process() -> Column:
    runs = F.col("_nth_run") - 1
    new = (runs == 0) & (F.col("_known") > 10)
    rare = (runs > 0) & (F.col("_processes") > 100) & (runs < F.floor(F.col("_processes") / 100))
    severity = F.when(new, F.lit("high")).otherwise(F.lit("medium"))
    text = F.when(new, "Execution of a process never before seen on this entity.").otherwise("Execution of a process rarely seen on this entity.")
    return _found("RareProcess", severity, text, F.col("_proc").isNotNull() & (new | rare))


def _anomalies(state: DataFrame, *checks: Column) -> DataFrame:
    found = F.filter(F.array(*checks), lambda a: a.isNotNull())
    return state.select("event_id", "entity", "ts", "source", F.explode(found).alias("_a")).select("event_id", "entity", "ts", "source", "_a.*")


def ueba_after_hours(df: DataFrame, entity=ENTITY_FIELDS, group_rows: int | None = None) -> DataFrame:
    """Events in an hour of day that holds under 1/48 of the entity's more than 50 earlier events."""
    return _anomalies(_state(df, entity, group_rows), _after_hours())


def ueba_impossible_travel(df: DataFrame, entity=ENTITY_FIELDS, window: str = "5m", group_rows: int | None = None) -> DataFrame:
    """Events whose address differs from the entity's last one, less than `window` after its last event."""
    return _anomalies(_state(df, entity, group_rows), _travel(window))


def ueba_rare_process(df: DataFrame, entity=ENTITY_FIELDS, group_rows: int | None = None) -> DataFrame:
    """Processes under 1 % of more than 100 earlier process events, or new after more than 10 known ones."""
    return _anomalies(_state(df, entity, group_rows), _rare_process())


def ueba_anomalies(df: DataFrame, entity=ENTITY_FIELDS, window: str = "5m", group_rows: int | None = None) -> DataFrame:
    """All three behaviour checks in one pass."""
    return _anomalies(_state(df, entity, group_rows), _after_hours(), _travel(window), _rare_process())


def ueba_profile(df: DataFrame, entity=ENTITY_FIELDS) -> DataFrame:
    """Activity total, 24-slot hour histogram, distinct addresses and processes per entity."""
    rows = with_entity(df, entity)
    hour = F.hour("ts")
    histogram = F.array(*[F.count_if(hour == h) for h in range(24)])
    return rows.groupBy("entity").agg(
        F.count(F.lit(1)).alias("total_activity"),
        histogram.alias("hour_baseline"),
        F.count_distinct(field(rows, "src_ip")).alias("unique_ips"),
        F.count_distinct(field(rows, "process_name")).alias("unique_procs"),
    )


def extract_features(df: DataFrame, window: str | None = "1h", ts: str = "ts") -> DataFrame:
    """Login and resource counts per user, outgoing bytes per address, mean CPU per host, by time window.

    `window=None` aggregates over all time.
    """

    def feature(prefix, name, label, value, when):
        key = field(df, name).cast("string")
        entity = F.concat(F.lit(prefix), key)
        return F.when(when & key.isNotNull() & (key != ""), F.struct(entity.alias("entity"), F.lit(label).alias("feature"), value.alias("v")))

    user = "user" if has_field(df, "user") else "user_name"
    host = "host" if has_field(df, "host") else "hostname"
    one = F.lit(1.0)
    found = [
        feature("user:", user, "login_count_1h", one, F.coalesce(field(df, "action") == "login", F.lit(False))),
        feature("user:", user, "resource_access_count_1h", one, field(df, "resource").isNotNull()),
        feature("ip:", "src_ip", "bytes_out_1h", number(field(df, "bytes_out")), number(field(df, "bytes_out")).isNotNull()),
        feature("asset:", host, "cpu_avg_1h", number(field(df, "cpu_usage")), number(field(df, "cpu_usage")).isNotNull()),
    ]
    at = F.lit(None).cast("timestamp") if window is None else bucket(F.col(ts), span_seconds(window))
    rows = df.select(at.alias("window_start"), F.col(ts).alias("_ts"), F.explode(F.filter(F.array(*found), lambda f: f.isNotNull())).alias("_f"))
    grouped = rows.groupBy(F.col("_f.entity").alias("entity"), F.col("_f.feature").alias("feature"), "window_start")
    # numbers only in the aggregate: a text in it would sort every row
    summed = grouped.agg(F.sum("_f.v").alias("_sum"), F.count(F.lit(1)).alias("n"), F.max("_ts").alias("ts"))
    value = F.when(F.col("feature") == "cpu_avg_1h", F.col("_sum") / F.col("n")).otherwise(F.col("_sum"))
    return summed.select("entity", "feature", "window_start", value.alias("value"), "n", "ts")


def feature_ops(updates: DataFrame, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """State after set, sum/inc, avg and max updates (one operation per feature); max never falls below 0."""
    grouped = updates.groupBy("entity", "feature", "op").agg(
        F.max_by("value", pair_order(updates, ts, tie)).alias("_last"),
        F.sum("value").alias("_sum"),
        F.avg("value").alias("_avg"),
        F.greatest(F.lit(0.0), F.max("value")).alias("_max"),
        F.count(F.lit(1)).alias("_n"),
        F.max(ts).alias("ts"),
    )
    op = F.col("op")
    value = F.when(op == "set", F.col("_last")).when(op.isin("sum", "inc"), F.col("_sum")).when(op == "avg", F.col("_avg")).when(op == "max", F.col("_max"))
    n = F.when(op == "set", F.lit(1)).when(op == "max", F.lit(0)).otherwise(F.col("_n")).cast("bigint")
    return grouped.select("entity", "feature", value.alias("value"), n.alias("n"), "ts")


def population_anomaly(features: DataFrame, threshold: float = 3.0, min_samples: int = 5) -> DataFrame:
    """Entities whose feature lies more than `threshold` population deviations from the mean of all entities.

    Statistics are aggregated per feature and joined back; no feature is gathered in one task.
    """
    stats = features.groupBy("feature").agg(F.avg("value").alias("baseline"), F.stddev_pop("value").alias("_sd"), F.count("value").alias("_n"))
    stats = stats.where((F.col("_n") >= min_samples) & (F.col("_sd") > 0))
    scored = features.join(stats, "feature").withColumn("score", (F.col("value") - F.col("baseline")) / F.col("_sd"))
    text = F.format_string("Value %.2f is %.2f sigmas from mean %.2f", "value", "score", "baseline")
    return scored.where(F.abs("score") > threshold).select("entity", "feature", "value", "baseline", "score", text.alias("description"))


# Numeric event fields watched for outliers.
METRICS = ("bytes", "duration", "response_time", "cpu", "memory", "connections")


def metric_rows(df: DataFrame, by=("entity",), metrics=METRICS) -> DataFrame:
    """One row per event and numeric metric present."""
    present = [m for m in metrics if has_field(df, m)]
    pairs = [F.struct(F.lit(m).alias("metric"), number(field(df, m)).alias("value")) for m in present]
    rows = df.select("event_id", "ts", *by, F.explode(F.array(*pairs)).alias("_m"))
    return rows.select("event_id", "ts", *by, "_m.metric", "_m.value").where("value is not null")


def rolling_anomaly(
    df: DataFrame, by=("entity",), window: int = 1000, min_seen: int = 10, threshold: float = 3.0, metrics=METRICS, block: int = 4000, group_rows: int | None = None
) -> DataFrame:
    """Values far from the mean of the previous `window` values of the same metric (and entity).

    Each key's rows are numbered and cut into blocks of `block`; a block also receives the
    last `window` rows of the block before it, so every task holds a bounded number of rows
    and `by=()` (one baseline per metric) stays parallel too. Sums come from running sums
    around the block mean, constant work per row whatever the window length.
    """
    keys, block = ["metric", *by], max(block, window)  # a block must reach the one before with its whole window
    rows = ordinal(metric_rows(df, by, metrics), keys, ["ts", "event_id"], "_rn", group_rows)
    home = F.floor((F.col("_rn") - 1) / block)
    tail = (F.col("_rn") - 1) % block >= block - window
    copies = F.when(tail, F.array(home, home + 1)).otherwise(F.array(home))
    placed = rows.withColumn("_home", home).withColumn("_block", F.explode(copies))
    whole = Window.partitionBy(*keys, "_block")
    order = whole.orderBy("_rn")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_c", F.avg("value").over(whole)).withColumn("_y", F.col("value") - F.col("_c"))
    changed = F.when(F.col("value") != F.lag("value").over(order), F.col("_rn"))
    placed = (
        placed.withColumn("_change", changed)
        .withColumn("_s1", F.coalesce(F.sum("_y").over(before), F.lit(0.0)))
        .withColumn("_s2", F.coalesce(F.sum(F.col("_y") * F.col("_y")).over(before), F.lit(0.0)))
        .withColumn("_changed_at", F.max("_change").over(before))
    )
    placed = placed.withColumn("_o1", F.coalesce(F.lag("_s1", window).over(order), F.lit(0.0))).withColumn("_o2", F.coalesce(F.lag("_s2", window).over(order), F.lit(0.0)))
    n = F.least(F.col("_rn") - 1, F.lit(window))
    mean_y = (F.col("_s1") - F.col("_o1")) / n
    spread = F.sqrt(F.greatest((F.col("_s2") - F.col("_o2")) / n - mean_y * mean_y, F.lit(0.0)))
    flat = F.coalesce(F.col("_changed_at") <= F.col("_rn") - n, F.lit(True))
    previous = F.lag("value").over(order)
    placed = placed.withColumn("_n", n).withColumn("_flat", flat).withColumn("_previous", previous)
    kept = placed.where((F.col("_home") == F.col("_block")) & (F.col("_rn") - 1 > min_seen))
    expected = F.when(F.col("_flat"), F.col("_previous")).otherwise(F.col("_c") + mean_y)
    scored = kept.withColumn("expected", expected).withColumn(
        "deviation",
        F.when(F.col("_flat"), F.when(F.col("value") != F.col("_previous"), F.lit(float("inf")))).otherwise(
            F.try_divide(F.abs(F.col("value") - F.col("expected")), spread)
        ),
    )
    flagged = scored.where(F.col("deviation") > threshold)
    return flagged.select("event_id", "ts", *keys, "value", "expected", "deviation", anomaly_severity(F.col("deviation")).alias("severity"))


def anomaly_severity(deviation: Column) -> Column:
    return F.when(deviation > 5, "critical").when(deviation > 4, "high").when(deviation > 3, "medium").otherwise("low")


# Sentences that explain an anomaly.
TOO_MANY_LOGINS = "User logged in %d times in the last hour, which is significantly higher than the baseline."
OFF_PEAK = "Activity occurred during off-peak hours."
TOO_MUCH_DATA = "Data transfer of %.2f MB exceeds 99th percentile of peer group."
NEW_DESTINATION = "Destination IP has no prior history with this entity."
DEVIATION = "Anomaly detected based on statistical deviation."
LOGIN_SUMMARY = "Unusual high frequency of login attempts detected."
VOLUME_SUMMARY = "Potential data exfiltration detected based on volume."
OTHER_SUMMARY = "Statistical anomaly detected."


def explain_anomaly(df: DataFrame, kind: str = "anomaly_type", value: str = "value") -> DataFrame:
    """One row per contributing factor of each anomaly, with confidence and summary."""
    v = F.col(value).cast("double")

    def factor(name, weight, amount, text):
        return F.struct(F.lit(name).alias("factor"), F.lit(weight).alias("weight"), amount.alias("factor_value"), text.alias("factor_text"))

    zero = F.lit(0.0)
    logins = F.array(
        factor("Login Frequency", 0.85, v, F.format_string(TOO_MANY_LOGINS, v.cast("long"))),
        factor("Time of Day", 0.15, zero, F.lit(OFF_PEAK)),
    )
    volume = F.array(
        factor("Data Volume", 0.90, v, F.format_string(TOO_MUCH_DATA, v / 1024 / 1024)),
        factor("Destination IP Reputation", 0.10, zero, F.lit(NEW_DESTINATION)),
    )
    unknown = F.array(factor("Unknown Factor", 1.0, v, F.lit(DEVIATION)))
    is_login, is_volume = F.col(kind) == "login_count_1h", F.col(kind) == "bytes_out_1h"
    summary = (
        F.when(is_login, LOGIN_SUMMARY)
        .when(is_volume, VOLUME_SUMMARY)
        .otherwise(OTHER_SUMMARY)
    )
    exploded = df.withColumn("_f", F.explode(F.when(is_login, logins).when(is_volume, volume).otherwise(unknown)))
    return exploded.select(*df.columns, "_f.*", F.lit(0.92).alias("confidence"), summary.alias("summary"))
