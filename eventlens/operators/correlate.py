"""Threshold correlation over event time: windows, idle windows, and reset on fire."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.functions.fields import field, first_text
from eventlens.functions.ordered import FOLD_ROWS, Runs, greedy_spaced, ordinal
from eventlens.functions.spans import span_seconds
from eventlens.operators.rules import Rule, rule_column
from eventlens.session import cut_lineage

SECOND = 1_000_000


def entity_keys(df: DataFrame) -> Column:
    """Correlation keys of an event: `src_ip:…`, `user:…`, `hostname:…` where present, and `global`."""
    who = first_text(df, ["user", "user_name"])
    named = [
        F.concat(F.lit("src_ip:"), field(df, "src_ip").cast("string")),
        F.concat(F.lit("user:"), who),
        F.concat(F.lit("hostname:"), field(df, "hostname").cast("string")),
        F.lit("global"),
    ]
    return F.filter(F.array(*named), lambda k: k.isNotNull())


def rule_matches(df: DataFrame, rules: Iterable[Rule], ts: str = "ts", event_id: str = "event_id") -> DataFrame:
    """One row per (event, matching rule, entity key)."""
    found = [
        F.when(
            rule_column(df, r),
            F.struct(
                F.lit(r.id).alias("rule_id"),
                F.lit(r.name).alias("rule_name"),
                F.lit(r.severity).alias("severity"),
                F.lit(r.threshold).alias("threshold"),
                F.lit(span_seconds(r.window)).alias("span"),
            ),
        )
        for r in rules
        if r.enabled and r.conditions
    ]
    made = F.array(*found).cast("array<struct<rule_id:string,rule_name:string,severity:string,threshold:int,span:int>>")  # a type without rules too
    hits = F.filter(made, lambda x: x.isNotNull())
    exploded = df.select(F.col(ts).cast("timestamp").alias("ts"), F.col(event_id).alias("event_id"), entity_keys(df).alias("_keys"), F.explode(hits).alias("_r"))
    return exploded.select("ts", "event_id", "_r.*", F.explode("_keys").alias("entity_key"))


def window_starts(ts: Column, span: Column, slides: int) -> Column:
    """Epoch seconds of the windows of length `span` that hold `ts`; one begins every `span` / `slides` seconds, rounded down.

    There are `slides` of them, or more where the span doesn't divide evenly.
    """
    slide = F.greatest(F.lit(1), (span / slides).cast("long"))
    last = F.floor(F.unix_seconds(ts) / slide) * slide
    starts = F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(span / slide).cast("long") - 1), lambda i: last - i * slide)
    return F.filter(starts, lambda s: F.unix_seconds(ts) < s + span)


def in_windows(matches: DataFrame, slides: int = 1) -> DataFrame:
    """One row per match and window that holds it."""
    if slides == 1:
        epoch = F.unix_seconds("ts")
        return matches.withColumn("window_start", epoch - F.pmod(epoch, F.col("span").cast("long")))
    return matches.withColumn("window_start", F.explode(window_starts(F.col("ts"), F.col("span"), slides)))


def correlate_threshold(rules: Iterable[Rule], slides: int = 1, ts: str = "ts", event_id: str = "event_id"):
    """Windows in which a key reaches a rule's threshold: one row per (rule, key, window).

    Windows are epoch-aligned, as long as the rule says, and overlap `slides` times. Counts
    are pre-aggregated before the shuffle, so even the `global` key stays cheap.
    """
    rules = list(rules)

    def apply(df: DataFrame) -> DataFrame:
        rows = in_windows(rule_matches(df, rules, ts, event_id), slides)
        keys = ["rule_id", "rule_name", "severity", "threshold", "span", "entity_key", "window_start"]
        counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        return counted.where("n >= threshold").withColumn("window_end", F.col("window_start") + F.col("span"))

    return apply


def correlate_trailing(rules: Iterable[Rule], ts: str = "ts", event_id: str = "event_id", group_rows: int | None = None):
    """Every event at which a key reaches a rule's threshold: its matches in the `window` that ends with the event.

    A match counts from its time until, but not at, `window` later; of equal times those with smaller ids come first. So a burst is found wherever
    it lies, and each further event fires while the count holds. A match enters the order twice, as itself and as its own end; the
    running sum of both is the count, which `Runs` keeps parallel for the `global` key too.
    """
    rules = list(rules)

    def apply(df: DataFrame) -> DataFrame:
        matches = rule_matches(df, rules, ts, event_id)
        at = F.unix_micros("ts")
        # at equal times a match ends before another one comes
        turns = F.array(F.struct(at.alias("_at"), F.lit(1).alias("_step")), F.struct((at + F.col("span").cast("long") * SECOND).alias("_at"), F.lit(-1).alias("_step")))
        both = matches.select("*", F.inline(turns))
        counted = Runs(both, ["rule_id", "entity_key"], ["_at", "_step", "event_id"], group_rows).before(_open=("sum", F.col("_step"))).done()
        fired = counted.where("_step = 1").withColumn("n", (F.col("_open") + 1).cast("long")).where("n >= threshold")
        return fired.select("rule_id", "rule_name", "severity", "threshold", "span", "entity_key", "ts", "event_id", "n")

    return apply


def correlate_related(df: DataFrame, rules: Iterable[Rule], slides: int = 1, ts: str = "ts", event_id: str = "event_id") -> DataFrame:
    """Events behind every matched window, one row each (rule, key, window, event)."""
    rules = list(rules)
    found = correlate_threshold(rules, slides, ts, event_id)(df).select("rule_id", "entity_key", "window_start", "n")
    rows = in_windows(rule_matches(df, rules, ts, event_id), slides)
    return rows.join(found, ["rule_id", "entity_key", "window_start"]).select("rule_id", "rule_name", "severity", "entity_key", "window_start", "n", "event_id")


def correlate_idle_window(rules: Iterable[Rule], gap: str = "5m", ts: str = "ts", event_id: str = "event_id", group_rows: int | None = None):
    """Windows that live while matching events of a key keep arriving within `gap`."""
    rules = list(rules)
    idle = span_seconds(gap) * SECOND

    def apply(df: DataFrame) -> DataFrame:
        rows = rule_matches(df, rules, ts, event_id).withColumn("_at", F.unix_micros("ts"))
        runs = Runs(rows, ["rule_id", "entity_key"], ["_at", "event_id"], group_rows).before(_previous=("last", F.col("_at")))
        fresh = F.col("_previous").isNull() | (F.col("_at") - F.col("_previous") > idle)
        runs.frame = runs.frame.withColumn("_start", F.when(fresh, F.col("_at")))
        opened = runs.before(_opened=("max", F.col("_start"))).done()
        opened = opened.withColumn("_window", F.coalesce("_start", "_opened"))
        keys = ["rule_id", "rule_name", "severity", "threshold", "entity_key", "_window"]
        counted = opened.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        return counted.where("n >= threshold").drop("_window")

    return apply


def correlate_reset(rule: Rule, by: tuple[str, ...] = (), ts: str = "ts", event_id: str = "event_id", fold_rows: int = FOLD_ROWS, group_rows: int | None = None):
    """Signal whenever `threshold` matching events fall within the trailing window; then counting restarts.

    An event can close a signal when the event `threshold - 1` matches earlier is less than a
    window old; since firing clears the count, the next signal needs `threshold` new matches.
    Signals are therefore a greedy choice, `threshold` positions apart, among those events.
    A rule with threshold 1 gives a signal per match. `by` counts per entity instead of per rule.
    """
    span, need = span_seconds(rule.window) * SECOND, rule.threshold

    def apply(df: DataFrame) -> DataFrame:
        keys = list(by)
        hits = df.where(rule_column(df, rule)).select(*keys, F.col(ts).cast("timestamp").alias("ts"), F.col(event_id).alias("event_id"))
        described = [F.lit(rule.id).alias("rule_id"), F.lit(rule.name).alias("rule_name"), F.lit(rule.severity).alias("severity"), F.lit(rule.risk_score).alias("risk_score")]
        if need <= 1:
            return hits.select(*described, *keys, "ts", F.col("event_id").alias("trigger_id"), F.array("event_id").alias("source_ids"))
        # read three times below
        placed = cut_lineage(ordinal(hits, keys, ["ts", "event_id"], "_rn", group_rows))
        opening = placed.select(*[F.col(k).alias("_o_" + k) for k in keys], (F.col("_rn") + need - 1).alias("_o_rn"), F.col("ts").alias("_o_ts"))
        same = placed["_rn"] == opening["_o_rn"]
        for k in keys:
            same = same & placed[k].eqNullSafe(opening["_o_" + k])
        closing = placed.join(opening, same).where(F.unix_micros("ts") - F.unix_micros("_o_ts") < span).select(*placed.columns)
        fired = greedy_spaced(cut_lineage(closing), keys, "_rn", need, ["event_id"], "_fires", fold_rows, group_rows).where("_fires").drop("_fires")
        members = fired.select(
            *[F.col(k).alias("_m_" + k) for k in keys],
            F.col("event_id").alias("trigger_id"),
            F.col("ts").alias("_fired_at"),
            F.explode(F.sequence(F.col("_rn") - need + 1, F.col("_rn"))).alias("_m_rn"),
        )
        same = placed["_rn"] == members["_m_rn"]
        for k in keys:
            same = same & placed[k].eqNullSafe(members["_m_" + k])
        # each signal gathers exactly `threshold` rows
        signals = members.join(placed, same).groupBy(*keys, "trigger_id", "_fired_at").agg(F.array_sort(F.collect_list(F.struct("_rn", "event_id"))).alias("_s"))
        return signals.select(*described, *keys, F.col("_fired_at").alias("ts"), "trigger_id", F.col("_s.event_id").alias("source_ids"))

    return apply
