"""Rules as data, compiled to Spark predicates; stateless detection in one pass."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field as member
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.functions.fields import field, has_field, number, text, whole_number


@dataclass(frozen=True)
class Condition:
    field: str
    operator: str
    value: object


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    severity: str
    conditions: tuple[Condition, ...]
    enabled: bool = True
    threshold: int = 1
    window: str = "1m"
    tactics: tuple[str, ...] = ()
    techniques: tuple[str, ...] = ()
    risk_score: int = 0
    metadata: dict = member(default_factory=dict, hash=False)


ALIASES = {"equals": "eq", "not_equals": "ne", "neq": "ne", "==": "eq", "=": "eq", "!=": "ne"}


def condition_column(df: DataFrame, condition: Condition) -> Column:
    """The condition as a predicate that is never NULL; a missing field never matches."""
    return F.coalesce(raw_condition(df, condition), F.lit(False))


def raw_condition(df: DataFrame, condition: Condition) -> Column:
    """The condition as it reaches a scan: NULL where a value is missing."""
    if not has_field(df, condition.field):
        return F.lit(False)
    whole = whole_number(df, condition.field)
    col, value = field(df, condition.field), condition.value
    op = ALIASES.get(condition.operator, condition.operator)
    if op in ("eq", "ne"):
        same = _equal(col, value, whole)
        test = same if op == "eq" else ~same
    elif op in ("gt", "lt", "gte", "lte"):
        exact = whole and isinstance(value, int)
        left, right = (col, F.lit(value)) if exact else (number(col), F.lit(float(value)))
        test = {"gt": left > right, "lt": left < right, "gte": left >= right, "lte": left <= right}[op]
    elif op == "contains":
        test = text(col).contains(str(value))
    elif op == "in":
        test = reduce(lambda a, b: a | b, [_equal(col, v, whole) for v in value])
    elif op == "regex":
        test = text(col).rlike(str(value))
    else:
        raise ValueError(f"unknown operator {condition.operator!r}")
    return test


def _equal(col: Column, value, whole: bool = False) -> Column:
    if isinstance(value, bool):
        return col.try_cast("boolean") == F.lit(value)
    if whole and isinstance(value, int):
        return col == F.lit(value)
    if isinstance(value, (int, float)):
        return number(col) == F.lit(float(value))
    return text(col) == F.lit(str(value))


def rule_column(df: DataFrame, rule: Rule) -> Column:
    """AND of the conditions; a rule without conditions never matches."""
    if not rule.enabled or not rule.conditions:
        return F.lit(False)
    return reduce(and_, [condition_column(df, c) for c in rule.conditions])


def matched(df: DataFrame, rules: Iterable[Rule]) -> Column:
    """Array of the rules an event matches: (rule_id, rule_name, severity)."""
    found = [
        F.when(
            rule_column(df, r),
            F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.name).alias("rule_name"), F.lit(r.severity).alias("severity")),
        )
        for r in rules
        if r.enabled and r.conditions
    ]
    return F.filter(F.array(*found).cast("array<struct<rule_id:string,rule_name:string,severity:string>>"), lambda x: x.isNotNull())


def any_rule(df: DataFrame, rules: Iterable[Rule]) -> Column:
    """Whether some rule matches, on raw predicates that reach the scan."""
    each = [reduce(and_, [raw_condition(df, c) for c in r.conditions]) for r in rules if r.enabled and r.conditions]
    return reduce(or_, each) if each else F.lit(False)


def detect_rules(rules: Iterable[Rule]):
    """One output row per event and matching rule. Stateless: works on streams as well."""
    rules = list(rules)

    def apply(df: DataFrame) -> DataFrame:
        return df.where(any_rule(df, rules)).withColumn("_hit", F.explode(matched(df, rules))).select(*df.columns, "_hit.*")

    return apply


def rules_frame(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """Rules as rows."""
    rows = [
        (r.id, r.name, r.severity, r.enabled, r.threshold, r.window, list(r.tactics), list(r.techniques), r.risk_score)
        for r in rules
    ]
    schema = (
        "rule_id string, rule_name string, severity string, enabled boolean, threshold int, time_window string, "
        "tactics array<string>, techniques array<string>, risk_score int"
    )
    return spark.createDataFrame(rows, schema)


def load_rules(path: str) -> list[Rule]:
    """Detection rules from a YAML list."""
    import yaml

    with open(path) as handle:
        entries = yaml.safe_load(handle)
    return [
        Rule(
            id=e["id"],
            name=e["name"],
            severity=e["severity"],
            conditions=tuple(Condition(c["field"], c["operator"], c["value"]) for c in e.get("conditions", ())),
            enabled=e.get("enabled", True),
            tactics=tuple(e.get("mitre_tactics", ())),
            techniques=tuple(e.get("mitre_techniques", ())),
            metadata=e.get("metadata", {}),
        )
        for e in entries
    ]


def mitre_coverage(rules: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Rules per tactic and technique; coverage is `rules / 20` in percent, at most 100.

    With detection rows in `hits`, also how often the rules behind each entry fired.
    """
    fired = None if hits is None else hits.groupBy("rule_id").agg(F.count(F.lit(1)).alias("_fired"))
    known = rules if fired is None else rules.join(fired, "rule_id", "left")
    firing = F.lit(0) if fired is None else F.coalesce(F.col("_fired"), F.lit(0))
    entries = known.select(
        "rule_id",
        firing.alias("fired"),
        F.explode(
            F.concat(
                F.transform("tactics", lambda t: F.struct(F.lit("tactic").alias("kind"), t.alias("entry"))),
                F.transform("techniques", lambda t: F.struct(F.lit("technique").alias("kind"), t.alias("entry"))),
            )
        ).alias("_e"),
    )
    counted = entries.groupBy("_e.kind", "_e.entry").agg(F.count(F.lit(1)).alias("rules"), F.sum("fired").alias("fired"))
    share = F.least(F.lit(100.0), F.col("rules") / 20.0 * 100)
    return counted.withColumn("coverage_pct", F.when(F.col("kind") == "tactic", share))


# The default rule packs.
DETECTION_RULES = (
    Rule(
        "auth-001",
        "Failed Login Attempt",
        "medium",
        (Condition("event_type", "eq", "authentication"), Condition("status", "eq", "failed")),
        tactics=("Credential Access",),
        techniques=("T1110",),
    ),
    Rule(
        "auth-002",
        "Successful Login from Malicious IP",
        "critical",
        (
            Condition("event_type", "eq", "authentication"),
            Condition("status", "eq", "success"),
            Condition("src_ip_threat_malicious", "eq", True),
        ),
        tactics=("Initial Access",),
        techniques=("T1078",),
    ),
    Rule(
        "net-001",
        "Large Data Transfer",
        "high",
        (Condition("bytes", "gt", 10_000_000),),
        tactics=("Exfiltration",),
        techniques=("T1048",),
    ),
    Rule(
        "net-002",
        "Connection to High-Risk Country",
        "medium",
        (Condition("dst_ip_geo_country", "in", ("KP", "IR", "SY")),),
        tactics=("Command and Control",),
    ),
    Rule(
        "file-001",
        "Malware Hash Detected",
        "critical",
        (Condition("file_threat_malicious", "eq", True),),
        tactics=("Execution",),
        techniques=("T1204",),
    ),
    Rule(
        "priv-001",
        "Privilege Escalation Attempt",
        "high",
        (Condition("event_type", "eq", "privilege_change"), Condition("new_privilege", "contains", "admin")),
        tactics=("Privilege Escalation",),
        techniques=("T1068",),
    ),
)

CORRELATION_RULES = (
    Rule(
        "CORR-001",
        "Brute Force Detection",
        "high",
        (Condition("event_type", "equals", "authentication"), Condition("status", "equals", "failed")),
        threshold=5,
        window="5m",
        tactics=("Credential Access",),
        techniques=("T1110",),
    ),
    Rule(
        "CORR-002",
        "Port Scan Detection",
        "medium",
        (Condition("event_type", "equals", "network"),),
        threshold=10,
        window="1m",
        tactics=("Discovery",),
        techniques=("T1046",),
    ),
    Rule(
        "CORR-003",
        "Data Exfiltration",
        "critical",
        (Condition("direction", "equals", "outbound"), Condition("bytes", "gt", 1_000_000.0)),
        threshold=1,
        window="1m",
        tactics=("Exfiltration",),
        techniques=("T1041",),
    ),
)

SIGNAL_RULES = (
    Rule(
        "rule-brute-force",
        "Potential Brute Force",
        "high",
        (Condition("action", "equals", "login_failed"),),
        threshold=5,
        window="60s",
        risk_score=80,
    ),
    Rule(
        "rule-root-access",
        "Root Access Granted",
        "critical",
        (Condition("message", "contains", "sudo: session opened"),),
        risk_score=100,
    ),
    Rule("rule-lateral", "Suspicious Lateral Movement", "medium", (Condition("process", "contains", "psexec"),), risk_score=50),
)
