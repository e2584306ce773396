"""Small summary tables for overview pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def indicator_stats(indicators: DataFrame) -> DataFrame:
    """Totals, critical and high counts, and counts by indicator type."""
    kind = F.col("pattern")
    ip, domain = kind.contains("ipv4-addr"), kind.contains("domain-name")
    return indicators.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "high").alias("high"),
        F.count_if(ip).alias("ip"),
        F.count_if(domain & ~ip).alias("domain"),
        F.count_if(kind.contains("file:hashes") & ~ip & ~domain).alias("hash"),
    )


def posture_score(signals: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """`floor(min(100, 10 * critical + signals / 2))` and one active incident per five signals."""
    n = F.count(F.lit(1))
    critical = F.count_if(F.col("severity") == "critical")
    score = F.floor(F.least(F.lit(100.0), critical * 10 + n * 0.5)).cast("int")
    return signals.groupBy(*by).agg(score.alias("posture_score"), F.floor(n / 5).alias("active_incidents"))
