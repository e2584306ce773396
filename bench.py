"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from eventlens.plans.all_queries import QUERIES
from eventlens.session import get_session

HEADLINE = [
    "search_keyword",
    "search_field",
    "search_tokens",
    "where_compare",
    "stats_by",
    "stats_dc",
    "timechart",
    "top_n_others",
    "enrich_user",
    "enrich_threat",
    "enrich_geo",
    "resolve_identity_asof",
    "detect_rules",
    "correlate_threshold",
    "correlate_idle_window",
    "correlate_reset",
    "ueba_anomalies",
    "extract_features",
    "population_anomaly",
    "rolling_anomaly",
    "risk_decay",
    "dedup_ttl",
    "mask_by_role",
    "hash_chain",
    "merkle_root",
    "norm_aws_event",
    "asset_risk",
    "blast_radius",
    "stream_timechart",
    "stream_detect",
    "ingest_pipeline",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # start-up of the JVM, code generation and the file cache is not part of any one query
    spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").count().write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    events = spark.read.parquet(f"{sf}/events.parquet").count()
    spark.stop()
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf.rsplit("sf", 1)[-1],
        "cpus": int(cpus),
        "events": events,
        "events_per_second_detect": round(events / times["detect_rules"]),
        "events_per_second_ingest": round(events / times["ingest_pipeline"]),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
