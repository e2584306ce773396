"""Retention and tiers that act on a stored event table, partition by partition.

Which partitions are due follows from their folders' names alone. Those past retention are deleted without being read; one that the limit
cuts through, or that may hold audit rows with a longer limit, is rewritten once, by dynamic partition overwrite. Days that
are due for a colder tier are written there in that tier's layout and then leave the warmer one. Each step can be run again: what was done is not done twice,
and a run that was cut off is completed by the next one.
"""

from __future__ import annotations

import posixpath
import re
from collections import defaultdict
from collections.abc import Iterable
from datetime import datetime, timedelta
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.operators.lifecycle import DAY, expire_events

LEAF = re.compile(r"date=(\d{4}-\d\d-\d\d)(?:/hour=(\d+))?(?=/)")
#: Underscored, so that readers of the table skip it.
LOG = "_retention"
LOG_SCHEMA = "leaf string, until string, limits string"
ACTIONS = "action string, leaf string, files int"
#: Days after which a day's last hour is due for the tier.
TIERS = {"warm": 1, "cold": 7}


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _fs(spark, path)
    return fs.exists(place)


def delete(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        fs, place = _fs(spark, path)
        fs.delete(place, True)


def leaves(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Files of each partition folder (relative to the table) that has any; nothing is read."""
    if not exists(spark, path):
        return {}
    # a schema, so that no file is opened to learn it
    files = spark.read.schema("_none string").option("recursiveFileLookup", "true").parquet(path).inputFiles()
    found = defaultdict(list)
    for file in sorted(map(unquote, files)):
        if m := LEAF.search(file):
            found[m.group(0)].append(file)
    return dict(found)


def span_of(leaf: str) -> tuple[datetime, datetime]:
    """First moment of a partition and the one after its last."""
    date, hour = LEAF.search(leaf + "/").groups()
    start = datetime.fromisoformat(date) + timedelta(hours=int(hour or 0))
    return start, start + (timedelta(days=1) if hour is None else timedelta(hours=1))


def _read(spark: SparkSession, path: str, wanted: Iterable[str]) -> DataFrame:
    return spark.read.option("basePath", path).parquet(*[posixpath.join(path, leaf) for leaf in wanted])


def _log(spark: SparkSession, path: str) -> dict[str, tuple[str, str]]:
    """Per leaf the latest limit it was cut at; a row for each partition that was ever cut."""
    place = posixpath.join(path, LOG)
    if not exists(spark, place):
        return {}
    rows = spark.read.schema(LOG_SCHEMA).parquet(place).groupBy("leaf").agg(F.max(F.struct("until", "limits")).alias("_l")).collect()
    return {r.leaf: (r._l.until, r._l.limits) for r in rows}


def expire_store(spark: SparkSession, path: str, as_of: str, days: int, audit_days: int | None = None, is_audit: Column | None = None, ts: str = "ts") -> DataFrame:
    """Apply retention to the event store at `path`: a row (action, leaf, files) for each partition that was `dropped` or `rewritten`.

    Rules are those of `expire_events`. A partition that ends before the last limit is deleted unread. One between the two limits is
    rewritten without its expired rows once, after it has left the first limit behind; the partition a limit cuts through is rewritten each
    time the limit has moved. Rows must lie in the partition of their time.
    """
    now = datetime.fromisoformat(as_of)
    limits = [now - timedelta(days=days)] + ([now - timedelta(days=audit_days)] if audit_days is not None and is_audit is not None else [])
    found, log, done, cut = leaves(spark, path), _log(spark, path), [], []
    for leaf, files in found.items():
        start, end = span_of(leaf)
        if end <= min(limits):
            delete(spark, [posixpath.join(path, leaf)])
            done.append(("dropped", leaf, len(files)))
        elif start < max(limits):
            # what decides about this partition: limits that lie inside it, or have passed it
            state = ",".join(str(min(limit, end)) if limit > start else "-" for limit in limits)
            if log.get(leaf, ("", ""))[1] != state:
                cut.append((leaf, state))
    if cut:
        rows = _read(spark, path, [leaf for leaf, _ in cut]).transform(expire_events(as_of, days, audit_days, is_audit, ts))
        columns = ["date", "hour"] if "hour" in rows.columns and "hour=" in cut[0][0] else ["date"]
        placed = rows.hint("rebalance", *columns).sortWithinPartitions(*columns, *[c for c in ("shard", ts) if c in rows.columns])
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)
        after = leaves(spark, path)
        for leaf, _ in cut:
            if set(after.get(leaf, [])) & set(found[leaf]):  # no row is left, so nothing was written over it
                delete(spark, [posixpath.join(path, leaf)])
            done.append(("rewritten", leaf, len(found[leaf])))
        spark.createDataFrame([(leaf, as_of, state) for leaf, state in cut], LOG_SCHEMA).coalesce(1).write.mode("append").parquet(posixpath.join(path, LOG))
    spark.catalog.refreshByPath(path)
    return spark.createDataFrame(done, ACTIONS)


def day_tier(date: str, as_of: str) -> str:
    """Tier of a day's partition: that of its youngest hour."""
    age = (datetime.fromisoformat(as_of) - datetime.fromisoformat(date) - timedelta(hours=23)).total_seconds()
    return next((tier for tier, after in sorted(TIERS.items(), key=lambda t: -t[1]) if age > after * DAY), "hot")


def _dates(found: Iterable[str]) -> set[str]:
    return {LEAF.search(leaf + "/").group(1) for leaf in found}


def move_tiers(spark: SparkSession, stores: dict[str, str], as_of: str, ts: str = "ts", rows_per_file: int = 20_000_000) -> DataFrame:
    """Move whole days to the tier their age asks for: a row (action, leaf, files) for each day moved.

    `stores` has the paths of `hot`, `warm` and `cold`. Hot days lie in hour partitions as they were written; warm and cold ones in one partition a day, in few files
    sorted by shard and time, cold ones compressed harder. A day is first written, replacing what an interrupted run may have left, and then
    deleted where it was; `read_tiers` shows it once at any time.
    """
    done = []
    order = ["hot", *TIERS]
    for here in reversed(order[:-1]):
        found = leaves(spark, stores[here])
        due = defaultdict(list)
        for leaf in found:
            tier = day_tier(LEAF.search(leaf + "/").group(1), as_of)
            if order.index(tier) > order.index(here):
                due[tier].append(leaf)
        for tier, wanted in due.items():
            rows = _read(spark, stores[here], wanted)
            placed = rows.hint("rebalance", "date").sortWithinPartitions("date", *[c for c in ("shard", ts) if c in rows.columns])
            writer = placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file)
            if tier == "cold":
                writer = writer.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "12")
            writer.partitionBy("date").parquet(stores[tier])
            delete(spark, {posixpath.join(stores[here], f"date={date}") for date in _dates(wanted)})
            done += [(f"{here} to {tier}", f"date={date}", sum(len(found[leaf]) for leaf in wanted if f"date={date}" in leaf)) for date in sorted(_dates(wanted))]
        spark.catalog.refreshByPath(stores[here])
    return spark.createDataFrame(done, ACTIONS)


def read_tiers(spark: SparkSession, stores: dict[str, str]) -> DataFrame | None:
    """All events with their `tier`; a day that is in two tiers, its move cut off, is read from the colder one. None without any."""
    whole, seen = None, set()
    for tier in ["hot", *TIERS][::-1]:
        found = [leaf for leaf in leaves(spark, stores[tier]) if LEAF.search(leaf + "/").group(1) not in seen]
        if found:
            part = _read(spark, stores[tier], found).withColumn("tier", F.lit(tier))
            whole = part if whole is None else whole.unionByName(part, allowMissingColumns=True)
            seen |= _dates(found)
    return whole
