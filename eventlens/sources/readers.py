"""Event sources: stored events, and mappers from landed raw records to events.

The mappers are plain DataFrame functions, so they serve batch tables and streams alike.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.sources.tail import tail


def scan_events(spark: SparkSession, path: str, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Events of a store partitioned by date (and hour) in [start, end], by default the last 24 hours.

    A filter on `ts` prunes row groups but not folders, so the partition columns are
    constrained as well.
    """
    end = end or datetime.now(timezone.utc).replace(tzinfo=None)
    start = start or end - timedelta(hours=24)
    lower, upper = (F.lit(t.isoformat(sep=" ")).cast("timestamp") for t in (start, end))
    stored = spark.read.parquet(path)
    pruned = stored.where(F.col("date").between(F.lit(start.date()), F.lit(end.date())))
    if start.date() == end.date() and "hour" in stored.columns:
        pruned = pruned.where(F.col("hour").between(start.hour, end.hour))
    return pruned.where(F.col("ts").between(lower, upper))


COLLECTOR = "time bigint, host string, source string, sourcetype string, index string, event string, fields map<string,string>"


def from_collector(df: DataFrame, raw: str = "value") -> DataFrame:
    """HTTP-collector JSON envelopes; `time` 0 or absent means now; the payload is `fields`."""
    rows = df.withColumn("_j", F.from_json(raw, COLLECTOR))
    j = F.col("_j")
    at = F.when(F.coalesce(j["time"], F.lit(0)) != 0, F.timestamp_seconds(j["time"])).otherwise(F.current_timestamp())
    return rows.select(
        at.alias("ts"),
        j["source"].alias("source"),
        j["host"].alias("host"),
        j["sourcetype"].alias("sourcetype"),
        j["index"].alias("index"),
        j["event"].alias("message"),
        j["fields"].alias("data"),
        F.try_parse_json(raw).isNull().alias("bad_record"),
        F.col(raw).alias("raw"),
    )


def from_syslog(df: DataFrame, raw: str = "value", received: Column | None = None) -> DataFrame:
    """Syslog lines; the priority is the text between a leading `<` and the first `>`; receive time is event time."""
    priority = F.regexp_extract(raw, "^<([^>]*)>", 1)
    number = priority.try_cast("int")
    return df.select(
        (F.current_timestamp() if received is None else received).alias("ts"),
        F.lit("syslog").alias("source"),
        F.nullif(priority, F.lit("")).alias("priority"),
        F.floor(number / 8).cast("int").alias("facility"),
        (number % 8).alias("severity_code"),
        F.col(raw).alias("message"),
        number.isNull().alias("bad_record"),
    )


def from_kafka(df: DataFrame) -> DataFrame:
    """Topic records (key, value, topic, partition, offset, timestamp) as events."""
    return df.select(
        F.concat(F.lit("kafka:"), "topic").alias("source"),
        F.col("timestamp").alias("ts"),
        "topic",
        "partition",
        "offset",
        F.decode("value", "utf-8").alias("payload"),
        F.decode("key", "utf-8").alias("key"),
    )


def read_kafka(spark: SparkSession, servers: str, topics: str, **options: str) -> DataFrame:
    """Streaming topic reader (needs the Kafka connector on the class path)."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics)
    return from_kafka(reader.options(**options).load())


ENVELOPES = {
    "mqtt": ("topic string, payload string, qos int", "topic"),
    "amqp": ("exchange string, routing_key string, payload string, priority int", "routing_key"),
}


def from_messages(df: DataFrame, protocol: str, raw: str = "value", received: Column | None = None) -> DataFrame:
    """Landed MQTT or AMQP records as events; the source is `mqtt:<topic>` or `amqp:<routing key>`."""
    schema, name = ENVELOPES[protocol]
    rows = df.withColumn("_j", F.from_json(raw, schema))
    fields = [part.split()[0] for part in schema.split(", ")]
    return rows.select(
        (F.current_timestamp() if received is None else received).alias("ts"),
        F.concat(F.lit(f"{protocol}:"), F.col("_j")[name]).alias("source"),
        *[F.col("_j")[f].alias(f) for f in fields],
        F.try_parse_json(raw).isNull().alias("bad_record"),
    )


# Words that make a log line relevant, per protocol.
LOG_KEYWORDS = {
    "dns": ("query",),
    "dhcp": ("DHCPACK", "DHCPREQUEST"),
    "mail": ("from=", "to=", "LOGIN"),
    "ldap": ("BIND", "SEARCH"),
    "ntp": ("synchronized", "offset"),
    "sip": ("INVITE", "BYE", "REGISTER"),
    "rtp": ("RTP", "RTSP", "stream"),
    "dnp3": ("DNP3", "outstation"),
    "bitcoin": ("block", "transaction", "peer", "mining", "sync", "rpc"),
    "ethereum": ("block", "transaction", "peer", "mining", "sync", "rpc"),
    "libp2p": ("peer", "dht", "pubsub"),
    "file": (),
}
IGNORE_CASE = ("bitcoin", "ethereum")


def is_relevant(protocol: str, raw: str = "value") -> Column:
    """Whether a line holds a keyword of the protocol; `file` takes every line."""
    line = F.lower(raw) if protocol in IGNORE_CASE else F.col(raw)
    test = F.lit(not LOG_KEYWORDS[protocol])
    for word in LOG_KEYWORDS[protocol]:
        test = test | line.contains(word)
    return test


def from_log(df: DataFrame, protocol: str, raw: str = "value", received: Column | None = None) -> DataFrame:
    """Relevant lines of a text log; `file` keeps every line."""
    return from_logs(df, (protocol,), raw, received)


def from_logs(df: DataFrame, protocols: Sequence[str] = tuple(LOG_KEYWORDS), raw: str = "value", received: Column | None = None) -> DataFrame:
    """A row for each line and protocol that finds it relevant, in one pass over the lines."""
    found = F.array_compact(F.array(*[F.when(is_relevant(p, raw), F.lit(p)) for p in protocols]))
    at = F.current_timestamp() if received is None else received
    return df.select(at.alias("ts"), F.explode(found).alias("source"), F.col(raw).alias("message"))


def read_log_stream(spark: SparkSession, path: str, *protocols: str, **options: str) -> DataFrame:
    """Follow the text files of a folder, as they grow and rotate; by default for all protocols."""
    return from_logs(tail(spark, path, **options), protocols or tuple(LOG_KEYWORDS))
