"""Lookup, range and interval joins that add context to events.

Lookups are plain left joins without a broadcast hint: Spark broadcasts a table only
while its size is below `spark.sql.autoBroadcastJoinThreshold`, and otherwise uses a
sort-merge join whose oversized partitions adaptive execution splits. Range and interval
lookups form no pairs; they use an ordered last value (see `functions.ordered`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.functions.addresses import address_key, masked, network_parts, next_key
from eventlens.functions.fields import field, first_text, has_field
from eventlens.functions.ordered import asof_last, disjoint_first
from eventlens.session import cut_lineage

# Event fields that may hold an address or a file hash.
IP_FIELDS = ("src_ip", "dst_ip", "client_ip", "remote_addr", "ip")
HASH_FIELDS = ("md5", "sha1", "sha256", "file_hash")
USER_FIELDS = ("user", "username", "email", "principal")


def lookup(df: DataFrame, dim: DataFrame, key: Column, dim_key: str, columns: dict[str, str], extra=None) -> DataFrame:
    """Left join on one key, adding `columns` (dim column → output column). `dim_key` must be unique."""
    right = dim.select(F.col(dim_key).alias("_dim_key"), *[F.col(c).alias("_d_" + c) for c in columns])
    left = df.withColumn("_key", key)
    on = F.col("_key") == F.col("_dim_key")
    joined = left.join(right, on if extra is None else on & extra, "left")
    return joined.select(*df.columns, *[F.col("_d_" + c).alias(out) for c, out in columns.items()])


def used_only(df: DataFrame, names: list[str], dim: DataFrame, key: str) -> DataFrame:
    """Rows of a large lookup table whose key occurs in the events at all: often few enough to broadcast."""
    values = df.select(F.explode(F.array(*[field(df, n).cast("string") for n in names])).alias("_used")).where("_used is not null").distinct()
    return dim.join(values, dim[key] == values["_used"], "left_semi")


def enrich_asset(assets: DataFrame):
    """Six `asset_*` columns by source address if there is one, else by host name."""
    names = ["hostname", "owner", "department", "criticality", "environment", "tags"]
    return lambda df: lookup(df, assets, first_text(df, ["src_ip", "hostname"]), "key", {n: f"asset_{n}" for n in names})


def enrich_user(users: DataFrame, names: tuple[str, ...] = USER_FIELDS):
    """Seven `user_*` columns by the first present user field."""
    added = ["full_name", "email", "department", "role", "manager", "title", "location"]
    return lambda df: lookup(df, users, first_text(df, list(names)), "key", {n: f"user_{n}" for n in added})


def enrich_identity(identities: DataFrame, names: tuple[str, ...] = ("user", "src_ip")):
    """Owner of the account or address, matched without regard to case; of keys that differ in case only the least counts."""
    added = {"primary_user": "owner_user", "department": "owner_department", "uid": "owner_uid"}

    def apply(df: DataFrame) -> DataFrame:
        dim = identities.groupBy(F.lower("key").alias("_lower")).agg(F.min_by(F.struct(*identities.columns), "key").alias("_i")).select("_lower", "_i.*")
        return lookup(df, dim, F.lower(first_text(df, list(names))), "_lower", added)

    return apply


def enrich_threat(threats: DataFrame, ttl: str = "1 hour", ts: str = "ts", reduce: bool = False):
    """Threat columns for every address and hash field whose indicator is still valid at event time.

    The latest entry per indicator counts, until `ttl` after it was last seen. Of several
    hash fields the later one wins. With `reduce`, a feed too large to broadcast is first cut down to the
    indicators that occur, by one pass over the indicator fields, instead of shuffling the events per field.
    """
    values = ["is_malicious", "reputation", "categories", "source", "last_seen"]

    def apply(df: DataFrame) -> DataFrame:
        latest = threats.groupBy("indicator").agg(F.max_by(F.struct(*values), "last_seen").alias("_v")).select("indicator", "_v.*")
        if reduce:
            latest = used_only(df, [n for n in (*IP_FIELDS, *HASH_FIELDS) if has_field(df, n)], latest, "indicator")
        result = df
        valid = F.col(ts).cast("timestamp") < F.col("_d_last_seen").cast("timestamp") + F.expr(f"INTERVAL {ttl}")
        for name in IP_FIELDS:
            if has_field(df, name):
                added = {"is_malicious": "malicious", "reputation": "reputation", "categories": "categories", "source": "source"}
                columns = {k: f"{name}_threat_{v}" for k, v in added.items()} | {"last_seen": "_seen"}
                result = lookup(result, latest, field(df, name).cast("string"), "indicator", columns, valid).drop("_seen")
        hashes = [name for name in HASH_FIELDS if has_field(df, name)]
        for name in hashes:
            columns = {"is_malicious": f"_{name}_malicious", "categories": f"_{name}_categories", "last_seen": f"_{name}_seen"}
            result = lookup(result, latest, field(df, name).cast("string"), "indicator", columns, valid)
        if hashes:
            for part in ("malicious", "categories"):
                found = [F.when(F.col(f"_{n}_seen").isNotNull(), F.col(f"_{n}_{part}")) for n in reversed(hashes)]
                result = result.withColumn(f"file_threat_{part}", F.coalesce(*found))
            result = result.drop(*[f"_{n}_{p}" for n in hashes for p in ("malicious", "categories", "seen")])
        return result

    return apply


def ipv4_number(col: Column) -> Column:
    """Dotted IPv4 text as a number; NULL for anything else."""
    part = F.transform(F.split(col, r"\."), lambda p: p.try_cast("long"))
    good = col.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$") & (F.array_max(part) <= 255)
    return F.when(good, F.aggregate(part, F.lit(0).cast("long"), lambda acc, p: acc * 256 + p))


def flat_networks(networks: DataFrame, values: Sequence[str], network: str = "network") -> DataFrame:
    """Disjoint segments in which the narrowest network is the same: `first_key`, `covered` and `values`, up to the next `first_key`.

    Networks nest or are apart, so only their bounds can begin a segment. Each bound meets its own prefix of every length that occurs
    (129 at most) in one equality join; the longest wins. Of equal networks the one with the least values counts.
    """
    key, length = network_parts(F.col(network))
    packed = F.struct(*values)
    rows = networks.select(key.alias("_k"), length.alias("length"), packed.alias("_v")).where("length is not null")
    nets = cut_lineage(rows.groupBy(masked(F.col("_k"), F.col("length"), "0").alias("first"), "length").agg(F.min("_v").alias("_v")))
    lengths = [r.length for r in nets.select("length").distinct().collect()]
    after = next_key(masked(F.col("first"), F.col("length"), "f"))
    bounds = nets.select(F.explode(F.array("first", after)).alias("first_key")).where("first_key is not null").distinct()
    asked = bounds.select("first_key", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>")).alias("length")).withColumn("first", masked(F.col("first_key"), F.col("length"), "0"))
    widest = asked.join(nets, ["first", "length"]).groupBy("first_key").agg(F.max_by("_v", "length").alias("_v"))
    return bounds.join(widest, "first_key", "left").select("first_key", F.col("_v").isNotNull().alias("covered"), *[F.col("_v")[v].alias(v) for v in values])


def locate_addresses(addresses: DataFrame, networks: DataFrame, values: Sequence[str], address: str = "address", group_rows: int | None = None) -> DataFrame:
    """`addresses` (distinct) that lie in a network, with the `values` of the narrowest one; both families, by one ordered pass."""
    keyed = addresses.withColumn("_n", address_key(F.col(address))).where("_n is not null")
    found = asof_last(keyed, flat_networks(networks, values), [], "_n", "first_key", [address], ["covered", *values], group_rows)
    return found.where("covered").drop("covered", "_n")


def used_addresses(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(F.explode(F.array_distinct(F.array(*[field(df, n).cast("string") for n in names]))).alias("address")).where("address is not null").distinct()


def enrich_geo(ranges: DataFrame, names: tuple[str, ...] = IP_FIELDS, group_rows: int | None = None):
    """Country, city, latitude, longitude and region of each address field.

    `ranges` has either `network` (IPv4 or IPv6 with a prefix length; the narrowest network counts) or the numbers `start_ip` and `end_ip` (IPv4 only; where ranges
    overlap, the one that starts first counts). Only distinct addresses are placed: an ordered pass over addresses and range starts, then an equi join back.
    """
    added = {"country": "country", "city": "city", "lat": "latitude", "lon": "longitude", "region": "region"}

    def apply(df: DataFrame) -> DataFrame:
        present = [n for n in names if has_field(df, n)]
        addresses = used_addresses(df, present)
        if "network" in ranges.columns:
            found = locate_addresses(addresses, ranges, list(added), group_rows=group_rows)
        else:
            numbered = addresses.withColumn("_n", ipv4_number(F.col("address"))).where("_n is not null")
            flat = disjoint_first(ranges, [], "start_ip", "end_ip", ["end_ip"], F.lit(1))
            found = asof_last(numbered, flat, [], "_n", "start_ip", ["address"], ["end_ip", *added], group_rows).where("_n <= end_ip")
        result = df
        for name in present:
            result = lookup(result, found, field(df, name).cast("string"), "address", {k: f"{name}_geo_{v}" for k, v in added.items()})
        return result

    return apply


def enrich_threat_networks(threats: DataFrame, ttl: str = "1 hour", ts: str = "ts", names: tuple[str, ...] = IP_FIELDS, group_rows: int | None = None):
    """Threat columns of each address field from the narrowest network indicator around it that is still valid at event time.

    `threats` is as for `enrich_threat`; indicators that are no address or network are left out. The latest entry per network counts, whether its
    address is written in one family or mapped into the other. An address inside an expired narrow network has no threat.
    """
    values = ["is_malicious", "reputation", "categories", "source", "last_seen"]

    def apply(df: DataFrame) -> DataFrame:
        present = [n for n in names if has_field(df, n)]
        key, length = network_parts(F.col("indicator"))
        latest = (
            threats.select(masked(key, length, "0").alias("_first"), length.alias("_length"), F.col("indicator").alias("network"), *values)
            .where("_length is not null")
            .groupBy("_first", "_length")
            .agg(F.max_by(F.struct("network", *values), F.struct("last_seen", "network")).alias("_v"))
            .select("_v.*")
        )
        found = locate_addresses(used_addresses(df, present), latest, values, group_rows=group_rows)
        valid = F.col(ts).cast("timestamp") < F.col("_d_last_seen").cast("timestamp") + F.expr(f"INTERVAL {ttl}")
        added = {"is_malicious": "malicious", "reputation": "reputation", "categories": "categories", "source": "source"}
        result = df
        for name in present:
            result = lookup(result, found, field(df, name).cast("string"), "address", {k: f"{name}_threat_{v}" for k, v in added.items()} | {"last_seen": "_seen"}, valid).drop("_seen")
        return result

    return apply


FAR_FUTURE = "9999-12-31 23:59:59"


def resolve_identity_asof(events: DataFrame, mappings: DataFrame, identifier: str, ts: str = "ts", event_id: str = "event_id", group_rows: int | None = None) -> DataFrame:
    """Add `entity_id`: the owner of the identifier at event time, both interval ends included.

    Of overlapping intervals the one that starts first is used. Intervals are first cut to be
    disjoint; each event then takes the last one begun, so events and intervals are never paired.
    """
    closed = mappings.select(
        F.col("identifier").alias("_id"),
        "entity_id",
        F.col("valid_from").cast("timestamp").alias("valid_from"),
        F.coalesce(F.col("valid_to").cast("timestamp"), F.lit(FAR_FUTURE).cast("timestamp")).alias("valid_to"),
    )
    flat = disjoint_first(closed, ["_id"], "valid_from", "valid_to", ["entity_id"], F.expr("INTERVAL '0.000001' SECOND"))
    points = events.withColumn("_id", field(events, identifier).cast("string")).withColumn("_ts", F.col(ts).cast("timestamp"))
    found = asof_last(points, flat, ["_id"], "_ts", "valid_from", [event_id], ["entity_id", "valid_to"], group_rows)
    inside = F.when(F.col("_ts") <= F.col("valid_to"), F.col("entity_id"))
    return found.select(*events.columns, inside.alias("entity_id"))


def indicator_values(indicators: DataFrame) -> DataFrame:
    """Indicators with each quoted value of their pattern; of equal values the lowest id stays."""
    valued = indicators.withColumn("value", F.explode(F.regexp_extract_all("pattern", F.lit("= '([^']+)'"), F.lit(1))))
    columns = [c for c in indicators.columns]
    first = valued.where("value is not null").groupBy("value").agg(F.min_by(F.struct(*columns), "id").alias("_i"))
    return first.select("value", "_i.*")


def match_indicator(indicators: DataFrame, name: str, how: str = "left"):
    """Join events to indicators by value (`left`, `inner`), or keep or drop matching events (`semi`, `anti`)."""

    def apply(df: DataFrame) -> DataFrame:
        found = indicator_values(indicators).select(F.col("value").alias("_v"), F.col("id").alias("indicator_id"), F.col("severity").alias("indicator_severity"))
        return df.join(found, field(df, name).cast("string") == found["_v"], how).drop("_v")

    return apply


def incident_entities(incidents: DataFrame, signals: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct entities behind the signals of each incident."""
    links = incidents.select("incident_id", F.explode("source_signals").alias("signal_id"))
    named = links.join(signals.select("signal_id", "entities"), "signal_id").select("incident_id", F.explode("entities").alias("entity_id"))
    return named.distinct().join(entities, "entity_id")


def config_drift(golden: DataFrame, runtime: DataFrame) -> DataFrame:
    """Golden keys that are missing at runtime or have another value; extra runtime keys are ignored."""
    right = runtime.select(F.col("key").alias("_k"), F.col("value").cast("string").alias("_actual"))
    joined = golden.join(right, golden["key"] == right["_k"], "left")
    expected = F.col("value").cast("string")
    missing = F.col("_k").isNull()
    text = F.when(missing, F.concat(F.lit("Missing configuration key: "), "key")).otherwise(
        F.concat(F.lit("Drift in "), "key", F.lit(": expected "), F.coalesce(expected, F.lit("<nil>")), F.lit(", got "), F.coalesce("_actual", F.lit("<nil>")))
    )
    return joined.where(missing | ~expected.eqNullSafe(F.col("_actual"))).select(
        "key", F.when(missing, "missing").otherwise("drift").alias("kind"), text.alias("discrepancy")
    )


def detokenize(vault: DataFrame, *columns: str):
    """Replace tokens by the original values kept in the vault table (token, value)."""

    def apply(df: DataFrame) -> DataFrame:
        result = df
        for name in columns:
            right = vault.select(F.col("token").alias("_t"), F.col("value").alias("_v"))
            joined = result.join(right, result[name] == right["_t"], "left")
            result = joined.withColumn(name, F.coalesce("_v", name)).select(*df.columns)
        return result

    return apply
