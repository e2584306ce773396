"""Reachability, blast radius and paths over asset relationships; trust nodes and edges.

Loops advance a frontier by one join per step and cut lineage with reliable checkpoints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.session import cut_lineage


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct (a, b) in both directions from `from_id`, `to_id`."""
    there = edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    back = edges.select(F.col("to_id").alias("a"), F.col("from_id").alias("b"))
    return there.union(back).where("a is not null and b is not null").distinct()


def graph_connected(starts: DataFrame, edges: DataFrame, depth: int, assets: DataFrame | None = None) -> DataFrame:
    """Ids within `depth` steps of each start (column `id`): (start_id, id, distance), the start included.

    Ids without an asset row are walked through but not returned. Stops early when no new id appears.
    """
    links = cut_lineage(undirected(edges))
    seen = cut_lineage(starts.select(F.col("id").alias("start_id"), "id", F.lit(0).alias("distance")).distinct())
    frontier = seen
    for step in range(1, depth + 1):
        ahead = frontier.join(links, frontier["id"] == links["a"]).select("start_id", F.col("b").alias("id")).distinct()
        fresh = ahead.join(seen.select("start_id", "id"), ["start_id", "id"], "left_anti")
        frontier = cut_lineage(fresh.withColumn("distance", F.lit(step)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen if assets is None else seen.join(assets.select("id"), "id", "left_semi").select("start_id", "id", "distance")


def blast_radius(starts: DataFrame, edges: DataFrame, assets: DataFrame | None = None, depth: int = 10) -> DataFrame:
    """How many assets a compromised start can reach, and how severe that is."""
    counted = graph_connected(starts, edges, depth, assets).groupBy("start_id").agg(F.count(F.lit(1)).alias("blast_radius"))
    return counted.withColumn("severity", severity(F.col("blast_radius")))


def severity(n: Column) -> Column:
    return F.when(n > 100, "critical").when(n > 50, "high").when(n > 20, "medium").otherwise("low")


def reach_of_all(edges: DataFrame, assets: DataFrame, depth: int, lg_entries: int = 7) -> DataFrame:
    """id and `reach` of every asset: how many assets lie within `depth` steps, itself included; `exact` tells whether that is a count.

    Each node keeps a theta sketch of what it reaches and, at each step, merges its neighbours' into it: edges times steps rows of bounded size,
    never a row for each pair of nodes. A sketch holds 2 ** `lg_entries` hashes of ids and counts exactly up to there; beyond, the standard error is
    about 2 ** (-lg_entries / 2), and the estimate is never below the limit. Nodes without an asset row pass on what they reach and are not counted.
    """
    links = cut_lineage(undirected(edges))
    known = assets.select("id").where("id is not null").distinct()
    own = known.groupBy("id").agg(F.theta_sketch_agg("id", F.lit(lg_entries)).alias("sketch"))
    reached = cut_lineage(own)
    for _ in range(depth):
        told = links.join(reached, links["b"] == reached["id"]).select(F.col("a").alias("id"), "sketch")
        merged = reached.unionByName(told).groupBy("id").agg(F.theta_union_agg("sketch", F.lit(lg_entries)).alias("sketch"))
        ahead = cut_lineage(merged)
        old = reached.select(F.col("id").alias("_id"), F.col("sketch").alias("_old"))
        changed = ahead.join(old, F.col("id") == F.col("_id"), "left").where(F.col("_old").isNull() | (F.col("sketch") != F.col("_old")))
        reached = ahead
        if changed.isEmpty():
            break
    n = F.theta_sketch_estimate("sketch")
    return reached.join(known, "id", "left_semi").select("id", n.alias("reach"), (n <= F.lit(1 << lg_entries)).alias("exact"))


def blast_radius_of_all(edges: DataFrame, assets: DataFrame, depth: int = 10, lg_entries: int = 7) -> DataFrame:
    """Blast radius and severity of every asset. Severities are always exact, as sketches count exactly beyond the highest limit."""
    if 1 << lg_entries <= 100:
        raise ValueError("sketches must count exactly up to the highest severity limit, 100")
    found = reach_of_all(edges, assets, depth, lg_entries)
    return found.select(F.col("id").alias("start_id"), F.col("reach").alias("blast_radius"), severity(F.col("reach")).alias("severity"), "exact")


def graph_paths(pairs: DataFrame, edges: DataFrame, max_nodes: int) -> DataFrame:
    """Every simple path of at most `max_nodes` nodes for each (from_id, to_id).

    A node with one neighbour cannot lie inside a path, so such nodes are dropped first unless
    they are ends. A path may then only grow into nodes from which its target is still within
    reach: branches that cannot arrive are not enumerated. Reach is kept per distinct target, so
    ask for many sources and few targets rather than the other way round.
    """
    both_ways = cut_lineage(undirected(edges))
    ends = pairs.select(F.col("from_id").alias("_end")).union(pairs.select("to_id")).distinct()
    degree = both_ways.groupBy("a").agg(F.count(F.lit(1)).alias("_n"))
    leaves = cut_lineage(degree.where("_n = 1").join(ends, F.col("a") == F.col("_end"), "left_anti").select(F.col("a").alias("_leaf")))
    inner = both_ways.join(leaves, F.col("a") == F.col("_leaf"), "left_anti")
    links = cut_lineage(inner.join(leaves, F.col("b") == F.col("_leaf"), "left_anti"))
    core = links.select(F.col("a").alias("from_id"), F.col("b").alias("to_id"))
    goals = pairs.select(F.col("to_id").alias("id")).distinct()
    near = cut_lineage(graph_connected(goals, core, max_nodes - 1).select(F.col("start_id").alias("goal"), F.col("id").alias("_id"), F.col("distance").alias("_left")))
    open_paths = pairs.distinct().select("from_id", "to_id", F.array("from_id").alias("path"))
    found = None
    for size in range(1, max_nodes + 1):
        open_paths = cut_lineage(open_paths)
        arrived = open_paths.where(F.element_at("path", -1) == F.col("to_id"))
        found = arrived if found is None else found.unionByName(arrived)
        going = open_paths.where(F.element_at("path", -1) != F.col("to_id"))
        if size == max_nodes or going.isEmpty():
            break
        stepped = going.join(links, F.element_at(going["path"], -1) == links["a"]).where(~F.array_contains("path", F.col("b")))
        reach = (F.col("b") == near["_id"]) & (F.col("to_id") == near["goal"]) & (near["_left"] <= max_nodes - size - 1)
        kept = stepped.join(near, reach, "left_semi")
        open_paths = kept.select("from_id", "to_id", F.concat("path", F.array("b")).alias("path"))
    return found


def trust_nodes(events: DataFrame, source: str = "source", user: str = "user", ts: str = "ts") -> DataFrame:
    """Latest state per node: sources are verified systems, users reputable users."""
    named = F.explode(F.array(*[F.struct(F.col(c).cast("string").alias("id"), F.lit(p).alias("person")) for c, p in ((source, False), (user, True))]))
    rows = events.select(named.alias("_n"), F.col(ts).alias("_ts")).select("_n.id", "_n.person", "_ts").where("id is not null")
    # times only in the aggregate: a pair of texts in it would sort every row
    latest = rows.groupBy("id").agg(
        F.max(F.when(~F.col("person"), F.col("_ts"))).alias("_system"),
        F.max(F.when(F.col("person"), F.col("_ts"))).alias("_user"),
        F.max("person").alias("_person"),
        F.max("_ts").alias("last_seen"),
    )
    # a user named like a source is written after it within one event
    person = F.col("_person") & F.coalesce(F.col("_user") >= F.col("_system"), F.col("_system").isNull())
    return latest.select("id", F.when(person, "user").otherwise("system").alias("type"), F.when(person, "reputable").otherwise("verified").alias("level"), "last_seen")


def trust_edges(events: DataFrame, source: str = "source", user: str = "user", weighted: bool = False) -> DataFrame:
    """User → source edges, one per event, or one per pair with a weight."""
    edges = events.where(F.col(user).isNotNull()).select(
        F.col(user).alias("from_id"), F.col(source).alias("to_id"), F.lit("produced").alias("action"), F.lit("reputable").alias("level")
    )
    if not weighted:
        return edges
    return edges.groupBy("from_id", "to_id", "action", "level").agg(F.count(F.lit(1)).alias("weight"))


def trust_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node count per level, node total and edge total as (metric, value) rows."""
    levels = nodes.groupBy("level").agg(F.count(F.lit(1)).alias("value")).select(F.concat(F.lit("level:"), "level").alias("metric"), "value")
    totals = nodes.agg(F.count(F.lit(1)).alias("value")).select(F.lit("total_nodes").alias("metric"), "value")
    return levels.union(totals).union(edges.agg(F.count(F.lit(1)).alias("value")).select(F.lit("total_edges"), "value"))
