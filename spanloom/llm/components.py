"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, drop, save

#: A node with more links than this is a hub: its links are joined where they lie, by a broadcast of the hubs, and not sent to one task.
HUB = 500


def _with_least(edges: DataFrame, least: DataFrame, bound: int) -> DataFrame:
    """``edges`` (u, v) with m, from the table ``least`` (u, m, n) of their u's, of at most ``bound`` edges.

    Hubs are at most bound / HUB; a broadcast of that many is proven small, or else all join by a shuffle.
    """
    plain = least.select("u", "m")
    if bound <= HUB or bound // HUB * 64 > BROADCAST_BYTES:
        return edges.join(plain, "u")
    hubs = least.where(F.col("n") > HUB).select("u", "m")
    others = edges.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(least.where(F.col("n") <= HUB).select("u", "m"), "u")
    return others.unionByName(edges.join(F.broadcast(hubs), "u"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; component is the smallest node reachable.

    Large-star and small-star rounds: every node hands its larger neighbours to the smallest
    node it knows, until the links are stars around each component's smallest node. A round is
    two grouped minima (combined before the shuffle) and two equi-joins, in which a hub's links stay where they
    are; no neighbourhood is ever gathered in a task. Rounds grow with the logarithm of the longest path. Links with a
    null end or equal ends are ignored; an empty table gives an empty table.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("u <> v").distinct()
    edges, state = save(edges, "links"), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = tuple(now)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = _with_least(both, least, 2 * now[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = save(large.distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, least, now[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        new = save(small.distinct(), "links")
        drop(edges)
        drop(large)
        edges = new
