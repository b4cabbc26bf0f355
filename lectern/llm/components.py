"""Connected components of a graph given by its links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut, forget


def _least_neighbour(links: DataFrame) -> DataFrame:
    """(u, least): the least of u and its neighbours; aggregated before the shuffle, so a hub costs one row a task."""
    return links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"))


def _round(links: DataFrame) -> DataFrame:
    """One large-star and one small-star round. Joins with a hub are split at run time (they have one row of its kind on the other side)."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # large star: every larger neighbour is linked to the least one
    large = both.join(_least_neighbour(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
    # small star: every smaller neighbour and the node itself are linked to the least one
    least = _least_neighbour(large)
    small = large.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).union(least.select("u", F.col("least").alias("v")))
    return small.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of links(u, v); u and v are of one orderable type.

    Rounds repeat until nothing changes, a number that grows with the logarithm of the longest chain. Every round is
    a written table, so a lost executor repeats one round. Nodes without links, self links and repeated links are
    fine; no links give no rows.
    """
    now = cut(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        after = cut(_round(now))
        forget(now)
        now = after
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == mark or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        mark = state
