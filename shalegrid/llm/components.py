"""Connected components of an undirected graph, by alternating large-star and small-star steps.

Each step is a grouped minimum and a join, so that a hub's links are never gathered in one task; the number of links never
grows. The rounds are logarithmic in the number of nodes for the shapes that near-duplicate links have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shalegrid.llm.common import joined, staged, unstage


def _least(links: DataFrame, rows: int) -> DataFrame:
    """(u, v, m): each of so many links at most with the least of u and u's neighbours."""
    least = links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return joined(links, least, "u", rows)


def _large_star(links: DataFrame, rows: int) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both, 2 * rows).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame, rows: int) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    near = _least(down, rows)
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes that occur in links (u, v): component is the smallest node reachable.

    Self links and repeated links change nothing; nulls are dropped; no links give no rows. Raises if not settled in rounds.
    """
    links = staged(links.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = None
    for _ in range(rounds):
        mark = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark["n"] == 0 or state == (mark["n"], mark["h"]):
            break
        state = (mark["n"], mark["h"])
        new = staged(_small_star(_large_star(links, mark["n"]), mark["n"]), "links")
        unstage(links)
        links = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
