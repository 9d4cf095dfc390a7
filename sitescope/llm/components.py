"""Connected components by alternating large-star and small-star rounds.

Each round moves every edge to the smallest neighbour known so far, and rounds
repeat until nothing changes; their number grows with the logarithm of the
longest chain. Edges stay distributed: a round is joins and grouped minima,
written to the shared folder, and only two numbers reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


HUB = 256  # edges of a node from which it may count as a hub
MOST_HUBS = 4_096


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """``edges`` (a, b) with n = a and m, the smallest b of a.

    Edges of hubs stay where they are: a hub has more than a ``MOST_HUBS``-th of all ``total``
    edges, so that there are at most ``MOST_HUBS`` of them, whose minima are broadcast. All
    other edges meet their minimum by a shuffle on keys of few edges each.
    """
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("deg")).select(F.col("a").alias("n"), "m", "deg")
    hub = F.col("deg") > max(HUB, total // MOST_HUBS)
    hubs, rest = F.broadcast(least.where(hub).drop("deg")), least.where(~hub).drop("deg")
    heavy = edges.join(hubs, edges["a"] == hubs["n"])
    light = edges.join(hubs, edges["a"] == hubs["n"], "left_anti")
    return heavy.union(light.join(rest, light["a"] == rest["n"]))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Each larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.union(edges.select("b", "a"))
    return _with_least(both, 2 * total).where("b > a").select(F.col("b").alias("a"), F.least("n", "m").alias("b"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node's smaller neighbours, and the node, to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    met = _with_least(down, total)
    # the node itself is among the smallest one's neighbours once, by its edge to it
    return met.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
                      F.col("m").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the smallest node of its component."""
    now = written(edges.where("a <> b").select("a", "b"), "edges")
    mark, total = None, now.count()
    while True:
        large = written(_large_star(now, total), "edges")
        now = written(_small_star(large, large.count()), "edges")
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark, total = new, new[0]
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
