"""Connected components of a link table: alternating large-star and small-star rounds as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.session import stage


HUB = 8  # links that make a node a hub, at least


def _with_least(rows: DataFrame, least: DataFrame, n_links: int) -> DataFrame:
    """``rows`` (u, v) with the ``m`` of their node u from ``least`` (u, m, d).

    A node with over a 500th of all links is a hub; there are fewer than 1,000 of them, as a link counts for two nodes. Their ``m`` is
    broadcast, so that no task has to read all links of a hub; all other rows are joined by a shuffle.
    """
    bound = max(HUB, n_links // 500)
    hubs = F.broadcast(least.filter(F.col("d") > bound).select("u", F.col("m").alias("hub")))
    tagged = rows.select("u", "v").join(hubs, "u", "left")
    settled = tagged.filter("hub IS NOT NULL").select("u", "v", F.col("hub").alias("m"))
    rest = tagged.filter("hub IS NULL").select("u", "v").join(least.filter(F.col("d") <= bound).select("u", "m"), "u")
    return settled.unionByName(rest)


def _large_star(links: DataFrame, n_links: int) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node of its neighbourhood (itself included)."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("d"))
    return _with_least(both.filter("v > u"), least, n_links).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame, n_links: int) -> DataFrame:
    """Link the smaller neighbours of a node, and the node, to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v")
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d"))
    moved = _with_least(down, least, n_links).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("u != v").union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component): the smallest node reachable from each node of ``links`` (u long, v long).

    Nodes without links don't appear. Each round is written to the shared folder, so no lineage grows and no link
    reaches the driver; rounds are logarithmic in the size of the largest component. The rounds end when a
    round changes nothing, which two sums over all links show.
    """
    now = stage(links.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark, n_links = None, now.count()
    for _ in range(max_rounds):
        now = stage(_small_star(_large_star(now, n_links), n_links), "links")
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (row.n, row.h) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        mark, n_links = (row.n, row.h), row.n
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
