"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.llm.shared import Scratch


def _joined(links: DataFrame, per_node: DataFrame, node: str, scratch: Scratch) -> DataFrame:
    """links with per_node's m. per_node: node, m and n, the number of links that the node has at most."""
    per_node = scratch.save(per_node)
    total = per_node.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    many = F.col("n") > max(100, total // 1000)
    hot = F.broadcast(per_node.filter(many).select(node, "m"))  # a thousand nodes at most, as the counts sum to the total
    rest = links.join(F.broadcast(per_node.filter(many).select(node)), node, "left_anti")
    return links.join(hot, node).unionByName(rest.join(per_node.filter(~many).select(node, "m"), node))


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """links: a, b (long). Returns node and root, the smallest node it is linked to, for every linked node.

    Both steps are one minimum per node and one join, so no node's links are gathered in one place: minima are
    pre-aggregated before the shuffle, and nodes with more than a thousandth of all links, a few thousand at most, are
    joined by broadcast. Each round's links are a written table. Null ends and self-links are left out; repeated links
    count once; no links give no rows.
    """
    links = scratch.save(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        # Large star: every larger neighbour of a node is linked to the smallest node around it.
        both = links.select("a", "b").union(links.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = scratch.save(_joined(both.filter("v > u"), low, "u", scratch).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        # Small star: a node's smaller neighbours are linked to the smallest of them, and the node too.
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _joined(large, least, "a", scratch).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        new = scratch.save(small.filter("a <> b").distinct())
        scratch.drop(links, large)
        links = new
        # Done when each node has one link and no end of a link has a link itself.
        sizes = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        state = (sizes["n"], sizes["h"])
        if state == seen:
            break
        seen = state
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select(F.col("b"), F.col("b")).distinct())
