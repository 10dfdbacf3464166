"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _mark(edges: DataFrame) -> tuple:
    """Row count and an order-free digest of an edge set."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


#: Links (16 bytes each) of a partition at least: a small table of links in many partitions would be many small files at every step.
PART_LINKS = 250_000


def connected_components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node that has a link.

    links has two long columns a, b. Alternates large-star and small-star steps
    until the stars stand still; each step is a group-by minimum (combined map-side)
    and a join on the node, so a hub is spread by partial aggregation and skew
    joins. Self links are ignored. Only a row count and a digest reach the driver;
    the count says in how many partitions the links are held."""
    edges = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(edges)
    parts = 1 + mark[0] // PART_LINKS
    while mark[0]:
        edges = edges.coalesce(parts)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(small.union(least.select("u", F.col("m").alias("v"))).coalesce(parts).distinct().coalesce(parts))
        last, mark = mark, _mark(edges)
        if mark == last:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v")).distinct())
