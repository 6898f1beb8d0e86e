"""Connected components of a graph held in tables, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweir.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, label): the least node of its component, for each node that has a link.

    Every step replaces links by links to a smaller node, so no list of neighbours is ever gathered in one task; the
    number of steps grows with the logarithm of the longest chain. A self-link counts for nothing; repeated links
    count once; an empty table gives an empty one."""
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: every larger neighbour is linked to the least one
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours, and the node itself, are linked to the least one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = cut_lineage(small.where("u <> v").distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if before == now:
            break
        before = now
    roots = edges.groupBy("u").agg(F.min("v").alias("label"))
    return roots.select(F.col("u").alias("node"), "label").unionByName(
        roots.select("label").distinct().select(F.col("label").alias("node"), "label")
    )
