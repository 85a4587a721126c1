"""Connected components of a link table, by large-star and small-star rounds on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillhouse.sources.tables import stage


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b); component is its smallest member.

    Each round replaces links by links to smaller neighbours, so that long chains shrink by half and a hub
    only passes on its minimum: groups are aggregated, never collected. Links with a null end are left out;
    a link from a node to itself keeps the node as its own component; an empty table gives an empty one.
    Raises if the rounds don't suffice (2^60 nodes in a chain).
    """
    clean = links.filter("a is not null and b is not null")
    edges = stage(clean.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    edges = edges.filter("u <> v")
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.filter("u <> v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = stage(small.filter("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    root = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return nodes.join(root, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
