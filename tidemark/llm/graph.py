"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.stage import stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Ties the neighbours of every node to the smallest of them and the node itself.

    Large: only larger neighbours, seen from both ends. Small: only smaller ones. The minimum is
    a combinable aggregate and is joined back, so a node with very many neighbours is no hot group.
    """
    if large:
        sides = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        tied = sides.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        inner = links.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        tied = inner.unionByName(least.select("u", F.col("m").alias("v")))
    return tied.where("u != v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node with a link; the component is its smallest node.

    Repeated links and loops do no harm. Each round is written to the shared folder; the number
    of rounds grows with the logarithm of the number of nodes.
    """
    x, y = F.col(a), F.col(b)
    now = stored(links.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where("u != v").distinct(), "links")
    state = None
    while True:
        now = stored(_star(_star(now, True), False), "links")
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == state:
            break
        state = tuple(found)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
