"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.llm.common import release, settled


def component_roots(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node with a link (columns src and dst, longs): the smallest node of its component.

    Alternating large-star and small-star steps: each round joins the larger (or smaller) neighbours of every node to its
    smallest neighbour, until nothing changes and all links are stars. Each round ends in a checkpoint, so a lost executor
    costs a round at most. Smallest neighbours are written out before they are joined to all, so that Spark can split the join by
    the rows of a node with many neighbours. Links from a node to itself and repeated links count for nothing; no links, no rows.
    """
    edges = settled(links.select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).filter("lo <> hi").distinct())

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())

    before = state(edges)
    for _ in range(max_rounds):
        # large star: u's neighbours v > u take the smallest of u and its neighbours
        both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = settled(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).filter("lo <> hi").distinct()
        # small star: u and its neighbours v < u take the smallest of them
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(least, "hi")
        small = joined.select(F.col("m").alias("lo"), F.col("lo").alias("hi")).unionByName(joined.select(F.col("m").alias("lo"), "hi")).filter("lo <> hi").distinct()
        edges = settled(small)
        after = state(edges)
        if after == before:
            break
        before = after
        del both, least, large, joined, small
        release(edges.sparkSession)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root"))).distinct()
