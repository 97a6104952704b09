"""Connected components by alternating stars, as joins and aggregates; nothing but two numbers reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import saved


def roots(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (u, v) that isn't a root: root is the smallest node that can be reached. Nodes are numbers or structs that have an order.

    Each round hangs all larger neighbours of a node on its smallest one, then all smaller ones; the number of rounds grows with
    the logarithm of the nodes. A node with very many neighbours is aggregated in parts and met by a join that Spark can split.
    """
    links = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        links = saved(small.where("u <> v").distinct(), "links")
        state = tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == seen or not state[0]:
            break
        seen = state
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
