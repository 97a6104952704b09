"""Connected components of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stars import roots


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (u, v), roots included: root is the smallest node that can be reached."""
    links = roots(edges)
    return links.unionByName(links.select(F.col("root").alias("node"), "root").distinct())
