"""Connected components of links between integers, by alternating large and small stars.

Each round joins links with the smallest neighbour of their ends; the links stay a spanning subgraph of their
components and become stars. The number of rounds grows with the logarithm of the number of nodes. Every round is written
to the shared folder. The centre of a star may have any number of links: minima are aggregated before they are
shuffled, and the join back to them is one that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every end of a link in ``links`` (columns u and v); component is its smallest node.

    Links to itself and repeated links do nothing; nodes without links don't appear.
    """
    edges = written(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(edges.join(low, "u").select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        large = written(large, "links")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        old, edges = edges, written(small, "links")
        dropped(old, large)
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
