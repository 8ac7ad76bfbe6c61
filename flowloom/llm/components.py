"""Connected components with DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.session import cut_lineage


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node of the component of each node that has an edge.

    Alternates the two star contractions: in turn every node's larger, then its smaller
    neighbours are tied to the smallest neighbour.  The number of edges never grows and the
    rounds grow with the logarithm of the number of nodes.  A neighbourhood is only ever
    aggregated to its minimum, so a node with very many edges is no hot group.
    Self loops and null ends are passed over.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    pairs = cut_lineage(pairs)
    before = None
    while True:
        both = pairs.union(pairs.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("x"), "m").where("x <> m").union(down.select("u", "m")).toDF("u", "v").distinct()
        pairs = cut_lineage(small)
        # The sum of the links tells whether a round changed anything.
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(pairs.select("v", "v").distinct().toDF("node", "root"))
