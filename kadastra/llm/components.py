"""Connected components of a sparse link table, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kadastra.llm.common import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node that it reaches.

    Alternating stars: each round first hangs a node's larger neighbours on its smallest neighbour, then each node's
    smaller neighbours too, until the links are a forest of stars. The rounds grow with the logarithm of the
    longest chain, and links are never more than at the start.
    """
    edges = cut(links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while True:
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.join(low, "x").filter("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low2 = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        small = (
            large.join(low2, F.col("u") == F.col("x"))
            .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .filter("u != v")
            .distinct()
        )
        after = cut(small)
        changed = after.exceptAll(edges).limit(1).count() + edges.exceptAll(after).limit(1).count()
        edges = after
        if not changed:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
