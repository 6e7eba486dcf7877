"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, materialise


def components(edges: DataFrame) -> DataFrame:
    """From edges (a, b) of longs: (node, root) for every node but the roots; the root is a component's smallest node.

    Each round is written to the shared folder, so lineage stays short; the number of rounds is logarithmic.
    """
    spark = edges.sparkSession
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).collect()[0]
    current, path = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = mark(current)
    while last[0]:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a")
        small = hung.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        following, new_path = materialise(small, "edges")
        now = mark(following)
        delete(spark, path)
        current, path = following, new_path
        if now == last:
            break
        last = now
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
