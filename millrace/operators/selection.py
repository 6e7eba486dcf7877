"""Values at given ranks, exactly, by histograms that narrow: no sort of the rows, no task that holds a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop, written

#: Bins of a pass: what a group and target hands on, whatever the number of its rows and of its different values.
BINS = 1024


def at_ranks(rows: DataFrame, value: Column, keys: list[str], targets: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """keys and a column by target: the value at a rank (from 0, of the group's size) in ascending order. Nulls and NaN don't count.

    A pass counts each target's interval in BINS equal parts, and goes on with the part that holds the rank, from its least to its greatest value.
    The parts of the ends differ, so every pass narrows; it is over when least and greatest are one value. Some three passes are the rule.
    """
    given = written(rows.select(*keys, value.cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)"), "values")
    sizes = given.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).filter("n > 0")
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("target"), F.least(F.greatest(rank(F.col("n")).cast("long"), F.lit(0)), F.col("n") - 1).alias("rank")) for name, rank in targets.items()))).alias("t")
    left = written(sizes.select(*keys, "lo", "hi", each).select(*keys, "t.target", "t.rank", "lo", "hi"), "targets")
    by = [*keys, "target"]
    while left.filter("lo < hi").limit(1).count():
        meets = given.join(left.filter("lo < hi"), keys) if keys else given.join(F.broadcast(left.filter("lo < hi")))  # without keys a row a target
        inside = meets.filter(F.col("v").between(F.col("lo"), F.col("hi")))
        half = lambda c: F.col(c) / 2  # noqa: E731  the width of an interval may be beyond the greatest number
        part = F.least(F.floor((half("v") - half("lo")) / (half("hi") - half("lo")) * BINS), F.lit(BINS - 1))
        counts = inside.groupBy(*by, "rank", part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy(*by).orderBy("part"))
        chosen = counts.withColumn("upto", upto).filter("rank < upto AND rank >= upto - n").select(*by, (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"), "lo", "hi")
        following = written(chosen.unionByName(left.filter("lo = hi")), "targets")
        drop(left)
        left = following
    drop(given)
    return left.groupBy(*keys).agg(*(F.max(F.when(F.col("target") == name, F.col("lo"))).alias(name) for name in targets))
