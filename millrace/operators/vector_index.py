"""A stored vector index: blocks of vectors with a row of metadata, checked when it is opened."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import cells
from .shared import written

VERSION = 1


def metadata(vectors: DataFrame, model: str) -> DataFrame:
    """One row: version, model, dimension (of the longest vector), vectors, and a digest of ids and lengths that no order changes."""
    n = F.conv(F.substring(F.md5(F.concat_ws("|", "vec_id", F.size("embedding").cast("string"))), 1, 8), 16, 10).cast("long")
    return vectors.agg(F.lit(VERSION).alias("version"), F.lit(model).alias("model"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dimension"), F.count("*").alias("vectors"), F.coalesce(F.sum(n), F.lit(0)).alias("digest"))


def save(vectors: DataFrame, path: str, model: str, parts: int | None = None) -> None:
    """Vectors in ranges of their ids, then the metadata: an index without it is unfinished."""
    kept = vectors.select("vec_id", "embedding")
    ranged = kept.repartitionByRange(parts, "vec_id") if parts else kept
    ranged.write.mode("overwrite").parquet(f"{path}/vectors")
    metadata(kept.sparkSession.read.parquet(f"{path}/vectors"), model).write.mode("overwrite").parquet(f"{path}/metadata")


def load(spark: SparkSession, path: str, model: str, dimension: int, current: DataFrame | None = None) -> DataFrame:
    """The index's vectors. ValueError if it was made by another model, has another dimension, isn't what its metadata says, or, given the
    current vectors, no longer holds those."""
    vectors, held = spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/metadata").first()
    problems = [name for name, found, wanted in (("version", held["version"], VERSION), ("model", held["model"], model), ("dimension", held["dimension"], dimension)) if found != wanted]
    if metadata(vectors, held["model"]).first() != held:
        problems.append("content")
    if current is not None and metadata(current.select("vec_id", "embedding"), held["model"]).first()["digest"] != held["digest"]:
        problems.append("snapshot")
    if problems:
        raise ValueError(f"index at {path} doesn't fit: {', '.join(problems)}")
    return vectors


def migrate(spark: SparkSession, source: str, target: str, parts: int | None = None) -> int:
    """An index written anew elsewhere, in one pass; the number of its vectors."""
    held = spark.read.parquet(f"{source}/metadata").first()
    save(load(spark, source, held["model"], held["dimension"]), target, held["model"], parts)
    return held["vectors"]


def diagnostics(spark: SparkSession, path: str) -> DataFrame:
    """The metadata beside the number of vectors that don't have its dimension."""
    held = spark.read.parquet(f"{path}/metadata")
    odd = spark.read.parquet(f"{path}/vectors").join(F.broadcast(held.select("dimension"))).agg(F.count_if(F.size("embedding") != F.col("dimension")).alias("odd"))
    return held.join(F.broadcast(odd))  # one row each


def save_cells(vectors: DataFrame, path: str, block: int | None = None) -> None:
    """An index that a search reads in part: blocks of near vectors in a folder a cell, and a row about each block beside them."""
    made = cells.blocks(vectors, most=block)
    made.sortWithinPartitions("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/blocks")
    held = made.sparkSession.read.parquet(f"{path}/blocks")
    held.select("block", "size", "cell", "n", "centre", "radius").write.mode("overwrite").parquet(f"{path}/cells")


def needed(spark: SparkSession, path: str, pairs: DataFrame) -> DataFrame:
    """The stored blocks of the pairs' cells: other folders aren't read. As many cells as CENTRES a vector length at most."""
    about = spark.read.parquet(f"{path}/cells").select(F.col("block").alias("b"), "cell")
    wanted = sorted(r["cell"] for r in about.join(pairs.select("b").distinct(), "b", "left_semi").select("cell").distinct().collect())
    return spark.read.parquet(f"{path}/blocks").filter(F.col("cell").isin(wanted))


def search_cells(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int | None = None, block: int | None = None) -> DataFrame:
    """query_id, vec_id, rank, distance and score of each query's k nearest in a stored index, by squared distance, then vec_id.

    Exact by default. With probes only each query's `probes` nearest blocks are read, and neighbours elsewhere are missed.
    """
    left = written(cells.blocks(queries, most=block), "blocks")
    about = spark.read.parquet(f"{path}/cells")
    found = cells.nearest(left, None, about, k, probes, lambda pairs: needed(spark, path, pairs))
    return cells.ranked(found, k).select("query_id", "vec_id", "rank", F.round("distance", 4).alias("distance"), F.round(V.score_of(F.col("distance")), 6).alias("score"))


def evaluated(cases: DataFrame, results: DataFrame, k: int = 10) -> DataFrame:
    """(case_id, found, reciprocal): whether the expected key is among the first k results, and one over its rank.

    cases(case_id, expected), results(case_id, rank, key).
    """
    hit = results.filter(F.col("rank") <= k).join(cases, "case_id").filter(F.col("key") == F.col("expected")).groupBy("case_id").agg(F.min("rank").alias("rank"))
    return cases.join(hit, "case_id", "left").select("case_id", F.col("rank").isNotNull().alias("found"), F.coalesce(1 / F.col("rank"), F.lit(0.0)).alias("reciprocal"))
