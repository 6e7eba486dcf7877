"""Question and answer pairs: from JSON and back, looked up by question or alias, as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAIR = "id string, question string, answer string, category string, aliases array<string>, tags array<string>, metadata map<string,string>"


def load(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Pairs from JSON files, each an array (or lines: a pair a line, as dump() writes); the category is general where none is named."""
    given = spark.read.schema(PAIR).option("multiLine", not lines).json(path)
    nothing = F.array().cast("array<string>")
    filled = {"category": F.coalesce(F.nullif("category", F.lit("")), F.lit("general")), "aliases": F.coalesce("aliases", nothing), "tags": F.coalesce("tags", nothing)}
    return given.withColumns(filled)


def dump(pairs: DataFrame, path: str) -> None:
    pairs.select(*(x.split(" ")[0] for x in PAIR.replace("map<string,string>", "map").split(", "))).write.mode("overwrite").json(path)


def lookup(pairs: DataFrame, questions: DataFrame) -> DataFrame:
    """Each question (column question) with the pair whose question or alias it is, in any case; the pair with the least id if there are several."""
    spoken = pairs.select(F.col("id"), F.explode(F.array_distinct(F.transform(F.concat(F.array("question"), "aliases"), lambda s: F.lower(s)))).alias("key"))
    first = spoken.groupBy("key").agg(F.min("id").alias("id"))
    found = questions.withColumn("key", F.lower("question")).join(first, "key", "left").drop("key")
    return found.join(pairs.select("id", "answer", "category"), "id", "left").select("question", "id", "answer", "category")


def as_documents(pairs: DataFrame, labels: tuple[str, str] = ("Question: ", "Answer: ")) -> DataFrame:
    """(path, content, type, language, metadata) of each pair; aliases and tags are lists with commas in the metadata."""
    listed = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ", ")
    own = F.map_filter(F.create_map(F.lit("qa_id"), "id", F.lit("category"), F.coalesce("category", F.lit("general")), F.lit("aliases"), listed("aliases"), F.lit("tags"), listed("tags")), lambda k, v: v != "")
    more = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("qa_id", "category", "aliases", "tags"))
    content = F.concat(F.lit(labels[0]), "question", F.lit("\n\n" + labels[1]), "answer")
    return pairs.select(F.concat(F.lit("qa://"), "id").alias("path"), content.alias("content"), F.lit("qa_pair").alias("type"), F.lit("text").alias("language"), F.map_concat(own, more).alias("metadata"))


def listed(pairs: DataFrame, category: str = "", tag: str = "", text: str = "", skip: int = 0, most: int = 50) -> DataFrame:
    """A page of pairs by id, with total and has_more: of the category, with the tag in any case, and the text somewhere in id, question, answer or category."""
    from ..operators.retrieval import page_of

    if category:
        pairs = pairs.filter(F.col("category") == category)
    if tag:
        pairs = pairs.filter(F.exists("tags", lambda t: F.lower(t) == tag.lower()))
    if text:
        pairs = pairs.filter(F.contains(F.lower(F.concat_ws(" ", "id", "question", "answer", "category")), F.lit(text.lower())))
    return page_of(pairs, ["id"], skip, most)
