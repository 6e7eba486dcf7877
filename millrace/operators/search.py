"""Retrieval: term statistics, BM25, nearest vectors, score fusion, question answering."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from . import cells
from .shared import drop, written

K1, B = 1.5, 0.75


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """tf per document and term: a token counts 1, an identifier 2 more. Each text is parsed once and counted where it lies; rows of one key are summed."""
    each = docs.select(key, T.term_counts(F.col(text)).alias("c")).select(key, F.explode("c.terms").alias("x"))
    return each.groupBy(key, F.col("x.term").alias("term")).agg(F.sum("x.n").cast("double").alias("tf"))


def document_frequency(docs: DataFrame, text: str) -> DataFrame:
    """Documents (rows) that hold each token or identifier: distinct inside a row, so only terms are shuffled, summed before."""
    found = docs.select(T.term_counts(F.col(text)).alias("c")).select(F.explode("c.terms.term").alias("term"))
    return found.groupBy("term").agg(F.count("*").alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


#: What a match at or under the least score counts in a filtered search.
FILTERED_SCORE = 0.12


def bm25(docs: DataFrame, key: str, text: str, terms: list[str], least: float = 0.1, filtered: bool = False) -> DataFrame:
    """Scores above `least` of the rows of docs; filtered (docs are what a filter left): other rows with a term count FILTERED_SCORE. A row's terms are counted inside it, in one scan; those few numbers are written, and statistics
    and scores come from them."""
    parsed = docs.select(key, T.term_counts(F.col(text), terms).alias("c"))
    count = lambda term: F.coalesce(F.get(F.filter("c.terms", lambda x: x["term"] == term), 0)["n"], F.lit(0)).cast("double")
    rows = parsed.select(key, (F.col("c.words") + 2.0 * F.col("c.names")).alias("len"), (F.col("c.words") + 3.0 * F.col("c.names")).alias("weight"), *(count(t).alias(f"tf{k}") for k, t in enumerate(terms)))
    rows = written(rows, "counts")
    whole = rows.agg(F.count("*").alias("n"), F.avg("weight").alias("avg"), *(F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(terms))))
    scored = rows.join(F.broadcast(whole))  # one row
    part = lambda tf, df: idf(F.col("n"), df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    score = sum((F.when(F.col(f"tf{k}") > 0, part(F.col(f"tf{k}"), F.col(f"df{k}"))).otherwise(0.0) for k in range(len(terms))), F.lit(0.0))
    if filtered:
        some = sum((F.col(f"tf{k}") for k in range(len(terms))), F.lit(0.0)) > 0
        return scored.filter(some).select(key, F.when(score > least, score).otherwise(FILTERED_SCORE).alias("score"))
    return scored.select(key, score.alias("score")).filter(F.col("score") > least)


def nearest(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k nearest by squared distance; vectors of another length are skipped."""
    near = vectors.filter(F.size("embedding") == len(query)).withColumn("distance", V.squared_distance(F.col("embedding"), V.vector(query)))
    return near.orderBy("distance", "vec_id").limit(k).select("vec_id", F.round("distance", 4).alias("distance"), F.round(V.score_of(F.col("distance")), 6).alias("score"))


def earlier_duplicates(vectors: DataFrame, least: float = 0.85, asked: DataFrame | None = None, block: int | None = None) -> DataFrame:
    """For each asked row (all rows by default) the smallest smaller id whose cosine is `least` or more; vec_id, first_id.

    Only pairs of blocks meet whose centres and radii leave room for such a cosine; a pair gives one row an asked one at most.
    """
    import pandas as pd

    def first(a, b):
        lowest = np.full(len(a.ids), np.iinfo(np.int64).max)
        for i, j in cells.above(a, b, least):
            np.minimum.at(lowest, i, b.ids[j])
        some = lowest < a.ids
        yield pd.DataFrame({"vec_id": a.ids[some], "first_id": lowest[some]})

    made = written(cells.blocks(vectors, True, block), "blocks")
    left = made if asked is None else written(cells.blocks(asked, True, block), "blocks")
    found = cells.met(cells.pairs(cells.summaries(left), cells.summaries(made), reach(least)), left, made, first, "vec_id long, first_id long")
    return found.groupBy("vec_id").agg(F.min("first_id").alias("first_id"))


def reach(least: float) -> float:
    """Distance within which vectors of length one have this cosine."""
    return float(np.sqrt(max(0.0, 2 - 2 * least)))


def components(edges: DataFrame) -> DataFrame:
    """From edges (a, b): node and root (the smallest node of its component) of every node; each round halves the way to it at least.

    Its joins are merge joins: a table of roots that is just small enough to be broadcast would go through the driver several times a round."""
    both = written(edges.union(edges.select("b", "a")).distinct(), "edges")
    state = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "roots")
    while True:
        near = both.join(state.select(F.col("node").alias("b"), "root").hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        lower = state.join(near.hint("merge"), "node").select("node", F.col("root").alias("old"), F.least("root", "low").alias("root"))
        jump = lower.select(F.col("node").alias("root"), F.col("root").alias("low"))
        following = written(lower.join(jump.hint("merge"), "root", "left").select("node", "old", F.coalesce("low", "root").alias("root")), "roots")
        drop(state)
        if not following.filter("old <> root").limit(1).count():
            drop(both)
            return following.select("node", "root")
        state = following


def similar_classes(vectors: DataFrame, least: float = 0.85, block: int | None = None) -> DataFrame:
    """vec_id, class_id (smallest id reachable over cosines of `least` or more) and links (such rows besides itself), for every row.

    Pairs of blocks that can't hold such a cosine are ruled out by their centres and radii; each other pair is a matrix product in a task,
    of which only counts and a spanning forest leave. Ids are unique; null, empty and zero vectors link to nothing. Exact: where the vectors
    have no clusters, nothing can be ruled out, and time grows with the square of the rows.
    """
    import pandas as pd

    def links(a, b):
        same = a.number == b.number
        shift = 0 if same else len(a.ids)
        ids = a.ids if same else np.concatenate((a.ids, b.ids))
        n, label = np.zeros(len(ids), int), np.arange(len(ids))
        for i, j in cells.above(a, b, least):
            if same:
                i, j = i[i != j], j[i != j]
            n += np.bincount(i, minlength=len(ids))
            if not same:
                n += np.bincount(j + shift, minlength=len(ids))
            cells.united(label, i, j + shift)
        some, joined = n > 0, label != np.arange(len(ids))
        yield pd.DataFrame({"a": [*ids[some], *ids[joined]], "b": [*ids[some], *ids[label[joined]]], "links": [*n[some], *np.zeros(joined.sum(), int)]})

    made = written(cells.blocks(vectors, True, block), "blocks")
    about = cells.summaries(made)
    found = written(cells.met(cells.pairs(about, about, reach(least), once=True), made, made, links, "a long, b long, links long"), "links")
    counts = found.filter("links > 0").groupBy(F.col("a").alias("vec_id")).agg(F.sum("links").alias("links"))
    roots = components(found.filter("links = 0").select("a", "b"))
    out = vectors.select("vec_id").join(counts.hint("merge"), "vec_id", "left").join(roots.hint("merge"), F.col("vec_id") == F.col("node"), "left")
    drop(made)
    return out.select("vec_id", F.coalesce("root", "vec_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def nearest_many(vectors: DataFrame, queries: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """query_id, vec_id, rank, distance and score of the k nearest of each query (vec_id, embedding), by squared distance, then vec_id.

    Each block of queries meets the blocks nearest to it, then those that may hold something nearer than the k found there.
    """
    left, right = (written(cells.blocks(df, most=block), "blocks") for df in (queries, vectors))
    found = cells.ranked(cells.nearest(left, right, cells.summaries(right), k), k)
    return found.select("query_id", "vec_id", "rank", F.round("distance", 4).alias("distance"), F.round(V.score_of(F.col("distance")), 6).alias("score"))


def fused(vector: DataFrame, text: DataFrame, key: str, shares: tuple[float, float] = (0.6, 0.4), least: float = 0.1) -> DataFrame:
    """Both scores over their maximum, weighted; a document may be on one side only."""
    top = lambda df: df.agg(F.max("score").alias("most"))
    side = lambda df, name: df.join(F.broadcast(top(df))).select(key, F.when(F.col("most") > 0, F.col("score") / F.col("most")).otherwise(0.0).alias(name))
    both = side(vector, "v").join(side(text, "t"), key, "full")
    score = shares[0] * F.coalesce("v", F.lit(0.0)) + shares[1] * F.coalesce("t", F.lit(0.0))
    return both.select(key, score.alias("score")).filter(F.col("score") >= least)


def best_of(variants: list[tuple[DataFrame, float]], key: str) -> DataFrame:
    """Union of query variants with their weights; the best score of each key stays."""
    out = None
    for df, weight in variants:
        part = df.select(key, (F.col("score") * weight).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(key).agg(F.max("score").alias("score"))


def answer_score(question: Column, answer: Column, query: str, rank: Column, aliases: Column | None = None) -> Column:
    """By rank, at least 0.88 if the answer has the query, 0.94 if an alias has, 1 if the question has."""
    base = F.greatest(F.lit(0.35), 0.98 - 0.04 * rank)
    has = lambda c: F.contains(F.lower(c), F.lit(query.lower()))
    scored = F.when(has(answer), F.greatest(base, F.lit(0.88))).otherwise(base)
    if aliases is not None:
        scored = F.when(F.coalesce(F.exists(aliases, has), F.lit(False)), F.greatest(scored, F.lit(0.94))).otherwise(scored)
    return F.when(has(question), 1.0).otherwise(scored)
