"""Temperature mixing of sources, with DataFrame functions only.

A source's share of all tokens is raised to an exponent between 0 (all sources alike) and 1 (as they are) and
normalised. The exponent is bisected so that the weights just meet an entropy target or a repetition limit. The weights
times a token budget say how often each source is passed. Every pass is a permutation of the source by a seeded hash;
the last, partial one takes whole hash blocks while they fit into the budget, then documents of the next block.
"""

from __future__ import annotations

from math import ceil, log, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import delete, join_small, materialise

SEED = 17
#: Hash bits that name a block, at least and at most: about half the bits of the largest source's rows, so that the window
#: over a source's blocks and the one over its edge block are both as short as they can be (n rows: about the root of n).
BLOCK_BITS = (10, 24)
#: Points tried at once: one step is six bisections.
POINTS, STEPS = 63, 4
REPETITION = 1.5
WORD = r"[^\x20\x09-\x0D]+"


def tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_key(source: Column) -> Column:
    """Null sources are one source of their own."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def block_bits(rows: int) -> int:
    least, most = BLOCK_BITS
    return min(most, max(least, ceil(log2(max(rows, 2)) / 2)))


def exponent(totals: DataFrame, repetition: float | None = REPETITION, entropy: float | None = None) -> float:
    """Bisect. repetition: the smallest exponent at which no source is passed more than so many times as often as the
    least passed one. entropy: the largest at which the weights have this part of the greatest entropy, ln(sources)."""
    whole = totals.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()[0]
    if not whole["t"] or whole["n"] < 2:
        return 1.0
    shares = totals.select((F.col("tokens") / F.lit(float(whole["t"]))).alias("p"))
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        step = (high - low) / (POINTS + 1)
        grid = F.explode(F.array(*(F.lit(low + step * i) for i in range(POINTS + 2)))).alias("x")
        q = F.pow("p", "x")
        tried = shares.select("p", grid).groupBy("x").agg((F.log(F.sum(q)) - F.sum(q * F.log(q)) / F.sum(q)).alias("h"), (F.max(q / F.col("p")) / F.min(q / F.col("p"))).alias("r")).orderBy("x").collect()
        if repetition is not None:
            good = [i for i, t in enumerate(tried) if t["r"] <= repetition * (1 + 1e-12)]
            at = good[0] if good else len(tried) - 1
            if at == 0:
                return tried[0]["x"]
            low, high = tried[at - 1]["x"], tried[at]["x"]
        else:
            good = [i for i, t in enumerate(tried) if t["h"] >= entropy * log(whole["n"])]
            at = good[-1] if good else 0
            if at == len(tried) - 1 or not good:
                return tried[at]["x"]
            low, high = tried[at]["x"], tried[at + 1]["x"]
    return high if repetition is not None else low


def permuted(turn: Column, seed: int) -> Column:
    """A document's place in the source's permutation of that pass, over all longs."""
    return F.xxhash64(F.lit(seed), turn, F.col("id"))


def mix(docs: DataFrame, source: str = "source", budget: int | None = None, repetition: float | None = REPETITION, entropy: float | None = None, seed: int = SEED) -> DataFrame:
    """All columns of docs, a row per document and pass, with copy (the pass, from 0), n_tokens, weight and position.

    A token is a word between ASCII white space, not a tokenizer's: DataFrame functions can count those.
    position in [0, 1) orders the mix: in any stretch of it the sources have their weights. budget (tokens): by default
    the least that passes every document at least once. A source without a token is passed once, with weight 0. Null
    text: empty; null sources are one source; equal rows (ties) are permuted alike; a very long document is passed whole, or
    left out of a last pass that it doesn't fit; columns named like the new ones are replaced, other names can't clash; an
    empty table gives no rows.
    """
    own = [c for c in docs.columns if c not in ("copy", "n_tokens", "weight", "position")]
    given = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("own"), source_key(F.col(f"`{source}`")).alias("key"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("id"), tokens(F.col("text")).alias("n_tokens"))
    slim, slim_path = materialise(given.select("key", "id", "n_tokens"), "mix")
    totals, _ = materialise(slim.groupBy("key").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")), "totals")
    bits = block_bits(totals.agg(F.max("rows")).first()[0] or 0)
    live = totals.filter("tokens > 0")
    x = exponent(live, repetition, entropy)
    whole = live.agg(F.sum("tokens").alias("t")).collect()[0]["t"] or 0
    share = F.col("tokens") / F.lit(float(whole or 1))
    z = live.agg(F.sum(F.pow(share, F.lit(x))).alias("z"), F.max(share / F.pow(share, F.lit(x))).alias("most")).collect()[0]
    weight = F.pow(share, F.lit(x)) / F.lit(z["z"] or 1.0)
    tokens_in_all = float(budget) if budget is not None else whole * (z["most"] or 1.0) * (z["z"] or 1.0)
    passes = F.when(F.col("tokens") > 0, weight * tokens_in_all / F.col("tokens")).otherwise(1.0)
    # an all but whole number of passes is whole: nothing is left out for a rounding error
    plan = totals.select("key", "tokens", F.when(F.col("tokens") > 0, weight).otherwise(0.0).alias("weight"), F.when(F.abs(passes - F.round(passes)) < 1e-9, F.round(passes)).otherwise(passes).alias("passes"))
    plan, _ = materialise(plan.withColumn("full", F.floor("passes")), "plan")

    last = join_small(slim, plan, "key").filter("passes > full")
    last = last.select("key", "n_tokens", permuted(F.col("full"), seed).alias("h"), ((F.col("passes") - F.col("full")) * F.col("tokens")).alias("room"))
    block = F.shiftright("h", 64 - bits)
    in_source = Window.partitionBy("key").orderBy("block")
    blocks = last.groupBy("key", block.alias("block"), "room").agg(F.sum("n_tokens").alias("t"))
    edge = blocks.withColumn("upto", F.sum("t").over(in_source)).filter("upto > room and upto - t <= room").select("key", "block", (F.col("room") - F.col("upto") + F.col("t")).alias("rest"))
    edge, _ = materialise(edge, "edge")
    inside = join_small(last.withColumn("block", block), edge, ["key", "block"], "inner")
    inside = inside.withColumn("upto", F.sum("n_tokens").over(Window.partitionBy("key").orderBy("h"))).filter("upto <= rest").groupBy("key").agg(F.max("h").alias("h"))
    cut = edge.join(inside, "key", "left").select("key", F.coalesce("h", F.try_subtract(F.shiftleft("block", 64 - bits), F.lit(1).cast("long"))).alias("cut"), F.lit(True).alias("edged"))
    plan, _ = materialise(plan.join(cut, "key", "left"), "plan")
    delete(docs.sparkSession, slim_path)

    joined = join_small(given, plan.select("key", "weight", "passes", "full", "cut", "edged"), "key")
    # a null cut of an edge: not even the first document of the first block fits
    extra = F.when((F.col("passes") > F.col("full")) & (F.col("edged").isNull() | (permuted(F.col("full"), seed) <= F.col("cut"))), 1).otherwise(0)
    n = (F.col("full") + extra).cast("int")
    each = joined.filter(n > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), n - 1)))
    unit = lambda h: h / F.lit(2.0**64) + 0.5
    within = unit(permuted(F.col("copy").cast("long"), seed))
    partial = within / F.greatest(unit(F.coalesce("cut", F.lit((1 << 63) - 1))), F.lit(2.0**-64)) * (F.col("passes") - F.col("full"))
    place = F.least((F.col("copy") + F.when(F.col("copy") == F.col("full"), partial).otherwise(within)) / F.col("passes"), F.lit(1 - 2.0**-53))
    return each.withColumn("position", place).select("own.*", "copy", "n_tokens", "weight", "position")
