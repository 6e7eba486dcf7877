"""Vectors in blocks of near ones, and jobs over the pairs of blocks that may meet.

Rows are assigned to the nearest of some centres (k-means on a bounded sample; every row is then assigned), and lie with
others of their cell in blocks of bounded bytes, each with its own centre and radius. By the triangle inequality no two
vectors of two blocks are nearer than their centres' distance less both radii: pairs of blocks beyond a limit are ruled
out from that row a block, before any vector is moved. The pairs that stay are dealt out by number; a task streams
the partners of one block past it and holds two blocks at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop, written

#: Rows to fit centres on and centres at most (documented bounds; the rows of all sizes are assigned), bytes of a block's vectors,
#: partners of a block that go to one task, summaries that a task compares with at a time.
SAMPLE, CENTRES, BLOCK_BYTES, PARTNERS, SLAB = 16_384, 256, 4 << 20, 8, 50_000
BLOCKS = "block long, size int, cell int, n int, ids binary, values binary, centre array<double>, radius double"


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T))


def unit(values: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(values, axis=1, keepdims=True)
    return np.divide(values, n, out=np.zeros_like(values), where=n > 0)


def centres(rows: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means from rows spread by number; empty cells keep their place."""
    at = rows[np.linspace(0, len(rows) - 1, k).astype(int)].copy()
    for _ in range(rounds if k > 1 else 1):
        of = distances(rows, at).argmin(1)
        for j in range(k):
            if (of == j).any():
                at[j] = rows[of == j].mean(0)
    return at


def block_rows(size: int, most: int | None = None) -> int:
    return max(1, min(most or 1 << 30, BLOCK_BYTES // (8 * size)))


def sampled(rows: DataFrame, key: str, n: int, most: int) -> pd.DataFrame:
    """Of n rows the `most` with the lowest hashes of their key, in that order.

    They are taken among rows under a hash that some more than `most` are expected to have, so what moves doesn't grow with the number of tasks:
    a sorted limit that is collected takes `most` rows of every task to the driver. Where keys repeat too few may be under it; then all rows are sorted.
    """
    hashed = rows.withColumn("hash", F.xxhash64(key))
    under = min((1 << 63) - 1, int(1.25 * most * (1 << 64)) // max(n, 1) - (1 << 63))
    first = lambda df: written(df.orderBy("hash", key).limit(most), "sample")
    made = first(hashed.filter(F.col("hash") <= under))
    if made.count() < min(n, most):
        drop(made)
        made = first(hashed)
    found = made.toPandas().sort_values(["hash", key], kind="stable", ignore_index=True).drop(columns="hash")
    drop(made)
    return found


def fit(given: DataFrame, most: int | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Centres by vector length, with the tasks that each cell is dealt to; from SAMPLE rows by the hash of their ids."""
    counts = written(given.groupBy("size").agg(F.count("*").alias("n")), "sizes")
    sizes = {r["size"]: r["n"] for r in counts.orderBy(F.desc("n")).limit(1000).collect()}
    sample = sampled(given, "vec_id", counts.agg(F.sum("n")).first()[0] or 0, SAMPLE)
    drop(counts)
    out = {}
    for size, n in sizes.items():
        rows = sample.loc[sample["size"] == size, "embedding"]
        if len(rows):
            values = np.stack(rows.to_numpy()).astype(float)
            k = int(min(CENTRES, len(values), max(1, n // block_rows(size, most))))
            at = centres(values, k)
            share = np.bincount(distances(values, at).argmin(1), minlength=k) / len(values)
            out[size] = (at, np.maximum(1, np.ceil(share * n / (4 * block_rows(size, most)))).astype(int))
    return out


def blocks(vectors: DataFrame, normal: bool = False, most: int | None = None) -> DataFrame:
    """BLOCKS of vectors (vec_id, embedding): null and empty ones and those without an id are left out, and zero ones if normal, which brings
    all to length one.

    Lengths beyond the thousand commonest, and those of which the sample has none, have one cell. A block has at most `most` rows and
    BLOCK_BYTES; a cell of many rows is dealt to several tasks by the hash of the ids.
    """
    given = vectors.filter((F.size("embedding") > 0) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("size"))
    if normal:
        length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
        given = given.withColumn("length", length).filter("length > 0").select("vec_id", F.transform("embedding", lambda x: x / F.col("length")).alias("embedding"), "size")
    fitted = given.sparkSession.sparkContext.broadcast(fit(given, most))

    def assign(batches):
        for pdf in batches:
            cell, deal = np.zeros(len(pdf), np.int32), np.zeros(len(pdf), np.int64)
            for size, at in pdf.groupby("size").indices.items():
                if size in fitted.value:
                    where, spread = fitted.value[size]
                    cell[at] = distances(np.stack(pdf["embedding"].to_numpy()[at]), where).argmin(1)
                    deal[at] = pdf["vec_id"].to_numpy()[at] * 2654435761 % 2**32 * spread[cell[at]] >> 32
            yield pdf.assign(cell=cell, deal=deal)

    def pack(batches):
        held: list[tuple[int, np.ndarray]] = []
        at, number = None, 0

        def block(size, cell):
            nonlocal number
            ids, values = np.array([i for i, _ in held], np.int64), np.stack([v for _, v in held]).astype(float)
            order = np.argsort(ids)
            middle = values.mean(0)
            radius = float(np.sqrt(((values - middle) ** 2).sum(1).max())) * (1 + 1e-9) + 1e-9
            number += 1
            held.clear()
            return pd.DataFrame({"block": [number], "size": [size], "cell": [cell], "n": [len(ids)], "ids": [ids[order].tobytes()], "values": [values[order].tobytes()], "centre": [middle], "radius": [radius]})

        for pdf in batches:
            for i, v, size, cell in zip(pdf["vec_id"], pdf["embedding"], pdf["size"], pdf["cell"]):
                if held and ((size, cell) != at or len(held) >= block_rows(at[0], most)):
                    yield block(*at)
                at = (size, cell)
                held.append((i, v))
        if held:
            yield block(*at)

    assigned = given.mapInPandas(assign, "vec_id long, embedding array<double>, size int, cell int, deal long")
    made = assigned.repartition("size", "cell", "deal").sortWithinPartitions("size", "cell").drop("deal").mapInPandas(pack, BLOCKS)
    return made.withColumn("block", F.monotonically_increasing_id())  # unique once it is written


def summaries(made: DataFrame) -> DataFrame:
    return made.select("block", "size", "n", "centre", "radius")


def pairs(a: DataFrame, b: DataFrame, limit: float | None = None, once: bool = False) -> DataFrame:
    """(a, b): blocks of one length that may hold vectors within the limit: a's own column `limit` if it has one, else the given one (None: any).

    a and b are summaries; b comes to the tasks SLAB rows at a time. once: each pair in one order, and a block with itself.
    """
    spark, own = a.sparkSession, "limit" in a.columns
    b = written(b, "summaries")
    slabs = -(-b.count() // SLAB)
    out = None
    for s in range(max(1, slabs)):
        part = b.filter(F.pmod(F.xxhash64("block"), F.lit(slabs)) == s).toPandas() if slabs > 1 else b.toPandas()
        by = {size: (x["block"].to_numpy(), np.stack(x["centre"].to_numpy()), x["radius"].to_numpy()) for size, x in part.groupby("size")}
        known = spark.sparkContext.broadcast(by)

        def near(batches, known=known):
            for pdf in batches:
                for r in pdf.itertuples():
                    if r.size in known.value:
                        others, middles, radii = known.value[r.size]
                        gap = distances(np.asarray(r.centre)[None], middles)[0] - radii - r.radius
                        most = r.limit if own else limit
                        ok = np.ones(len(others), bool) if most is None else gap <= most + 1e-6
                        if once:  # half of a block's partners come to it, it goes to the others
                            ok &= np.where((others + r.block) % 2 == 0, others >= r.block, others <= r.block)
                        yield pd.DataFrame({"a": r.block, "b": others[ok]})

        columns = ["block", "size", "centre", "radius"] + (["limit"] if own else [])
        found = a.select(*columns).mapInPandas(near, "a long, b long")
        out = found if out is None else out.unionByName(found)
    return out


class Block:
    def __init__(self, number: int, ids: bytes, values: bytes, n: int):
        self.number, self.ids = number, np.frombuffer(ids, np.int64)
        self.values = np.frombuffer(values).reshape(n, -1)
        self._single = None

    @property
    def single(self) -> np.ndarray:
        """The values in single precision: products in it choose candidates, which are then decided in double."""
        if self._single is None:
            self._single = self.values.astype(np.float32)
        return self._single


def met(found: DataFrame, left: DataFrame, right: DataFrame, fn: Callable[[Block, Block], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """fn(block of left, block of right) of each pair (a, b). A block's partners stream past it, PARTNERS to a task."""
    dealt = written(found, "pairs")
    spread = F.pmod(F.xxhash64("b"), F.greatest(F.lit(1), F.ceil(F.col("n") / PARTNERS)).cast("long"))
    counts = dealt.groupBy("a").agg(F.count("*").alias("n"))
    grouped = written(dealt.join(counts, "a").select("a", "b", spread.alias("part")), "pairs")
    tasks = grouped.select("a", "part").distinct()
    heads = tasks.join(left.select(F.col("block").alias("a"), "n", "ids", "values"), "a").select("a", "part", F.lit(0).alias("kind"), F.col("a").alias("b"), "n", "ids", "values")
    tails = grouped.join(right.select(F.col("block").alias("b"), "n", "ids", "values"), "b").select("a", "part", F.lit(1).alias("kind"), "b", "n", "ids", "values")

    def run(batches):
        head = None
        for pdf in batches:
            for r in pdf.itertuples():
                here = Block(r.b, r.ids, r.values, r.n)
                if r.kind == 0:
                    head = here
                else:
                    yield from fn(head, here)

    n = min(20_000, max(1, tasks.count()))
    return heads.unionByName(tails).repartition(n, "a", "part").sortWithinPartitions("a", "part", "kind", "b").mapInPandas(run, schema)


def above(a: Block, b: Block, least: float, rows: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in a, in b) whose inner product is `least` or more, some rows of a at a time; what is close to it is decided in double."""
    margin = (a.values.shape[1] + 4) * 2.0**-23  # what single precision is off by at most, for vectors of length one
    for at in range(0, len(a.ids), rows):
        product = a.single[at : at + rows] @ b.single.T
        flat = np.flatnonzero(product.ravel() >= least - margin)
        i, j = np.divmod(flat, len(b.ids))
        near = np.flatnonzero(product.ravel()[flat] < least + margin)
        ok = np.ones(len(flat), bool)
        for s in range(0, len(near), 1 << 16):
            k = near[s : s + (1 << 16)]
            ok[k] = np.einsum("ij,ij->i", a.values[at + i[k]], b.values[j[k]]) >= least - 1e-12
        yield at + i[ok], j[ok]


def united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of a[i] and b[i]; label is each place's smallest known one."""
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]


def homes(left: DataFrame, right: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """(a, b): for each block of left the nearest of right (a summary) that hold k rows together; or, with probes, each of its rows' `probes` nearest."""
    about = right.select("block", "size", "n", "centre")
    blocks_ = about.count()
    part = about.toPandas() if blocks_ <= SLAB else sampled(about, "block", blocks_, SLAB)
    by = {size: (x["block"].to_numpy(), np.stack(x["centre"].to_numpy()), x["n"].to_numpy()) for size, x in part.groupby("size")}
    known = left.sparkSession.sparkContext.broadcast(by)

    def near(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                if r.size in known.value:
                    others, middles, sizes = known.value[r.size]
                    if probes is None:
                        order = np.argsort(distances(np.asarray(r.centre)[None], middles)[0], kind="stable")
                        chosen = order[: int(np.searchsorted(np.cumsum(sizes[order]), k)) + 1]
                    else:
                        far = distances(np.frombuffer(r.values).reshape(r.n, -1), middles)
                        chosen = np.unique(np.argpartition(far, min(probes, len(others)) - 1, axis=1)[:, :probes])
                    yield pd.DataFrame({"a": r.block, "b": others[chosen]})

    return left.select("block", "size", "n", "centre", *(["values"] if probes is not None else [])).mapInPandas(near, "a long, b long")


def tops(k: int):
    """For met(): block, query_id, vec_id and squared distance of the k nearest of each query of the first block in the second."""

    def best(a: Block, b: Block, rows: int = 512) -> Iterator[pd.DataFrame]:
        q, v, d = [], [], []
        length = (b.values**2).sum(1)
        for at in range(0, len(a.ids), rows):
            values = a.values[at : at + rows]
            about = (values**2).sum(1)[:, None] + length[None, :] - 2 * values @ b.values.T
            slack = 1e-9 * (1 + (values**2).sum(1) + length.max())
            limit = np.partition(about, min(k, len(b.ids)) - 1, axis=1)[:, min(k, len(b.ids)) - 1] + slack
            for i, x in enumerate(values):
                near = np.flatnonzero(about[i] <= limit[i])
                exact = ((b.values[near] - x) ** 2).sum(1)  # the product only chooses: equal vectors must tie
                order = np.lexsort((b.ids[near], exact))[:k]
                q += [a.ids[at + i]] * len(order)
                v += b.ids[near][order].tolist()
                d += exact[order].tolist()
        yield pd.DataFrame({"block": a.number, "query_id": q, "vec_id": v, "distance": d})

    return best


TOPS = "block long, query_id long, vec_id long, distance double"


def nearest(left: DataFrame, right: DataFrame | None, about: DataFrame, k: int, probes: int | None = None, read: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """TOPS of left's blocks (written) in right's, with every row's k nearest among them; about: right's summaries.

    First each block meets the blocks nearest to it, which bounds the distance of its rows' k-th neighbour; then only blocks that may hold
    something nearer. With probes: each row's `probes` nearest blocks, no more. read(pairs) gives the blocks of right that the pairs need (default: all).
    """
    read = read or (lambda _: right)
    first = written(homes(left, about, k, probes), "pairs")
    found = written(met(first, left, read(first), tops(k), TOPS), "tops")
    if probes is not None:
        return found
    kth = found.groupBy("block", "query_id").agg(F.sort_array(F.collect_list("distance")).alias("d"))  # some k of the nearest blocks
    limit = kth.groupBy("block").agg(F.max(F.when(F.size("d") >= k, F.sqrt(F.col("d")[k - 1])).otherwise(float("inf"))).alias("limit"))
    more = written(pairs(summaries(left).join(limit, "block"), about).join(first, ["a", "b"], "left_anti"), "pairs")
    if not more.limit(1).count():
        return found
    return found.unionByName(met(more, left, read(more), tops(k), TOPS))


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, rank, distance (squared): the k nearest of each query, equal ones by id."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return found.select("query_id", "vec_id", "distance", rank.alias("rank")).filter(F.col("rank") <= k)
