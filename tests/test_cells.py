"""Blocks of vectors: nothing is lost where blocks are ruled out, and little is read where the vectors have clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import cells, search, shared, vector_index

SCHEMA = "vec_id long, embedding array<float>"


def clustered(clusters=40, each=50, size=16, spread=0.05, seed=1):
    """Tight clusters far from each other, one of a third of all rows, and copies."""
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 1, (clusters, size))
    rows = np.concatenate([m + rng.normal(0, spread, (each if i else each * clusters // 2, size)) for i, m in enumerate(middles)]).astype(np.float32)
    rows[-30:] = rows[5]
    return rows[np.random.default_rng(2).permutation(len(rows))]


@pytest.fixture(scope="module")
def rows():
    return clustered()


@pytest.fixture(scope="module")
def frame(spark, rows):
    odd = [(90_000, None), (90_001, []), (90_002, [0.0] * 16), (90_003, [1.0, 2.0]), (90_004, [1.0, 2.0]), (None, [1.0] * 16)]
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)] + odd, SCHEMA).repartition(4)


def test_blocks(spark, frame, rows):
    """Every row is in one block, blocks are bounded, and their circles hold their rows."""
    made = cells.blocks(frame, most=64).collect()
    ids = [i for b in made for i in np.frombuffer(b["ids"], np.int64)]
    assert sorted(ids) == [*range(len(rows)), 90_002, 90_003, 90_004] and max(b["n"] for b in made) <= 64
    for b in made:
        values = np.frombuffer(b["values"]).reshape(b["n"], b["size"])
        assert np.linalg.norm(values - np.array(b["centre"]), axis=1).max() <= b["radius"]
    assert 90_002 not in [i for b in cells.blocks(frame, True).collect() for i in np.frombuffer(b["ids"], np.int64)]


def test_sample(spark, frame, monkeypatch):
    """The rows of lowest hash, also where few keys repeat; no sorted limit is collected, for which every task sends its own to the driver."""
    given = frame.filter("vec_id is not null").select("vec_id", "embedding", F.size("embedding").alias("size"))
    kind, plans = type(given), []
    whole = kind.toPandas
    monkeypatch.setattr(kind, "toPandas", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or whole(df))
    monkeypatch.setattr(cells, "SAMPLE", 100)
    assert cells.fit(given.filter("size = 16"), 64).keys() == {16}
    assert plans and not any("TakeOrdered" in p for p in plans)
    for rows, n in ((given, given.count()), (given.withColumn("vec_id", F.col("vec_id") % 3), given.count()), (given.limit(5), 5), (given.limit(0), 0)):
        hashed = sorted(tuple(r) for r in rows.select(F.xxhash64("vec_id"), "vec_id").collect())
        assert cells.sampled(rows.select("vec_id"), "vec_id", n, 100)["vec_id"].tolist() == [i for _, i in hashed[:100]]


def test_components_broadcast_nothing(spark, monkeypatch):
    plans, kept = [], search.written
    monkeypatch.setattr(search, "written", lambda df, tag: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, tag))
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 10 != 9], "a long, b long")
    assert {(r["node"], r["root"]) for r in search.components(edges).collect()} == {(i, i // 10 * 10) for i in range(40)}
    assert not any("Broadcast" in p for p in plans) and any("SortMergeJoin" in p for p in plans)


def test_pairs_are_ruled_out(spark, frame, rows, monkeypatch):
    """Classes and earlier duplicates are those of all pairs, from a small part of the pairs of blocks."""
    u = cells.unit(rows.astype(float))
    hit = u @ u.T >= 0.9 - 1e-12
    np.fill_diagonal(hit, False)
    label = np.arange(len(rows))
    while True:
        new = np.array([min(label[i], label[h].min()) if h.any() else label[i] for i, h in enumerate(hit)])
        if (new == label).all():
            break
        label = new
    seen = []
    met = cells.met
    monkeypatch.setattr(cells, "met", lambda found, *a: (seen.append(found), met(found, *a))[1])
    got = {r["vec_id"]: (r["class_id"], r["links"]) for r in search.similar_classes(frame.filter("vec_id IS NOT NULL"), 0.9, 64).collect()}
    assert {i: got[i] for i in range(len(rows))} == {i: (label[i], int(hit[i].sum())) for i in range(len(rows))}
    assert all(got[i] == (i, 0) for i in (90_000, 90_001, 90_002)) and got[90_003] == got[90_004] == (90_003, 1)
    first = {j: int(np.flatnonzero(hit[j, :j])[0]) for j in range(len(rows)) if hit[j, :j].any()} | {90_004: 90_003}
    assert {r["vec_id"]: r["first_id"] for r in search.earlier_duplicates(frame, 0.9, block=64).collect()} == first
    n = -(-len(rows) // 64)
    made = cells.blocks(frame, True, 64).count()
    assert made < 3 * n
    about = shared.written(cells.summaries(cells.blocks(frame, True, 64)))
    kept = cells.pairs(about, about, search.reach(0.9), once=True).count()
    assert kept < 0.4 * made * (made + 1) / 2


def plain_nearest(rows, q, k):
    d = ((rows.astype(float) - rows[q].astype(float)) ** 2).sum(1)
    return [int(i) for i in np.lexsort((np.arange(len(rows)), d))[:k]]


@pytest.mark.parametrize("most", [64, 100_000])
def test_nearest_is_exact(spark, frame, rows, most):
    queries = frame.filter("vec_id % 20 = 0")
    got = search.nearest_many(frame, queries, 7, most).filter("query_id < 90000").orderBy("query_id", "rank").collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert found == {q: plain_nearest(rows, q, 7) for q in range(0, len(rows), 20)}


def test_stored_index(spark, frame, rows, tmp_path, monkeypatch):
    """One query reads few of the stored files and finds the k nearest; probes find nine in ten at least and read less."""
    path = f"file://{tmp_path}/index"
    vector_index.save_cells(frame, path, 64)
    files = spark.read.parquet(f"{path}/blocks").select("_metadata.file_path").distinct().count()
    read = []
    needed = vector_index.needed
    monkeypatch.setattr(vector_index, "needed", lambda *a: (read.append(needed(*a)), read[-1])[1])
    out = vector_index.search_cells(spark, path, frame.filter("vec_id = 20"), 7).orderBy("rank").collect()
    assert [r["vec_id"] for r in out] == plain_nearest(rows, 20, 7)
    touched = {r[0] for df in read for r in df.select("_metadata.file_path").distinct().collect()}
    assert 0 < len(touched) < 0.5 * files
    wanted = {q: set(plain_nearest(rows, q, 7)) for q in range(0, len(rows), 20)}
    some = vector_index.search_cells(spark, path, frame.filter("vec_id % 20 = 0 AND vec_id < 90000"), 7, probes=4, block=64).collect()
    recall = sum(r["vec_id"] in wanted[r["query_id"]] for r in some) / (7 * len(wanted))
    assert recall >= 0.9


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert search.similar_classes(none).count() == search.earlier_duplicates(none).count() == search.nearest_many(none, none, 3).count() == 0
    one = spark.createDataFrame([(1, [1.0, 0.0])], SCHEMA)
    assert [tuple(r)[:3] for r in search.nearest_many(one, one, 3).collect()] == [(1, 1, 1)]
