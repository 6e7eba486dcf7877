"""Stored tables that change in part, exact ranks, counted ingestion, and databases that describe themselves."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import changes
from millrace.operators.keyed import PART, KeyedTable
from millrace.operators.selection import at_ranks
from millrace.plans.table import Table
from millrace.sources.jdbc import Database
from millrace.streaming import ingest

SCHEMA = "k long, v string, n int"


def files(table):
    return {r[0] for r in table._whole().select("_metadata.file_path").distinct().collect()}


def rows(df):
    return sorted((tuple(r) for r in df.select("k", "v", "n").collect()), key=repr)


@pytest.fixture
def table(spark, tmp_path):
    df = spark.createDataFrame([(i, f"v{i % 5}", i) for i in range(400)] + [(None, "none", 1)], SCHEMA).repartition(3)
    return KeyedTable.create(df, f"file://{tmp_path}/t", "k", 20), df


def test_untouched_files_stay(spark, table):
    table, old = table
    before = files(table)
    assert len(before) == 20 and rows(table.read()) == rows(old)
    new = spark.createDataFrame([(7, "new", 1), (7, "newer", 2), (9001, "more", 3)], SCHEMA)
    touched = table.upsert(new, "n")
    assert 1 <= len(touched) <= 2 and rows(table.read()) == rows(changes.upsert(old, new, "k", "n"))
    kept = {f for f in before if not any(f"{PART}={p}/" in f for p in touched)}
    assert len(kept) >= 18 and kept <= files(table)
    state, before = changes.upsert(old, new, "k", "n"), files(table)
    assert table.insert_ignore(new) == [] and files(table) == before
    assert len(table.insert_ignore(spark.createDataFrame([(8, "x", 0), (5000, "x", 0)], SCHEMA))) == 1
    state = changes.insert_ignore(state, spark.createDataFrame([(8, "x", 0), (5000, "x", 0)], SCHEMA), "k")
    assert rows(table.read()) == rows(state)
    assert len(table.update(F.col("k") == 11, {"v": F.lit("changed")})) == 1
    state = changes.update(state, F.col("k") == 11, {"v": F.lit("changed")})
    assert len(table.remove(F.col("k").isin(12, 13))) <= 2 and table.remove(F.col("k") == -1) == []
    state = changes.remove(state, F.col("k").isin(12, 13))
    assert rows(table.read()) == rows(state)
    snapshot = state.select("k").filter("k <> 20")
    touched = table.drop_stale(snapshot)
    assert len(touched) <= 2 and rows(table.read()) == rows(changes.drop_stale(state, snapshot, "k"))
    with pytest.raises(ValueError):
        table.update(F.col("n") == 1, {"k": F.lit(1)})


def test_emptied_part(spark, tmp_path):
    KeyedTable.create(spark.createDataFrame([(i, "a", i) for i in range(60)], SCHEMA), f"file://{tmp_path}/u", "k", 3).remove(F.col("k") < 59)
    assert spark.read.parquet(f"file://{tmp_path}/u").count() == 1


@pytest.mark.parametrize("seed", range(3))
def test_ranks(spark, seed):
    """Heavy tails, ties, one value, far numbers, infinities apart, groups of every size and one of a third of all rows."""
    rng = random.Random(seed)
    made = []
    for g in range(12):
        n = 700 if g == 0 else rng.randint(1, 60)
        kind = g % 4
        made += [(g, float(v)) for v in ([rng.lognormvariate(0, 6) for _ in range(n)] if kind == 0 else [rng.choice([1.5, 1.5, -2.25]) for _ in range(n)] if kind == 1 else [7.125] * n if kind == 2 else [rng.choice([-1.7e308, 1.7e308, rng.random() * 1e-300, rng.gauss(0, 1)]) for _ in range(n)])]
    odd = [(3, None), (99, None), (3, float("nan"))]
    df = spark.createDataFrame(made + odd, "g int, v double").repartition(4)
    targets = {"low": lambda n: F.lit(0), "half": lambda n: F.floor(n / 2), "p90": lambda n: F.floor(n * 90 / 100), "high": lambda n: n + 5}
    by = {}
    for g, v in made:
        by.setdefault(g, []).append(v)
    expected = {g: (x := sorted(vs))[0:1] + [x[len(x) // 2], x[len(x) * 90 // 100], x[-1]] for g, vs in by.items()}
    assert {r["g"]: [r["low"], r["half"], r["p90"], r["high"]] for r in at_ranks(df, F.col("v"), ["g"], targets).collect()} == expected
    every = sorted(v for _, v in made)
    assert [tuple(r) for r in at_ranks(df, F.col("v"), [], targets).collect()] == [(every[0], every[len(every) // 2], every[len(every) * 90 // 100], every[-1])]
    assert at_ranks(df.filter("g = 99"), F.col("v"), ["g"], targets).count() == 0


def test_large_files_are_not_read(spark, tmp_path):
    folder, at = tmp_path / "in", [f"file://{tmp_path}/{n}" for n in ("in", "docs", "status", "marks")]
    folder.mkdir()
    for name, text in (("a.txt", b"one"), ("b.txt", b"x" * 5000), ("c.txt", b"one"), ("d.txt", b"x\0")):
        (folder / name).write_bytes(text)
    ingest.ingest(spark, *at, most=4000)
    (folder / "e.txt").write_bytes(b"two")
    ingest.ingest(spark, *at, most=4000)
    assert sorted(r["content"] for r in ingest.documents(spark, at[1]).collect()) == ["one", "two"]
    assert sorted(tuple(r) for r in ingest.statuses(spark, at[2]).select("batch", "seen", "issues", "repeated", "imported").collect()) == [(0, 4, 2, 1, 1), (1, 1, 0, 0, 1)]


def test_digest_parts(spark, tmp_path):
    """New digests read no part of the index, repeated ones only theirs; a batch's own try doesn't count."""
    import hashlib

    made = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(3000)]
    frame = lambda ds: spark.createDataFrame([(d,) for d in ds], "digest string")
    index = ingest.Digests(spark, f"file://{tmp_path}/digests")
    assert index.held(frame(made[:5]), 0).count() == 0
    index.add(frame(made[:1000]), 0)
    index.add(frame(made[1000:2000]), 1)
    read = []
    whole = index.read
    index.read = lambda found: (read.append(whole(found)), read[-1])[1]
    touched = lambda: read[-1].select("_metadata.file_path").distinct().count()
    assert index.held(frame(made[2000:2200]), 2).count() == 0 and touched() <= 3
    got = {r[0] for r in index.held(frame(made[995:1003] + made[2500:2510]), 2).collect()}
    assert got == set(made[995:1003]) and touched() <= 11
    assert spark.read.parquet(index.path).select("_metadata.file_path").distinct().count() > 400
    assert {r[0] for r in index.held(frame(made[998:1002]), 1).collect()} == set(made[998:1000])


def test_database_describes_itself(spark, tmp_path):
    """Joins along the keys that the database declares, without any declared here."""
    base = Database(f"jdbc:derby:{tmp_path}/base;create=true", (("driver", "org.apache.derby.iapi.jdbc.AutoloadedDriver"),))
    spark._jvm.java.lang.Class.forName("org.apache.derby.iapi.jdbc.AutoloadedDriver")
    connection = spark._jvm.java.sql.DriverManager.getConnection(base.url)
    for sql in (
        "CREATE TABLE KINDS (ID INT NOT NULL PRIMARY KEY, LABEL VARCHAR(20) NOT NULL)", "CREATE TABLE PRODUCTS (ID INT NOT NULL PRIMARY KEY, SORT INT REFERENCES KINDS(ID), PRICE DOUBLE)",
        "CREATE UNIQUE INDEX LABELS ON KINDS (LABEL)", "CREATE TABLE PAIRS (A INT NOT NULL, B INT NOT NULL, PRIMARY KEY (A, B))", "CREATE VIEW DEAR AS SELECT ID, PRICE FROM PRODUCTS WHERE PRICE > 50",
        "INSERT INTO KINDS VALUES (1, 'one'), (2, 'two')", "INSERT INTO PRODUCTS VALUES (1, 1, 10), (2, 1, 60), (3, 2, 70), (4, NULL, 80)",
    ):
        connection.createStatement().execute(sql)
    connection.close()
    held = {name: {tuple(r) for r in df.collect()} for name, df in base.snapshot(spark, "APP").items()}
    assert held["tables"] == {("KINDS", "TABLE"), ("PRODUCTS", "TABLE"), ("PAIRS", "TABLE"), ("DEAR", "VIEW")}
    assert ("PRODUCTS", 3, "PRICE", "DOUBLE", True) in held["columns"] and ("KINDS", 1, "ID", "INTEGER", False) in held["columns"]
    assert held["primary_keys"] == {("KINDS", 1, "ID"), ("PRODUCTS", 1, "ID"), ("PAIRS", 1, "A"), ("PAIRS", 2, "B")}
    assert [(t, c, o, d) for t, _, _, c, o, d in held["foreign_keys"]] == [("PRODUCTS", "SORT", "KINDS", "ID")]
    assert ("KINDS", "LABELS", 1, "LABEL", True) in held["indexes"]
    shop = base.introspected(spark, "APP")
    got = Table.of(shop, "PRODUCTS").group_by("KINDS.LABEL").values("SUM(PRICE) as total").order_by("LABEL").frame_of().collect()
    assert [tuple(r) for r in got] == [("one", 70.0), ("two", 70.0)]
    assert shop.frame("DEAR").count() == 3 and shop.frame("PRODUCTS").rdd.getNumPartitions() > 1
