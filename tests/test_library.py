"""Query API, functions, changes, sources and streaming on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import vectors as V
from millrace.operators import changes, documents, schemas, search
from millrace.plans.catalog import Catalog, ForeignKey
from millrace.plans.predicates import literal, split_lookup
from millrace.plans.table import Policy, Table, from_json, from_url
from millrace.sources import files
from millrace.sources.jdbc import Database
from millrace.streaming import ingest, limits


@pytest.fixture(scope="module")
def shop(spark):
    items = [(1, "Laptop", 1, 50000.0), (2, "Phone", 1, 30000.0), (3, "Shirt", 2, 2000.0), (4, "Jeans", 2, None), (5, "it's (a) book & more", 3, 1500.0)]
    kinds = [(1, "Electronics"), (2, "Clothes"), (3, "Books"), (4, "Empty")]
    frames = {"products": spark.createDataFrame(items, "id int, name string, kind_id int, price double"), "kinds": spark.createDataFrame(kinds, "id int, label string")}
    return Catalog(frames, (ForeignKey("products", "kind_id", "kinds", "id"),))


def ids(q):
    return sorted(r[0] for r in q.values("products.id").frame_of().collect())


@pytest.mark.parametrize("text,expected", [
    ("price >= 2000", [1, 2, 3]), ("price__lt=2000", [5]), ("price > 1000 & (name = 'Phone' | name__like='S%')", [2, 3]), ("price = 1500 | price = 2000 & name = 'x'", [5]),
    ("name = 'it''s (a) book & more'", [5]), ("price = null", [4]), ("price != null && kind_id__in=[1,3]", [1, 2, 5]), ("kinds.label = 'Clothes'", [3, 4]), ("((price > 40000))", [1]),
])
def test_conditions(shop, text, expected):
    q = Table.of(shop, "products")
    q = q.filter(text)
    out = q.frame_of() if "kinds" not in text else q.values("products.id").frame_of()
    assert sorted(r["id"] for r in out.collect()) == expected


@pytest.mark.parametrize("text", ["price >", "(price > 1", "price > 1)", "& price = 1", "price", ""])
def test_bad_conditions(shop, text):
    if text:
        with pytest.raises(ValueError):
            Table.of(shop, "products").filter(text)
    with pytest.raises((ValueError, KeyError)):
        Table.of(shop, "products").filter(nowhere__label="x")


def test_lookups_and_paths(shop):
    assert split_lookup("a__b__gte") == ("a.b", "gte") and split_lookup("price") == ("price", "eq")
    assert literal("'a''b'") == "a'b" and literal("[1, 'x']") == [1, "x"] and literal("2.5") == 2.5 and literal("true") is True
    q = Table.of(shop, "products").filter(kinds__label="Electronics", price__gt=40000)
    assert ids(q) == [1]
    grouped = Table.of(shop, "kinds").group_by("label").values("COUNT(products.kind_id) as n").order_by("-n", "label").frame_of()
    assert [tuple(r) for r in grouped.collect()] == [("Clothes", 2), ("Electronics", 2), ("Books", 1), ("Empty", 0)]
    assert Table.of(shop, "products").count() == 5 and Table.of(shop, "products").limit(2).count() == 2


def test_requests(shop):
    policy = Policy({"products": ("id", "name", "price")}, default_limit=3, max_limit=4)
    assert from_json(shop, '{"table": "products", "fields": ["id"], "order_by": ["id ASC"]}', policy).count() == 3
    assert from_json(shop, {"table": "products", "fields": ["id"], "limit": 99}, policy).count() == 4
    assert [r["id"] for r in from_url(shop, "(table:[products];fields:[id];filter:[price>=2000];order_by:[id DESC];limit:[2])", policy).collect()] == [3, 2]
    for bad in ({"table": "kinds"}, {"table": "products", "fields": ["kind_id"]}, {"table": "products", "where": [{"field": "kind_id", "op": "eq", "value": 1}]}):
        with pytest.raises(PermissionError):
            from_json(shop, bad, policy)


def test_text(spark):
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c(F.col("t")).alias("x")).first()["x"]
    assert one(T.tokens, "The Quick_fox, 12 abc9 für THIS") == ["quick_fox", "abc9"]
    assert one(T.identifiers, "int main() { class Worker; doIt (x) }") == ["main", "doIt", "Worker"]
    assert one(T.identifier_terms, "parseHTTPRequest_v2") == ["parse", "http", "request", "v2"]
    assert one(T.safe_term, "A b/c:d") == "a_b/c:d" and one(T.metadata_key, " A  b!c ") == "a_b_c"
    assert one(T.html_title, "<title>A &amp; B</title>") == "A & B" and "track" not in one(T.html_text, "<script>track()</script><p>x</p>y")
    assert one(T.citations, "[S1] and [Q2] [S1] [x]") == ["S1", "Q2"] and one(T.estimated_tokens, "abcdefgh") == 2
    assert one(lambda c: T.snippet(c, ["hit"], 1), "a\nb\nhit c\nd\ne") == "   2 | b\n   3 | hit c\n   4 | d"
    assert one(T.kept_lines, " a \n\n b") == "a\nb" and one(T.claims, "Short. This sentence has more than enough bytes!") == ["This sentence has more than enough bytes"]
    assert one(T.language_of, "привет") == "russian"


def test_vectors_and_search(spark):
    v = spark.createDataFrame([(10, [1.0, 0.0, 0.0]), (20, [0.0, 1.0, 0.0]), (30, [0.0, 0.0, 1.0]), (40, [1.0]), (60, [2.0, 0.1, 0.0])], "vec_id long, embedding array<float>")
    near = search.nearest(v, [1.0, 0.0, 0.0], 2).collect()
    assert [r["vec_id"] for r in near] == [10, 60] and near[0]["score"] == 1.0
    assert {tuple(r) for r in search.earlier_duplicates(v.filter("vec_id <> 40")).collect()} == {(60, 10)}
    assert v.filter("vec_id = 40").select(V.cosine(F.col("embedding"), V.vector([1.0, 0.0])).alias("c")).first()["c"] == 0.0
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "gamma delta"), (3, "beta gamma")], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in search.bm25(docs, "doc_id", "text", ["beta"]).collect()}
    assert set(scores) == {1, 3} and scores[1] > scores[3]


def test_documents(spark):
    for n in (0, 1, 40, 41, 219, 220, 221, 399, 400, 401):
        docs = spark.createDataFrame([(1, " ".join(["w"] * n))], "doc_id long, text string")
        starts, at = [], 0
        while n:
            starts.append(at)
            if at + 220 >= n:
                break
            at += 180
        assert [r["start"] for r in documents.chunk_plain(docs, "doc_id", "text").orderBy("chunk").collect()] == starts
    md = spark.createDataFrame([(1, "intro\n# A\nx\n## B\ny\nz")], "doc_id long, text string")
    assert [r["title"] for r in documents.sections(md, "doc_id", "text", r"^\s{0,3}#{1,6}\s+").orderBy("section").collect()] == ["intro", "# A", "## B"]
    rows = spark.createDataFrame([(1, 5), (2, 5), (3, 50), (4, 1)], "k int, n int")
    assert [r["k"] for r in documents.within_budget(rows, ["k"], F.col("n"), 12).collect()] == [1, 2]


def test_changes(spark, tmp_path):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, v string")
    assert {tuple(r) for r in changes.upsert(t, spark.createDataFrame([(2, "x"), (9, "y")], "id int, v string"), "id").collect()} == {(1, "a"), (2, "x"), (3, None), (9, "y")}
    assert {tuple(r) for r in changes.insert_ignore(t, spark.createDataFrame([(2, "x"), (9, "y")], "id int, v string"), "id").collect()} == {(1, "a"), (2, "b"), (3, None), (9, "y")}
    assert changes.remove(t, F.col("v") == "a").count() == 2
    assert {tuple(r) for r in changes.update(t, F.col("v") == "a", {"v": F.lit("z")}).collect()} == {(1, "z"), (2, "b"), (3, None)}
    path = f"file://{tmp_path}/t"
    changes.write_table(t, path)
    changes.write_table(changes.remove(spark.read.parquet(path), F.col("id") == 1), path)
    assert spark.read.parquet(path).count() == 2
    h = spark.createDataFrame([(1, 1, "create")], "id int, version int, action string")
    assert {tuple(r) for r in changes.with_history(h, t.select("id"), "id", "update").collect()} == {(1, 1, "create"), (1, 2, "update"), (2, 1, "update"), (3, 1, "update")}


def test_schemas(spark, shop):
    now = schemas.catalog_rows(spark, {"a": shop.frame("products").schema, "gone": shop.frame("kinds").schema})
    wanted = schemas.catalog_rows(spark, {"a": shop.frame("products").drop("name").withColumn("id", F.lit(1).cast("long")).withColumn("extra", F.lit("x")).schema, "new": shop.frame("kinds").schema})
    steps = [(r["change"], r["tbl"], r["col"], r["risk"]) for r in schemas.plan(schemas.difference(wanted, now)).orderBy("step").collect()]
    assert steps == [("TableAdded", "new", None, "Safe"), ("ColumnAdded", "a", "extra", "Warning"), ("ColumnTypeChanged", "a", "id", "ManualReview"), ("ColumnOnlyInCurrent", "a", "name", "Destructive"), ("TableOnlyInCurrent", "gone", None, "Destructive")]


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: One\naliases: x, y\n---\nbody")
    (tmp_path / "b.md").write_text("---\ntitle: one\n---\nother")
    (tmp_path / "c.py").write_bytes(b"x\0y")
    (tmp_path / "e.txt").write_text("plain")
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.scan(spark, f"file://{tmp_path}").collect()}
    assert got["c.py"]["issue"] == "binary" and got["e.txt"]["issue"] is None and got["e.txt"]["content"] == "plain" and got["a.md"]["language"] == "markdown"
    pairs = files.markdown_pairs(files.scan(spark, f"file://{tmp_path}", ["md"])).collect()
    assert [(p["title"], p["category"], p["aliases"], p["body"]) for p in pairs] == [("One", "general", ["x", "y"], "body")]
    rows = spark.createDataFrame([("1", "2020-01-01", ""), ("2.5", "=A1", None)], "a string, b string, c string")
    assert {r["col"]: r["merged"] for r in files.profile(rows).collect()} == {"a": "Number", "b": "Mixed", "c": "Empty"}


def test_limits(spark):
    ev = spark.sql("SELECT id AS event_id, id % 2 AS user_id, timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 0.2) AS ts, 'view' AS event_type FROM range(40)")
    got = {r["event_id"]: r["allowed"] for r in limits.limited(ev, "user_id", 2, 5).collect()}
    for u in (0, 1):
        kept = []
        for i in range(u, 40, 2):
            t = round(i * 0.2, 6)
            ok = sum(x > t - 1 for x in kept) < 2 and len(kept) < 5
            assert got[i] == ok
            if ok:
                kept.append(t)


def test_stream(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(f"{tmp_path}/in")
    stream = limits.windowed_counts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) AS n FROM counts").first()["n"] == spark.read.parquet(f"{sf}/events.parquet").count()


def test_object_plan(spark):
    from millrace.plans.catalogue import CURRENT, WANTED

    wanted, now = (spark.createDataFrame(list(rows), "object string, tbl string, name string, properties map<string,string>") for rows in (WANTED, CURRENT))
    steps = [(r["change"], r["object"], r["tbl"], r["name"], r["property"], r["decision"]) for r in schemas.object_plan(schemas.object_changes(wanted, now), schemas.ChangePolicy(warnings=False, destructive=True, confirm_destructive=False)).orderBy("step").collect()]
    assert steps == [
        ("Added", "table", "customer", "", None, "Allowed"), ("Added", "column", "orders", "note", None, "Blocked"), ("Added", "foreign_key", "orders", "customer", None, "Blocked"),
        ("Changed", "column", "orders", "total", "defaultValue", "Allowed"), ("Changed", "column", "orders", "total", "nullable", "ManualReviewRequired"), ("Changed", "column", "orders", "id", "type", "ManualReviewRequired"),
        ("Changed", "view", "big_orders", "", "definition", "Blocked"), ("OnlyInCurrent", "column", "orders", "old", None, "Allowed"), ("OnlyInCurrent", "sequence", "numbers", "", None, "Unsupported"),
        ("OnlyInCurrent", "table", "gone", "", None, "Allowed"), ("Changed", "index", "orders", "by_total", "columns", "Blocked"),
    ]
    assert schemas.object_changes(wanted, wanted).count() == 0


def test_ingest(spark, tmp_path):
    folder, at = tmp_path / "in", [f"file://{tmp_path}/{n}" for n in ("in", "docs", "status", "marks")]
    folder.mkdir()
    for name, text in (("a.txt", b"one"), ("b.txt", b"one"), ("c.py", b"two"), ("d.txt", b"x\0")):
        (folder / name).write_bytes(text)
    ingest.ingest(spark, *at)
    (folder / "e.txt").write_bytes(b"two")
    (folder / "f.txt").write_bytes(b"three")
    ingest.ingest(spark, *at)
    (folder / "g.txt").write_bytes(b"three")
    ingest.ingest(spark, *at)
    docs = ingest.documents(spark, at[1]).collect()
    assert sorted((r["path"].rsplit("/", 1)[1], r["language"], r["content"], r["batch"]) for r in docs) == [("a.txt", "text", "one", 0), ("c.py", "python", "two", 0), ("f.txt", "text", "three", 1)]
    assert sorted(tuple(r) for r in ingest.statuses(spark, at[2]).select("batch", "seen", "issues", "repeated", "imported").collect()) == [(0, 4, 1, 1, 2), (1, 2, 0, 1, 1), (2, 1, 0, 1, 0)]


def test_database(spark, tmp_path):
    base = Database(f"jdbc:derby:{tmp_path}/base;create=true", (("driver", "org.apache.derby.iapi.jdbc.AutoloadedDriver"),))
    base.append(spark.sql("SELECT CAST(id AS INT) AS id, CAST(id % 3 AS INT) AS kind_id, id * 1.5D AS price FROM range(100)"), "products")
    base.append(spark.sql("SELECT CAST(id AS INT) AS id, id + 7 AS code FROM range(3)"), "kinds")
    base.append(spark.sql("SELECT 1 AS id WHERE false"), "nothing")
    shop = base.catalog(spark, {"products": "id", "kinds": None}, (ForeignKey("products", "kind_id", "kinds", "id"),))
    assert shop.frame("products").rdd.getNumPartitions() == 8 and shop.frame("products").count() == 100
    got = Table.of(shop, "products").filter(price__gte=75).group_by("kinds.code").values("COUNT(products.id) as n").order_by("code").frame_of().collect()
    assert [tuple(r) for r in got] == [(7, 17), (8, 16), (9, 17)]
    assert base.table(spark, "nothing", "id").count() == 0
    assert base.query(spark, "SELECT COUNT(*) AS n FROM products").first()[0] == 100


def test_every_vector_judged(spark):
    from millrace.operators import search

    given = [(1, [1.0, 0.0]), (3, [0.0, 1.0]), (7, [1.0, 0.1]), (9, [0.9, 0.3]), (11, [0.7, 0.7]), (20, [0.0, 0.0]), (21, None), (22, [1.0]), (40, [0.0, 2.0])]
    vectors = spark.createDataFrame(given, "vec_id long, embedding array<float>")
    expected = {1: (1, 2), 7: (1, 2), 9: (1, 2), 3: (3, 1), 40: (3, 1), 11: (11, 0), 20: (20, 0), 21: (21, 0), 22: (22, 0)}
    for block in (1024, 2):
        assert {r["vec_id"]: (r["class_id"], r["links"]) for r in search.similar_classes(vectors, 0.94, block).collect()} == expected


def test_many_queries(spark):
    from millrace.operators import search

    vectors = spark.createDataFrame([(i, [float(i % 10), float(i // 10)]) for i in range(60)] + [(100, [0.0, 0.0]), (101, None)], "vec_id long, embedding array<float>")
    for block in (1024, 7):
        got = search.nearest_many(vectors, vectors.filter("vec_id % 20 = 0"), 3, block).collect()
        assert {q: [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 20, 40, 100)} == {0: [0, 100, 1], 20: [20, 10, 21], 40: [40, 30, 41], 100: [0, 100, 1]}


def test_no_rows_left_out(spark, sf):
    from millrace.plans import catalogue

    n = catalogue.QUERIES["doc_frequency"](spark, sf).count()
    assert catalogue.QUERIES["idf"](spark, sf).count() == n
    longest = spark.read.parquet(f"{sf}/documents.parquet").orderBy("n_chars", ascending=False).first()
    first = [r for r in catalogue.QUERIES["context_budget"](spark, sf).collect() if r["rank"] == 1]
    assert [(r["doc_id"], r["upto"]) for r in first] == [(longest["doc_id"], longest["n_chars"])] and longest["n_chars"] >= 3000
