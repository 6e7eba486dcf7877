"""Full text, chunks, requests with rights, sources, indexes and streams on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import analytics, changes, documents, fulltext, schemas, search, vector_index
from millrace.plans.catalog import Catalog, ForeignKey
from millrace.plans.table import Field, Policy, Rights, Table, from_json, from_params, from_url, payload, written
from millrace.sources import files, parsers, questions
from millrace.streaming import limits


@pytest.fixture(scope="module")
def shop(spark):
    orders = [(1, 10, 500.0, "F"), (2, 10, 50.0, "O"), (3, 20, 900.0, "F"), (4, 30, 5.0, "P")]
    customers = [(10, "a", 1), (20, "b", 2), (30, "a", 1)]
    frames = {"orders": spark.createDataFrame(orders, "id int, customer_key int, price double, status string"), "customers": spark.createDataFrame(customers, "key int, segment string, vip int"), "notes": spark.createDataFrame([(1, 2, "n")], "id int, orders_id int, body string")}
    return Catalog(frames, (ForeignKey("orders", "customer_key", "customers", "key"),))


POLICY = Policy({"orders": ("id", "status"), "customers": Rights({"segment": Field(), "vip": Field(filter=False, sort=False), "key": Field(hidden=True)})}, 10, 100)


@pytest.mark.parametrize("body", [
    {"fields": ["MAX(price) as m"]}, {"fields": ["id"], "order_by": ["-price"]}, {"fields": ["customers.id"]}, {"fields": ["customers.key"]}, {"fields": ["COUNT(*) as n"], "group_by": ["status"], "having": ["MAX(price) > 1"]},
    {"fields": ["COUNT(*) as n"], "group_by": ["status"], "having": ["price > 1"]}, {"fields": ["COUNT(*) as n"], "group_by": ["price"]}, {"fields": ["id"], "where": [{"field": "customers.vip", "op": "eq", "value": 1}]},
    {"fields": ["id"], "order_by": ["customers.vip"]}, {"fields": ["notes.body"]}, {"fields": ["price as id"]}, {"fields": ["id", "price as p"], "order_by": ["p"]},
])
def test_refused(shop, body):
    with pytest.raises((PermissionError, ValueError)):
        from_json(shop, {"table": "orders", **body}, POLICY)


@pytest.mark.parametrize("text", ["id>0&price>400", "id>0 | price>400", "price>1", "id > price", "customers.vip=1"])
def test_refused_filters(shop, text):
    with pytest.raises(PermissionError):
        from_url(shop, f"(table:[orders];fields:[id];filter:[{text}])", POLICY)


def test_allowed(shop):
    assert from_json(shop, {"table": "orders"}, POLICY).columns == ["id", "status"]
    assert from_url(shop, "(table:[orders];fields:[COUNT(*) as n])", POLICY).first()["n"] == 4
    got = from_url(shop, "(table:[orders];fields:[COUNT(*) as n];groups:[customers.segment];having:[n>1];order_by:[n DESC];limit:[5];offset:[0])", POLICY).collect()
    assert [tuple(r) for r in got] == [("a", 3)]
    assert [r["id"] for r in from_params(shop, "orders", {"status__in": "F,O", "order_by": "-id", "limit": "2", "offset": "1", "values": "id"}, POLICY).collect()] == [2, 1]
    assert from_json(shop, {"table": "orders", "fields": ["id", "customers.vip"]}, POLICY).count() == 4


def test_groups(shop):
    with pytest.raises(ValueError):
        Table.of(shop, "orders").values("status", "COUNT(*) as n").frame_of()
    with pytest.raises(ValueError):
        Table.of(shop, "orders").group_by("COUNT(*)")
    assert sorted(r[0] for r in Table.of(shop, "orders").group_by("status").frame_of().collect()) == ["F", "O", "P"]
    got = Table.of(shop, "orders").group_by("status").values("status as s", "COUNT(*) as n").having("SUM(customers.vip) >= 2 & AVG(price) > 10").order_by("s").frame_of()
    assert got.columns == ["s", "n"] and [tuple(r) for r in got.collect()] == [("F", 2)]
    assert sorted(r["id"] for r in Table.of(shop, "orders").filter("id < price & price > customers.key").values("orders.id").frame_of().collect()) == [1, 2, 3]
    assert [tuple(r) for r in Table.of(shop, "notes").values("body", "orders.price").frame_of().collect()] == [("n", 50.0)]
    assert sorted(tuple(r) for r in Table.of(shop, "orders").group_by("orders.id").values("COUNT(notes.id) as n").frame_of().collect()) == [(1, 0), (2, 1), (3, 0), (4, 0)]


def test_writes(shop):
    rights = Policy({"orders": Rights({"id": Field(), "price": Field(write=True), "status": Field()}, write=True)})
    assert written(shop, "POST", "orders", {"price": 3}, rights, key="id").filter("id = 5 and price = 3 and status is null").count() == 1
    assert written(shop, "PUT", "orders", {"data": {"price": 1.0}}, rights, {"status": "F"}).filter("price = 1").count() == 2
    for bad in (("DELETE", {}, {"id": 1}), ("PATCH", {"status": "x"}, {"id": 1})):
        with pytest.raises(PermissionError):
            written(shop, bad[0], "orders", bad[1], rights, bad[2])
    with pytest.raises(ValueError):
        written(shop, "DELETE", "orders", {}, None, None)
    assert written(shop, "DELETE", "orders", {}, None, {"id": 1}).count() == 3
    assert payload('{"a": 1}') == {"a": 1} and payload({"table": "t", "data": {"b": 2}}) == {"b": 2}


def test_changes_of_repeated_keys(spark, tmp_path):
    t = spark.createDataFrame([(1, "a")], "id int, v string")
    twice = spark.createDataFrame([(1, "x"), (1, "y"), (2, "p"), (2, "q")], "id int, v string")
    assert {tuple(r) for r in changes.upsert(t, twice, "id", "v").collect()} == {(1, "y"), (2, "q")}
    assert {tuple(r) for r in changes.insert_ignore(t, twice, "id", "v").collect()} == {(1, "a"), (2, "p")}
    path = f"file://{tmp_path}/t"
    changes.write_table(t, path)
    (tmp_path / "t").rename(tmp_path / "t.old")  # as a crash between the two renames leaves it
    changes.restore(spark, path)
    assert spark.read.parquet(path).count() == 1
    changes.write_table(twice, path)
    assert spark.read.parquet(path).count() == 4 and sorted(p.name for p in tmp_path.iterdir()) == ["t"]
    new = spark.range(7).select(F.col("id").cast("string").alias("v")).repartition(3)
    assert sorted(r["id"] for r in changes.insert(t, new, "id").collect()) == list(range(1, 9))
    for kind in ("json", "csv", "xml"):
        changes.exported(twice, f"file://{tmp_path}/{kind}", kind)
    assert spark.read.json(f"file://{tmp_path}/json").count() == spark.read.option("rowTag", "row").xml(f"file://{tmp_path}/xml").count() == 4


def test_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta beta", "src/AlphaFile.cpp", {"chunk_page": "3"}), (2, "gamma delta 東京都", "docs/x.md", {"chunk_symbol_name": "run_all"}), (3, "beta gamma", None, None)], "doc_id long, text string, path string, m map<string,string>")
    index = fulltext.postings(docs, "doc_id", "text", {"path": "path"}, "m", cjk=True)
    held = {(r["prefix"], r["term"], r["doc_id"]): r["wdf"] for r in index.collect()}
    assert held["", "beta", 1] == 2 and held["QPATH", "alphafile", 1] == 2 and held["QB", "alpha", 1] == 1 and held["QPAGE", "3", 1] == 2 and held["QSYMBOL", "run_all", 2] == 7 and held["QCJK", "東京", 2] == 1
    path = f"file://{tmp_path}/index"
    fulltext.store(docs, path, "doc_id", "text", {"path": "path"}, "m", cjk=True, parts=2)
    back = fulltext.stored(spark, f"{path}/blocks").select("prefix", "term", F.explode("postings").alias("p")).select("prefix", "term", F.col("p.key").alias("doc_id"), F.col("p.wdf").alias("wdf"))
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in index.select("prefix", "term", "doc_id", "wdf").collect()}
    for query, cjk in (("alphaFile beta", False), ("京都", True)):
        pairs = fulltext.query_pairs(query, cjk)
        score = {r["key"]: round(r["score"], 9) for r in fulltext.top(spark, path, pairs, 10).collect()}
        assert score == {r["doc_id"]: round(r["score"], 9) for r in fulltext.scored(docs, "doc_id", "text", pairs, {"path": "path"}, "m", True).collect()}
        assert (score[1] == 1.0 and 0 < score[3] < 1 and 2 not in score) if not cjk else list(score) == [2]
    assert fulltext.top(spark, path, [("", "nowhere")], 3).count() == 0
    assert fulltext.prefix_terms("Ab_c, düR!") == ["ab_c", "dür"]
    assert docs.filter(fulltext.has_prefixes([F.col("text")], "gam del")).count() == 1 and docs.filter(fulltext.has_prefixes([F.col("text")], " ?")).count() == 0


def test_variants_and_context(spark):
    assert [o for _, o in fulltext.variants("How does the parseHttp request filter work?")] == ["original", "rewritten"]
    assert fulltext.variants("x")[0] == ("x", "original") and len(fulltext.variants("alpha beta gamma delta epsilon zeta eta theta", 2)) == 2
    keyed = spark.createDataFrame([("p", {"chunk_index": "2", "other": "z"}), ("q", {})], "path string, m map<string,string>")
    assert [r[0] for r in keyed.select(fulltext.merge_key(F.col("path"), F.col("m"))).collect()] == ["p|chunk_index=2", "q"]
    hits = spark.createDataFrame([(1, i, f"f{i}", "source", "C", 0.5, "x" * n, "snip", {}) for i, n in ((1, 10), (2, 3000), (3, 10), (4, 5000), (5, 1))], "q int, rank int, path string, kind string, language string, score double, content string, snippet string, metadata map<string,string>")
    made = fulltext.context(hits, ["q"], 4000).first()
    assert made["files"] == 3 and "FILE: f2" in made["text"] and "snip\n...\n" in made["text"] and "f4" not in made["text"] and "f5" not in made["text"] and made["text"].count("x" * 10) == 2
    answers = spark.createDataFrame([("yes [S1] [S9]", ["S1", "S2"], 0.9), ("no", ["S1"], 0.9), ("z [S1]", ["S1"], 0.4), ("z", [], 0.4)], "a string, c array<string>, p double")
    assert [r[0] for r in answers.select(fulltext.answer_status(F.col("a"), F.col("c"), F.col("p"))).collect()] == ["unsupported_citations", "uncited", "partial", "no_context"]
    assert answers.select(fulltext.with_sources(F.col("a"), F.col("c"))).collect()[1][0] == "no\n\nSources: [S1]"


def test_chunks(spark):
    text = "intro line\n\n# A b\n one two\n three\n## C\nfour five six seven\n"
    d = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, " a b  c ")], "doc_id long, text string")
    for strategy in ("markdown_heading", "plain_text_token", "pdf_page"):
        rows = documents.chunks(d, "doc_id", "text", F.concat(F.lit("p"), "doc_id"), strategy, 3, 1).collect()
        for r in rows:
            m, whole = r["metadata"], {1: text, 4: " a b  c "}[r["doc_id"]]
            assert whole[int(m["chunk_char_start"]) : int(m["chunk_char_end"])] == r["content"] and int(m["chunk_token_count"]) == len(r["content"].split()) <= 3
        first = [r for r in rows if r["doc_id"] == 1]
        assert [r["path"] for r in first] == [f"p1#chunk-{i}" for i in range(len(first))] and {r["metadata"]["chunk_count"] for r in first} == {str(len(first))}
    code = "// x\nnamespace n {\nclass A : B {\n};\n}\nstatic void g(int x)\n{\n}\nexport async function run(a) {\n"
    got = [(r["kind"], r["name"], r["scope"]) for r in documents.code_sections(spark.createDataFrame([(1, code)], "doc_id long, text string"), "doc_id", "text").orderBy("section").collect()]
    assert got == [(None, None, None), ("namespace", "n", "namespace:n"), ("class", "A", "class:A"), ("function", "g", "class:A"), ("function", "run", "class:A")]
    long = spark.createDataFrame([(1, "w " * 200_000)], "doc_id long, text string")
    assert documents.chunk_plain(long, "doc_id", "text").count() == 1111


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.txt").write_text("x" * 5000)
    (tmp_path / "c.html").write_text("<title>T</title><p>para</p>")
    (tmp_path / "d.png").write_bytes(b"png")
    got = {r["path"].rsplit("/", 1)[1]: (r["issue"], r["content"] and len(r["content"])) for r in files.scan(spark, f"file://{tmp_path}", most=1000).collect()}
    assert got["b.txt"] == ("too large", None) and got["a.txt"] == (None, 7)
    parsed = {r["path"].rsplit("/", 1)[1]: (r["parser"], r["text"]) for r in parsers.Registry().parsed(files.scan(spark, f"file://{tmp_path}", most=1000)).collect()}
    assert parsed["c.html"] == ("html", "T\n\npara") and parsed["a.txt"] == ("plain", "one\ntwo") and parsed["d.png"] == (None, None)
    registry = parsers.Registry()
    registry.add(parsers.Parser("shout", lambda t: t["extension"] == "txt", F.upper))
    assert registry.parsed(files.scan(spark, f"file://{tmp_path}", ["txt"], most=1000)).filter("text = 'ONE\nTWO' and parser = 'shout'").count() == 1
    spark.dataSource.register(parsers.LineSource)
    lines = spark.read.format("millrace_lines").options(path=str(tmp_path), suffix=".txt").load()
    assert sorted((r["line"], r["text"][:3]) for r in lines.collect()) == [(1, "one"), (1, "xxx"), (2, "two")]
    docs = files.memory(spark, [("p", "1"), ("q", "2"), ("p", "3")], "relative_path string, content string")
    more = spark.createDataFrame([("p", "9"), ("r", "5"), ("r", "4")], docs.schema)
    assert sorted(tuple(r) for r in files.appended(docs, more).collect()) == [("p", "1"), ("q", "2"), ("r", "4")]
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c.alias("x")).first()["x"]
    assert one(files.delimiter_of(F.col("t")), 'a;"b,c,d";e\n1') == ";" and one(files.delimiter_of(F.col("t")), "abc") == "," and one(files.delimiter_of(F.col("t")), "a\tb|c\td") == "\t"
    csv = spark.createDataFrame([(1, 'name;note\nx;"a ""q""; b"\ny;\n'), (2, "1,2\n3,4\n"), (3, None)], "k int, t string")
    assert [(r["k"], r["row"], dict(r["cells"])) for r in files.csv_rows(csv, "k", "t").orderBy("k", "row").collect()] == [(1, 1, {"name": "x", "note": 'a "q"; b'}), (1, 2, {"name": "y", "note": ""}), (2, 1, {"A": "1", "B": "2"}), (2, 2, {"A": "3", "B": "4"})]
    assert [one(files.column_letters(F.lit(i)), "x") for i in (0, 25, 26, 701, 702, 18277, 18278)] == ["A", "Z", "AA", "ZZ", "AAA", "ZZZ", "AAAA"]
    for path, inside in (("/data/in/x", True), ("/data/in/../x", False), ("/data/inside", False), ("/data/in/a/../../in/b", True), ("../data/in/x", False)):
        verdict = one(files.upload_check(F.lit("x.md"), F.lit(None), F.lit(1), [".md"], [], 10, F.lit(path), "/data/in"), "x")
        assert verdict == ("ok" if inside else "outside_folder"), path

    def fnv(raw):
        h = 1469598103934665603
        for b in raw:
            h = (h ^ b) * 1099511628211 % 2**64
        return f"{h:016x}"

    assert all(one(files.content_hash(F.col("t")), t) == fnv(t.encode()) for t in ("", "a", "hello wörld", "\x7f" * 30, "zz" * 50))


def test_questions(spark, tmp_path):
    (tmp_path / "qa.json").write_text('[{"id": "1", "question": "How?", "answer": "So.", "aliases": ["why"], "tags": ["Web"]}, {"id": "2", "question": "why", "answer": "B.", "category": "x"}]')
    pairs = questions.load(spark, f"file://{tmp_path}/qa.json")
    asked = spark.createDataFrame([("HOW?",), ("Why",), ("no",)], "question string")
    assert sorted((r["question"], r["id"] or "") for r in questions.lookup(pairs, asked).collect()) == [("HOW?", "1"), ("Why", "1"), ("no", "")]
    assert questions.listed(pairs, category="general", tag="web").select("id", "total", "has_more").collect()[0] == ("1", 1, False)
    questions.dump(pairs, f"file://{tmp_path}/out")
    assert questions.load(spark, f"file://{tmp_path}/out", lines=True).count() == 2
    doc = questions.as_documents(pairs).filter("path = 'qa://1'").first()
    assert doc["content"] == "Question: How?\n\nAnswer: So." and doc["metadata"] == {"qa_id": "1", "category": "general", "aliases": "why", "tags": "Web"}


def test_stored_vectors(spark, tmp_path):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "vec_id long, embedding array<float>")
    path = f"file://{tmp_path}/v"
    vector_index.save(v, path, "m", 3)
    assert vector_index.load(spark, path, "m", 2, v).count() == 20
    for model, dimension, current in (("other", 2, None), ("m", 3, None), ("m", 2, v.filter("vec_id > 0"))):
        with pytest.raises(ValueError):
            vector_index.load(spark, path, model, dimension, current)
    assert vector_index.migrate(spark, path, f"file://{tmp_path}/w") == 20 and vector_index.diagnostics(spark, f"file://{tmp_path}/w").first()["odd"] == 0


def test_every_earlier_duplicate(spark):
    v = spark.createDataFrame([(i, [1.0, i / 50]) for i in range(40)] + [(40, None), (41, [1.0]), (42, [0.0, 0.0])], "vec_id long, embedding array<float>")
    cos = lambda a, b: (1 + a * b / 2500) / ((1 + a * a / 2500) * (1 + b * b / 2500)) ** 0.5
    expected = {(j, min(i for i in range(j) if cos(i, j) >= 0.99)) for j in range(1, 40) if any(cos(i, j) >= 0.99 for i in range(j))}
    for block in (1024, 7):
        assert {tuple(r) for r in search.earlier_duplicates(v, 0.99, block=block).collect()} == expected


def test_limits_with_gaps(spark):
    import random

    rng = random.Random(4)
    rows, t = [], 0
    for i in range(400):
        t += rng.choice([100_000, 300_000, 900_000, 20_000_000, 70_000_000, 130_000_000])
        rows.append((i, rng.randint(0, 2), t))
    given = spark.createDataFrame([*rows, (900, None, 5), (901, 1, None)], "event_id long, user_id long, t long").select("event_id", "user_id", F.timestamp_micros("t").alias("ts"))
    got = {r["event_id"]: r["allowed"] for r in limits.limited(given, "user_id", 1, 4).collect()}
    for u in range(3):
        state = []
        own = [(i, x) for i, k, x in rows if k == u]
        assert [got[i] for i, _ in own] == limits.decided([x for _, x in own], state, 1, 4)
    assert got[900] is None and got[901] is None and len(got) == 402


def test_cascade(spark):
    """Four counters one after the other over crowded and thin stretches, equal times, a free key, missing keys and times."""
    import random
    from collections import defaultdict

    rng = random.Random(9)
    rows, t = [], 0
    for i in range(1500):
        t += rng.choice([0, 0, 50_000, 100_000, 100_000, 1_000_000, 1_000_000, 3_000_000] if i % 300 < 280 else [61_000_000, 130_000_000])
        rows.append((i, rng.choice([0, 0, 1, 2, 7, None]), t))
    given = spark.createDataFrame([*rows, (9000, 1, None)], "event_id long, user_id long, t long").select("event_id", "user_id", F.timestamp_micros("t").alias("ts")).repartition(5)
    for stages in (limits.STAGES, (limits.Stage("a", 3, 1_000_000, False), limits.Stage("b", 20, 60_000_000, False), limits.Stage("c", 1, 1_000_000, True), limits.Stage("d", 4, 60_000_000, True))):
        held, expected = defaultdict(list), {9000: None}
        for i, user, at in sorted(rows, key=lambda r: (r[2], r[0])):
            verdict = "allowed"
            for s in stages if user != 7 else ():
                if s.keyed and user is None:
                    continue
                state = held[s.name, user if s.keyed else None]
                if sum(x >= at - s.window for x in state) >= s.limit:
                    verdict = s.name
                    break
                state.append(at)
            expected[i] = verdict
        got = {r["event_id"]: r["decision"] for r in limits.cascaded(given, "user_id", stages, free=(7,)).collect()}
        assert got == expected and len(set(got.values())) > 4


def test_limits_stream(spark, tmp_path):
    ev = spark.sql("SELECT id AS event_id, id % 2 AS user_id, timestamp '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 0.2) AS ts FROM range(40)")
    ev.filter("event_id < 20").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    stream = spark.readStream.schema(ev.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for i in range(2):
        if i:
            ev.filter("event_id >= 20").coalesce(1).write.parquet(f"{tmp_path}/in/b")
        q = limits.limited_stream(stream, "user_id", 2, 5).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/marks").trigger(availableNow=True).start()
        q.awaitTermination()
    got = {r["event_id"]: r["allowed"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {r["event_id"]: r["allowed"] for r in limits.limited(ev, "user_id", 2, 5).collect()}


def test_cascade_stream(spark, tmp_path):
    """Two batches on a stream are decided as all events at once; the second meets what the first left."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        ev = spark.sql("SELECT id AS event_id, CASE WHEN id % 7 <> 3 THEN id % 2 END AS user_id, timestamp '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 0.1 + floor(id / 45) * 50) AS ts FROM range(120)")
        stages = (limits.Stage("a", 4, 1_000_000, False), limits.Stage("b", 15, 60_000_000, False), limits.Stage("c", 1, 1_000_000, True), limits.Stage("d", 1, 60_000_000, True))
        (tmp_path / "in").mkdir()
        stream = spark.readStream.schema(ev.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        for i, part in enumerate(("event_id < 50", "event_id >= 50")):
            ev.filter(part).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
            q = limits.cascaded_stream(stream, "user_id", stages).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/marks").trigger(availableNow=True).start()
            q.awaitTermination()
        got = {r["event_id"]: (r["user_id"], r["decision"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
        assert got == {r["event_id"]: (r["user_id"], r["decision"]) for r in limits.cascaded(ev, "user_id", stages).collect()}
        assert {d for _, d in got.values()} == {"a", "b", "c", "d", "allowed"}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_repeated_citations(spark):
    from millrace.operators import retrieval

    answers = spark.createDataFrame([(1, "The river carries stones and water downhill [S1]. Nothing of this is cited anywhere at all.")], "k int, answer string")
    context = spark.createDataFrame([(1, "S1", "unrelated words"), (1, "S1", "river carries stones water downhill")], "k int, citation string, snippet string")
    assert [r["status"] for r in retrieval.grounded_claims(answers, context, "k").orderBy("claim").collect()] == ["grounded", "uncited"]


def test_metadata_of_columns(spark):
    from millrace.operators.retrieval import MetadataFilter, filtered

    d = spark.createDataFrame([(1, "pdf", "a/b", {}), (2, "html", "a/c", {"type": "pdf"})], "k int, kind string, path string, m map<string,string>")
    fields = {"type": "kind", "path": "path"}
    assert [r["k"] for r in filtered(d, "m", [MetadataFilter("document_type", "PDF")], fields).collect()] == [1]
    assert [r["k"] for r in filtered(d, "m", [MetadataFilter("type", "pdf")]).collect()] == [2]
    assert [r["k"] for r in filtered(d, "m", [MetadataFilter("path", "A/", "prefix"), MetadataFilter("type", "html")], fields).collect()] == [2]


def test_reports_and_history(spark, tmp_path):
    log = spark.createDataFrame([("a", "2024-01-01 10:00:00", "up"), ("", "2024-01-02 10:00:00", "down"), ("a", "2024-02-01 10:00:00", "x")], "c string, t string, r string").withColumn("ts", F.col("t").cast("timestamp"))
    assert analytics.between(log, "2024-01-01 10:00:00", "2024-01-02 10:00:00").count() == 2 and analytics.kept_days(log, 10, "2024-02-05 00:00:00").count() == 1
    assert [tuple(r) for r in analytics.feedback_by_category(log, "r", "c").collect()] == [("a", 2, 1, 0)]
    assert analytics.freshness(log.limit(0), "ts", "c", "2024-02-05 00:00:00").first()["freshness"] == 100
    record = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS at, 'p1' AS plan_id, 'me' AS applied_by, true AS success, false AS dry_run, 'ok' AS message, array(named_struct('step', 1, 'change', 'Added', 'tbl', 't', 'name', '', 'risk', 'Safe')) AS steps")
    for day in ("2024-01-02 00:00:00", "2024-01-01 00:00:00"):
        schemas.append_history(record.withColumn("at", F.lit(day).cast("timestamp")), f"file://{tmp_path}/h")
    assert [(str(r["at"])[:10], r["steps"][0]["change"]) for r in schemas.history(spark, f"file://{tmp_path}/h").collect()] == [("2024-01-01", "Added"), ("2024-01-02", "Added")]
    assert spark.range(1).select(T.combined_key(F.lit("a"), F.lit(None)) != T.combined_key(F.lit("a"), F.lit(""))).first()[0]
