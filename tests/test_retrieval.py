"""Retrieval, sections and text functions on small hand-made rows."""

import hashlib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import analytics, documents, retrieval
from millrace.operators.retrieval import MetadataFilter


def value(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


def test_terms(spark):
    assert value(spark, T.safe_term, "  Über uns/a.B! ") == "ber_uns/a.b" and value(spark, T.safe_term, "!!") == "empty" and value(spark, T.safe_term, "a_ b _c") == "a_b__c"
    assert value(spark, T.word_parts, "fooBar_baz-X foo") == ["bar", "baz", "foo"] and value(spark, T.word_parts, "") == []
    assert value(spark, T.cjk_bigrams, "日本語 x 字") == ["字", "日本", "本語"] and value(spark, T.cjk_bigrams, "none") == [] and value(spark, T.cjk_bigrams, None) is None
    assert value(spark, T.question_terms, "What is the Spark, spark plan?") == ["spark", "plan"]
    assert T.query_terms("parseHTTPRequest values src/main.cpp")[:3] == ["parsehttprequest", "values", "value"] and {"parse", "http", "request", "main", ".cpp"} <= set(T.query_terms("parseHTTPRequest src/main.cpp"))


def test_places(spark):
    found = lambda t: [tuple(r) for r in value(spark, lambda c: T.match_places(c, "aa"), t)]
    assert found("aaa\nxAAy") == [(1, 0), (1, 1), (2, 1)] and found("") == [] and found("b") == []


def test_hash(spark):
    def expected(text):
        h = 5381
        for b in text.encode():
            h = (h * 33 + b) % 2**64
        return format(h, "X").lower()

    for text in ("", "a", "question|answer with some more letters to wrap around", "Ünïcode"):
        assert value(spark, T.shift_add_hash, text) == expected(text)


META = {"chunk_page_start": "3", "chunk_page_end": "5", "Lang": "DE", "n": "7", "chunk_row_start": "x", "blank": " "}


@pytest.mark.parametrize("f,expected", [
    (MetadataFilter("page", "4"), True), (MetadataFilter("page", "6"), False), (MetadataFilter("page", "x"), False), (MetadataFilter("row", "1"), False), (MetadataFilter("LANG", "de"), True),
    (MetadataFilter("n", "7.0", "gte"), True), (MetadataFilter("n", "6", "<="), False), (MetadataFilter("Lang", "1", "gte"), False), (MetadataFilter("none", "", "exists"), False),
    (MetadataFilter("blank", "", "exists"), True), (MetadataFilter("blank", "", "not_empty"), False), (MetadataFilter("lang", "d", "prefix"), True), (MetadataFilter("lang", "E", "contains"), True),
    (MetadataFilter("none", "x", "contains"), False), (MetadataFilter("lang", "de", "unheard"), True), (MetadataFilter(""), True), (MetadataFilter("none"), True),
])
def test_metadata_filters(spark, f, expected):
    df = spark.createDataFrame([(META,)], "m map<string,string>")
    assert df.select(retrieval.filter_condition(F.col("m"), f).alias("x")).first()["x"] is expected


def test_sections(spark):
    rows = [(1, "\n# A\nx\n## B\n"), (2, "pre\n# A"), (3, ""), (4, None), (5, "plain\n\nlines\n"), (6, "# A\n# B")]
    got = documents.sections(spark.createDataFrame(rows, "id int, text string"), "id", "text", documents.HEADINGS["markdown"]).orderBy("id", "section").collect()
    assert [(r["id"], r["start"], r["title"], r["content"]) for r in got] == [
        (1, 0, "# A", "\n# A\nx"), (1, 3, "## B", "## B"), (2, 0, "pre", "pre"), (2, 1, "# A", "# A"), (5, 0, "plain", "plain\n\nlines"), (6, 0, "# A", "# A"), (6, 1, "# B", "# B"),
    ]
    code = spark.createDataFrame([(1, "import x\nclass A:\n  y = 1\n  def f(self):\n    pass\nfunc main() {\n}")], "id int, text string")
    assert [r["title"].strip() for r in documents.sections(code, "id", "text", documents.HEADINGS["code"]).orderBy("section").collect()] == ["import x", "class A:", "def f(self):", "func main() {"]


def test_pages_and_rows(spark):
    df = spark.createDataFrame([(1, "Page 1: one\f \fthree"), (2, None)], "id int, text string")
    assert [tuple(r) for r in documents.pages(df, "id", "text").collect()] == [(1, 1, "one"), (1, 3, "three")]
    df = spark.createDataFrame([(1, "Row 1: a\nSheet: S2\nRow 2: b\nnote\n Row 3: c\nSheet: S3\nRow 4: d"), (2, ""), (3, None)], "id int, text string")
    assert [tuple(r) for r in documents.sheet_rows(df, "id", "text").orderBy("row").collect()] == [(1, "Sheet", 1, "Row 1: a"), (1, "S2", 2, "Row 2: b"), (1, "S2", 3, "Row 3: c"), (1, "S3", 4, "Row 4: d")]
    assert documents.token_budget(220, 0, 100) == 100 and documents.token_budget() == 1


def test_grounding(spark):
    said = "The engine reads parquet files quickly [S1]. Unrelated words about cooking pasta well [S2]. Nothing is cited for this long claim."
    answers = spark.createDataFrame([(1, said), (2, "Short."), (3, "The engine reads parquet files [S1]"), (4, "The engine reads parquet files [S1]"), (5, None)], "id int, answer string")
    context = spark.createDataFrame([(1, "S1", "an ENGINE that reads parquet files"), (1, "S2", "quite other matters"), (2, "S1", "x"), (3, "S1", "the engine reads parquet files"), (5, "S1", "y")], "id int, citation string, snippet string")
    got = {(r["id"], r["claim"]): r["status"] for r in retrieval.grounded_claims(answers, context, "id").collect()}
    assert got == {(1, 0): "grounded", (1, 1): "unsupported", (1, 2): "uncited", (3, 0): "grounded", (4, 0): "unsupported"}
    verdicts = {r["id"]: r["verdict"] for r in retrieval.grounding(answers, context, "id").collect()}
    assert verdicts == {1: "unsupported_claims", 2: "no_claims", 3: "grounded", 4: "no_context", 5: "no_claims"}


def test_embeddings(spark):
    docs = spark.createDataFrame([(1, "spark plans spark"), (2, "plans joins"), (3, ""), (4, None), (5, "joins")], "id long, text string")
    norms = {r["id"]: r["n"] for r in retrieval.hashed_embeddings(docs, "id", "text").groupBy("id").agg(F.sum(F.col("weight") * F.col("weight")).alias("n")).collect()}
    assert set(norms) == {1, 2, 5} and all(abs(n - 1) < 1e-9 for n in norms.values())
    wanted, held = spark.createDataFrame([(1, "a"), (2, "b")], "id int, hash string"), spark.createDataFrame([(1, "a", [1.0]), (2, "old", [2.0])], "id int, hash string, embedding array<double>")
    assert {tuple(r) for r in retrieval.reuse_counts(wanted, held, ["id", "hash"]).collect()} == {("reused", 1), ("generated", 1), ("stale", 1)}


@pytest.mark.parametrize("common", [0, 3, 10**9])
def test_embeddings_by_hand(spark, monkeypatch, common):
    """Words weighed beside their document or by a join give the same; rows of one key and length are one document, rows without a key only count
    in frequencies, and the words of single documents aren't shuffled by their document."""
    monkeypatch.setattr(retrieval, "COMMON", common)
    texts = [(i, f"alpha beta{i % 3} gamma{i} alpha call{i % 2}(x) beta{i % 5}") for i in range(40)]
    texts += [(7, "alpha alpha delta beta1"), (50, "omega alpha"), (50, "omega omega"), (50, "alpha beta1 beta1"), (None, "alpha omega"), (60, ""), (61, None)]
    parsed = [(k, [w for w in re.split("[^a-z0-9_]+", (t or "").lower()) if len(w) >= 3], re.findall(r"(call\d)\(", t or "")) for k, t in texts]
    df, q, sums = Counter(w for _, words, named in parsed for w in {*words, *named}), Counter(), Counter()
    for k, words, _ in parsed:
        if k is not None:
            q.update((k, len(words), w) for w in words)
    for (k, n, w), c in q.items():
        sums[k, int(hashlib.md5(w.encode()).hexdigest()[:2], 16)] += c * c / n * math.log(len(texts) / (1 + df[w]))
    norm = Counter()
    for (k, _), w in sums.items():
        norm[k] += w * w
    docs = spark.createDataFrame(texts, "id long, text string").repartition(3)
    found = retrieval.hashed_embeddings(docs, "id", "text")
    rows = found.collect()
    got = {(r["id"], r["slot"]): r["weight"] for r in rows}
    expected = {(k, s): w / norm[k] ** 0.5 for (k, s), w in sums.items() if norm[k] > 0}
    assert len(rows) == len(got) and got.keys() == expected.keys() and all(abs(got[k] - w) < 1e-9 for k, w in expected.items())
    single = retrieval.hashed_embeddings(docs.filter("id < 7"), "id", "text")
    assert not re.search(r"hashpartitioning\(id#\d+L, n#", single._jdf.queryExecution().toString())


def test_log_reports(spark):
    log = spark.createDataFrame([(i, float(i)) for i in range(10)], "id long, v double")
    kept = lambda most: sorted(r["id"] for r in analytics.pruned(log, [F.desc("id")], most).collect())
    assert kept(10) == list(range(10)) and kept(6) == [7, 8, 9]
    one = analytics.load_test(log.withColumn("k", F.lit("a")), "k", F.col("v")).first()
    assert (one["median"], one["p90"], one["p99"], one["mean"]) == (5.0, 9.0, 9.0, 4.5)
    empty = log.filter("id < 0")
    assert analytics.pruned(empty, [F.desc("id")]).count() == 0 and analytics.load_test(empty.withColumn("k", F.lit("a")), "k", F.col("v")).count() == 0
