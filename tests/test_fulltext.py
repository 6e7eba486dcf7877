"""A stored full-text index: the k best exactly, from part of the blocks; prefixes from ranges of a dictionary."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import fulltext


@pytest.fixture(scope="module")
def docs(spark):
    """Terms of every frequency; some stretches of documents are about something, others aren't; two of a tie."""
    rng = random.Random(1)
    words = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(3000):
        ws = [rng.choice(words) for _ in range(rng.randint(5, 60))] + (["common"] if rng.random() < 0.9 else [])
        if 1000 <= i < 1100:
            ws += ["topic"] * rng.randint(1, 9) + ["subject"] * rng.randint(0, 3)
        elif rng.random() < 0.02:
            ws += ["topic"] + ["filler"] * 200
        rng.shuffle(ws)
        rows.append((i, " ".join(ws), f"src{i % 7}"))
    rows += [(5000, "topic topic subject", "x"), (5001, "topic topic subject", "x"), (5002, None, None), (5003, "", "y"), (5004, "a of", "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(fulltext, "STRETCH", 16)
    monkeypatch.setattr(fulltext, "FIRST_STRETCHES", 4)
    monkeypatch.setattr(fulltext, "MORE_STRETCHES", 2)


def test_top(spark, docs, tmp_path, small):
    path = f"file://{tmp_path}/index"
    fulltext.store(docs, path, "doc_id", "text", {"source": "source"}, parts=4)
    for pairs in ([("", "topic"), ("", "subject")], [("", "common")], [("", "word7"), ("", "common"), ("QSOURCE", "src3")], [("", "word1"), ("", "none")]):
        every = fulltext.scored(docs, "doc_id", "text", pairs, {"source": "source"}).orderBy(F.desc("score"), "doc_id")
        for k in (1, 10, 4000):
            expected = [(r["doc_id"], round(r["score"], 9)) for r in every.limit(k).collect()]
            got = [(r["key"], round(r["score"], 9)) for r in fulltext.top(spark, path, pairs, k).collect()]
            assert sorted(got) == sorted(expected) or [s for _, s in got] == pytest.approx([s for _, s in expected])
    read: list[int] = []
    fulltext.top(spark, path, [("", "topic"), ("", "subject")], 10, read).collect()
    *rounds, whole = read
    assert whole > 40 and sum(rounds) < whole / 2
    # only postings of the query's terms are met, and they are found by folder and by the files' statistics
    plan = fulltext.stored(spark, f"{path}/blocks").filter(fulltext._wanted([("", "topic")]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "topic" in plan.split("PushedFilters")[1]
    assert spark.read.parquet(f"{path}/terms").filter("prefix = '' AND term = 'common'").first()["df"] == docs.filter("text like '%common%'").count()


def test_prefixes(spark, docs, tmp_path, small):
    path = f"file://{tmp_path}/words"
    fulltext.store_words(docs, path, "doc_id", ["text", "source"], parts=6)
    for query in ("word29", "Topic sub", "word1 src3 comm", "to of", "nothing", "", "src word2 word3"):
        assert sorted(r["key"] for r in fulltext.with_prefixes(spark, path, query).collect()) == sorted(r["doc_id"] for r in docs.filter(fulltext.has_prefixes([F.col("text"), F.col("source")], query)).select("doc_id").collect())
    held = spark.read.parquet(path)
    files = held.select("_metadata.file_path").distinct().count()
    some = held.filter(F.startswith("word", F.lit("topi")))
    assert "StringStartsWith" in some._jdf.queryExecution().toString()
    assert some.select("_metadata.file_path").distinct().count() < files


def test_scans_once(spark, sf):
    """Texts are parsed in one scan, whatever the query asks for."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = fulltext.scored(docs, "doc_id", "text", [("", "that"), ("QSOURCE", "src1")], {"source": "source"})
    assert "documents.parquet" not in out._jdf.queryExecution().optimizedPlan().toString() and out.count() > 0


def test_filtered_floor(spark):
    from millrace.operators import search

    docs = spark.createDataFrame([(i, "common " * 50 + "x" * 5) for i in range(40)], "doc_id long, text string")
    assert search.bm25(docs, "doc_id", "text", ["common"]).count() == 0
    assert {r["score"] for r in search.bm25(docs, "doc_id", "text", ["common"], filtered=True).collect()} == {0.12}
    assert search.bm25(docs, "doc_id", "text", ["absent"], filtered=True).count() == 0


def test_fields_of_rows_without_terms(spark, tmp_path):
    """Rows whose text has no term aren't found, but a term of their fields is less rare."""
    from math import log

    docs = spark.createDataFrame([(1, "alpha beta", "s"), (2, "alpha gamma delta", "t"), (3, None, "s"), (4, "a of", "s"), (5, "beta", "u")], "doc_id long, text string, source string")
    pairs = [("QSOURCE", "s"), ("", "alpha")]
    part = lambda df, wdf, size: log((3 - df + 0.5) / (df + 0.5) + 1) * wdf * 2.5 / (wdf + 1.5 * (0.25 + 0.75 * size / 2))
    score = {1: part(3, 4, 2) + part(2, 1, 2), 2: part(2, 1, 3)}
    expected = {i: s / max(score.values()) for i, s in score.items()}
    assert {r["doc_id"]: r["score"] for r in fulltext.scored(docs, "doc_id", "text", pairs, {"source": "source"}).collect()} == pytest.approx(expected)
    path = f"file://{tmp_path}/index"
    fulltext.store(docs, path, "doc_id", "text", {"source": "source"})
    assert {r["key"]: r["score"] for r in fulltext.top(spark, path, pairs, 10).collect()} == pytest.approx(expected)


def test_terms_counted_in_batches(spark):
    """What is counted in batches is what the array functions find."""
    from collections import Counter

    from millrace.functions import text as T

    texts = [None, "", "The the a_b x9 foo(1) classes class Bar (y) if (z) Foo (foo", "\u0130stanbul \u212aelvin na\u00efve caf\u00e9s straße", "class  this(that) DEF_1\u000b(2) ab abc", "кошки house 東京 x²y ٣٤٥"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    c = F.col("text")
    got = docs.select("id", T.term_counts(c).alias("a"), T.term_counts(c, ["foo", "the", "abc"]).alias("b"), T.word_counts(c).alias("w"), T.tokens(c).alias("t"), T.identifiers(c).alias("i"), fulltext.stemmed(c, F.lit("none")).alias("s")).collect()
    for r in got:
        t, i = Counter(r["t"] or []), Counter(r["i"] or [])
        assert (r["a"]["words"], r["a"]["names"]) == (r["b"]["words"], r["b"]["names"]) == (t.total(), i.total())
        assert {(x["term"], x["n"], x["words"]) for x in r["a"]["terms"]} == {(w, t[w] + 2 * i[w], t[w]) for w in t | i}
        assert {x["term"]: x["n"] for x in r["b"]["terms"]} == {w: t[w] + 2 * i[w] for w in ("foo", "abc") if t[w] + i[w]}
        assert {x["term"]: x["n"] for x in r["w"]} == Counter(r["s"] or [])


@pytest.mark.parametrize("common", [0, 100_000])
def test_stems_from_a_dictionary(spark, sf, monkeypatch, common):
    """Each different word is stemmed once; the stems of every text are those of its own words."""
    from collections import Counter

    monkeypatch.setattr(fulltext, "COMMON_ROWS", common)
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).withColumn("len", F.lit(1))
    language = fulltext.T.stemming_language(F.col("text"), F.col("lang"))
    expected = {r["doc_id"]: Counter(r["s"] or []) for r in docs.select("doc_id", fulltext.stemmed(F.col("text"), language).alias("s")).collect()}
    got = {i: Counter() for i in expected}
    for r in fulltext.stem_postings(docs, "doc_id", "text", "lang", ("len",)).collect():
        got[r["doc_id"]][r["term"]] += r["wdf"]
    assert got == expected
