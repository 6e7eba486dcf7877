"""Operators over pairs, sources, archives and languages, and the pipeline, against brute force."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from millrace.llm import graph, langid, mixing, phrases, repeats, simhash, suffixes, warc

from .fixtures import empty, frame, prose, rows


def test_triples():
    from itertools import combinations

    assert len(simhash.TRIPLES) == 20
    assert all(any(set(t) <= set(four) for t in simhash.TRIPLES) for four in combinations(range(8), 4))


def plain_simhash(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def plain_near(given):
    prints = [plain_simhash(r[1]) for r in given]
    root = plain_components(prints)
    least = {}
    for r, c in zip(given, root):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    return prints, root, least


def test_simhash(spark):
    given = rows()
    prints, root, least = plain_near(given)
    expected = Counter((r[0], f"{p:016x}", least.get(c)) for r, p, c in zip(given, prints, root))
    assert Counter(map(tuple, simhash.near_duplicates(frame(spark)).collect())) == expected
    kept = simhash.deduplicate(frame(spark))
    assert kept.columns == frame(spark).columns and kept.count() == len(set(root))
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(least.get(c) for c in set(root))
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.deduplicate(empty(spark)).count() == 0


@pytest.mark.parametrize("block", [simhash.BLOCK, 8])
def test_links_of_a_large_group(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for center in list(prints)[:4]:
        for _ in range(60):
            x = center
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    root = plain_components(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {r["fp"]: r["root"] for r in simhash.groups(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    assert len(set(zip(root, (got[p] for p in signed)))) == len(set(root)) == len(set(got.values()))


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 180), rng.randint(100, 180)) for _ in range(60)] + [(500, 500), (7, 3)]
    parent = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in parent.items() if k != v}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_removed(given, width, cut):
    first = {}
    for doc_id, units in given:
        if doc_id is not None:
            for i in range(len(units) - width + 1):
                w = cut(units, i)
                first[w] = min(first.get(w, doc_id), doc_id)
    for doc_id, units in given:
        gone = np.zeros(len(units), bool)
        for i in range(len(units) - width + 1):
            if doc_id is not None and first[cut(units, i)] < doc_id:
                gone[i : i + width] = True
        yield doc_id, units, gone


@pytest.mark.parametrize("hot", [repeats.HOT, 3, 1])
def test_suffixes(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "GATHER", 500)
    expected = Counter()
    for doc_id, raw, gone in plain_removed([(r[0], (r[1] or "").encode()) for r in rows()], 50, lambda u, i: u[i : i + 50]):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0])).astype(int)) == 1)
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        expected[(doc_id, len(raw), int(gone.sum()), len(edges), hashlib.sha256(kept).hexdigest())] += 1
    assert Counter(map(tuple, suffixes.remove_repeats(frame(spark)).collect())) == expected
    assert suffixes.remove_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("hot", [repeats.HOT, 3, 1])
def test_phrases(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(phrases, "PATTERNS", 50)
    expected = Counter()
    for doc_id, words, gone in plain_removed([(r[0], (r[1] or "").encode().split()) for r in rows()], 13, lambda u, i: tuple(u[i : i + 13])):
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        expected[(doc_id, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest())] += 1
    assert Counter(map(tuple, phrases.remove_passages(frame(spark)).collect())) == expected
    assert phrases.remove_passages(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_sorted_suffixes(seed):
    rng = np.random.default_rng(seed)
    n, width = int(rng.integers(1, 400)), int(rng.integers(8, 30))
    raw = bytes(rng.integers(97, 97 + int(rng.integers(1, 5)), n).astype(np.uint8)) + bytes(2 * width + 32)
    text = np.frombuffer(raw, np.uint8)
    wanted = np.flatnonzero(rng.random(n) < 0.6)
    order = suffixes.sorted_suffixes(text, wanted, width).tolist()
    assert sorted(order) == wanted.tolist()
    keys = [raw[i : i + width] for i in order]
    assert keys == sorted(keys)
    prefixes = suffixes.adjacent_prefixes(text, np.array(order, int), width).tolist()[1:]
    assert prefixes == [next((i for i in range(width) if a[i] != b[i]), width) for a, b in zip(keys, keys[1:])]


def test_warc(spark, sf):
    given = [(i, f"http://h/{i}", t) for i, t in enumerate(["<p>a</p>", "b" * 5000, "<p>a</p>", None, "", "é\r\n\r\nWARC/1.0\r\n", "<p>a</p>"])]
    given += [(20, None, "b" * 5000), (None, "http://n", "b" * 5000), (None, "x\ny", "only"), (0, "http://again", "<p>a</p>")]
    pages = spark.createDataFrame([(*g, "x", 1) for g in given], "page_id long, url string, html string, file string, sha int").repartition(3)
    index = warc.write(pages)
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read(index).collect())
    least = {}
    for i, _, t in given:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    expected = Counter()
    for i, _, t in given:
        raw, first = (t or "").encode(), least.get(t or "")
        revisit = first is not None and first != i
        expected[(i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else None)] += 1
    assert got == expected
    some = warc.read(index.filter("page_id = 5")).collect()
    assert [bytes(r["payload"]).decode() for r in some] == ["é\r\n\r\nWARC/1.0\r\n"]
    assert index.filter("offset < 0 or length <= 0").count() == 0 and warc.read(warc.write(pages.limit(0))).count() == 0
    assert [len(x) for x in warc.ranges([("a", 0, 10), ("a", 10, 5), ("a", 10 + warc.GAP * 2, 5), ("b", 0, 5)])] == [2, 1, 1]


def test_mixing(spark):
    own = frame(spark).columns
    for kwargs in ({}, {"budget": 20_000}, {"repetition": None, "entropy": 0.95}):
        got = mixing.mix(frame(spark), **kwargs)
        assert got.columns == [*own, "copy", "n_tokens", "weight", "position"]
        out = got.collect()
        total, weight, passed = Counter(), {}, Counter()
        for r in rows():
            total[r[3]] += len((r[1] or "").encode().split())
        for r in out:
            weight[r["source"]] = r["weight"]
            passed[r["source"]] += r["n_tokens"]
            assert 0 <= r["position"] < 1
        assert abs(sum(weight.values()) - 1) < 1e-9
        seen = Counter((r["doc_id"], r["text"], r["copy"]) for r in out)
        once = Counter((r[0], r[1]) for r in rows())
        assert all(n == once[k[:2]] for k, n in seen.items())
        ratios = [weight[s] / (total[s] / sum(total.values())) for s in total]
        if kwargs.get("repetition", 1):
            assert max(ratios) / min(ratios) <= mixing.REPETITION * (1 + 1e-6)
            assert max(ratios) / min(ratios) > mixing.REPETITION * 0.999
        if "entropy" in kwargs:
            h = -sum(w * np.log(w) for w in weight.values())
            assert abs(h - 0.95 * np.log(len(weight))) < 1e-4 or -sum(t / sum(total.values()) * np.log(t / sum(total.values())) for t in total.values()) > 0.95 * np.log(len(weight))
        budget = kwargs.get("budget")
        if budget is None:
            assert {(r[0], r[1]) for r in rows()} == {k[:2] for k in seen}
            budget = max(total[s] / weight[s] for s in total)
        longest = max(len((r[1] or "").encode().split()) for r in rows())
        for s in total:
            assert passed[s] <= weight[s] * budget + 1e-6 * budget and passed[s] > weight[s] * budget - longest
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.mix(frame(spark).filter("source = 'big'")).count() == frame(spark).filter("source = 'big'").count()


def test_language(spark):
    rng = random.Random(2)
    words = {"en": "the of and to in is that it was for on are with they".split(), "de": "der die und das ist nicht mit für auf eine dem sich".split(), "fr": "le la les des est une pour dans que qui sur avec pas".split()}
    given = []
    for i in range(300):
        lang = rng.choice(list(words))
        declared = None if i % 3 == 0 else rng.choice(list(words)) if i % 20 == 1 else lang
        given.append((i, prose(rng, rng.randint(3, 60), words[lang]), declared, f"{lang}.example.{lang}", lang, True))
    given += [(1000, None, None, None, "und", None), (1001, " \n", "en", "x", "und", None), (1002, "\x01\x07\x7f\x02\x13\x11\x0f" * 20, None, None, "und", None)]
    docs = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, truth string, kept boolean")
    got = langid.identify(docs)
    assert got.columns == ["doc_id", "text", "lang", "source", "truth", "lang_id", "posterior", "kept"]
    out = got.collect()
    assert len(out) == len(given)
    real = [r for r in out if r["doc_id"] < 1000]
    assert np.mean([r["lang_id"] == r["truth"] for r in real if r["lang"] is None]) > 0.97  # not used to fit
    assert all(r["kept"] for r in real) and not any(r["kept"] for r in out if r["doc_id"] >= 1000)
    assert langid.identify(frame(spark)).count() == len(rows()) and langid.identify(empty(spark)).count() == 0


def plain_similar(given):
    """Least doc_id of each group linked at a five-word similarity of 0.8."""
    sets = []
    for _, text in given:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {b" ".join(w)})
    group = list(range(len(given)))
    for i in range(len(given)):
        for j in range(i):
            if group[i] != group[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                group = [group[j] if x == group[i] else x for x in group]
    return [min(d for (d, _), g in zip(given, group) if g == k) for k in set(group)]


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    given = docs.collect()
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language ID"](spark, docs, sf)
    assert known.columns == docs.columns and known.count() >= 0.95 * len(given)
    near = stages["near-duplicates by MinHash bands"](spark, docs, sf).collect()
    assert sorted(r["doc_id"] for r in near) == sorted(plain_similar([(r["doc_id"], r["text"]) for r in given]))
    clean = stages["PII"](spark, docs, sf)
    assert clean.columns == docs.columns and clean.count() == len(given) and clean.filter("text rlike '[a-z]@[a-z]+[.][a-z]'").count() == 0
    mixed = stages["mixing sources to target weights"](spark, docs, sf)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.select("doc_id").collect()} == {r["doc_id"] for r in given}
    assert corpus_pipeline.run(spark, sf).count() > 0
    by = defaultdict(int)
    for r in corpus_pipeline.run(spark, sf).collect():
        by[r["sequence_id"]] += r["length"]
    assert max(by.values()) <= 4096


def test_sql(spark, sf):
    import glob
    import os

    import duckdb

    from millrace.llm import queries

    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, sf)
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert Counter(map(tuple, df.select(names).collect())) == Counter(cur.fetchall()), name


def jaccard(a, b):
    sets = []
    for text in (a, b):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {b" ".join(w)})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def edited(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.random()}"
    return words


@pytest.mark.parametrize("block", [1024, 4])
def test_similar(spark, monkeypatch, block):
    """The stage keeps one document of each group linked at five-word similarity 0.8, scattered edits and chains included."""
    import corpus_pipeline
    from millrace.llm import similar

    monkeypatch.setattr(similar, "BLOCK", block)
    rng = random.Random(8)
    given = [(r[0], r[1]) for r in rows()]
    for k in range(25):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(500)]
        given += [(20_000 + 100 * k + n, " ".join(edited(rng, base, n))) for n in (0, 4, 7, 10, 11, 14, 60)]
    expected = list(range(len(given)))
    for i in range(len(given)):
        for j in range(i):
            if expected[i] != expected[j] and jaccard(given[i][1], given[j][1]) >= 0.8:
                expected = [expected[j] if x == expected[i] else x for x in expected]
    least = {}
    for (doc_id, _), c in zip(given, expected):
        least[c] = min(least.get(c, (True, 0)), (doc_id is None, doc_id or 0))
    docs = spark.createDataFrame([(*g, "en", "s", 1) for g in given], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = dict(corpus_pipeline.STAGES)["near-duplicates by MinHash bands"](spark, docs, "")
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(None if none else i for none, i in least.values())
    assert similar.deduplicate(empty(spark)).count() == 0


def test_many_languages(spark):
    """Each of 200 declared languages keeps its clean documents, however many documents of another there are, and its model has a bounded size."""
    rng = random.Random(4)
    registered = langid.languages_of(spark)
    codes = ["fil", "haw", "fi", "ha", *sorted(set(registered.values()) - {"fil", "haw", "fi", "ha"})][:200]
    assert len(codes) == 200 and len(set(registered.values())) < 1000
    words = {c: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 6))) for _ in range(25)] for c in codes}
    given = [(c, f"{c}-XX" if i % 2 else c.upper(), " ".join(rng.choices(words[c], k=40))) for c in codes for i in range(8)]
    given += [("fi", "fin" if i % 2 else "fi", " ".join(rng.choices(words["fi"], k=40))) for i in range(9000)]
    docs = spark.createDataFrame(given, "truth string, lang string, text string").withColumn("source", langid.F.lit(None).cast("string")).repartition(4)
    model = langid.fit(langid.inputs(docs, "text", "lang", None, None))
    assert model.by_bucket.nbytes == 201 * 8192 * 8
    out = langid.identify(docs).filter("truth <> 'fi'").collect()
    assert len(out) == 8 * 199 and all(r["kept"] and r["lang_id"] == r["truth"] for r in out)


def letters(rng, alphabet, n=60):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(n))


def judged(spark, given):
    docs = spark.createDataFrame([(i, lang, letters(random.Random(i), alphabet)) for i, (lang, alphabet) in enumerate(given)], "doc_id long, lang string, text string")
    return [(r["lang_id"], r["kept"]) for r in langid.identify(docs.withColumn("source", langid.F.lit("s"))).orderBy("doc_id").collect()]


def test_few_documents(spark):
    """A language of four documents, or of one, is as much a language as one of thirty."""
    given = [("fi", "abcdefg")] * 30 + [("sv", "hijklmn")] * 30 + [("cs", "opqrst")] * 4 + [("da", "uvwxyz")]
    assert judged(spark, given) == [(lang, True) for lang, _ in given]


def test_junk_tags(spark):
    """Names and other codes are the language they stand for; what is no language is undeclared, and never a result."""
    given = [("en", "abcdefg")] * 20 + [("english", "abcdefg")] * 25 + [("ENG", "abcdefg")] * 3 + [("de", "hijklmn")] * 20
    given += [("unknown", "abcdefg")] * 20 + [("none", "hijklmn")] * 8 + [("zxx", "opqrst"), ("xxx", "opqrst"), ("n/a", "opqrst")] * 4
    out = judged(spark, given)
    assert out[:48] == [("en", True)] * 48 and out[48:68] == [("de", True)] * 20
    assert out[68:88] == [("en", True)] * 20 and out[88:96] == [("de", True)] * 8
    assert all(lang in ("en", "de", "und") and (lang != "und" or not kept) for lang, kept in out)


def test_declared_codes(spark):
    given = {"en-US": "en", " DE_at ": "de", "deu": "de", "ger": "de", "German": "de", "english": "en", "fil": "fil", "haw": "haw", "iw": "he", "zh-Hant-TW": "zh", "und": None, "": None, "12": None, None: None}
    given |= {"unknown": None, "none": None, "xq": None, "x-private": None, "art-lojban": None, "english-speaking": None}
    docs = spark.createDataFrame([(k, "x") for k in given], "lang string, text string")
    assert {r["own"]["lang"]: r["declared"] for r in langid.inputs(docs, "text", "lang", None, None).collect()} == given


PAGES = ['<html lang="de">', "<html lang='de'>", "<html lang=de>", '<HTML LANG="de-AT">', '<html xml:lang="de" class="x">', "<html\nclass='y'\n lang = 'de' >", '<!doctype html><html dir="ltr" lang="deu">']
NO_PAGES = ["<html>", '<html data-lang="de">', '<html hreflang="de">', "<p lang='de'>", "", '<html lang="">', "<htmlx lang='de'>"]


def test_declared_pages(spark, tmp_path):
    """lang in every way of writing it; entities are decoded, so they aren't words."""
    from millrace.llm import queries

    body = "<p>Wir gehen &quot;heute&quot; &amp; morgen durch den Wald</p><script>var x = 1</script>"
    rows = [(i, f"http://h{i}.example/", html + body) for i, html in enumerate(PAGES + NO_PAGES)] + [(90, None, None), (91, "x", "<html lang='de'></html>"), (92, "http://a/", "&quot;&amp;")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = {r["page_id"]: r for r in queries.langid_pages(spark, str(tmp_path)).collect()}
    assert len(out) == len(rows)
    for i in range(len(PAGES)):
        assert out[i]["declared"].lower()[:2] == "de" and (out[i]["lang_id"], out[i]["kept"]) == ("de", True)
    for i in range(len(PAGES), len(PAGES + NO_PAGES)):
        assert not out[i]["declared"]
    assert not any(out[i]["kept"] for i in (90, 91))
