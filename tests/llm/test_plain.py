"""Evidence, mixing, fingerprints and automata against plain versions; names that clash; work that is dealt out."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import common, langid, media, mixing, phrases, queries, repeats, similar, simhash, warc

from .fixtures import empty, frame, rows

CLASHES = "own row key id full cut passes edged _mix_source _mix_id _host _n _text _total _row host domain suffix declared total ll ld n_grams fp node keys part copy_ seg anchor first".split()


def test_clashing_names(spark):
    docs = frame(spark).drop("row", "seg").withColumns({c: F.lit(f"mine {c}") for c in CLASHES})
    for made in (mixing.mix(docs), langid.identify(docs), simhash.deduplicate(docs), similar.deduplicate(docs)):
        assert set(docs.columns) <= {*made.columns, "kept"}
        values = made.select(*(c for c in CLASHES if c in docs.columns)).distinct().collect()
        assert [r.asDict() for r in values] == [{c: f"mine {c}" for c in CLASHES}]
        assert made.filter("doc_id = 3").select("text").first()["text"] == dict((r[0], r[1]) for r in rows())[3]


def plain_grams(text):
    """Trigram buckets of the contract: lower-cased words without digits and the like, single spaces, hashed."""
    words = [w for w in (text or "").lower().encode().split() if not re.search(rb"[0-9@=_/\\\\]", w)]
    b = b" " + b" ".join(words) + b" "
    return [((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761 % 2**32) >> 19 for i in range(len(b) - 2)] if words else []


def plain_posteriors(items):
    """items: (text, declared language, host, domain, suffix), as cleaned; (language, posterior, kept) of each."""
    languages = sorted({x[1] for x in items if x[1]})
    counts = {k: Counter() for k in languages}
    for text, declared, *_ in items:
        if declared in counts:
            counts[declared].update(plain_grams(text))
    names = [*languages, "und"]
    sums = {k: sum(c.values()) + 0.5 * 8192 for k, c in counts.items()}

    def likelihood(text):
        grams = plain_grams(text)
        scale = min(1.0, 60 / max(1, len(grams)))
        return [scale * sum(math.log((counts[k][g] + 0.5) / sums[k]) for g in grams) for k in languages] + [-scale * len(grams) * 14.5 * math.log(2)]

    ll = [likelihood(x[0]) for x in items]
    best = [max(range(len(names)), key=lambda i: x[i]) for x in ll]
    whole = Counter(best)
    base = [(whole[i] + 1) / (len(items) + len(names)) for i in range(len(names))]
    by = {key: defaultdict(Counter) for key in (1, 2, 3, 4)}
    for x, i in zip(items, best):
        for key in by:
            by[key][x[key]][i] += 1
    hosts = defaultdict(Counter)
    for x, i in zip(items, best):
        hosts[x[2], x[3]][i] += 1

    def known(key, value):
        return [math.log((by[key][value][i] + 1) / (whole[i] + 2)) for i in range(len(names))] if value is not None else [0.0] * len(names)

    def prior(host, domain):
        if host is None:
            return [math.log(b) for b in base]
        d = by[3][domain] if domain is not None else Counter()
        up = [(d[i] + 20 * b) / (sum(d.values()) + 20) for i, b in enumerate(base)]
        c = hosts[host, domain]
        return [math.log((c[i] + 20 * u) / (sum(c.values()) + 20)) for i, u in enumerate(up)]

    out = []
    for (text, declared, host, domain, suffix), x in zip(items, ll):
        total = [sum(v) for v in zip(x, known(1, declared), known(4, suffix), prior(host, domain))]
        top = max(total)
        p = 1 / sum(math.exp(v - top) for v in total)
        name = names[total.index(top)]
        words = plain_grams(text) or (text or "").split()
        out.append((name, p, bool(words) and name != "und" and p >= 0.5))
    return out


def same(got, expected):
    for (lang, p, kept), (want, q, wanted) in zip(got, expected):
        assert abs(p - q) < 1e-6 and (lang, kept) == (want, wanted)


def test_posteriors_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = queries.op5_langid(spark, sf).orderBy("doc_id").collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(out) == len(texts)
    same([(r["lang_id"], r["posterior"], r["kept"]) for r in out], plain_posteriors([(texts[r["doc_id"]], r["lang"], r["source"] and r["source"].lower(), None, None) for r in out]))


def test_posteriors_of_pages(spark, sf):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = queries.langid_pages(spark, sf).orderBy("page_id").collect()
    assert len(out) == len(pages)
    items = []
    for r in out:
        page = pages[r["page_id"]]
        tag = re.search(r"(?is)<html\b([^>]*)>", page["html"] or "")
        m = re.search(r"""(?is)\s(?:xml:)?lang\s*=\s*["']?([a-z]+)""", tag[1] if tag else "")
        declared = m[1].lower() if m else None
        text = re.sub(r"<[^>]*>", " ", re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", page["html"] or ""))
        for name, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
            text = text.replace(name, c)
        host = (re.match(r"[a-z+]+://([^/:?#]+)", page["url"] or "") or [None, ""])[1].lower()
        code = re.match(r"[a-z+]+://[^/]+/([a-z]{2})(?:/|$)", page["url"] or "")
        end = re.search(r"\.([a-z]{2,})$", host)
        domain = (re.search(r"([^.]+\.[^.]+)$", host) or [None, ""])[1] if "." in host else None
        items.append((text, declared, host, domain, code[1] if code else end[1] if end else None))
    same([(r["lang_id"], r["posterior"], r["kept"]) for r in out], plain_posteriors(items))


@pytest.mark.parametrize("kwargs", [{}, {"budget": 15_000}, {"repetition": 2.0}])
def test_mixing_plainly(spark, kwargs):
    """Weights by a plain bisection; the last pass of a source is the longest prefix of its permutation that fits."""
    out = mixing.mix(frame(spark), **kwargs)
    given = [(r[0], r[1], r[3], len((r[1] or "").encode().split())) for r in rows()]
    total = Counter()
    for *_, source, n in given:
        total[source] += n
    whole = sum(total.values())
    share = {s: n / whole for s, n in total.items() if n}

    def weights(x):
        z = sum(p**x for p in share.values())
        return {s: p**x / z for s, p in share.items()}

    low, high = 0.0, 1.0
    limit = kwargs.get("repetition", mixing.REPETITION)
    for _ in range(60):
        mid = (low + high) / 2
        ratio = [w / share[s] for s, w in weights(mid).items()]
        low, high = (low, mid) if max(ratio) / min(ratio) <= limit else (mid, high)
    got = {r["source"]: r["weight"] for r in out.select("source", "weight").distinct().collect()}
    assert all(abs(got[s] - w) < 1e-6 for s, w in weights(high).items())
    budget = kwargs.get("budget") or whole * max(p / got[s] for s, p in share.items())
    passes = {s: got[s] * budget / total[s] for s in share}
    full = {s: math.floor(round(p, 9)) for s, p in passes.items()}
    ids = spark.createDataFrame(given, "doc_id long, text string, source string, n long").select("*", F.xxhash64("doc_id", "text").alias("id"))
    turn = F.create_map(*(F.lit(v) for s, n in full.items() for v in (s if s is not None else "?", n)))[F.coalesce("source", F.lit("?"))].cast("long")
    hashed = ids.withColumn("h", mixing.permuted(turn, mixing.SEED)).collect()
    expected = Counter()
    for s in share:
        own = sorted((r["h"], r["n"], r["doc_id"], r["text"]) for r in hashed if r["source"] == s) if None not in [r["doc_id"] for r in hashed if r["source"] == s] else sorted(((r["h"], r["n"], r["doc_id"], r["text"]) for r in hashed if r["source"] == s), key=lambda x: x[0])
        room, upto, cut = (passes[s] - full[s]) * total[s], 0, None
        by_hash = defaultdict(int)
        for h, n, *_ in own:
            by_hash[h] += n
        for h in sorted(by_hash):
            upto += by_hash[h]
            if upto > room + 1e-6:
                break
            cut = h
        for h, _, doc_id, text in own:
            n = full[s] + (cut is not None and h <= cut and passes[s] - full[s] > 1e-9)
            if n:
                expected[doc_id, text, s] += n
    found = Counter((r["doc_id"], r["text"], r["source"]) for r in out.collect())
    assert found == expected


def plain_pairs(samples):
    """Peaks and pairs as the documentation says, frame by frame."""
    strongest = []
    for start in range(0, len(samples) - 511, 288):
        x = (samples[start : start + 512].astype(np.float32) - 128) * np.hanning(512).astype(np.float32)
        f = np.fft.rfft(x)
        p = f.real**2 + f.imag**2
        strongest.append([(a + int(p[a:b].argmax()), p[a:b].max()) for a, b in ((1, 17), (17, 65), (65, 129), (129, 257))])
    found = []
    for t, bands in enumerate(strongest):
        for i, (bin_, power) in enumerate(bands):
            before = strongest[t - 1][i][1] if t else -1.0
            after = strongest[t + 1][i][1] if t + 1 < len(strongest) else -1.0
            if power >= before and power > after:
                found.append((t, bin_))
    pairs = []
    for k, (t, b) in enumerate(found):
        for u, c in found[k + 1 : k + 4]:
            if u - t <= 63:
                pairs.append((t, b << 15 | c << 6 | (u - t)))
    return pairs, len(strongest)


def test_fingerprints(spark):
    done = 0
    for r in media.media_features(frame(spark).filter("text IS NULL OR length(text) < 8000")).collect():
        text = next(x[1] for x in rows() if x[0] == r["doc_id"] and len((x[1] or "").encode()) == r["n_bytes"])
        raw = (text or "").encode()
        payload = raw + b"\xff" * (576 if not raw else -len(raw) % 576)
        pairs, n = plain_pairs(np.frombuffer(payload + b"\x80" * media.TAIL, np.uint8))
        assert n == r["n_frames"] and sorted(zip(r["times"], r["codes"])) == sorted(pairs)
        done += 1
    assert done > 40


def test_every_byte_is_in_a_frame():
    for n in (576, 1152, 5760):
        assert (n + media.TAIL - media.FRAME) % media.HOP == 0


def test_automata():
    """Coverage is what the automaton matches: without its patterns nothing goes."""
    words = [f"w{i}" for i in range(20)]
    passage = " ".join(words[2:9]).encode()
    patterns = [(passage, 0, 3, 5), (passage, 3, 4, 9), (b"x y z w", 0, 1, 1)]
    text = [w.encode() for w in ["a", *words[2:9], "x", "y", "z", "w", "x", "y"]]
    machine = phrases.Automaton(patterns, 4)
    for doc_id, spans in ((10, [(1, 8), (8, 12)]), (9, [(1, 7), (8, 12)]), (5, [(8, 12)]), (1, [])):
        s, e = machine.located(text, doc_id)
        covered = set().union(*(range(a, b) for a, b in spans))
        assert set().union(*(range(a, b) for a, b in zip(s.tolist(), e.tolist()))) == covered
    s, e = phrases.Automaton(patterns[2:], 4).located(text, 10)
    assert (s.tolist(), e.tolist()) == ([8], [12])
    assert not len(phrases.Automaton(patterns[2:], 4).located(text[:8], 10)[0])


def test_buckets_by_bytes(spark, monkeypatch):
    """One shuffle partition in the session, yet no bucket over its bound."""
    monkeypatch.setattr(repeats, "BUCKET_KEYS", 500)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        for kind in (repeats.Bytes(50), repeats.Words(13)):
            table = repeats.text_table(frame(spark))
            keys = Counter()
            n = repeats.buckets(table, kind)
            for r in table.filter("not copy and doc_id is not null").collect():
                found = kind.anchors(kind.units(bytes(r["raw"])))
                if found:
                    for k in np.unique(np.concatenate(found[4:])).tolist():
                        keys[k % n] += k != -1
            assert n > 1 and max(keys.values()) <= 2 * 500
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_small_index_of_much_data(spark, monkeypatch):
    monkeypatch.setattr(warc, "TASK_BYTES", 50_000)
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("http://h").alias("url"), F.concat_ws(" ", F.sha2(F.col("id").cast("string"), 512), F.sha2((F.col("id") + 1).cast("string"), 512)).alias("html")).repartition(4)
    index = warc.write(pages)
    tasks = warc.read(index).select(F.spark_partition_id().alias("task")).groupBy("task").count().collect()
    assert len(tasks) >= 8 and max(r["count"] for r in tasks) < 600


def test_scratch(spark):
    with common.scratch(spark):
        df, path = common.materialise(spark.range(5), "test")
        assert df.count() == 5
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)


def test_wide_rows_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 100)
    left, right = spark.range(100), spark.range(50).withColumn("x", F.array_repeat(F.lit(1.5), 40))
    plan = common.join_small(left, right, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan
    assert common.join_small(left, right, "id").count() == 100


@pytest.mark.parametrize("which", ["rows", "empty", "nulls"])
def test_pipeline_on_odd_tables(spark, tmp_path, which):
    """The stages one after the other, on nulls, repeated rows, clashing names and no rows."""
    import corpus_pipeline

    docs = {"rows": frame(spark), "empty": empty(spark), "nulls": frame(spark).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in frame(spark).schema))}[which]
    docs = docs.withColumns({"row_": F.lit(1), "own": F.lit(2), "total": F.lit(3), "weight": F.lit(4), "rest": F.lit(5), "lang_id": F.lit("x")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    given = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        following = stage(spark, given, str(tmp_path))
        assert following.columns == docs.columns, name
        assert {tuple(r) for r in following.select("own", "total", "weight", "rest", "lang_id").distinct().collect()} <= {(2, 3, 4, 5, "x")}
        following.write.parquet(f"{tmp_path}/{name}")
        given = spark.read.parquet(f"{tmp_path}/{name}")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert bool(out) == (which == "rows")
    whole = defaultdict(list)
    for r in out:
        whole[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in whole.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and sum(places[-1]) <= 4096
