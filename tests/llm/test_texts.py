"""Packing, media, personal data and quality rules against plain versions of their contracts."""

import hashlib
import io
import re
import wave
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import media, packing, pii, quality
from millrace.llm.queries import tokenizer_path

from .fixtures import empty, frame, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_pack(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    expected = Counter()
    for doc_id, text, *_ in rows():
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            block = ids[at : at + 4096]
            expected[(doc_id, piece, at, len(block), zlib.crc32(np.asarray(block, "<u4").tobytes()))] += 1
    got = packing.pack(frame(spark), tokenizer_path()).collect()
    assert Counter(tuple(r)[:5] for r in got) == expected
    check_places(got, 4096)
    few = packing.pack(frame(spark), tokenizer_path(), capacity=100, keep_ids=True).collect()
    check_places(few, 100)
    assert all(len(r["ids"]) == r["length"] and zlib.crc32(np.asarray(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in few)
    assert packing.pack(empty(spark), tokenizer_path()).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_word_ids(sf, name):
    import duckdb
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    tok = Tokenizer.from_file(path)
    texts = [r[0] for r in duckdb.sql(f"select text from '{sf}/documents.parquet'").fetchall()]
    texts += ["The. (A) 42. é. É, … a…. it's. IT'S! 'S. x|y| <|endoftext|> <|ENDOFTEXT|>. A\u0301. \u0301. K. \u212a. 1st, ½. .. ,,a, \x85\xa0b. ǅ. ﬁ. İ.", "don't! 'll: 's; we'RE, 7? a.b.c. \x1ca\x1f"]
    known = packing.WordIds(path)
    assert known.by_word == (name == "word_bpe_49k.json")
    for text in texts:
        assert np.frombuffer(known.ids(text.encode()), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def check_places(got, capacity):
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    gaps = []
    for n in sorted((r["length"] for r in got), reverse=True):  # one document after the other
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(capacity - n)
        else:
            gaps.remove(fit)
            gaps.append(fit - n)
    assert len(bins) == len(gaps)


@pytest.mark.parametrize("seed", range(5))
def test_sweep(seed):
    rng = np.random.default_rng(seed)
    counts = {int(n): int(rng.integers(1, 50)) for n in rng.integers(1, 65, 20)}
    runs, opened = packing.sweep(counts, 64)
    places = [(first + j // each, at + j % each * length, length) for length, _, n, first, each, at in runs.tolist() for j in range(n)]
    assert Counter(x[2] for x in places) == Counter(counts)
    by = defaultdict(list)
    for b, at, n in places:
        by[b].append((at, n))
    assert set(by) == set(range(opened))
    for x in by.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:])) and sum(x[-1]) <= 64


def test_media(spark):
    got = media.media_digest(frame(spark)).collect()
    stored = {r["doc_id"]: r["media"] for r in media.encode(frame(spark)).collect()}
    expected, features = Counter(), defaultdict(set)
    for doc_id, text, *_ in rows():
        raw = (text or "").encode()
        payload = raw + b"\xff" * (576 if not raw else -len(raw) % 576)
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setparams((1, 1, 8000, 0, "NONE", ""))
            w.writeframes(payload)
        wav = out.getvalue()
        expected[(doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(wav), hashlib.sha256(wav).hexdigest())] += 1
    names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")
    assert Counter(tuple(r[n] for n in names) for r in got) == expected
    for r in got:
        features[r["payload_sha256"]].add(r["feature"])
    assert all(len(x) == 1 for x in features.values()) and len({min(x) for x in features.values()}) > 30
    assert stored and media.media_digest(empty(spark)).count() == 0


def test_media_tone_and_blocks(monkeypatch):
    tone = (128 + 100 * np.sin(2 * np.pi * 64 / 512 * np.arange(5760))).astype(np.uint8)
    _, bins, _ = media.peaks(tone)
    assert 64 in set(bins.tolist()) and all(b == 64 for b in bins.tolist() if 17 <= b < 65)
    noise = np.random.default_rng(1).integers(0, 256, 50_000).astype(np.uint8)
    whole = media.pairs(noise)
    monkeypatch.setattr(media, "BLOCK", 7)
    assert all(np.array_equal(a, b) for a, b in zip(whole, media.pairs(noise)))


def plain_spans(text):
    spans = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            spans.append(("card", *m.span()))
    spans += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return spans


def test_pii(spark):
    got = pii.detect(frame(spark)).collect()
    expected = Counter()
    for doc_id, text, *_ in rows():
        if text and len(text) >= 20_000 and not text.strip("x7"):
            spans = []  # the plain patterns are quadratic on these
        else:
            spans = plain_spans(text or "")
        expected[(doc_id, *(sum(k == x[0] for x in spans) for k in pii.BASE), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest())] += 1
    assert Counter(tuple(r)[:6] for r in got) == expected
    plain = defaultdict(list)
    for doc_id, text in {(r[0], r[1] or "") for r in rows()}:
        if not (len(text) >= 20_000 and not text.strip("x7")):
            plain[doc_id].append(set(plain_spans(text)))
    for r in got:
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r["spans"].split(",") if x)]
        assert sorted(spans, key=lambda x: (pii.KINDS.index(x[0]), x[1])) == spans and len(set(spans)) == len(spans)
        base = [[x for x in spans if x in own] for own in plain[r["doc_id"]]]
        assert not base or any(hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in x).encode()).hexdigest() == r["base_sha256"] for x in base)
    assert pii.detect(empty(spark)).count() == 0
    assert pii.redacted("call +49 30 1234567 or a@b.c", pii.base_spans("call +49 30 1234567 or a@b.c")[0]) == "call <phone> or <email>"
    clean = pii.redact(frame(spark))
    assert clean.columns == frame(spark).columns and clean.filter("text like '%4111 1111 1111 1111%'").count() == 0
    assert clean.filter("text is null").count() == frame(spark).filter("text is null").count()


@pytest.mark.parametrize("text", ["a@b.c.d@e.f", "a@@b.c", "x.y@z", "1.2.3.4.5.6.7.8", "01.002.0003.4", "999.1.1.1 1.2.3.4", "a@b.c-@d.e", "é@a.b ü.x@a.bé", "+1+49 30 1234567 8", "4111-1111-1111-1111-", "0" * 16, "1.2.3.400.5.6.7"])
def test_base_spans(text):
    assert sorted(pii.base_spans(text)[0]) == sorted(plain_spans(text))


def test_span_model():
    strict = pii.code_of("phone", [0, 0, 1, 0, 1], "(555) 123-4567")
    weak = pii.code_of("phone", [0, 0, 0, -1, 1], "555 123-4567")
    model = pii.SpanModel({pii.code_of("email", [1, 1, 1, 0, 1], "a@b.com"): 500, strict: 60, weak: 60, pii.code_of("card", [-1, -1, 0, -1, -1], "1" * 13): 300})
    assert model(strict) > model(weak) and model(weak) < pii.ACCEPT


def plain_model(counts):
    """Expectation-maximisation and the ridge logistic regression, one candidate pattern after the other."""
    pattern = {c: pii.features(c) for c in counts}
    prior = [[4.0, 2.0, 1.0], [1.0, 2.0, 4.0]]
    p = {c: 1 / (1 + np.exp(-sum(v - 1 for v in pattern[c][1]))) for c in counts}
    for _ in range(50):
        share = (sum(counts[c] * p[c] for c in counts) + 1) / (sum(counts.values()) + 2)
        table = [[list(x) for x in prior] for _ in range(5)]
        for c, n in counts.items():
            for j, v in enumerate(pattern[c][1]):
                table[j][1][v] += n * p[c]
                table[j][0][v] += n * (1 - p[c])
        for c in counts:
            odds = np.log(share / (1 - share))
            for j, v in enumerate(pattern[c][1]):
                odds += np.log(table[j][1][v] / sum(table[j][1])) - np.log(table[j][0][v] / sum(table[j][0]))
            p[c] = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    ones = {}
    for c, (kind, vote, length, digits) in pattern.items():
        ones[c] = [0, 1 + kind, *(7 + 3 * j + v for j, v in enumerate(vote)), 22 + length, 26 + digits]
    w = np.zeros(30)
    for _ in range(25):
        grad, hess = -w, np.eye(30)
        for c, n in counts.items():
            x = np.zeros(30)
            x[ones[c]] = 1
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = grad + n * (p[c] - q) * x
            hess = hess + n * q * (1 - q) * np.outer(x, x)
        w = w + np.linalg.solve(hess, grad)
    return {c: 1 / (1 + np.exp(-np.clip(sum(w[i] for i in ones[c]), -30, 30))) for c in counts}


def test_span_model_plainly():
    rng = np.random.default_rng(3)
    counts = {int(c): int(n) for c, n in zip(rng.choice(pii.MOST_CODES, 60, replace=False), rng.integers(1, 400, 60))}
    model, plain = pii.SpanModel(counts), plain_model(counts)
    assert all(abs(model(c) - q) < 1e-6 for c, q in plain.items())


def labelled(rng, n):
    """Texts with one candidate outside the base each, and whether it is personal data."""
    digits = lambda k: "".join(rng.choice(list("0123456789"), k))

    def iban():
        body = digits(18)
        check = 98 - int(body + "131400") % 97
        return f"DE{check:02d}{body}"

    def ssn():
        return f"{rng.integers(100, 600)}-{rng.integers(10, 99)}-{rng.integers(1000, 9999)}"

    def phone():
        return f"({rng.integers(200, 999)}) {rng.integers(200, 999)}-{digits(4)}"

    makers = [
        (lambda: f"my ssn is {ssn()} thanks", "national_id", True), (lambda: f"the serial part no 9{digits(2)}-00-{digits(4)} was sold", "national_id", False),
        (lambda: f"account iban {iban()} please", "iban", True), (lambda: f"build version ZZ{digits(2)} {digits(4)} {digits(4)} {digits(4)}", "iban", False),
        (lambda: f"call or phone {phone()} today", "phone", True), (lambda: f"invoice serial 1{digits(2)} 1{digits(2)} {digits(4)} stored", "phone", False),
        (lambda: f"contact mail anna(at)example.com now", "email", True), (lambda: f"version build x(at)y.zzqq here", "email", False),
    ]
    for i in range(n):
        make, kind, truth = makers[i % len(makers)]
        yield make(), kind, truth


def test_added_spans_held_out(spark):
    """Spans that the method adds, on texts that it wasn't fitted on: precision and recall of 0.9."""
    rng = np.random.default_rng(1)
    fitted = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(labelled(rng, 800))], "doc_id long, text string")
    model = pii.fit(fitted)
    hit = wrong = missed = 0
    for text, kind, truth in labelled(np.random.default_rng(2), 800):
        base, spans = pii.find(text, model)
        found = any(k == kind for k, *x in spans if (k, *x) not in base)
        hit, wrong, missed = hit + (found and truth), wrong + (found and not truth), missed + (truth and not found)
    assert hit / (hit + wrong) >= 0.9 and hit / (hit + missed) >= 0.9


@pytest.mark.parametrize("kind,text,listed", [("phone", "+2348012345678", 1), ("phone", "+92 300 1234567", 1), ("phone", "+999 123456789", -1), ("phone", "+420 123 456 789", 1), ("iban", "DE89370400440532013000", 1), ("iban", "DE8937040044053201300", -1), ("national_id", "666-12-1234", -1), ("national_id", "123-45-6789", 1), ("email", "a@b.ng", 1), ("email", "a@b.qq", -1), ("card", "2223000048400011", 1)])
def test_gazetteers(kind, text, listed):
    assert pii.listed_in(kind, text, frozenset({"ng", "de"})) == listed


def plain_quality(text):
    words = WORD.findall(text or "")
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dups, len(inside)


def test_quality(spark):
    for limit in (20, 2):
        got = Counter(map(tuple, quality.rules(frame(spark), limit=limit).collect()))
        docs, seen = defaultdict(set), []
        for r in rows():
            lines = Counter()
            for line in (r[1] or "").split("\n"):
                if own := WORD.findall(line):
                    lines[quality.normalised(line.encode())] += len(own)
            seen.append(lines)
            for k in lines if r[0] is not None else ():
                docs[(r[3] or "", k)].add(r[0])
        expected = Counter()
        for r, lines in zip(rows(), seen):
            n, *rest = plain_quality(r[1])
            lost = sum(v for k, v in lines.items() if len(docs[(r[3] or "", k)]) > limit)
            failed = n < 50 or 100 * rest[-1] > 50 * n
            expected[(r[0], n, *rest, lost, failed, not failed and n - lost >= 0.5 * n)] += 1
        assert got == expected
    assert quality.rules(empty(spark)).count() == 0


def test_quality_counts_documents(spark):
    line = "the same line of seven words here"
    text = line + "\n" + " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "h")] * 25 + [(None, text, "h")] * 25, "doc_id long, text string, source string")
    assert {r["n_line_words"] for r in quality.rules(docs).collect()} == {0}
    docs = docs.unionByName(spark.createDataFrame([(i, text, "h") for i in range(2, 22)], docs.schema))
    assert {r["n_line_words"] for r in quality.rules(docs).collect()} == {67}
