"""Alignment of two tokenizers against byte offsets of whole texts."""

import hashlib
from collections import Counter, defaultdict

import pytest

from millrace.llm import alignment, queries

from .fixtures import empty, frame, rows

MORE = ["  two  spaces\n\nand\tlines \n", "tab\there\r\nand there;\r", "▁ mark", "nb\xa0sp　ace\x85x\x1cy", "\x00\x01", "naïve Ünïcödé 漢字かな 🙂👩‍👩‍👧 é", "don't I'LL we've 's'", "x" * 5000, "a.b,c!! (d) [e]... 3.14 1,000", "<s></s><|endoftext|> <unk>", "\n", " ", "\n\n x", "foo.\nBar, baz!\nQux"]


def token_bytes():
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = queries.aligned_paths()
    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    printable = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
    others = iter(range(256, 512))
    char = {c: chr(c) if c in printable else chr(next(others)) for c in range(256)}
    back = {v: k for k, v in char.items()}

    def sides(text):
        x = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = [(i, bytes.fromhex(p[3:5]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
        raw = (" " + text).encode()
        return (x, y) if text and b"".join(t for _, t in x) == raw == b"".join(t for _, t in y) else ([], [])

    return sides


def ends(tokens):
    at, out = 0, []
    for i, raw in tokens:
        at += len(raw)
        out.append((at, i))
    return out


def plain(texts):
    sides = token_bytes()
    found, counts = [], Counter()
    for text in texts:
        x, y = map(ends, sides(text or ""))
        links = [(i, j) for e, i in x for f, j in y if e == f] if len(x) < 200 else [(i, dict(y)[e]) for e, i in x if e in dict(y)]
        shared = sorted({e for e, _ in x} & {e for e, _ in y})
        groups = []
        for lo, hi in zip([0, *shared], shared):
            groups.append("|".join(",".join(str(i) for e, i in side if lo < e <= hi) for side in (x, y)))
        counts.update(links)
        found.append((len(x), len(y), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    most = defaultdict(int)
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return [(a, b, g, len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), sha) for a, b, g, links, sha in found]


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_align(spark):
    given = [r for r in rows() if len(r[1] or "") < 20_000] + [(20_000 + i, t, *rows()[0][2:]) for i, t in enumerate(MORE)]
    docs = spark.createDataFrame(given, frame(spark).schema).repartition(3)
    expected = plain([r[1] for r in given])
    out = alignment.align(docs, *queries.aligned_paths()).collect()
    assert Counter((r["doc_id"], *(r[n] for n in NAMES)) for r in out) == Counter((r[0], *e) for r, e in zip(given, expected))


def test_words_are_whole_texts(sf):
    """What words give, joined, is what the tokenizers give the whole text; small generations of remembered words change nothing."""
    import duckdb

    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{sf}/documents.parquet'").fetchall()] + MORE
    aligner = alignment.Aligner(*queries.aligned_paths())
    assert aligner.by_word
    for size, texts in ((300_000, texts), (50, texts[::20] + MORE)):
        alignment.CACHED_WORDS, kept = size, alignment.CACHED_WORDS
        try:
            got = [x for t in texts for x in aligner([t])]
        finally:
            alignment.CACHED_WORDS = kept
        for text, found in zip(texts, got):
            ids = aligner.whole(text) if text else None
            assert found == (ids and alignment.packed(aligner.transducer.groups(*ids)))


def test_transducer():
    t = alignment.Transducer([b"ab", b"c", b"abcd", b"x"], [b"a", b"bc", b"d", b"abc"])
    assert t.groups([0, 1], [0, 1]) == [([0, 1], [0, 1])]
    assert t.groups([2], [3, 2]) == [([2], [3, 2])]
    assert t.groups([2, 0, 1], [3, 2, 3]) == [([2], [3, 2]), ([0, 1], [3])]
    with pytest.raises(ValueError):
        t.groups([3], [0])


def test_groups_and_query(spark, sf):
    kept = alignment.encode(spark.read.parquet(f"{sf}/documents.parquet"), *queries.aligned_paths(), keep_groups=True).collect()
    for r in kept[:50]:
        text = ";".join(f"{','.join(map(str, g['a']))}|{','.join(map(str, g['b']))}" for g in r["groups"])
        assert r["groups_sha256"] == (hashlib.sha256(text.encode()).hexdigest() if text else "")
    assert alignment.align(empty(spark), *queries.aligned_paths()).count() == 0
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.op11_alignment(spark, sf).collect()
    assert len(out) == len(texts)
    assert {r["doc_id"]: tuple(r[n] for n in NAMES) for r in out} == dict(zip(texts, plain(texts.values())))
