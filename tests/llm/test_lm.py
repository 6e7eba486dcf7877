"""Counts and base scores exactly; the network against numbers, finite differences, a plain forward pass and held-out text."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import gru, lm, queries

from .fixtures import empty, frame, rows


def tokens(text):
    return (text or "").encode().lower().split() + [b""]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def check_base(given, out):
    train = Counter(w for i, t in given if not held(i) for w in tokens(t))
    total, distinct = sum(train.values()), len(train)
    expected = Counter()
    for i, t in given:
        ws = tokens(t)
        base = sum(math.log10((train[w] + 1) / (total + distinct + 1)) for w in ws)
        expected[i, held(i), len(ws), sum(train[w] > 0 for w in ws), total, round(base, 5)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in out) == expected


def test_odd_documents(spark, monkeypatch):
    """Few common words, so most of them meet their counts in the join; a short vocabulary; all odd cases."""
    given = [(r[0], r[1]) for r in rows()]
    check_base(given, lm.score_documents(frame(spark)).collect())
    monkeypatch.setattr(lm, "COMMON", 40)
    monkeypatch.setattr(lm, "WORDS", 20)
    out = lm.score_documents(frame(spark)).collect()
    check_base(given, out)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in out)
    assert lm.score_documents(empty(spark)).count() == 0
    alone = spark.createDataFrame([(next(i for i in range(99) if held(i)), "only held out")], "doc_id long, text string")
    assert [(r["train_tokens"], r["base_score"]) for r in lm.score_documents(alone).collect()] == [(0, 0.0)]


def test_query_beats_counts(spark, sf):
    """On documents that it hasn't seen the network is better than the counts; equal texts score alike."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.op12_language_model(spark, sf).collect()
    check_base(list(docs.items()), out)
    unseen = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)
    by_text = {}
    for r in out:
        assert abs(by_text.setdefault(docs[r["doc_id"]], r["score"]) - r["score"]) < 1e-3 * abs(r["score"])


def plain_log_likelihood(model, ids):
    """One document, one token after the other, in double precision and without windows."""
    p = {k: x.astype(float) for k, x in model.p.items()}
    h, last, total, k = np.zeros(gru.HIDDEN), model.end, 0.0, gru.HIDDEN
    sig = lambda x: 1 / (1 + np.exp(-x))
    for i in ids:
        g, x = h @ p["u"], p["x"][last]
        z, r = sig(x[:k] + g[:k]), sig(x[k : 2 * k] + g[k : 2 * k])
        h = (1 - z) * np.tanh(x[2 * k :] + r * g[2 * k :]) + z * h
        a = h @ p["c"] + p["cb"]
        c, w = divmod(i, gru.CLASS_WORDS)
        b = h @ p["w"][c] + p["wb"][c]
        total += a[c] - np.log(np.exp(a).sum()) + b[w] - np.log(np.exp(b).sum())
        last = i
    return total


@pytest.fixture
def model():
    rng = np.random.default_rng(4)
    return gru.Model(rng.normal(0, 0.3, gru.SIZE).astype(np.float32), 7)


def some_docs(n=300, seed=2):
    rng = np.random.default_rng(seed)
    return [np.append(rng.integers(0, gru.OUTPUTS, rng.integers(0, 90)), 7).astype(np.int32) for _ in range(n)] + [np.append(rng.integers(0, 1024, 700), 7).astype(np.int32)]


def test_state_is_carried(model):
    """More documents than lanes, documents over many windows: each is scored as if alone."""
    docs = some_docs()
    assert np.allclose(model.score(docs), [plain_log_likelihood(model, d.tolist()) for d in docs], rtol=1e-3)


def test_probabilities_sum_to_one(model):
    h = np.random.default_rng(3).normal(0, 1, (1, gru.HIDDEN)).astype(np.float32)
    lp, _ = model.outputs(np.repeat(h, gru.OUTPUTS, 0), np.arange(gru.OUTPUTS))
    assert abs(np.exp(lp.astype(float)).sum() - 1) < 1e-4


def test_gradient(model):
    """Against finite differences, where documents fit in one window."""
    docs = [d[: gru.STEPS - 2] for d in some_docs(20)]
    inputs, target, _, go_on, h = next(model.windows(docs))
    grads_flat = np.zeros(gru.SIZE, np.float32)
    grads, real = gru.views(grads_flat), target >= 0

    def loss():
        hs, _ = model.forward(inputs, go_on, h)
        return -model.outputs(hs[real], target[real])[0].astype(float).mean()

    hs, tape = model.forward(inputs, go_on, h)
    _, dh = model.outputs(hs[real], target[real], grads)
    dh_out = np.zeros_like(hs)
    dh_out[real] = dh
    model.backward(inputs, go_on, tape, dh_out, grads)
    rng = np.random.default_rng(5)
    for name, shape in gru.SHAPES.items():
        flat, g = model.p[name].reshape(-1), grads[name].reshape(-1)
        direction = rng.normal(0, 1, flat.shape).astype(np.float32)
        kept, eps = flat.copy(), 1e-2
        flat[:] = kept + eps * direction
        up = loss()
        flat[:] = kept - eps * direction
        down = loss()
        flat[:] = kept
        assert abs((up - down) / (2 * eps) - g @ direction) < 2e-2 * max(0.05, abs(g @ direction)), name


def test_training_lowers_loss(model):
    rng = np.random.default_rng(1)
    docs = [np.append(np.tile(rng.integers(0, 1024, 3), 30), 7).astype(np.int32) for _ in range(4)] * 60
    before, squares = model.score(docs).sum(), np.zeros(gru.SIZE, np.float32)
    for _ in range(3):
        model.train(docs, squares, 1)
    assert model.score(docs).sum() > 0.7 * before


def test_every_window_trains(model, monkeypatch):
    """Each window of each document gives a gradient step: over whole documents, all inputs go back."""
    docs, seen, back = some_docs(300), [], gru.Model.backward
    monkeypatch.setattr(gru.Model, "backward", lambda self, inputs, *rest: (seen.append(inputs.size), back(self, inputs, *rest))[1])
    steps = model.train(docs, np.zeros(gru.SIZE, np.float32))
    assert steps == len(seen) > 20 and sum(seen) >= sum(map(len, docs))
    assert not hasattr(lm, "EVERY")
