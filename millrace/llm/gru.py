"""A gated recurrent language model over a bounded vocabulary, in numpy: one task's part of the work.

Documents run side by side in lanes; a lane's state goes on from window to window and starts anew with each document, so a
document's log-likelihood is that of its whole text. Gradients go back through one window (truncated backpropagation). The
output is factored: a softmax over classes, then one over the words of the class.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

#: Size of the state, classes and words of a class, lanes, steps of a window, step size and its first divisor (Adagrad).
HIDDEN, CLASSES, CLASS_WORDS, LANES, STEPS, RATE, FIRST = 16, 32, 32, 128, 32, 0.2, 0.5
OUTPUTS = CLASSES * CLASS_WORDS
SHAPES = {"x": (OUTPUTS, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "c": (HIDDEN, CLASSES), "cb": (CLASSES,), "w": (CLASSES, HIDDEN, CLASS_WORDS), "wb": (CLASSES, CLASS_WORDS)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def first_weights(counts: np.ndarray) -> np.ndarray:
    """Weights whose outputs are the outputs' shares in counts; small fixed random numbers elsewhere."""
    flat = np.random.default_rng(1).normal(0, 0.1, SIZE).astype(np.float32)
    p, share = views(flat), (counts + 0.01).reshape(CLASSES, CLASS_WORDS)
    p["cb"][:] = np.log(share.sum(1) / share.sum())
    p["wb"][:] = np.log(share / share.sum(1, keepdims=True))
    p["c"][:] = p["w"][:] = 0
    return flat


def lanes(docs: list[np.ndarray], width: int = LANES) -> tuple[np.ndarray, np.ndarray]:
    """Targets (-1: none) and documents by step and lane; the longest documents first, each to the shortest lane."""
    n = min(width, len(docs))
    heap, rows = [(0, i) for i in range(n)], [[] for _ in range(n)]
    for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
        size, i = heapq.heappop(heap)
        rows[i].append(d)
        heapq.heappush(heap, (size + len(docs[d]), i))
    rows.sort(key=lambda ds: -sum(len(docs[d]) for d in ds))
    target, of = np.full((n, max(size for size, _ in heap)), -1, np.int32), np.full((n, max(size for size, _ in heap)), -1, np.int32)
    for i, ds in enumerate(rows):
        joined = np.concatenate([docs[d] for d in ds])
        target[i, : len(joined)] = joined
        of[i, : len(joined)] = np.repeat(ds, [len(docs[d]) for d in ds])
    return np.ascontiguousarray(target.T), np.ascontiguousarray(of.T)


class Model:
    """end: the output that ends a document, and stands before its first token."""

    def __init__(self, flat: np.ndarray, end: int):
        self.flat, self.end = flat.astype(np.float32), end
        self.p = views(self.flat)

    def windows(self, docs: list[np.ndarray], width: int = LANES) -> Iterator[tuple]:
        """(inputs, targets, documents, first-of-document marks, state before) of each window; the caller sends back the state after it."""
        target, of = lanes(docs, width)
        h = np.zeros((target.shape[1], HIDDEN), np.float32)
        before_t, before_d = np.full(target.shape[1], self.end), np.full(target.shape[1], -1)
        for at in range(0, len(target), STEPS):
            n = int((target[at] >= 0).sum())  # lanes are sorted by length: those still busy come first
            t, d = target[at : at + STEPS, :n], of[at : at + STEPS, :n]
            fresh = d != np.vstack([before_d[None, :n], d[:-1]])
            inputs = np.where(fresh, self.end, np.vstack([before_t[None, :n], t[:-1]]))
            h = yield inputs, t, d, ~fresh, h[:n]
            before_t, before_d = t[-1], d[-1]

    def forward(self, inputs: np.ndarray, go_on: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
        """States after each step, and what going back needs: states before, gates, candidates and the candidates' share of the state."""
        x, u, k, (steps, n), whole = self.p["x"][inputs].transpose(0, 2, 1).copy(), self.p["u"].T.copy(), 2 * HIDDEN, inputs.shape, go_on.all(1)
        before, out, cand, share = (np.empty((steps, HIDDEN, n), np.float32) for _ in range(4))
        gates, h = np.empty((steps, k, n), np.float32), h.T
        x[:, :k] *= -1
        for t in range(steps):
            b, a, c = before[t], gates[t], cand[t]
            if whole[t]:
                b[:] = h
            else:
                np.multiply(h, go_on[t], out=b)
            g = u @ b
            np.subtract(x[t, :k], g[:k], out=a)
            np.exp(a, out=a)
            a += 1
            np.reciprocal(a, out=a)
            share[t] = g[k:]
            np.multiply(a[HIDDEN:], g[k:], out=c)
            c += x[t, k:]
            np.tanh(c, out=c)
            h = np.subtract(b, c, out=out[t])
            h *= a[:HIDDEN]
            h += c
        return out.transpose(0, 2, 1), (before, gates, cand, share)

    def outputs(self, h: np.ndarray, target: np.ndarray, grads: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log-probabilities of targets after states h (rows); with grads also the gradient by h, of the negative mean. Inside, a state is a column."""
        p, at_ = self.p, np.arange(len(h), dtype=np.int64)
        cls, word = np.divmod(target, CLASS_WORDS)
        order = np.argsort(cls.astype(np.uint8), kind="stable")
        h, cls, word = np.ascontiguousarray(h[order].T), cls[order], word[order]
        a = p["c"].T @ h + p["cb"][:, None]
        a -= a.max(0)
        lp = a[cls, at_]
        np.exp(a, out=a)
        s = a.sum(0)
        lp -= np.log(s)
        dh = None
        if grads is not None:
            a *= 1 / (s * len(at_))
            a[cls, at_] -= np.float32(1 / len(at_))
            dh = p["c"] @ a
            grads["c"] += h @ a.T
            grads["cb"] += a.sum(1)
        bounds = np.searchsorted(cls, np.arange(CLASSES + 1))
        for k in np.flatnonzero(np.diff(bounds)):
            at = slice(bounds[k], bounds[k + 1])
            hk, wk, i = h[:, at], word[at], at_[: bounds[k + 1] - bounds[k]]
            f = p["w"][k].T @ hk + p["wb"][k][:, None]
            f -= f.max(0)
            own = f[wk, i]
            np.exp(f, out=f)
            s = f.sum(0)
            lp[at] += own - np.log(s)
            if grads is not None:
                f *= 1 / (s * len(at_))
                f[wk, i] -= np.float32(1 / len(at_))
                dh[:, at] += p["w"][k] @ f
                grads["w"][k] += hk @ f.T
                grads["wb"][k] += f.sum(1)
        back = np.empty_like(order)
        back[order] = at_
        return lp[back], dh.T[back] if dh is not None else None

    def backward(self, inputs: np.ndarray, go_on: np.ndarray, tape: tuple, dh_out: np.ndarray, grads: dict[str, np.ndarray]) -> None:
        (before, gates, cand, share), u, whole, k = tape, self.p["u"], go_on.all(1), 2 * HIDDEN
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        by_n, by_z, by_r = (1 - z) * (1 - cand * cand), (before - cand) * z * (1 - z), share * r * (1 - r)
        dh_out = np.ascontiguousarray(dh_out.transpose(0, 2, 1))
        dx, dg, dh = np.empty((len(z), 3 * HIDDEN, z.shape[2]), np.float32), np.empty((len(z), 3 * HIDDEN, z.shape[2]), np.float32), np.zeros_like(dh_out[0])
        for t in range(len(inputs) - 1, -1, -1):
            d, dn = dg[t], dx[t, k:]
            dh += dh_out[t]
            np.multiply(dh, by_z[t], out=d[:HIDDEN])
            np.multiply(dh, by_n[t], out=dn)
            np.multiply(dn, by_r[t], out=d[HIDDEN:k])
            np.multiply(dn, r[t], out=d[k:])
            dh *= z[t]
            dh += u @ d
            if not whole[t]:
                dh *= go_on[t]
        dx[:, :k] = dg[:, :k]
        grads["u"] += (before @ dg.transpose(0, 2, 1)).sum(0)
        dx = dx.transpose(0, 2, 1)
        ids = inputs.ravel()
        order = np.argsort(ids.astype(np.uint16), kind="stable")
        first = np.flatnonzero(np.diff(ids[order], prepend=-1))
        grads["x"][ids[order][first]] += np.add.reduceat(dx.reshape(-1, 3 * HIDDEN)[order], first)

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Natural log-likelihood of each document; in twice as many lanes, which changes nothing but the number of calls."""
        out, steps = np.zeros(len(docs)), self.windows(docs, 2 * LANES)
        at = next(steps, None)
        while at is not None:
            inputs, target, of, go_on, h = at
            hs, _ = self.forward(inputs, go_on, h)
            real = target >= 0
            lp, _ = self.outputs(hs[real], target[real])
            out += np.bincount(of[real], lp, len(docs))
            at = _send(steps, hs[-1])
        return out

    def train(self, docs: list[np.ndarray], squares: np.ndarray, turn: int = 0) -> int:
        """Goes once through whole documents; every window gives a step. The windows seen, with `turn` before."""
        steps = self.windows(docs)
        at = next(steps, None)
        while at is not None:
            inputs, target, _, go_on, h = at
            hs, tape = self.forward(inputs, go_on, h)
            flat = np.zeros(SIZE, np.float32)
            grads, real = views(flat), target >= 0
            _, dh = self.outputs(hs[real], target[real], grads)
            dh_out = np.zeros_like(hs)
            dh_out[real] = dh
            self.backward(inputs, go_on, tape, dh_out, grads)
            root = flat * flat
            root *= 1e4
            squares += root
            np.add(squares, FIRST, out=root)
            np.sqrt(root, out=root)
            flat *= RATE * 100
            flat /= root
            self.flat -= flat
            turn += 1
            at = _send(steps, hs[-1])
        return turn


def _send(steps, value):
    try:
        return steps.send(value)
    except StopIteration:
        return None
