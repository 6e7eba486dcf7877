"""Removal of repeated passages by sharded Aho-Corasick automata.

Recurring passages are confirmed first: segments of words that may repeat come from repeats.py, those of an anchor meet in
a shard, and the windows that two or more documents hold are told there by numpy, each with its least doc_id. This only
chooses the patterns. A passage (a run of windows with one least doc_id) goes to every stretch of the texts that may hold it,
is compiled there with the stretch's other passages into an Aho-Corasick automaton over word numbers, and all documents of
the stretch are streamed through it. What goes from a document is what the automaton finds. A stretch ends where its
patterns reach PATTERNS, so an automaton is bounded however long the texts are.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, map_batches, materialise
from .repeats import SPLIT, Words, chunk_file, meetings, merged, per_chunk, resolved, shared_keys, text_table, written_by_chunk

WIDTH = 13
#: Different segments that a stretch of texts has at most (one document's may exceed it): the patterns of an automaton.
PATTERNS = 20_000
#: Characters that stand for a word in an automaton: with as few as the cube root of its words in each place, no state has many ways on.
DIGITS = 3


def confirmed(numbers: np.ndarray, starts: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For the windows at `starts` in numbers: their least lo, and whether two documents hold them."""
    h = np.zeros(len(starts), np.uint64)
    for i in range(width):
        h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (numbers[starts + i].astype(np.uint64) + np.uint64(1))
    order = np.argsort(h, kind="stable")
    new = h[order][1:] != h[order][:-1]
    differ = np.zeros(len(new), bool)
    for i in range(width):
        x = numbers[starts[order] + i]
        differ |= x[1:] != x[:-1]
    if (differ & ~new).any():  # different windows with one hash: compare the windows themselves
        order = np.lexsort([numbers[starts + i] for i in range(width)])
        new = np.zeros(len(starts) - 1, bool)
        for i in range(width):
            x = numbers[starts[order] + i]
            new |= x[1:] != x[:-1]
    head = np.flatnonzero(np.concatenate(([True], new)))
    size = np.diff(np.concatenate((head, [len(order)])))
    least, most = np.minimum.reduceat(lo[order], head), np.maximum.reduceat(hi[order], head)
    out, twice = np.empty(len(order), np.int64), np.empty(len(order), bool)
    out[order], twice[order] = np.repeat(least, size), np.repeat(least < most, size)
    return out, twice


def least_docs(segments: list[bytes], lo: np.ndarray, hi: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """For each segment and window, the least lo of all segments that hold the window."""
    known: dict[bytes, int] = {}
    numbers = [[known.setdefault(w, len(known)) for w in s.split(b" ")] for s in segments]
    sizes = np.array([len(t) for t in numbers])
    flat = np.fromiter((n for t in numbers for n in t), np.int64, int(sizes.sum()))
    windows = sizes - width + 1
    first = np.cumsum(windows) - windows
    owner = np.repeat(np.arange(len(sizes)), windows)
    inside = np.arange(len(owner)) - first[owner]
    least, _ = confirmed(flat, (np.cumsum(sizes) - sizes)[owner] + inside, lo[owner], hi[owner], width)
    return np.split(least, first[1:])


def known_keys(shared: str, chunk: int) -> np.ndarray:
    found = chunk_file(shared, chunk, ["keys"])
    if found is None or not found.num_rows:
        return np.zeros(0, np.int64)
    return np.unique(np.concatenate([np.frombuffer(x, "<i8") for x in found.column(0).to_pylist()]))


def stretches(table: DataFrame, kind: Words, shared: str) -> DataFrame:
    """anchor, seg, lo, hi, chunk, first: the different segments with shared keys of each stretch, which begins with row `first`."""
    most = PATTERNS

    def run(batches):
        last, known, first, held = None, None, None, {}

        def out():
            segs, at = list(held), list(held.values())
            return {"anchor": [x[0] for x in at], "seg": segs, "lo": [x[1] for x in at], "hi": [x[2] for x in at], "chunk": [last] * len(at), "first": [first] * len(at)}

        for chunk, b in per_chunk(batches):
            if chunk != last:
                if held:
                    yield out()
                last, known, first, held = chunk, known_keys(shared, chunk), None, {}
            for doc_id, raw, copy, row in zip(*(b.column(c).to_pylist() for c in ("doc_id", "raw", "copy", "row"))):
                if len(held) >= most:
                    yield out()
                    first, held = None, {}
                first = row if first is None else first
                if copy or doc_id is None or not len(known):
                    continue
                words = kind.units(raw)
                if not (own := kind.anchors(words)):
                    continue
                for anchor, p, m in zip(*(x.tolist() for x in kind.kept(own, known))):
                    for q in range(0, m, SPLIT):
                        seg = kind.cut(words, p + q, min(SPLIT, m - q))
                        if (e := held.get(seg)) is None:
                            held[seg] = [anchor, doc_id, doc_id]
                        elif doc_id < e[1]:
                            e[1] = doc_id
                        elif doc_id > e[2]:
                            e[2] = doc_id
        if held:
            yield out()

    return map_batches(table.select("chunk", "doc_id", "raw", "copy", "row"), run, "anchor long, seg binary, lo long, hi long, chunk int, first long")


def passages(docs: DataFrame, kind: Words) -> tuple[DataFrame, str]:
    """The text table, and the folder with each chunk's patterns: first (row of the stretch), seg, and the windows a to b of it whose least doc_id is m."""
    spark = docs.sparkSession
    width = kind.width
    table = text_table(docs)
    shared = shared_keys(table, kind)
    found, path = materialise(stretches(table, kind, shared), "segments")
    where, folded, paths = meetings(found, kind, "lo", "hi")
    met, met_path = materialise(resolved(folded, kind, lambda segments, lo, hi: least_docs(segments, lo, hi, width)), "resolved")
    # a passage whose least document is the stretch's last takes nothing there
    wanted = where.join(met, ["sa", "sb"]).select("chunk", "first", "seg", F.explode(F.filter("found", lambda r: r["m"] < F.col("hi"))).alias("r")).select("chunk", "first", "seg", "r.a", "r.b", "r.m")
    out = written_by_chunk(wanted, "patterns", table)
    delete(spark, shared, path, met_path, *paths)
    return table, out


class Automaton:
    """Patterns (segment, from, to, least doc_id) compiled; a word is DIGITS characters, each from an alphabet of its place."""

    def __init__(self, patterns, width: int):
        import ahocorasick

        passages = [(seg.split(b" ")[a : b + width - 1], m) for seg, a, b, m in patterns]
        numbers = {w: i for i, w in enumerate({w for words, _ in passages for w in words})}
        base = next(b for b in range(1, len(numbers) + 2) if b**DIGITS > len(numbers))
        places = [[chr(1 + base * k + d) for d in range(base)] for k in range(DIGITS)]
        self.code = {w: "".join(p[i // base**k % base] for k, p in enumerate(places)) for w, i in numbers.items()}
        self.other = chr(1 + base * DIGITS) * DIGITS
        self.machine = ahocorasick.Automaton()
        for words, m in passages:
            self.machine.add_word("".join(map(self.code.__getitem__, words)), (m, len(words)))
        self.machine.make_automaton()

    def located(self, words: list[bytes], doc_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Runs of words that the matches of passages of documents before doc_id cover."""
        text = "".join(map(self.code.get, words, repeat(self.other)))
        spans = [(end // DIGITS + 1 - n, end // DIGITS + 1) for end, (m, n) in self.machine.iter(text) if m < doc_id]
        if not spans:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return merged(*np.array(spans, np.int64).T)


def remove_passages(docs: DataFrame, width: int = WIDTH, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept, the remaining words).

    A word goes if a window of `width` words over it also starts in a document with a smaller doc_id. A null or empty
    text has no words; a document with a null doc_id neither loses words nor takes any; rows of one doc_id (ties) never take
    from each other; a very long text is one stretch's, searched and streamed whole; an empty table gives no rows; other
    columns are ignored.
    """
    kind = Words(width)
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * texts
    table, folder = passages(docs, kind)

    def run(batches):
        last, starts, patterns, at, machine = None, None, None, None, None
        none = np.zeros(0, np.int64)
        for chunk, b in per_chunk(batches):
            if chunk != last:
                found = chunk_file(folder, chunk, ["first", "seg", "a", "b", "m"])
                patterns = found.sort_by("first") if found is not None else None
                starts = patterns.column("first").to_numpy() if found is not None else none
                last, at, machine = chunk, None, None
            out = {n: [] for n in names}
            for doc_id, raw, copy, row in zip(*(b.column(c).to_pylist() for c in ("doc_id", "raw", "copy", "row"))):
                words = kind.units(raw)
                now = int(np.searchsorted(starts, row, "right"))
                if now != at:  # the patterns of the stretch that this row belongs to
                    at = now
                    i = int(np.searchsorted(starts, starts[now - 1])) if now else 0
                    own = patterns.slice(i, now - i) if now else None
                    machine = Automaton(zip(*(own.column(c).to_pylist() for c in ("seg", "a", "b", "m"))), width) if now else None
                s = e = none
                if copy and len(words) >= width:
                    s, e = np.array([0]), np.array([len(words)])
                elif doc_id is not None and machine and not copy:
                    s, e = machine.located(words, doc_id)
                kept = words
                if len(s):
                    cuts = [0, *np.stack((s, e), 1).ravel().tolist(), len(words)]
                    kept = [w for i, j in zip(cuts[::2], cuts[1::2]) for w in words[i:j]]
                kept = b" ".join(kept)
                for name, v in zip(names, (doc_id, len(words), int((e - s).sum()), hashlib.sha256(kept).hexdigest(), kept)):
                    out[name].append(v)
            yield out

    return map_batches(table, run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept binary" * texts)
