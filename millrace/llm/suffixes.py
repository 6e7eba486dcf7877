"""Removal of repeated byte strings by two-stage suffix sorting.

Segments that may repeat come from repeats.py, those of an anchor together. In a shard only the suffixes smaller than
their successors are sorted directly (by their first `width` bytes); the others are induced in one scan over the buckets
of first bytes, as a suffix larger than its successor stands in its bucket by the rank of that successor, before all
directly sorted ones. Adjacent common prefixes of `width` bytes or more then join equal windows into classes.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .repeats import Bytes, covered, with_spans

WIDTH = 50


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; runs of a byte are as their end is, and the text's end is above all bytes."""
    n = len(text)
    up = np.zeros(n, bool)
    up[:-1] = text[:-1] < text[1:]
    up[-1] = True
    differs = np.concatenate((np.flatnonzero(text[:-1] != text[1:]), [n - 1]))
    return up[differs[np.searchsorted(differs, np.arange(n))]]


def prefix_words(text: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    """The first `width` bytes of each suffix as big-endian numbers."""
    raw = text.tobytes()
    view = np.ndarray((len(raw) - 7,), ">u8", raw, 0, (1,))
    out = [view[at + i].astype(np.uint64) for i in range(0, width - 7, 8)]
    if width % 8:
        out.append(view[at + width - width % 8].astype(np.uint64) >> np.uint64(8 * (8 - width % 8)))
    return out


def sorted_suffixes(text: np.ndarray, wanted: np.ndarray, width: int) -> np.ndarray:
    """The wanted positions by their first `width` bytes. text ends with over `width` + 8 zeros.

    Successors that an induced suffix needs are added: a chain of them ends at the next directly sorted suffix.
    """
    direct = smaller_than_next(text)
    need = np.zeros(len(text), bool)
    need[wanted] = True
    grow = wanted
    while len(grow := grow[~direct[grow]] + 1):
        grow = grow[~need[grow]]
        need[grow] = True
    at = np.flatnonzero(need)
    by_hand = at[direct[at]]
    by_hand = by_hand[np.lexsort(prefix_words(text, by_hand, width)[::-1])]
    first = text[by_hand]
    hand_cut = np.searchsorted(first, np.arange(257))
    induced = at[~direct[at]]
    induced = induced[np.argsort(text[induced], kind="stable")]
    cut = np.searchsorted(text[induced], np.arange(257))
    rank = np.full(len(text), -1, np.int64)
    out, placed = [], 0

    def place(part):
        nonlocal placed
        rank[part] = np.arange(placed, placed + len(part))
        placed += len(part)
        out.append(part)

    for c in range(256):
        part = induced[cut[c] : cut[c + 1]]
        if len(part):
            lower = text[part + 1] < c
            ready, rest = part[lower], part[~lower]
            place(ready[np.argsort(rank[ready + 1])])
            while len(rest):  # runs of the same byte, one byte longer each time
                follows = rank[rest + 1] >= 0
                ready, rest = rest[follows], rest[~follows]
                place(ready[np.argsort(rank[ready + 1])])
                if not len(ready):
                    raise AssertionError("a chain of successors is broken")
        if hand_cut[c] < hand_cut[c + 1]:
            place(by_hand[hand_cut[c] : hand_cut[c + 1]])
    order = np.concatenate(out) if out else at
    chosen = np.zeros(len(text), bool)
    chosen[wanted] = True
    return order[chosen[order]]


def adjacent_prefixes(text: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """Common prefix with the suffix before, `width` at most (0 for the first)."""
    words = prefix_words(text, order, width)
    out = np.zeros(len(order), np.int64)
    going = np.ones(max(len(order) - 1, 0), bool)
    for i, w in enumerate(words):
        last = i == len(words) - 1 and width % 8
        step = width % 8 if last else 8
        differ = w[1:] ^ w[:-1]
        same = sum(((differ >> np.uint64(8 * j)) == 0).astype(np.int64) for j in range(step))
        out[1:] += np.where(going, same, 0)
        going &= differ == 0
    return out


def least_docs(segments: list[bytes], lo: np.ndarray, hi: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """For each segment and window, the least lo of all segments that hold the window."""
    sizes = np.array([len(s) for s in segments])
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    text = np.frombuffer(b"\0".join(segments) + bytes(2 * width + 32), np.uint8)
    windows = sizes - width + 1
    owner = np.repeat(np.arange(len(segments)), windows)
    first = np.cumsum(windows) - windows
    wanted = starts[owner] + np.arange(len(owner)) - first[owner]
    order = sorted_suffixes(text, wanted, width)
    which = np.searchsorted(starts, order, "right") - 1
    head = np.flatnonzero(adjacent_prefixes(text, order, width) < width)
    least = np.minimum.reduceat(lo[which], head)
    out = np.empty(len(wanted), np.int64)
    out[first[which] + order - starts[which]] = np.repeat(least, np.diff(np.concatenate((head, [len(order)]))))
    return np.split(out, first[1:])


def remove_repeats(docs: DataFrame, width: int = WIDTH, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes).

    A byte goes if a `width`-byte string over it also starts in a document with a smaller doc_id. A null or empty text
    has no bytes; a document with a null doc_id neither loses bytes nor takes any; rows of one doc_id (ties) never take from
    each other; a very long text is searched in overlapping parts, each of its windows once; an empty table gives no rows; other columns are ignored.
    """
    kind = Bytes(width)

    def finish(raw, starts, ends):
        kept = raw
        if len(starts):
            at = [0, *np.stack((starts, ends), 1).ravel().tolist(), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(at[::2], at[1::2]))
        return (len(raw), int((ends - starts).sum()), len(starts), hashlib.sha256(kept).hexdigest(), *([kept] * texts))

    table, folder = covered(docs, kind, lambda segments, lo, hi: least_docs(segments, lo, hi, width))
    return with_spans(table, folder, kind, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts)
