"""Postings of many documents as one row a term: counted where the texts lie, and made into blocks where a term's rows meet.

A posting is a few bytes beside others, not a row, so what is shuffled and sorted is a row for each different term of a chunk (some thousand
documents), not for each term of each document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Words that wait to be counted, postings of a chunk, rows and bytes of a batch. No result depends on them.
WAITING, CHUNK, ROWS, BYTES = 1 << 17, 1 << 21, 8192, 8 << 20
#: A posting: the document's place in its chunk, how often the term is in it, its length and its key. Keys that aren't longs, or are null, stand beside it.
POSTING = np.dtype([("place", "<i4"), ("wdf", "<i4"), ("len", "<i4"), ("key", "<i8")])


def _distinct(words: list[str], places: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(words, code, place, n): each word of a document once, with how often it occurs there; places rise."""
    coded = pa.array(words, pa.string()).dictionary_encode()
    both, n = np.unique(coded.indices.to_numpy().astype(np.int64) << 32 | places, return_counts=True)
    return coded.dictionary, (both >> 32).astype(np.int32), (both & 0xFFFFFFFF).astype(np.int32), n.astype(np.int32)


def _lists(values: pa.Array, ends: np.ndarray, a: int, b: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends[a : b + 1] - ends[a], pa.int32()), values.slice(ends[a], ends[b] - ends[a]))


def _bytes(packed: np.ndarray, ends: np.ndarray, a: int, b: int) -> pa.Array:
    offsets = ((ends[a : b + 1] - ends[a]) * POSTING.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(packed[ends[a] : ends[b]])])


class _Chunk:
    """Documents whose terms are counted together. They begin with a stretch and end with one, unless the partition does."""

    def __init__(self, first: int):
        self.first, self.size, self.keys, self.lengths, self.counted = first, 0, [], [], {}
        self.n = 0
        self._begin()

    def _begin(self) -> None:
        self.waiting: dict[tuple, tuple[list, list, list]] = {}
        self.begun, self.held = self.size, 0

    def add(self, group: tuple, place: int, words: list[str]) -> None:
        """A document's words, repeats included, under (prefix, tongue, whether those that are tokens count as the text's own terms too)."""
        if words:
            terms, places, times = self.waiting.setdefault(group, ([], [], []))
            terms += words
            places.append(place)
            times.append(len(words))
            self.held += len(words)

    def add_runs(self, group: tuple, place: int, runs: list[dict]) -> None:
        """A document's terms with their counts."""
        terms, places, times = self.counted.setdefault((*group, "runs"), ([], [], []))
        terms += [r["term"] for r in runs]
        places += [place] * len(runs)
        times += [r["n"] for r in runs]
        self.n += len(runs)

    def count(self) -> None:
        """What waits becomes postings; lengths are counts of the text's own terms."""
        lengths = np.zeros(self.size - self.begun, np.int64)
        for (prefix, tongue, both), (terms, places, times) in self.waiting.items():
            words, code, place, n = _distinct(terms, np.repeat(np.array(places, np.int64), times))
            if prefix:
                self._hold((prefix, tongue), words, code, place, n)
            if both or not prefix:
                token = pc.and_(pc.greater_equal(pc.utf8_length(words), 3), pc.invert(pc.is_in(words, value_set=_STOP)))
                kept = token.to_numpy(zero_copy_only=False)[code]
                self._hold(("", None), words, code[kept], place[kept], n[kept])
                lengths += np.bincount(place[kept] - self.begun, n[kept], len(lengths)).astype(np.int64)
        self.lengths.append(lengths)
        self._begin()

    def _hold(self, group: tuple, *part) -> None:
        self.counted.setdefault(group, []).append(part)
        self.n += len(part[1])

    def rows(self):
        """A row for each prefix, tongue and term, in batches; the first row has the number of documents with terms, and their length."""
        self.count()
        keys, lengths = pa.concat_arrays(self.keys), np.concatenate(self.lengths)
        inside = pa.types.is_int64(keys.type) and not keys.null_count
        whole = [int(np.count_nonzero(lengths)), int(lengths.sum())]
        for group, parts in self.counted.items():
            if len(group) == 3:
                coded = pa.array(parts[0], pa.string()).dictionary_encode()
                parts = [(coded.dictionary, coded.indices.to_numpy(), np.array(parts[1], np.int32), np.array(parts[2], np.int32))]
            coded = pa.concat_arrays([p[0] for p in parts]).dictionary_encode()
            at = np.cumsum([0] + [len(p[0]) for p in parts])
            code = np.concatenate([coded.indices.to_numpy()[i + p[1]] for i, p in zip(at, parts)])
            place, n = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
            order = np.argsort(code.astype(np.int64) << 32 | place)
            code, place, n = code[order], place[order], n[order]
            starts = np.flatnonzero(np.diff(code, prepend=-1))
            ends, terms = np.append(starts, len(code)), coded.dictionary.take(pa.array(code[starts]))
            packed = np.empty(len(code), POSTING)
            packed["place"], packed["wdf"], packed["len"] = place, n, lengths[place]
            packed["key"] = keys.to_numpy()[place] if inside else 0
            own = None if inside else keys.take(pa.array(place))
            for a in range(0, len(starts), ROWS):
                b = min(a + ROWS, len(starts))
                same = lambda value, kind: pa.repeat(pa.scalar(value, kind), b - a)  # noqa: B023, E731
                once = [pa.array([v] + [0] * (b - a - 1), pa.int64()) for v in whole]
                whole = [0, 0]
                columns = [same(group[0], pa.string()), same(group[1], pa.string()), terms.slice(a, b - a), same(self.first, pa.int64()), _bytes(packed, ends, a, b), pa.nulls(b - a, pa.list_(keys.type)) if inside else _lists(own, ends, a, b), *once]
                yield pa.RecordBatch.from_arrays(columns, names=["prefix", "tongue", "term", "first", "packed", "key", "docs", "total"])


_STOP = pa.array(sorted(T._STOP), pa.string())


def counted(docs: DataFrame, key: str, text: str, shift: int, stems: str | None = None, tongue: Column | None = None, runs: Column | None = None) -> DataFrame:
    """(prefix, tongue, term, first, packed, key, docs, total): the postings of a term in a chunk beside each other, in one scan without a shuffle.

    first is the chunk's first stretch (of 1 << shift documents), from which places count. Terms of the text have
    the prefix '', its words the prefix stems, if that is given, and their tongue: they are still to be stemmed where that isn't null.
    runs: array of (prefix, runs), more terms of a row with their counts. The columns docs and total sum to the documents with terms and to their length.
    """
    none = F.lit(None).cast("array<struct<prefix:string,runs:array<struct<term:string,n:int>>>>")
    given = docs.select(
        F.col(key).alias("key"), F.col(text).alias("text"), (F.lit(None) if tongue is None else tongue).cast("string").alias("tongue"), (none if runs is None else runs).alias("runs"),
        F.monotonically_increasing_id().alias("number"),
    )

    most, waiting = CHUNK, WAITING  # as they are now, in every worker

    def run(batches):
        chunk = None
        for batch in batches:
            keys, texts, tongues, runs, numbers = (batch.column(i) for i in range(5))
            begun = 0
            for i, (text, tongue, more, number) in enumerate(zip(texts.to_pylist(), tongues.to_pylist(), runs.to_pylist(), numbers.to_pylist())):
                if chunk and chunk.n + chunk.held >= most and not number & ((1 << shift) - 1):
                    chunk.keys.append(keys.slice(begun, i - begun))
                    yield from chunk.rows()
                    chunk, begun = None, i
                if chunk is None:
                    chunk = _Chunk(number >> shift)
                place = chunk.size
                chunk.size += 1
                if text:
                    low = text.lower()
                    own, both = T._identifiers(text) * 2, stems is not None and low.isascii()
                    chunk.add(("", None, False), place, own if both else T._WORD.findall(low) + own)
                    if stems is not None:
                        chunk.add((stems, tongue, both), place, T._ANY_WORD.findall(low))
                for x in more or ():
                    chunk.add_runs((x["prefix"], None), place, x["runs"])
                if chunk.held >= waiting:
                    chunk.count()
            chunk.keys.append(keys.slice(begun))
        if chunk:
            yield from chunk.rows()

    T._small_batches()
    kind = given.schema["key"].dataType.simpleString()
    return given.mapInArrow(run, f"prefix string, tongue string, term string, first long, packed binary, key array<{kind}>, docs long, total long")


def _blocks(rows: pa.Table, shift: int) -> pa.RecordBatch:
    """The blocks of rows that are sorted by prefix, term and chunk; postings of one term and document are summed."""
    prefix, term, first, packed, keys = (rows.column(i).combine_chunks() for i in range(5))
    first = first.to_numpy()
    fresh = np.append(True, _changes(prefix) | _changes(term) | (np.diff(first) != 0))
    group, head = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
    ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
    each = np.frombuffer(packed.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(POSTING)
    sizes = np.diff(ends) // POSTING.itemsize
    both = np.repeat(group, sizes).astype(np.int64) << 32 | each["place"]
    wdf, length, key = each["wdf"].astype(np.int64), each["len"].astype(np.int64), keys.flatten()
    if keys.null_count:  # of these rows keys are inside
        beside = np.repeat(keys.is_valid().to_numpy(zero_copy_only=False), sizes)
        key = pa.concat_arrays([pa.array(each["key"]).cast(key.type), key]).take(pa.array(np.where(beside, len(each) + np.cumsum(beside) - 1, np.arange(len(each)))))
    if np.any(np.diff(both) <= 0):
        order = np.argsort(both, kind="stable")
        both = both[order]
        one = np.flatnonzero(np.diff(both, prepend=-1))
        both, wdf, length, key = both[one], np.add.reduceat(wdf[order], one), length[order[one]], key.take(pa.array(order[one]))
    stretch = both >> shift  # the group stands above bit 32
    starts = np.flatnonzero(np.diff(stretch, prepend=-1))
    kept = length > 0
    ends = np.append(0, np.cumsum(np.add.reduceat(kept.astype(np.int64), starts)))
    none = ends[1:] == ends[:-1]
    most, least = np.maximum.reduceat(np.where(kept, wdf, 0), starts), np.minimum.reduceat(np.where(kept, length, np.iinfo(np.int64).max), starts)
    own = pa.array(head[both[starts] >> 32])
    parts = pa.StructArray.from_arrays([key.filter(pa.array(kept)), pa.array(wdf[kept]), pa.array(length[kept])], ["key", "wdf", "len"])
    arrays = [
        prefix.take(own), term.take(own), pa.array(first[own.to_numpy()] + ((both[starts] & 0xFFFFFFFF) >> shift)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts),
        pa.array(most, mask=none), pa.array(least, mask=none), pa.array(np.diff(np.append(starts, len(both)))),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=["prefix", "term", "stretch", "postings", "most", "least", "df"])


def _changes(values: pa.Array) -> np.ndarray:
    return pc.not_equal(values.slice(1), values.slice(0, max(len(values) - 1, 0))).to_numpy(zero_copy_only=False)


def blocks(rows: DataFrame, shift: int, parts: int | None = None) -> DataFrame:
    """(prefix, term, stretch, postings, most, least, df) of what counted() made, in ranges of terms. Documents without a term in their text count in
    df only; where there are no others, most and least are null."""
    keys = ["prefix", "term", "first"]
    kind = rows.schema["key"].dataType.elementType.simpleString()

    most = ROWS

    def run(batches):
        held = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < most and sum(b.nbytes for b in held) < BYTES:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            last = rows.num_rows - 1
            a = last
            # the last term's rows of a chunk may go on in the next batch
            while a and all(rows.column(i)[a - 1] == rows.column(i)[last] for i in range(3)):
                a -= 1
            if a:
                yield _blocks(rows.slice(0, a), shift)
            held = rows.slice(a).to_batches()
        if held:
            yield _blocks(pa.Table.from_batches(held), shift)

    T._small_batches()
    slim = rows.select(*keys, "packed", "key")
    ranged = (slim.repartitionByRange(parts, *keys) if parts else slim.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    return ranged.mapInArrow(run, f"prefix string, term string, stretch long, postings array<struct<key:{kind},wdf:long,len:long>>, most long, least long, df long")
