"""Windows that recur across documents, found without sending every window anywhere.

A window is `width` consecutive units (bytes or words). Its anchor is the gram of `gram` units with the least hash inside
it, so equal windows have equal anchors and a text needs one anchor for many windows. Around an anchor a window always
holds some units more on the left or on the right: hashes of both extents are the anchor's keys, and equal windows
share one. Steps, each over all documents:

1. The texts go to a written table with the input partition as `chunk`; exact copies of a text with a smaller doc_id are
   marked and left out: everything they hold also starts in that document.
2. Each chunk's distinct keys are dealt by hash to buckets, which keep those of two or more documents; there are as many
   buckets as the texts' bytes need, so that one holds about BUCKET_KEYS keys.
3. Segments (neighbouring windows with such a key) are cut out; equal segments are folded to their least and
   greatest doc_id; segments of an anchor meet, and a resolver finds each window's least doc_id among them.
   An anchor with more than HOT different segments is dealt out by its keys, a key with more window by window.
4. What was found goes back to the chunks, is written beside each and read by the last pass over its texts, so texts are
   never shuffled: for byte strings the covered spans (occurrences look up their segment), for phrases the patterns of
   the chunk's automata.

Keys are compared by 48 bits; a false agreement only brings segments that the resolver then tells apart.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, fresh_path, join_small, map_batches, materialise

MULTIPLY, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Windows in a segment at most; keys a worker gathers before it hands them on; different segments of an anchor that meet in one task (some 1.3 MB, well inside a shard).
SPLIT, GATHER, HOT = 64, 1 << 21, 20_000
#: Keys in a bucket, as estimated from the texts' bytes.
BUCKET_KEYS = 2_000_000
#: Bytes of segments that a resolver gets at once (an anchor's segments are never divided).
SHARD = 4 << 20


def sliding_least(h: np.ndarray, w: int) -> np.ndarray:
    """Least of every w neighbours, by doubling."""
    s = 1
    while 2 * s <= w:
        h = np.minimum(h[:-s], h[s:])
        s *= 2
    return np.minimum(h[: len(h) - (w - s)], h[w - s :]) if w > s else h


#: Low bits of a value that hold the place (up to 16 M units; longer texts are searched in overlapping parts).
PLACE = 24
NONE = np.int64(-1)


def anchored(h: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors (the leftmost least hash of every w neighbours), first windows and numbers of windows.

    Which place a window takes depends on what is in it alone.
    """
    mask = np.uint64((1 << PLACE) - 1)
    part = (1 << PLACE) - w
    out = []
    for i in range(0, max(1, len(h) - w + 1), part):
        v = (h[i : i + part + w - 1] & ~mask) | np.arange(min(part + w - 1, len(h) - i), dtype=np.uint64)
        least = sliding_least(v, w)
        at = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        out.append(((least[at] & mask).astype(np.int64) + i, at + i, np.diff(np.concatenate((at, [len(least)])))))
    return tuple(np.concatenate(x) for x in zip(*out))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * MIX
    return h ^ (h >> np.uint64(32))


class Windows:
    """width: units in a window; gram: units of the hashed grams.

    A window reaches beyond its anchor by width - gram units, so by `side` on the left or on the right at least. The
    hash of the anchor with that much of its left, or of its right, therefore is the same wherever the window is.
    """

    def __init__(self, width: int, gram: int):
        self.width, self.gram = width, gram
        self.side = (width - gram) // 2

    def expected_keys(self, n_bytes: int) -> float:
        """Keys of texts of so many bytes: of w + 1 neighbouring grams two are anchors, each has a left and a right key."""
        return 4 * n_bytes / self.unit_bytes / (self.width - self.gram + 2)

    def anchors(self, units):
        """Anchor, first window, windows, place, and left and right key (NONE where the text ends before) of each run."""
        n = len(units)
        if n < self.width:
            return None
        numbers = self.numbers(units)
        h = self.hashed(numbers, np.arange(n - self.gram + 1), self.gram)
        place, at, windows = anchored(h, self.width - self.gram + 1)
        cut = lambda x: (x >> np.uint64(16)).astype(np.int64)
        left, right = np.full(len(at), NONE), np.full(len(at), NONE)
        has = place >= self.side
        left[has] = cut(self.hashed(numbers, place[has] - self.side, self.gram + self.side))
        has = place + self.gram + self.side <= n
        right[has] = cut(mixed(~self.hashed(numbers, place[has], self.gram + self.side)))
        return cut(h[place]), at, windows, place, left, right

    def kept(self, found, known: np.ndarray):
        """Runs of windows, with their anchors, whose left or right key is known."""
        anchor, at, windows, place, left, right = found
        there = lambda k: known[np.minimum(np.searchsorted(known, k), len(known) - 1)] == k
        l, r = there(left), there(right)
        # windows up to `place - side` hold the left key; from `place - (width - gram - side)` on, the right one
        first = np.where(l, at, np.maximum(at, place - (self.width - self.gram - self.side)))
        last = np.where(r, at + windows, np.minimum(at + windows, place - self.side + 1))
        good = (l | r) & (last > first)
        return anchor[good], first[good], (last - first)[good]


class Bytes(Windows):
    """Windows of bytes."""

    unit_bytes = 1

    def __init__(self, width: int, gram: int = 16):
        super().__init__(width, gram)

    def units(self, raw: bytes) -> bytes:
        return raw

    def numbers(self, raw: bytes) -> np.ndarray:
        return np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))

    def hashed(self, numbers: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the n bytes at each place, eight at a time, the last eight overlapping."""
        whole = len(at) == len(numbers) + 8 - n and len(at) > 0 and at[0] == 0
        get = (lambda o: numbers[o : o + len(at)]) if whole else (lambda o: numbers[at + o])
        h = get(0) * MULTIPLY
        for o in range(8, n, 8):
            h ^= get(min(o, n - 8)) * MIX
            h *= MULTIPLY
        return mixed(h)

    def cut(self, raw: bytes, start: int, windows: int) -> bytes:
        return raw[start : start + windows + self.width - 1]



class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


class Words(Windows):
    """Windows of words, which ASCII white space separates (as bytes.split() does)."""

    unit_bytes = 4

    def __init__(self, width: int, gram: int = 5):
        super().__init__(width, gram)
        self.known = WordHashes()

    def units(self, raw: bytes) -> list[bytes]:
        return raw.split()

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > 500_000:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))

    def hashed(self, numbers: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        whole = len(at) == len(numbers) + 1 - n and len(at) > 0 and at[0] == 0
        get = (lambda i: numbers[i : i + len(at)]) if whole else (lambda i: numbers[at + i])
        h = get(0).copy()
        for i in range(1, n):
            h *= MULTIPLY
            h ^= get(i)
        return mixed(h)

    def cut(self, words: list[bytes], start: int, windows: int) -> bytes:
        return b" ".join(words[start : start + windows + self.width - 1])



def chunk_file(base: str, chunk: int, names: list[str]):
    """The rows written for one chunk, read from the shared folder; None if there are none."""
    from pyarrow import dataset, fs

    store, path = fs.FileSystem.from_uri(base)
    path = f"{path}/chunk={chunk}"
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return None
    return dataset.dataset(path, filesystem=store, format="parquet").to_table(columns=names)


def per_chunk(batches, column: str = "chunk"):
    """Slices of batches with one chunk each."""
    for b in batches:
        chunk = b.column(column).to_numpy()
        cuts = [0, *(np.flatnonzero(chunk[1:] != chunk[:-1]) + 1).tolist(), len(chunk)]
        for i, j in zip(cuts, cuts[1:]):
            if j > i:
                yield int(chunk[i]), b.slice(i, j - i)


def written_by_chunk(df: DataFrame, tag: str, table: DataFrame) -> str:
    """df by the chunks of the text table: a chunk is a partition of its own, so no task gets several that a hash throws together."""
    path = fresh_path(df.sparkSession, tag)
    chunks = (table.agg(F.max("chunk")).first()[0] or 0) + 1
    df.repartitionById(chunks, "chunk").write.option("compression", "zstd").partitionBy("chunk").parquet(path)
    return path


def text_table(docs: DataFrame) -> DataFrame:
    """chunk, row, doc_id, raw (UTF-8), copy (an equal text has a smaller doc_id), size (bytes)."""
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw.alias("raw")).withColumns({"ha": F.xxhash64("raw"), "hb": F.xxhash64(F.lit(1), "raw")})
    equal, _ = materialise(given.groupBy("ha", "hb").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "equal")
    marked = join_small(given, equal, ["ha", "hb"]).select(F.spark_partition_id().alias("chunk"), F.monotonically_increasing_id().alias("row"), "doc_id", "raw", F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)).alias("copy"), F.length("raw").cast("long").alias("size"))
    return materialise(marked, "texts")[0]


def buckets(table: DataFrame, kind: Windows) -> int:
    """By the bytes of the texts that are searched, whatever the session's number of shuffle partitions; that number at least."""
    total = table.filter(~F.col("copy")).agg(F.sum("size")).first()[0] or 0
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(kind.expected_keys(total) // BUCKET_KEYS) + 1)


def shared_keys(table: DataFrame, kind: Windows) -> str:
    """Folder with, for each chunk, those of its keys that two or more documents have."""
    n = buckets(table, kind)

    def gather(batches):
        held, size, last = [], 0, None

        def hand_on():
            h = np.sort(np.concatenate(held))  # each document's are distinct
            first = np.concatenate(([True], h[1:] != h[:-1]))
            at = np.flatnonzero(first)
            often = np.diff(np.concatenate((at, [len(h)]))) > 1
            h = h[at]
            bucket = h % n
            order = np.argsort(bucket, kind="stable")
            h, often, bucket = h[order], often[order], bucket[order]
            cuts = np.searchsorted(bucket, np.arange(n + 1))
            out = {"bucket": [], "chunk": [], "low": [], "high": [], "often": []}
            for i in range(n):
                if cuts[i] < cuts[i + 1]:
                    part = h[cuts[i] : cuts[i + 1]]
                    for name, v in zip(out, (i, last, (part & 0xFFFFFFFF).astype("<u4").tobytes(), (part >> 32).astype("<u2").tobytes(), np.packbits(often[cuts[i] : cuts[i + 1]]).tobytes())):
                        out[name].append(v)
            return out

        for chunk, b in per_chunk(batches):
            if held and (chunk != last or size >= GATHER):
                yield hand_on()
                held, size = [], 0
            last = chunk
            for doc_id, raw, copy in zip(*(b.column(c).to_pylist() for c in ("doc_id", "raw", "copy"))):
                if not copy and doc_id is not None and (found := kind.anchors(kind.units(raw))):
                    keys = np.unique(np.concatenate(found[4:]))
                    held.append(keys[keys != NONE])
                    size += len(held[-1])
        if held:
            yield hand_on()

    def keep(batches):
        def judged(rows):
            parts = [(np.frombuffer(hi, "<u2").astype(np.int64) << 32) | np.frombuffer(lo, "<u4") for _, _, lo, hi, _ in rows]
            h = np.sort(np.concatenate(parts))
            seen = np.unique(h[1:][h[1:] == h[:-1]])
            out = {"chunk": [], "keys": []}
            for (_, chunk, *_, often), p in zip(rows, parts):
                at = np.minimum(np.searchsorted(seen, p), max(len(seen) - 1, 0))
                mine = np.unpackbits(np.frombuffer(often, np.uint8), count=len(p)).astype(bool)
                if len(seen):
                    mine |= seen[at] == p
                if mine.any():
                    out["chunk"].append(chunk)
                    out["keys"].append(p[mine].astype("<i8").tobytes())
            return out

        rows: list = []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("bucket", "chunk", "low", "high", "often"))):
                if rows and row[0] != rows[0][0]:
                    yield judged(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield judged(rows)

    dealt = map_batches(table.select("chunk", "doc_id", "raw", "copy"), gather, "bucket int, chunk int, low binary, high binary, often binary")
    return written_by_chunk(map_batches(dealt.repartition(n, "bucket").sortWithinPartitions("bucket"), keep, "chunk int, keys binary"), "keys", table)


def segments(table: DataFrame, kind: Windows, shared: str) -> DataFrame:
    """anchor, seg, doc_id, chunk, row, start: the segments with shared keys."""

    def run(batches):
        last, known = None, None
        for chunk, b in per_chunk(batches):
            if chunk != last:
                found = chunk_file(shared, chunk, ["keys"])
                known = np.unique(np.concatenate([np.frombuffer(x, "<i8") for x in found.column(0).to_pylist()])) if found is not None and found.num_rows else np.zeros(0, np.int64)
                last = chunk
            if not len(known):
                continue
            out = {n: [] for n in SEGMENT}
            for doc_id, raw, copy, row in zip(*(b.column(c).to_pylist() for c in ("doc_id", "raw", "copy", "row"))):
                if copy or doc_id is None:
                    continue
                units = kind.units(raw)
                if not (own := kind.anchors(units)):
                    continue
                for h, p, m in zip(*(x.tolist() for x in kind.kept(own, known))):
                    for q in range(0, m, SPLIT):
                        for name, v in zip(out, (h, kind.cut(units, p + q, min(SPLIT, m - q)), doc_id, chunk, row, p + q)):
                            out[name].append(v)
            yield out

    return map_batches(table.select("chunk", "doc_id", "raw", "copy", "row"), run, SEGMENT_TYPE)


def resolved(folded: DataFrame, kind: Windows, resolve: Callable) -> DataFrame:
    """sa, sb, found: for each folded segment the runs of windows (from, to, least doc_id) that some occurrence may lose."""

    def run(batches):
        rows, size = [], 0

        def settle(part):
            least = resolve([r[1] for r in part], np.array([r[2] for r in part]), np.array([r[3] for r in part]))
            out = {"sa": [], "sb": [], "found": []}
            for (_, _, _, hi, sa, sb), m in zip(part, least):
                if (m < hi).any():
                    at = np.concatenate(([0], np.flatnonzero(m[1:] != m[:-1]) + 1))
                    end = np.concatenate((at[1:], [len(m)]))
                    out["sa"].append(sa)
                    out["sb"].append(sb)
                    out["found"].append([{"a": a, "b": z, "m": v} for a, z, v in zip(at.tolist(), end.tolist(), m[at].tolist()) if v < hi])
            return out

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("anchor", "seg", "lo", "hi", "sa", "sb"))):
                if size >= SHARD and row[0] != rows[-1][0]:
                    yield settle(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[1])
        if rows:
            yield settle(rows)

    return map_batches(folded.repartition("anchor").sortWithinPartitions("anchor"), run, "sa long, sb long, found array<struct<a: int, b: int, m: long>>")


SEGMENT = ("anchor", "seg", "doc_id", "chunk", "row", "start")
SEGMENT_TYPE = "anchor long, seg binary, doc_id long, chunk int, row long, start int"


def with_ids(found: DataFrame) -> DataFrame:
    """sa and sb: a segment's text by two hashes."""
    return found.withColumns({"sa": F.xxhash64("seg"), "sb": F.xxhash64(F.lit(1), "seg")})


def halves(kind: Windows, units):
    """(key, from, to) of a hot anchor's segment by its keys: windows that hold the left one, then the others, which hold the right one."""
    for _, at, n, place, left, right in zip(*(x.tolist() for x in kind.anchors(units))):
        middle = min(max(at, place - kind.side + 1), at + n)
        for key, p, q in ((left, at, middle), (right, middle, at + n)):
            if p < q:
                yield key, p, q


def single(kind: Windows, units):
    """The windows of a hot key's segment, each its own anchor."""
    for i in range(len(units) - kind.width + 1):
        yield xxhash.xxh64_intdigest(kind.cut(units, i, 1)) - (1 << 63), i, i + 1


def finer(found: DataFrame, kind: Windows, parts: Callable) -> DataFrame:
    """Segments cut into the parts that `parts` names, by new anchors; a column start moves along, others stay as they are."""
    names = found.columns
    at = names.index("start") if "start" in names else None

    def run(batches):
        for b in batches:
            out = {n: [] for n in names}
            for _, seg, *rest in zip(*(c.to_pylist() for c in b.columns)):
                units = kind.units(seg)
                for key, p, q in parts(kind, units):
                    row = [key, kind.cut(units, p, q - p), *rest]
                    if at is not None:
                        row[at] += p
                    for name, v in zip(out, row):
                        out[name].append(v)
            yield out

    return map_batches(found, run, ", ".join(f"{f.name} {f.dataType.simpleString().replace('bigint', 'long')}" for f in found.schema))


def meetings(found: DataFrame, kind: Windows, lo: str, hi: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """From written segments (anchor, seg, lo, hi, ...): the segments, hot anchors dealt out; folded ones, each text once; what to delete."""
    names, folds, where, paths = found.columns, [], [], []
    found = with_ids(found)
    for parts in (halves, single, None):
        folded, path = materialise(with_ids(found.groupBy("anchor", "seg").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"))), "folded")
        paths.append(path)
        hot = parts and materialise(folded.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("anchor"), "hot")[0]
        if not hot or not hot.limit(1).count():
            folds.append(folded)
            where.append(found)
            break
        folds.append(join_small(folded, hot, "anchor", "left_anti"))
        where.append(join_small(found, hot, "anchor", "left_anti"))
        found, path = materialise(with_ids(finer(join_small(found, hot, "anchor", "left_semi").select(*names), kind, parts)), "segments")
        paths.append(path)
    return reduce(DataFrame.unionByName, where), reduce(DataFrame.unionByName, folds), paths


def covered(docs: DataFrame, kind: Windows, resolve: Callable) -> tuple[DataFrame, str]:
    """The text table and the folder with each chunk's covered runs of windows (row, a, b)."""
    spark = docs.sparkSession
    table = text_table(docs)
    shared = shared_keys(table, kind)
    found, path = materialise(segments(table, kind, shared), "segments")
    where, folded, paths = meetings(found, kind, "doc_id", "doc_id")
    met, met_path = materialise(resolved(folded, kind, resolve), "resolved")
    hits = where.join(met, ["sa", "sb"]).select("chunk", "row", "start", F.explode(F.filter("found", lambda r: r["m"] < F.col("doc_id"))).alias("r"))
    out = written_by_chunk(hits.select("chunk", "row", (F.col("start") + F.col("r.a")).alias("a"), (F.col("start") + F.col("r.b")).alias("b")), "covered", table)
    delete(spark, shared, path, met_path, *paths)
    return table, out


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the spans [a, b)."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    upto = np.maximum.accumulate(b)
    at = np.flatnonzero(np.concatenate(([True], a[1:] > upto[:-1])))
    return a[at], upto[np.concatenate((at[1:] - 1, [len(a) - 1]))]


def with_spans(table: DataFrame, folder: str, kind: Windows, finish: Callable, schema: str) -> DataFrame:
    """A row per document: finish(raw, units, starts, ends) gives its columns after doc_id."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches):
        last, rows, a, b_ = None, None, None, None
        none = np.zeros(0, np.int64)
        for chunk, b in per_chunk(batches):
            if chunk != last:
                found = chunk_file(folder, chunk, ["row", "a", "b"])
                if found is None:
                    rows, a, b_ = none, none, none
                else:
                    rows, a, b_ = (found.column(c).to_numpy().astype(np.int64) for c in ("row", "a", "b"))
                    order = np.argsort(rows, kind="stable")
                    rows, a, b_ = rows[order], a[order], b_[order]
                last = chunk
            out = {n: [] for n in names}
            for doc_id, raw, copy, row in zip(*(b.column(c).to_pylist() for c in ("doc_id", "raw", "copy", "row"))):
                units = kind.units(raw)
                i, j = np.searchsorted(rows, (row, row + 1))
                if copy and len(units) >= kind.width:
                    s, e = np.array([0]), np.array([len(units)])
                elif j > i:
                    s, e = merged(a[i:j], b_[i:j] + kind.width - 1)
                else:
                    s = e = none
                for name, v in zip(names, (doc_id, *finish(units, s, e))):
                    out[name].append(v)
            yield out

    return map_batches(table, run, schema)
