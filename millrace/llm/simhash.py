"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints that differ in at most 4 of 64 bits differ in at most 4 of 8 bytes, so they share at least 4 positional
bytes: the guaranteed minimum. A list of all fingerprints with one byte in one place holds a 256th of the corpus, so the
index is keyed by three positional bytes together: TRIPLES is a family of byte triples of which any four positions
contain one, so no pair with four shared bytes is missed. Inside a list the other five positions are inverted again:
postings of a place and a byte give its pairs, shared bytes are tallied by pair, pairs whose tally reaches four are
verified bit by bit, and only a spanning forest of the links leaves. A list over BLOCK is dealt out by a fourth
positional byte, which every pair with four shared bytes has in common; what is still over BLOCK, prints with four equal
bytes, goes as pairs of blocks, so no task holds more than two blocks of it at once. Equal fingerprints are one node.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, join_small, map_batches, materialise, texts, wrapped, wrapped_texts
from .graph import components

WORDS, BITS, BYTES = 4, 4, 8
BLOCK = 1024
#: Pairs that may be formed at once while shared bytes are tallied.
PAIRS = 1 << 22
SEED = 42


def covering_triples() -> list[tuple[int, ...]]:
    """20 triples of 8 positions such that any 4 positions contain one: in three groups, those within a group and those with two in a group and one in the next."""
    group = [0, 0, 0, 1, 1, 1, 2, 2]

    def chosen(t):
        g = sorted(group[i] for i in t)
        for x in range(3):
            if g.count(x) == 3 or g.count(x) == 2 and g.count((x + 1) % 3) == 1:
                return True
        return False

    return [t for t in combinations(range(BYTES), 3) if chosen(t)]


TRIPLES = covering_triples()


def simhash(text: str) -> int:
    """Lower-cased A-Z, words by ASCII white space, XXH64 of 4-word shingles (repeats included); as a signed 64-bit number."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - WORDS + 1)
    last = ends[WORDS - 1 :] if len(words) >= WORDS else ends[-1:]
    count = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 15):
        h = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[i : min(n, i + (1 << 15))].tolist(), last[i : i + (1 << 15)].tolist())], "<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > n).view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long)."""

    def run(batches):
        for b in batches:
            yield {"doc_id": b.column(0), "fp": [simhash(t) for t in b.column(1).to_pylist()]}

    return map_batches(texts(docs), run, "doc_id long, fp long")


def run_pairs(run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of neighbours with the same number in `run`, which is sorted."""
    start = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    end = np.repeat(np.concatenate((start[1:], [len(run)])), np.diff(np.concatenate((start, [len(run)]))))
    at = np.arange(len(run))
    left, right = [], []
    d = 1
    while len(at := at[at + d < end[at]]):
        left.append(at)
        right.append(at + d)
        d += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (at, at)


def tallied(fp: np.ndarray, group: np.ndarray, keyed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows in a group that share BYTES - BITS positional bytes or more. keyed: a bit for each place that all the group shares."""
    known = np.bitwise_count(keyed)
    codes = []
    whole = np.flatnonzero(known >= BYTES - BITS)
    i, j = run_pairs(group[whole])
    codes.append(whole[i] * len(fp) + whole[j])
    octets = fp.view(np.uint8).reshape(-1, BYTES)
    for place in range(BYTES):
        rows = np.flatnonzero((known < BYTES - BITS) & (keyed >> place & 1 == 0))
        order = rows[np.lexsort((octets[rows, place], group[rows]))]
        posting = np.cumsum(np.concatenate(([0], (group[order][1:] != group[order][:-1]) | (octets[order, place][1:] != octets[order, place][:-1]))))[: len(order)]
        i, j = run_pairs(posting)
        codes.append(np.minimum(order[i], order[j]) * len(fp) + np.maximum(order[i], order[j]))
    pair, count = np.unique(np.concatenate(codes), return_counts=True)
    left = pair // len(fp)
    reach = known[left] + np.where(known[left] >= BYTES - BITS, 0, count) >= BYTES - BITS
    return left[reach], pair[reach] % len(fp)


def forest(fp: np.ndarray, group: np.ndarray, keyed: np.ndarray) -> tuple[list[int], list[int]]:
    """Spanning forest of the links inside each group; rows are sorted by group."""
    n = len(fp)
    start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.concatenate((start, [n])))
    turn = np.cumsum(size * size) // PAIRS
    cuts = np.concatenate((start[np.concatenate(([True], turn[1:] != turn[:-1]))], [n]))
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        i, j = tallied(fp[a:b], group[a:b], keyed[a:b])
        linked = np.bitwise_count((fp[a + i] ^ fp[a + j]).view(np.uint64)) <= BITS
        for x, y in zip((a + i[linked]).tolist(), (a + j[linked]).tolist()):
            if (x := root(x)) != (y := root(y)):
                parent[max(x, y)] = min(x, y)
    at = np.array([i for i in range(n) if parent[i] != i], np.int64)
    return fp[at].tolist(), fp[np.array([root(i) for i in at.tolist()], np.int64)].tolist()


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the fingerprints of nodes (fp, each once) as all their links do."""
    signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m)
    key = lambda t: F.xxhash64(F.lit(sum(1 << i for i in t)), F.col("fp").bitwiseAND(signed(sum(0xFF << (8 * i) for i in t))))
    keys = F.array(*(F.struct(key(t).alias("key"), F.lit(sum(1 << i for i in t)).alias("keyed")) for t in TRIPLES))
    postings = nodes.select("fp", F.explode(keys).alias("k")).select("fp", "k.key", "k.keyed")
    lists, _ = materialise(postings.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "lists")
    own = postings.join(lists, "key")
    parts = own.filter(F.col("n") <= BLOCK).select("fp", F.col("key").alias("part"), "keyed")
    if lists.filter(F.col("n") > BLOCK).limit(1).count():
        place = lambda i: F.struct(F.lit(1 << i).alias("bit"), F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255)).alias("byte"))
        fourth = own.filter(F.col("n") > BLOCK).select("fp", "key", "keyed", F.explode(F.array(*map(place, range(BYTES)))).alias("p")).filter(F.col("keyed").bitwiseAND(F.col("p.bit")) == 0)
        fourth, _ = materialise(fourth.select("fp", F.xxhash64("key", "p.bit", "p.byte").alias("key"), F.col("keyed").bitwiseOR(F.col("p.bit")).alias("keyed")), "fourth")
        lists, _ = materialise(fourth.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "lists")
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        mine = F.pmod(F.xxhash64("fp"), blocks).cast("int")
        dealt = fourth.join(lists, "key").select("fp", "key", "keyed", mine.alias("mine"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        parts = parts.unionByName(dealt.select("fp", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("part"), "keyed"))

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(table, whole):
            part, fp, keyed = (np.ascontiguousarray(table.column(n).to_numpy()) for n in ("part", "fp", "keyed"))
            cut = len(part) if whole else int(np.searchsorted(part, part[-1]))
            a, b = forest(fp[:cut], part[:cut], keyed[:cut]) if cut else ([], [])
            return {"a": a, "b": b}, table.slice(cut)

        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= 1 << 15:
                out, rest = flush(pa.Table.from_batches(held), False)
                yield out
                held, size = rest.to_batches(), rest.num_rows
        if size:
            yield flush(pa.Table.from_batches(held), True)[0]

    return map_batches(parts.repartition("part").sortWithinPartitions("part", "fp"), run, "a long, b long")


def groups(prints: DataFrame) -> DataFrame:
    """From (fp, ...) rows that are written: (fp, root) of every fingerprint; the root names its component."""
    spark = prints.sparkSession
    # a number given isn't merged later: 20 keys of each print leave every task
    dealt = prints.select("fp").distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "fp")
    nodes, path = materialise(dealt, "nodes")
    found = components(links(nodes))
    out, _ = materialise(nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root")), "roots")
    delete(spark, path)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links).

    A null or empty text has fingerprint zero and links as any other; a null doc_id is carried and never names a
    component (one of null ids only has a null one); repeated rows are reported each; a very long text is read whole, its
    shingles in turns; exactly BITS differing bits link; no rows give no rows; other columns are ignored.
    """
    prints, _ = materialise(fingerprints(docs), "prints")
    roots = groups(prints)
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    named = roots.join(firsts, "fp").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    names, _ = materialise(roots.join(named, "root").select("fp", "component_id"), "names")
    return join_small(prints, names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each component: the smallest doc_id (nulls last, then the first row). All columns are kept, whatever their names.

    Null, empty and very long texts as in near_duplicates; of repeated rows one stays; no rows give no rows.
    """
    table, _ = materialise(wrapped(docs), "rows")

    def run(batches):
        for b in batches:
            yield {"doc_id": b.column(0), "row": b.column(2), "fp": [simhash(t) for t in b.column(1).to_pylist()]}

    prints, _ = materialise(map_batches(wrapped_texts(table), run, "doc_id long, row long, fp long"), "prints")
    roots = groups(prints)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    firsts = prints.groupBy("fp").agg(F.min(key).alias("best"))
    best = roots.join(firsts, "fp").groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias("row"))
    drop, _ = materialise(prints.select("row").join(best, "row", "left_anti"), "drop")
    return join_small(table, drop, "row", "left_anti").select("own.*")
