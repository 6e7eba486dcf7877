"""Best-fit packing of tokenised documents into fixed-length sequences.

Documents and gaps are kept sorted by size. Each superstep takes the longest remaining length class, gives all its
documents at once to their successor gaps (the smallest that fit), resolves the conflict between documents that want the
same gap by their rank in the class, updates the gaps, and repeats; documents without a gap open sequences. Sizes are
integers of at most `capacity`, so a sweep's state is runs of equal sizes, never rows: its length is bounded by the
capacity, not by the data. Ranks, the assignment of every piece to its run and place, and all token work are distributed.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, materialise, texts, utf8

CAPACITY = 4096
END_ID = 1
#: Words in each of the two generations that a worker process remembers over its tasks.
CACHED_WORDS = 400_000
MARKS = frozenset(b".,|:;!?)")
# Rules of the tokenizers whose ids can be taken word by word.
WORD_RULES = {
    "truncation": None,
    "padding": None,
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_KNOWN: dict[str, "WordIds"] = {}
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


class WordIds(dict):
    """Ids of words, by which whole texts become little-endian unsigned 32-bit bytes.

    Tokenizers with WORD_RULES never join characters across ASCII white space, drop the space itself, ignore case, and
    part a mark from the ASCII letter or digit before it. So a text's ids are its words' ids in a row, and few distinct
    words reach the tokenizer. When this generation is full it becomes the old one; words met again are young again.
    Tokenizers with other rules, or with added tokens that don't begin with `<|`, get whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.old = self.tokenizer.model.tokenize, {}
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.by_word = all(rules.get(k) == v for k, v in WORD_RULES.items()) and all(t["content"].startswith("<|") for t in rules.get("added_tokens", []))

    @classmethod
    def of(cls, path: str) -> WordIds:
        if path not in _KNOWN:
            _KNOWN[path] = cls(path)
        return _KNOWN[path]

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            if word[-1] in MARKS and word[-2:-1].isalnum():
                ids = self[word[:-1]] + self[word[-1:]]
            elif word.isalpha():  # bytes a-z: the rules before the model change nothing
                ids = np.array([t.id for t in self.model(word.decode())], "<u4").tobytes()
            else:
                ids = np.array(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = ids
        return ids

    def ids(self, text: bytes) -> bytes:
        if len(self) > CACHED_WORDS:
            self.old = dict(self)
            self.clear()
        if not self.by_word or b"<|" in text:  # a special token would have its own case
            return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, text.lower().split()))


def tokenise(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece of at most `capacity` ids; a document is its ids, then END_ID. rank: among the task's pieces of that length."""
    end = np.asarray([END_ID], "<u4").tobytes()

    def run(batches):
        ids_of, seen, part = WordIds.of(tokenizer_path).ids, {}, TaskContext.get().partitionId()
        for batch in batches:
            out = {n: [] for n in ("doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", "ids")}
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                ids = ids_of(text) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    block = ids[at : at + 4 * capacity]
                    n = len(block) // 4
                    rank = seen.get(n, 0)
                    seen[n] = rank + 1
                    for name, v in zip(out, (doc_id, piece, at // 4, n, zlib.crc32(block), part, rank, np.frombuffer(block, "<u4").astype("i4") if keep_ids else None)):
                        out[name].append(v)
            yield out

    return map_batches(texts(docs), run, PIECES + (", ids array<int>" if keep_ids else ""))


def sweep(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, documents, first sequence, documents per sequence, offset) and the number of sequences."""
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    runs, opened = [], 0

    def put(size: int, first: int, n: int) -> None:
        if n and size:
            if size not in gaps:
                gaps[size] = []
                insort(sizes, size)
            gaps[size].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            i = bisect_left(sizes, length)
            if i == len(sizes):  # no gap fits: open as many sequences as this class still fills
                n = -(-left // (capacity // length))
                put(capacity, opened, n)
                opened += n
                continue
            size = sizes[i]
            first, n = gaps[size].pop()
            if not gaps[size]:
                del gaps[size]
                sizes.pop(i)
            each = size // length
            full = min(n, left // each)
            if not full:
                full, each = 1, left
            runs.append((length, rank, full * each, first, each, capacity - size))
            put(size - each * length, first, full)
            put(size, first + full, n - full)
            left -= full * each
            rank += full * each
    return np.asarray(sorted(runs), np.int64).reshape(-1, 6), opened


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pack every document; only those longer than `capacity` are cut.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids). A null or empty text is the one id
    END_ID; a null doc_id is carried; repeated rows are packed each; pieces of equal length (ties) go by task and place in it, which
    changes their places but not the number of sequences; a very long text is held whole by one task and cut into pieces; an
    empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    pieces, _ = materialise(tokenise(docs, tokenizer_path, capacity, keep_ids), "pieces")
    counts, _ = materialise(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    # At most one row per length: capacity rows, whatever the input.
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = sweep(totals, capacity)
    known = spark.sparkContext.broadcast((runs, (runs[:, 0] << 44) | runs[:, 1]))
    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches):
        table, keys = known.value
        for b in batches:
            length, rank = (b.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            rank = rank + b.column("before").to_numpy(zero_copy_only=False)
            run = table[np.searchsorted(keys, (length << 44) | rank, "right") - 1]
            at = rank - run[:, 1]
            yield {n: b.column(n) for n in names} | {"sequence_id": run[:, 3] + at // run[:, 4], "offset": run[:, 5] + at % run[:, 4] * length} | ({"ids": b.column("ids")} if keep_ids else {})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + (", ids array<int>" if keep_ids else "")
    return map_batches(pieces.join(before, ["part", "length"]), place, schema)
