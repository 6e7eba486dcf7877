"""Language-model scoring of whole documents: unigram counts and a gated recurrent network, both learned from all training documents.

Words are counted over all training documents. The network's outputs are the commonest words, the end of a document, and
buckets of the other words by their last two characters; a word in a bucket has its smoothed share in the bucket's counts.
So the model gives every word a probability (words that weren't seen count as one word a bucket). It is trained in rounds
over growing parts of the corpus: in each, every partition trains the last round's weights on its own documents, and the
weights are averaged by tokens. Every training document goes through the network once, and every window gives a gradient step.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialise
from .gru import OUTPUTS, SIZE, Model, first_weights

#: Words whose counts every task has, and bytes of such a word; rarer ones meet their counts in a join.
COMMON, COMMON_BYTES = 1 << 17, 64
BUCKETS = 63
#: Outputs that are words; one is the end.
WORDS = OUTPUTS - BUCKETS - 1
#: Sixteenths of the training documents in each round.
ROUNDS = (1, 4, 11)
#: Tokens that go through the network together, words counted before they are handed on, numbers in a block of weights.
CHUNK, COUNTED, BLOCK = 1 << 21, 400_000, 4096


def is_held_out(doc_id: Column) -> Column:
    """One document in seven, by crc32 of its id as text; a null id is an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space of all texts, A-Z in lower case, and the number of the text that each is from."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, of = split.flatten(), pc.list_parent_indices(split)
    some = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(some), of.filter(some).to_numpy().astype(np.int64)


def bucket(word: bytes) -> int:
    return zlib.crc32(word.decode("utf-8", "replace")[-2:].encode("utf-8", "replace")) % BUCKETS


def word_counts(given: DataFrame) -> DataFrame:
    """word, n: over training documents; the word "" is the end of a document."""

    def run(batches):
        held, rows, ends = [], 0, 0

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

        def out(t: pa.Table):
            return {name: pa.concat_arrays([*t[name].chunks, pa.array(more, t[name].type)]) for name, more in (("word", [""]), ("n", [ends]))}

        for b in batches:
            found = pc.value_counts(words(b.column(0))[0])
            held.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
            rows, ends = rows + len(found), ends + b.num_rows
            if rows > 4 * COUNTED:
                held = [summed()]
                rows = held[0].num_rows
                if rows > COUNTED:
                    yield out(held[0])
                    held, rows, ends = [], 0, 0
        if held:
            yield out(summed())

    parts = map_batches(given.filter(~F.col("held_out")).select("text"), run, "word string, n long")
    return materialise(parts.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")[0]


def least_common(counts: DataFrame) -> int:
    """The least n so that at most COMMON words have it or more: whole classes of equal n (of like n from 4096 on), so nothing is ranked in one task."""
    like = F.when(F.col("n") < 4096, F.col("n")).otherwise(4096 + F.floor(64 * F.log2(F.col("n") / 4096)))
    least, words = 1 << 62, 0
    for r in sorted(counts.groupBy(like.alias("like")).agg(F.min("n").alias("n"), F.count("*").alias("words")).collect(), reverse=True):  # some 7000 classes at most
        words += r["words"]
        if words > COMMON:
            break
        least = r["n"]
    return least


class Vocabulary:
    """Counts of common words, sums, and the outputs by falling count. Its size doesn't depend on the corpus."""

    def __init__(self, counts: DataFrame):
        self.tokens, distinct = (int(x or 0) for x in counts.agg(F.sum("n"), F.count("*")).first())
        self.base = float(self.tokens + distinct + 1)
        short = counts.filter((F.octet_length("word") <= COMMON_BYTES) & (F.col("word") != ""))
        self.least = least_common(short)
        common = sorted(((r["word"].encode(), r["n"]) for r in short.filter(F.col("n") >= self.least).collect()), key=lambda x: (-x[1], x[0]))
        ends = counts.filter("word = ''").first()
        self.ends = int(ends["n"]) if ends else 0
        self.counts = np.array([n for _, n in common], np.int64)
        self.index = {w: i for i, (w, _) in enumerate(common)}
        # Sums by bucket over every word that isn't an output itself.
        own = counts.sparkSession.createDataFrame([(w.decode(),) for w, _ in common[:WORDS]], "word string")
        rare = counts.join(F.broadcast(own), "word", "left_anti").filter("word <> ''")  # WORDS rows at most
        sums = rare.groupBy((F.crc32(F.right("word", F.lit(2))) % BUCKETS).cast("int").alias("bucket")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
        n, v = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for r in sums:
            n[r["bucket"]], v[r["bucket"]] = r["n"], r["v"]
        self.bucket_base = (n + v + 1).astype(float)
        # Outputs: end, words, buckets; then by count, so that a class holds outputs of like count.
        weight = np.zeros(OUTPUTS)
        weight[0], weight[1 : 1 + min(WORDS, len(common))], weight[1 + WORDS : 1 + WORDS + BUCKETS] = self.ends, self.counts[:WORDS], n
        order = np.argsort(-weight, kind="stable")
        self.place = np.empty(OUTPUTS, np.int64)
        self.place[order] = np.arange(OUTPUTS)
        self.weight = weight[order]
        self.end = int(self.place[0])
        at = np.arange(len(common))
        buckets = np.array([bucket(w) if i >= WORDS else 0 for i, (w, _) in enumerate(common)], np.int64)
        self.output = self.place[np.where(at < WORDS, 1 + np.minimum(at, WORDS - 1), 1 + WORDS + buckets)] if len(common) else np.zeros(0, np.int64)
        self.log_base = np.log10((self.counts + 1) / self.base)
        self.log_inner = np.where(at < WORDS, 0.0, np.log10((self.counts + 1) / self.bucket_base[buckets])) if len(common) else np.zeros(0)
        self.log_end = float(np.log10((self.ends + 1) / self.base))


ENCODED = "row long, doc_id long, held_out boolean, part int, n_tokens long, n_known long, base double, inner double, ids binary, rare array<string>, times array<int>"


def encode(given: DataFrame, known) -> DataFrame:
    """Documents as outputs (16 bits each), with what is certain of their scores; rare words with their number wait for their counts."""

    def run(batches):
        v: Vocabulary = known.value
        common = pa.array([w.decode() for w in v.index], pa.string())
        for batch in batches:
            flat, of = words(batch.column(4))
            m = batch.num_rows
            at = pc.fill_null(pc.index_in(flat, value_set=common), -1).to_numpy(zero_copy_only=False)
            seen = at >= 0
            held, rare, of_rare = at[seen], flat.filter(pa.array(~seen)), of[~seen]
            ends = pc.utf8_slice_codeunits(rare, -2).dictionary_encode()
            places = np.array([v.place[1 + WORDS + bucket(e.encode())] for e in ends.dictionary.to_pylist()], np.int64)
            n = np.bincount(of, minlength=m)
            ids = np.empty(len(of) + m, np.uint16)
            spots = np.arange(len(of)) + of
            ids[spots[seen]], ids[spots[~seen]], ids[np.cumsum(n) + np.arange(m)] = v.output[held], places[ends.indices.to_numpy()], v.end
            sums = lambda numbers: np.bincount(of[seen], numbers[held], m)
            times = pa.table({"of": of_rare, "word": rare}).group_by(["of", "word"], use_threads=False).aggregate([([], "count_all")])
            order = np.argsort(times["of"].to_numpy(), kind="stable")
            starts = pa.array(np.concatenate(([0], np.cumsum(np.bincount(times["of"].to_numpy(), minlength=m)))), pa.int32())
            lists = lambda column, kind: pa.ListArray.from_arrays(starts, column.take(order).combine_chunks().cast(kind))
            limits = np.concatenate(([0], np.cumsum(n + 1) * 2)).astype(np.int32)
            yield {c: batch.column(i) for i, c in enumerate(("row", "doc_id", "held_out", "part"))} | {
                "n_tokens": n + 1, "n_known": np.bincount(of[seen], minlength=m) + (v.ends > 0), "base": sums(v.log_base) + v.log_end, "inner": sums(v.log_inner),
                "ids": pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(limits), pa.py_buffer(ids)]), "rare": lists(times["word"], pa.string()), "times": lists(times["count_all"], pa.int32()),
            }

    return map_batches(given.select("row", "doc_id", "held_out", "part", "text"), run, ENCODED)


def chunks(batches, *more: str) -> Iterator[tuple]:
    """Documents' outputs, some CHUNK tokens at a time, with lists of the columns `more`."""
    docs, rest, n = [], [[] for _ in more], 0
    for b in batches:
        for ids in b.column("ids").to_pylist():
            docs.append(np.frombuffer(ids, np.uint16).astype(np.int32))
            n += len(docs[-1])
        for k, name in enumerate(more):
            rest[k] += b.column(name).to_pylist()
        if n >= CHUNK:
            yield docs, *rest
            docs, rest, n = [], [[] for _ in more], 0
    if docs:
        yield docs, *rest


def train_round(encoded: DataFrame, state: np.ndarray, end: int) -> np.ndarray:
    """Weights and their squares after a round: each partition trains on its documents, blocks of weights are averaged by tokens."""
    start = encoded.sparkSession.sparkContext.broadcast(state)

    def run(batches):
        model, squares, tokens = Model(start.value[:SIZE], end), start.value[SIZE:].copy(), 0
        for (docs,) in chunks(batches):
            model.train(docs, squares)
            tokens += sum(map(len, docs))
        if tokens:
            both = np.concatenate([model.flat, squares]).astype("<f4")
            at = range(0, len(both), BLOCK)
            yield {"block": [i // BLOCK for i in at], "tokens": [tokens] * len(at), "numbers": [both[i : i + BLOCK].tobytes() for i in at]}

    def add(batches):
        sums: dict[int, list] = {}
        for b in batches:
            for block, tokens, numbers in zip(*(c.to_pylist() for c in b.columns)):
                s = sums.setdefault(block, [0, 0.0])
                s[0] += tokens
                s[1] = s[1] + tokens * np.frombuffer(numbers, "<f4").astype(float)
        yield {"block": list(sums), "tokens": [s[0] for s in sums.values()], "numbers": [(s[1] / s[0]).astype("<f4").tobytes() for s in sums.values()]}

    schema = "block int, tokens long, numbers binary"
    trained, _ = materialise(map_batches(encoded.select("ids"), run, schema), "trained")
    averaged = sorted(map_batches(trained.repartition("block"), add, schema).collect())  # as many rows as the model has blocks
    return np.concatenate([np.frombuffer(r["numbers"], "<f4") for r in averaged]) if averaged else state


def fit(encoded: DataFrame, v: Vocabulary) -> np.ndarray:
    """The network's weights from all training documents."""
    state, lo = np.concatenate([first_weights(v.weight), np.zeros(SIZE, np.float32)]), 0
    for n in ROUNDS:
        state = train_round(encoded.filter(~F.col("held_out") & F.col("part").between(lo, lo + n - 1)), state, v.end)
        lo += n
    return state[:SIZE]


def rare_scores(encoded: DataFrame, counts: DataFrame, v: Vocabulary) -> DataFrame:
    """By row: rare_known, rare_base, rare_inner of its rare words, whose counts come by a join on the word (none of them is common, so no key is hot)."""
    used = encoded.select("row", F.inline(F.arrays_zip("rare", "times"))).withColumnsRenamed({"rare": "word", "times": "k"})
    rarer = counts.filter((F.col("n") < v.least) | (F.octet_length("word") > COMMON_BYTES))
    base = F.lit(v.bucket_base.tolist())[(F.crc32(F.right("word", F.lit(2))) % BUCKETS).cast("int")]
    n = F.coalesce("n", F.lit(0))
    return used.join(rarer, "word", "left").groupBy("row").agg(
        F.sum(F.when(n > 0, F.col("k")).otherwise(0)).alias("rare_known"), F.sum(F.col("k") * F.log10((n + 1) / F.lit(v.base))).alias("rare_base"), F.sum(F.col("k") * F.log10((n + 1) / base)).alias("rare_inner")
    )


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the whole text's probability).

    Null and empty texts are the one token that ends a document; a null doc_id is carried, and trained on; a repeated row counts and is
    scored each time; words of equal count (ties) are ranked by themselves; a very long text keeps its state over all its windows; without
    training documents every base probability is 1 and the network is as it began; an empty table gives no rows; other columns are ignored.
    Very long words are rare ones: their counts are looked up by a join, like those of all words beyond the COMMON first.
    """
    spark = docs.sparkSession
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(sum(ROUNDS))).cast("int")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    given = given.select("doc_id", "text", is_held_out(F.col("doc_id")).alias("held_out"), part.alias("part"), F.monotonically_increasing_id().alias("row"))
    counts = word_counts(given)
    v = Vocabulary(counts)
    encoded, _ = materialise(encode(given, spark.sparkContext.broadcast(v)), "encoded")
    weights = spark.sparkContext.broadcast(fit(encoded, v))
    end = v.end

    def run(batches):
        model, names = Model(weights.value, end), ("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "inner")
        for documents, *rest in chunks(batches, *names):
            yield dict(zip(names, rest)) | {"network": model.score(documents) / np.log(10)}

    scored = map_batches(encoded.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "inner", "ids"), run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, inner double, network double")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return scored.join(rare_scores(encoded, counts, v), "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("rare_known")).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rare_base")).alias("base_score"), (F.col("network") + F.col("inner") + zero("rare_inner")).alias("score"),
    )
