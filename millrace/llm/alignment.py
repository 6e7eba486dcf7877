"""Alignment of the tokens that two tokenizers give a text, by a dangling-suffix transducer.

Both token sequences spell the same bytes. The transducer reads a token of the side that is behind; its state is which side
leads and the bytes of that side that the other hasn't matched yet. Transitions are memoised by state and next token (a
residual is a suffix of one token, so there are few), and a group closes where the residual is empty. What a word's tokens
give is remembered too: no token reaches over a word's end, so there the residual is empty in every text.

A pair of tokens whose byte ranges end together is a link: tokens aren't empty, so each group has one, its last token on
either side. Of such two tokens one is a suffix of the other; hence the table of linked ids has at most as many rows as
the two vocabularies have bytes, however large the corpus is, and may be broadcast.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialise, texts

#: Words in each of the two generations that a worker remembers, characters of a word that is remembered, transitions before the memo starts anew.
CACHED_WORDS, CACHED_CHARS, CACHED_STEPS = 300_000, 40, 1_000_000
#: A word is what stands between these, with those before it; texts with other white space are taken whole.
WORD, ODD_SPACE = re.compile(r"[ \n\t]*[^ \n\t]+|[ \n\t]+"), re.compile(r"[^\S \n\t]")
TAIL = re.compile(r"(.*[A-Za-z0-9])([!-/:-@\[-`{-~]+)", re.S)
#: The rules under which the first tokenizer's words can be taken one by one.
WORD_RULES = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}
ENCODED = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>"
GROUPS = "groups array<struct<a:array<int>,b:array<int>>>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Transducer:
    """Groups of two token sequences over the same bytes; a_bytes and b_bytes give a token's bytes by id."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        self.bytes = (a_bytes, b_bytes)
        self.steps: dict[tuple[int, bytes, int], tuple[int, bytes]] = {}

    def step(self, lead: int, residual: bytes, token: int) -> tuple[int, bytes]:
        """The state after `token` of the side behind (side 0 where nothing dangles)."""
        key = (lead, residual, token)
        found = self.steps.get(key)
        if found is None:
            if len(self.steps) >= CACHED_STEPS:
                self.steps.clear()
            new = self.bytes[1 - lead][token]
            if residual.startswith(new):
                found = (lead, residual[len(new) :])
            elif new.startswith(residual):
                found = (1 - lead, new[len(residual) :])
            else:
                raise ValueError("the sequences spell different bytes")
            self.steps[key] = found
        return found

    def groups(self, a: list[int], b: list[int]) -> list[tuple[list[int], list[int]]]:
        known, step, out, i, j, first, second = self.steps, self.step, [], 0, 0, 0, 0
        lead, residual = 1, b""  # nothing dangles: side 0 reads
        while i < len(a) or j < len(b):
            if lead:
                token, i = a[i], i + 1
            else:
                token, j = b[j], j + 1
            lead, residual = known.get((lead, residual, token)) or step(lead, residual, token)
            if not residual:
                out.append((a[first:i], b[second:j]))
                first, second, lead = i, j, 1
        return out


def byte_level() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Tokens of both tokenizers and their groups: by word where the vocabularies allow that, else of the whole text."""

    _known: dict[tuple[str, str], Aligner] = {}

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        table, names = byte_level(), self.a.get_vocab(with_added_tokens=True)
        a_bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            a_bytes[i] = bytes(table[c] for c in name) if all(c in table for c in name) else name.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.transducer = Transducer(a_bytes, b_bytes)
        with open(a_path, encoding="utf-8") as f:
            rules = json.load(f)
        # Two characters that stand together in no piece are never joined by a merge.
        self.joins = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.newline = self.b.encode("\n")
        spaced = any((x[1] in "\n\t" or x[1] == "▁") and x[0] != "▁" or x[0] in "\n\t" for x in self.joins)
        self.by_word = not spaced and all(rules.get(k) == v for k, v in WORD_RULES.items()) and len(self.newline) == 2 and self.spells([], self.b.encode(" x \n"), b"  x \n")
        self.words: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    @classmethod
    def of(cls, a_path: str, b_path: str) -> Aligner:
        if (a_path, b_path) not in cls._known:
            cls._known[a_path, b_path] = cls(a_path, b_path)
        return cls._known[a_path, b_path]

    def spells(self, a: list[int], b: list[int], raw: bytes) -> bool:
        x, y = self.transducer.bytes
        return (not a or b"".join(map(x.__getitem__, a)) == raw) and b"".join(map(y.__getitem__, b)) == raw

    def whole(self, text: str) -> tuple[list[int], list[int]] | None:
        """Tokens of both sides for a whole text; None where either doesn't spell space+text."""
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        return (a, b) if a and self.spells(a, b, (" " + text).encode("utf-8", "replace")) else None

    def cut(self, word: str) -> int:
        """Where a word comes apart into two that share no token: behind a line's end, before the marks at its end; 0: nowhere."""
        if word[0] == "\n" and len(word) > 1 and not word[1].isspace():
            return 1
        tail = TAIL.fullmatch(word)
        return tail.end(1) if tail and word[tail.end(1) - 1 : tail.end(1) + 1] not in self.joins else 0

    def learn(self, words: list[str]) -> None:
        """(tokens of a, of b, groups as text, codes of linked pairs) of each word; None if a side doesn't spell it."""
        known, cuts, whole, todo = self.words, {}, {}, words
        while todo:
            word = todo.pop()
            if word in known or word in cuts or word in whole:
                continue
            if (old := self.old.get(word)) is not None:
                known[word] = old
            elif at := self.cut(word):
                cuts[word] = at
                todo += (word[:at], word[at:])
            else:
                whole[word] = None
        names = list(whole)
        of_a = self.a.encode_batch_fast(names, add_special_tokens=False)
        of_b = self.b.encode([w[1:] if w[0] == " " else "\n" + w for w in names], num_threads=1)
        for word, a, b in zip(names, of_a, of_b):
            a, b = a.ids, b if word[0] == " " else b[2:]
            known[word] = packed(self.transducer.groups(a, b)) if a and self.spells(a, b, word.encode("utf-8", "replace")) else None

        def joined(word: str) -> tuple | None:
            if word not in known:
                x, y = joined(word[: cuts[word]]), joined(word[cuts[word] :])
                known[word] = x and y and (x[0] + y[0], x[1] + y[1], x[2] + b";" + y[2], x[3] + y[3])
            return known[word]

        for word in cuts:
            joined(word)

    def __call__(self, texts: list[str]) -> list[tuple | None]:
        """What learn() says of a word, of each whole text; None: it has no tokens."""
        split = [WORD.findall(" " + t) if t and self.by_word and not ODD_SPACE.search(t) else None for t in texts]
        if len(self.words) > CACHED_WORDS:
            self.old, self.words = self.words, {}
        new = [w for w in set().union(*(x for x in split if x)) if w not in self.words]
        self.learn(list(new))
        out = []
        for text, words in zip(texts, split):
            found = None
            if words:
                parts = [*map(self.words.__getitem__, words)]
                if None not in parts:
                    a, b, groups, pairs = zip(*parts)
                    found = sum(a), sum(b), b";".join(groups), b"".join(pairs)
            if text and found is None and (ids := self.whole(text)):  # a word that isn't spelt: only the whole text can tell
                found = packed(self.transducer.groups(*ids))
            out.append(found)
        for w in new:
            if len(w) > CACHED_CHARS:
                del self.words[w]
        return out


def parsed(groups: bytes) -> list[tuple[list[int], list[int]]]:
    return [tuple(list(map(int, side.split(b","))) for side in g.split(b"|")) for g in groups.split(b";")] if groups else []


def packed(groups: list[tuple[list[int], list[int]]]) -> tuple:
    text = str(groups).replace("], [", "|").replace("]), ([", ";").replace(", ", ",")[3:-3]
    codes = [a[-1] << 32 | b[-1] for a, b in groups]
    return sum([len(a) for a, _ in groups]), sum([len(b) for _, b in groups]), text.encode(), struct.pack(f"<{len(codes)}q", *codes)


def encode(docs: DataFrame, a_path: str, b_path: str, keep_groups: bool = False) -> DataFrame:
    """Per document its sizes, the digest of its groups, and its linked pairs (a's id << 32 | b's id) with their number (and the groups)."""

    def run(batches):
        aligner = Aligner.of(a_path, b_path)
        for batch in batches:
            out = {n: [] for n in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times", "groups")}
            for doc_id, found in zip(batch.column(0).to_pylist(), aligner(batch.column(1).to_pylist())):
                a, b, groups, pairs = found or (0, 0, b"", b"")
                codes, times = np.unique(np.frombuffer(pairs, "<i8"), return_counts=True)
                kept = [{"a": x, "b": y} for x, y in parsed(groups)] if keep_groups else None
                for name, v in zip(out, (doc_id, a, b, len(pairs) // 8, hashlib.sha256(groups).hexdigest() if groups else "", codes, times.astype(np.int32), kept)):
                    out[name].append(v)
            yield out

    return map_batches(texts(docs), run, ENCODED + (f", {GROUPS}" if keep_groups else ""))


def pair_counts(encoded: DataFrame) -> DataFrame:
    """pair, n: links corpus-wide that hold it; best: n is its b id's highest. At most as many rows as the vocabularies have bytes."""
    counts = encoded.select(F.inline(F.arrays_zip("pairs", "times"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n"))
    counts, _ = materialise(counts.withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)), "pair-counts")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """RESULT, one row per document.

    Null, empty, or not spelt by both tokenizers: zeros and no digest. A null doc_id is carried; a repeated row counts each time; ids that
    tie for a b id's highest count are all best; a very long text is aligned whole by one task, which keeps each different pair once; an empty
    table gives no rows; other columns are ignored.
    """
    encoded, _ = materialise(encode(docs, a_path, b_path), "aligned")
    table = pair_counts(encoded).toArrow().sort_by("pair")
    known = docs.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))

    def run(batches):
        pair, n, best = known.value
        for batch in batches:
            of = dict(zip(batch.schema.names, batch.columns))
            links, bests, sums = [], [], []
            for codes, times in zip(of["pairs"], of["times"]):
                at, times = np.searchsorted(pair, codes.values.to_numpy()), times.values.to_numpy().astype(np.int64)
                links.append(int(times.sum()))
                bests.append(int(times @ best[at]))
                sums.append(int(times @ n[at]))
            yield {k: of[k] for k in ("doc_id", "n_a", "n_b", "n_groups")} | {"n_links": links, "n_best": bests, "count_sum": sums, "groups_sha256": of["groups_sha256"]}

    return map_batches(encoded, run, RESULT)
