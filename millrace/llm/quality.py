"""Quality rules with cross-document line frequency.

Lines are normalised (lower case, digits as 0, white space as one space) and hashed; the documents of a host that hold a
line are counted over the whole corpus; lines above the limit go, and documents that lose too many of their words go.
"""

from __future__ import annotations

import re
from collections import Counter

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_small, map_batches, materialise

#: A line in more documents of one host than this is boilerplate; a document must keep at least this share of its words.
LINE_LIMIT, LEAST_KEPT = 20, 0.5
SYMBOLS = re.compile(r"[#*$%&|<>]")
DIGIT = re.compile(rb"[0-9]")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def normalised(line: bytes) -> bytes:
    return DIGIT.sub(b"0", b" ".join(line.decode("utf-8", "replace").lower().encode().split()))


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more in the text, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    n, upto = 0, 0
    if len(seen) == len(windows):
        return 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            n += i + 3 - max(i, upto)
            upto = i + 3
    return n


def measure(text: str) -> tuple[tuple[int, ...], dict[int, int]]:
    """The base numbers, and the words that stand in each distinct normalised line (by hash).

    Words are separated by ASCII white space, which is what bytes.split() does.
    """
    raw = text.encode()
    words = raw.split()
    seen, dups, lines = set(), 0, {}
    for line in raw.split(b"\n"):
        if own := line.split():
            dups += line in seen
            seen.add(line)
            h = xxhash.xxh64_intdigest(normalised(line)) - (1 << 63)
            lines[h] = lines.get(h, 0) + len(own)
    n_chars = sum(len(w) for w in words) if len(raw) == len(text) else sum(len(w.decode()) for w in words)
    return (len(words), n_chars, len(SYMBOLS.findall(text)), dups, repeat_words(words)), lines


def rules(docs: DataFrame, host: str = "source", limit: int = LINE_LIMIT, least: float = LEAST_KEPT) -> DataFrame:
    """doc_id, the base numbers, base_failed, n_line_words (words in removed lines), kept.

    A null or empty text has no words and fails; null hosts are one host; rows with the same doc_id are one document when
    lines are counted, and are judged one by one; a row with a null doc_id is judged and counts for no line; very long
    texts are read whole, in linear time; a line at the limit exactly stays, as does a document that keeps exactly the
    least share; an empty table gives no rows; other columns are ignored. The text is read once: each document's numbers
    and line hashes go to a written table, from which lines are counted and documents judged.
    """

    def run(batches):
        for b in batches:
            out = {n: [] for n in (*BASE, "lines")}
            for text in b.column("text").to_pylist():
                numbers, lines = measure(text)
                for n, v in zip(BASE, numbers):
                    out[n].append(v)
                out["lines"].append([{"h": h, "n": n} for h, n in lines.items()])
            yield out | {"doc_id": b.column("doc_id"), "host": b.column("host")}

    schema = "doc_id long, host string, " + ", ".join(f"{n} long" for n in BASE) + ", lines array<struct<h: long, n: int>>"
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"))
    table, _ = materialise(map_batches(source, run, schema).withColumn("row", F.monotonically_increasing_id()), "quality")
    # the key of a line in a host is one hash of both
    line = F.xxhash64("host", "l.h").alias("line")
    lines = table.select("row", F.explode("lines").alias("l"), "host").select("row", line, F.col("l.n").alias("n"))
    # a row holds a line once; only rows whose doc_id comes again can count a document twice
    again, _ = materialise(table.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id", F.lit(True).alias("again")), "again")
    held = join_small(table.filter("doc_id IS NOT NULL").select("doc_id", "host", "lines"), again, "doc_id").select("doc_id", "again", "host", F.explode("lines").alias("l"))
    counted = held.filter("again IS NULL").select(line).unionByName(held.filter("again").select("doc_id", line).distinct().select("line"))
    common, _ = materialise(counted.groupBy("line").agg(F.count("*").alias("docs")).filter(F.col("docs") > limit).select("line"), "lines")
    lost = join_small(lines, common, "line", "inner").groupBy("row").agg(F.sum("n").alias("n_line_words"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = table.drop("lines", "host").join(lost, "row", "left").withColumn("n_line_words", F.coalesce("n_line_words", F.lit(0).cast("long")))
    return out.select("doc_id", *BASE, "n_line_words", failed.alias("base_failed"), (~failed & (F.col("n_words") - F.col("n_line_words") >= least * F.col("n_words"))).alias("kept"))
