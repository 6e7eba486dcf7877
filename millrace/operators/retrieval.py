"""Around a search: metadata filters, widening and reranking, embeddings by term statistics, inverted index, context and grounding."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import search
from .shared import written

# Filter keys and the metadata keys they stand for, in order of preference.
ALIASES = {
    "page": ("chunk_page", "chunk_page_start", "pdf_page_start"), "sheet": ("chunk_sheet",), "slide": ("chunk_slide",), "row": ("chunk_row_start",),
    "symbol": ("chunk_symbol_name", "chunk_symbol"), "symbol_name": ("chunk_symbol_name", "chunk_symbol"), "ocr_confidence": ("chunk_ocr_confidence", "image_ocr_confidence_avg"),
}


# Filter keys that a document's own columns answer, by the name of the field.
OWN_FIELDS = {"type": "type", "document_type": "type", "language": "language", "path": "path", "source": "source", "source_path": "source"}


@dataclass(frozen=True)
class MetadataFilter:
    key: str
    value: str = ""
    op: str = "equals"


def metadata_value(metadata: Column, key: str, fields: dict[str, str] | None = None) -> Column:
    """The value of a key: the column that fields names for it (by the names in OWN_FIELDS), else its aliases, then the key itself, then
    the key in any case (the first by name); null if there is none."""
    if fields and (own := fields.get(OWN_FIELDS.get(key.lower(), ""))):
        return F.col(own).cast("string")
    other = F.array_sort(F.map_keys(F.map_filter(metadata, lambda k, _: F.lower(k) == key.lower())))
    named = [F.try_element_at(metadata, F.lit(k)) for k in (*ALIASES.get(key.lower(), ()), key)]
    return F.coalesce(*named, F.try_element_at(metadata, F.try_element_at(other, F.lit(1))))


def filter_condition(metadata: Column, f: MetadataFilter, fields: dict[str, str] | None = None) -> Column:
    """True or false, never null. Texts ignore case; gte and lte compare numbers; a page or row equals what its interval contains."""
    key, op, value = f.key.lower(), (f.op or "equals").lower(), f.value
    number = lambda c: c.try_cast("double")
    if not key:
        return F.lit(True)
    if op == "equals" and key in ("page", "chunk_page", "row", "chunk_row"):
        kind = key.removeprefix("chunk_")
        start = number(metadata_value(metadata, f"chunk_{kind}_start"))
        end = F.coalesce(number(metadata_value(metadata, f"chunk_{kind}_end")), start)
        return F.coalesce(number(F.lit(value)).between(start, end), F.lit(False))
    held = F.coalesce(metadata_value(metadata, f.key, fields), F.lit(""))
    tests = {
        "exists": held != "", "not_empty": F.trim(held) != "", "contains": F.contains(F.lower(held), F.lit(value.lower())), "prefix": F.startswith(F.lower(held), F.lit(value.lower())),
        "gte": number(held) >= number(F.lit(value)), ">=": number(held) >= number(F.lit(value)), "lte": number(held) <= number(F.lit(value)), "<=": number(held) <= number(F.lit(value)),
    }
    made = tests.get(op, F.lower(held) == value.lower())
    if op not in ("exists", "not_empty") and value:
        made = made & (held != "")
    return F.coalesce(made, F.lit(False))


def filtered(docs: DataFrame, metadata: str, filters: list[MetadataFilter], fields: dict[str, str] | None = None) -> DataFrame:
    """Rows for which all filters hold. fields: the columns that answer type, language, path and source."""
    return docs.filter(reduce(lambda a, b: a & b, (filter_condition(F.col(metadata), f, fields) for f in filters), F.lit(True)))


def boost(path: Column, metadata: Column, content: Column, phrase: str, terms: list[str], by_path: float = 0.15, by_metadata: float = 0.1, by_phrase: float = 0.05) -> Column:
    """What a rerank adds: per term in the path, per term in some `key value`, once for the whole phrase in the content."""
    pairs = F.transform(F.map_entries(metadata), lambda e: F.lower(F.concat_ws(" ", e["key"], e["value"])))
    one = lambda cond, by: F.when(cond, by).otherwise(0.0)
    held = lambda t: F.exists(pairs, lambda p: F.contains(p, F.lit(t)))
    parts = [one(F.contains(F.lower(path), F.lit(t)), by_path) + one(held(t), by_metadata) for t in terms if t]
    if phrase:
        parts.append(one(F.contains(F.lower(content), F.lit(phrase.lower())), by_phrase))
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def path_weight(path: Column, terms: list[str]) -> Column:
    """What BM25 scores are multiplied with: 2 per query term in the file name, 1.2 for files under include or src."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    parts = [F.when(F.contains(name, F.lit(t)), 2.0).otherwise(1.0) for t in terms]
    return reduce(lambda a, b: a * b, parts, F.when(F.contains(path, F.lit("include")) | F.contains(path, F.lit("src")), 1.2).otherwise(1.0))


#: A word of over a document in so many is common: there are at most so many times a document's mean number of different words of them, whatever the corpus.
COMMON = 1000


def hashed_embeddings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, slot, weight): SLOTS slots by the first byte of the term's MD5, term weight tf idf per occurrence, unit length; zero slots are left out.

    idf = ln(N / (1 + df)) over all documents; df counts identifiers as terms too. Common words (COMMON) are weighed where the document lies, by
    their broadcast weights, and leave as one row a document; other words meet theirs in a shuffled join, of which no key has many rows. Rows of
    one key and length are one document: keys that repeat are found first, and their words are summed in a shuffle.
    """
    counted = docs.select(key, T.packed_counts(F.col(text)).alias("c")).select(key, F.col("c.words").alias("n"), "c.terms", "c.times")
    counted = written(counted, "terms")
    total = counted.count()
    slot = F.conv(F.substring(F.md5(F.col("term")), 1, 2), 16, 10).cast("int")
    df = counted.select("terms").mapInArrow(_rows, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weights = written(df.select("term", "df", slot.alias("slot"), F.log(total / (1.0 + F.col("df"))).alias("idf")), "weights")
    often = F.col("df") * COMMON > total
    common, others = weights.filter(often).drop("df"), weights.filter(~often).drop("df")
    known = docs.sparkSession.sparkContext.broadcast(common.toArrow().combine_chunks())
    named = counted.filter(F.col(key).isNotNull())
    again = written(named.groupBy(key).agg(F.count("*").alias("rows")).filter("rows > 1").select(key), "repeated")
    repeated = again.count() > 0
    single = named.join(again, key, "left_anti") if repeated else named
    kind = docs.schema[key].dataType.simpleString()
    whole = single.mapInArrow(lambda batches: _weighed(batches, known.value), f"`{key}` {kind}, slots binary, w binary")
    rest = single.mapInArrow(lambda batches: _each(batches, known.value), f"`{key}` {kind}, n int, term string, tf long").join(others, "term")
    if repeated:
        each = named.join(again, key, "left_semi").select(key, "n", "terms", "times").mapInArrow(_each, f"`{key}` {kind}, n int, term string, tf long").groupBy(key, "n", "term").agg(F.sum("tf").alias("tf"))
        for part in (each.join(F.broadcast(common), "term"), each.join(others, "term")):
            rest = rest.unionByName(part)
    rest = rest.select(key, "slot", (F.col("tf") * F.col("tf") / F.col("n") * F.col("idf")).alias("one"))
    return whole.unionByName(rest, True).repartition(key).sortWithinPartitions(key).mapInArrow(_unit, f"`{key}` {kind}, slot int, weight double")


SLOTS = 256


def _rows(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """(term, df): in how many rows each term is, counted over `most` terms at a time."""
    held: list[pa.Array] = []

    def counts() -> pa.RecordBatch:
        found = pc.value_counts(pa.chunked_array(held, pa.string()))
        held.clear()
        return pa.record_batch([found.field(0), found.field(1)], ["term", "df"])

    for batch in batches:
        held.append(pc.split_pattern(batch.column("terms"), " ").flatten())
        if sum(map(len, held)) >= most:
            yield counts()
    if held:
        yield counts()


def _parted(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of all words of a batch's rows: the row, how often it is there, and the word."""
    terms = pc.split_pattern(batch.column("terms"), " ")
    row = np.repeat(np.arange(len(batch)), pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False))
    tf = np.frombuffer(b"".join(batch.column("times").to_pylist()), np.int32).astype(np.int64)
    here = np.flatnonzero(tf)
    return row[here], tf[here], terms.flatten().take(pa.array(here))


def _places(term: pa.Array, known: pa.Table) -> np.ndarray:
    """Places among the known terms, -1: none."""
    return pc.fill_null(pc.index_in(term, value_set=known["term"]), -1).to_numpy(zero_copy_only=False)


def _summed(group: np.ndarray, groups: int, slot: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of w, and whether there is any, by group and slot."""
    cell = group * SLOTS + slot
    shape = (groups, SLOTS)
    return np.bincount(cell, w, groups * SLOTS).reshape(shape), np.bincount(cell, minlength=groups * SLOTS).reshape(shape) > 0


def _weighed(batches: Iterator[pa.RecordBatch], known: pa.Table) -> Iterator[pa.RecordBatch]:
    """(key, slots, w): what a row's known words add to its slots, as bytes and doubles."""
    place, idf = known["slot"].to_numpy(), known["idf"].to_numpy()
    for batch in batches:
        row, tf, term = _parted(batch)
        at = _places(term, known)
        row, tf, at = row[at >= 0], tf[at >= 0].astype(float), at[at >= 0]
        n = batch.column("n").to_numpy()[row]
        w, some = _summed(row, len(batch), place[at], tf * tf / n * idf[at])
        slots = [np.flatnonzero(x) for x in some]
        yield pa.record_batch([batch.column(0), pa.array([s.astype(np.uint8).tobytes() for s in slots], pa.binary()), pa.array([x[s].tobytes() for x, s in zip(w, slots)], pa.binary())], [batch.schema.names[0], "slots", "w"])


def _each(batches: Iterator[pa.RecordBatch], known: pa.Table | None = None) -> Iterator[pa.RecordBatch]:
    """(key, n, term, tf) of a row's words, or of those that aren't known."""
    for batch in batches:
        row, tf, term = _parted(batch)
        if known is not None:
            here = np.flatnonzero(_places(term, known) < 0)
            row, tf, term = row[here], tf[here], term.take(pa.array(here))
        of = pa.array(row)
        yield pa.record_batch([batch.column(0).take(of), batch.column("n").take(of), term, pa.array(tf)], [batch.schema.names[0], "n", "term", "tf"])


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, slot, weight) of rows sorted by key, which hold several slots (slots, w) or one (slot, one): summed by key, over batches too, and brought to length one."""
    held = None  # the last key with its sums

    def made(keys: pa.Array, w: np.ndarray, some: np.ndarray, name: str) -> pa.RecordBatch:
        norm = np.sqrt((w * w).sum(1))
        row, slot = np.nonzero(some & (norm > 0)[:, None])
        return pa.record_batch([keys.take(pa.array(row)), pa.array(slot.astype(np.int32)), pa.array(w[row, slot] / norm[row])], [name, "slot", "weight"])

    for batch in batches:
        if not len(batch):
            continue
        key, name = batch.column(0), batch.schema.names[0]
        new = np.concatenate(([True], pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)))
        keys = key.take(pa.array(np.flatnonzero(new)))
        group, slots, one = np.cumsum(new) - 1, batch.column("slots"), np.flatnonzero(batch.column("slot").is_valid())
        many = np.repeat(group, pc.fill_null(pc.binary_length(slots), 0).to_numpy(zero_copy_only=False))
        joined = lambda name, kind: np.frombuffer(b"".join(batch.column(name).drop_null().to_pylist()), kind)
        slot = np.concatenate((joined("slots", np.uint8), batch.column("slot").drop_null().to_numpy())).astype(int)
        w, some = _summed(np.concatenate((many, group[one])), len(keys), slot, np.concatenate((joined("w", float), batch.column("one").drop_null().to_numpy())))
        if held is not None:
            if held[0][0] == keys[0]:
                w[0] += held[1][0]
                some[0] |= held[2][0]
            else:
                yield made(*held, name)
        yield made(keys[:-1], w[:-1], some[:-1], name)
        held = keys[-1:], w[-1:], some[-1:]
    if held is not None:
        yield made(*held, name)


def inverted_index(docs: DataFrame, key: str, text: str, fields: dict[str, str]) -> DataFrame:
    """(prefix, term, key, wdf): the text's terms under prefix '', and each field's value as one term under its prefix."""
    texts = search.term_counts(docs, key, text).select(F.lit("").alias("prefix"), "term", key, F.col("tf").cast("long").alias("wdf"))
    values = F.array(*(F.struct(F.lit(p).alias("prefix"), T.safe_term(F.col(c)).alias("term")) for c, p in fields.items()))
    exact = docs.select(key, F.explode(values).alias("x")).filter("x.term is not null").select("x.prefix", "x.term", key, F.lit(1).cast("long").alias("wdf"))
    return texts.unionByName(exact)


def reused_embeddings(wanted: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted rows with `embedding` where a stored row has equal keys, else null; `status` says reused or generated."""
    # several stored rows of one key: any has the same content
    held = stored.groupBy(*keys).agg(F.first("embedding", True).alias("embedding"))
    return wanted.join(held, keys, "left").withColumn("status", F.when(F.col("embedding").isNotNull(), "reused").otherwise("generated"))


def reuse_counts(wanted: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """How many embeddings are reused, must be generated, or are stale: stored, but wanted no more."""
    used = reused_embeddings(wanted, stored, keys).groupBy("status").agg(F.count("*").alias("n"))
    stale = stored.join(wanted, keys, "left_anti").agg(F.lit("stale").alias("status"), F.count("*").alias("n"))
    return used.unionByName(stale)


def first_duplicate(vectors: DataFrame, new: list[float], least: float = 0.85) -> DataFrame:
    """The stored vector with the smallest id whose cosine to the new one reaches the limit; no row if none does."""
    from ..functions import vectors as V

    score = V.cosine(F.col("embedding"), V.vector(new))
    return vectors.select("vec_id", score.alias("score")).filter(F.col("score") >= least).orderBy("vec_id").limit(1)


def grounded_claims(answers: DataFrame, context: DataFrame, key: str) -> DataFrame:
    """(key, claim, text, support, status): each claim against the snippets that it cites.

    answers(key, answer), context(key, citation, snippet). The best overlap counts, over repeated citations too: grounded from 0.30,
    partial from 0.12, else unsupported; a claim that cites nothing is uncited.
    """
    claims = answers.select(key, F.posexplode(T.cited_claims(F.col("answer"))).alias("claim", "x")).select(key, "claim", F.col("x.claim").alias("text"), F.col("x.citations").alias("cited"))
    cites = claims.select(key, "claim", "text", F.explode("cited").alias("citation"))
    best = cites.join(context.select(key, "citation", "snippet"), [key, "citation"]).groupBy(key, "claim").agg(F.max(T.overlap(F.col("text"), F.col("snippet"))).alias("support"))
    support = F.coalesce("support", F.lit(0.0))
    status = F.when(F.size("cited") == 0, "uncited").when(support >= 0.3, "grounded").when(support >= 0.12, "partial").otherwise("unsupported")
    return claims.join(best, [key, "claim"], "left").select(key, "claim", "text", support.alias("support"), status.alias("status"))


def grounding(answers: DataFrame, context: DataFrame, key: str) -> DataFrame:
    """(key, verdict) of each answer: no_context, no_claims, unsupported_claims, uncited_claims or grounded, in that order."""
    has = lambda s: F.count_if(F.col("status") == s) > 0
    seen = grounded_claims(answers, context, key).groupBy(key).agg(has("unsupported").alias("bad"), has("uncited").alias("bare"))
    known = context.select(key).distinct().withColumn("known", F.lit(True))
    verdict = (
        F.when(F.col("known").isNull(), "no_context").when(F.col("bad").isNull(), "no_claims").when(F.col("bad"), "unsupported_claims")
        .when(F.col("bare"), "uncited_claims").otherwise("grounded")
    )
    return answers.select(key).join(known, key, "left").join(seen, key, "left").select(key, verdict.alias("verdict"))


def page_of(rows: DataFrame, order: list, skip: int, most: int) -> DataFrame:
    """One page of a list with the list's length and whether more follows."""
    total = rows.agg(F.count("*").alias("total"))
    page = rows.orderBy(*order).offset(skip).limit(most)
    return page.join(F.broadcast(total)).withColumn("has_more", F.col("total") > skip + most)  # one row
