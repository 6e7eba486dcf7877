"""A full-text index as a table of postings, queries over it, and what is made of the hits: fusion, citations, context."""

from __future__ import annotations

import contextlib
import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stems as S
from ..functions import text as T
from ..functions import vectors as V
from . import packed, search
from .shared import drop, written

# Prefixes of the fields in the index, with the weight of a word and of the whole value; of metadata, word parts, CJK pairs and stems.
FIELDS = {"path": ("QPATH", 2, 2), "source": ("QSOURCE", 2, 2), "type": ("QTYPE", 2, 2), "language": ("QLANG", 1, 1)}
METADATA, WORD_PARTS, CJK, STEM = "QMETA", "QB", "QCJK", "Z"
# Metadata keys with a field of their own: prefix, weight of a word (0: no words) and of the whole value.
KEYS = {"chunk_symbol_name": ("QSYMBOL", 4, 3), "chunk_page": ("QPAGE", 0, 2), "chunk_sheet": ("QSHEET", 3, 2), "chunk_slide": ("QSLIDE", 0, 2)}
# Weights of a query's variants, and what a rerank by embeddings and by the whole phrase adds.
VARIANTS = {"original": 1.0, "expanded": 0.97, "rewritten": 0.94, "keywords": 0.9}
BY_VECTOR, BY_PHRASE = 0.2, 0.08
RULE = "=" * 60


def field_words(value: Column) -> Column:
    return F.filter(F.split(F.lower(value), "[^a-z0-9_]+"), lambda w: w != "")


def run_lengths(terms: Column) -> Column:
    """(term, n) of the different terms of an array, sorted: counted where the row lies."""
    ordered = lambda s: F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))
    runs = lambda s, b: F.transform(b, lambda at, k: F.struct(F.get(s, at - 1).alias("term"), (F.coalesce(F.get(b, k + 1), F.size(s) + 1) - at).alias("n")))
    made = S.with_value(F.array_sort(terms), lambda s: S.with_value(ordered(s), lambda b: runs(s, b)))
    return F.when(F.size(terms) > 0, made).otherwise(F.array().cast("array<struct<term:string,n:int>>"))


def stemmed(text: Column, language: Column) -> Column:
    """Stems of the words of a text (letters and digits of any script, lower-cased) by the rules of its language; other languages' words are their own."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    out = words
    for name in S.LANGUAGES:
        out = F.when(language == name, _stems(words, name)).otherwise(out)
    return out


def _stems(words: Column, language: str) -> Column:
    return F.transform(words, lambda w: S.stem(w, language))


def query_stems(spark: SparkSession, query: str, language: str) -> list[tuple[str, str]]:
    """(prefix, term) of a query's words as the index has them: by their stems."""
    found = spark.range(1).select(stemmed(F.lit(query), F.lit(language)).alias("s")).first()["s"]
    return [(STEM, s) for s in dict.fromkeys(found)]


def term_lists(text: str, fields: dict[str, str] | None = None, metadata: str | None = None, cjk: bool = False, language: str | None = None) -> list[tuple[str, Column, int]]:
    """(prefix, terms, weight) of a row's text (prefix ''), and of words and whole values of fields and metadata under their prefixes.

    fields: column by the name of its field (those of FIELDS). Word parts of paths and sources stand under WORD_PARTS, with a column of language
    codes the text's stems under STEM.
    """
    nothing = F.array().cast("array<string>")
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    exact = lambda v: F.when(v != "", F.array(T.safe_term(v))).otherwise(nothing)
    lists = [("", T.tokens(F.col(text)), 1), ("", T.identifiers(F.col(text)), 2)]
    for name, column in (fields or {}).items():
        prefix, word, whole = FIELDS[name]
        lists += [(prefix, field_words(value(column)), word), (prefix, exact(value(column)), whole)]
        if name in ("path", "source"):
            lists.append((WORD_PARTS, T.word_parts(value(column)), 1))
    if cjk:
        lists.append((CJK, T.cjk_bigrams(F.col(text)), 1))
    if language:
        lists.append((STEM, stemmed(F.col(text), T.stemming_language(F.col(text), F.col(language))), 1))
    if metadata:
        entries = F.filter(F.map_entries(metadata), lambda e: (e["key"] != "") & (e["value"] != ""))
        words = F.flatten(F.transform(entries, lambda e: field_words(F.concat_ws(" ", e["key"], e["value"]))))
        whole = F.flatten(F.transform(entries, lambda e: F.array(T.safe_term(e["key"]), T.safe_term(F.concat(e["key"], F.lit(":"), e["value"])))))
        lists += [(METADATA, words, 1), (METADATA, whole, 1)]
        for name, (prefix, word, weight) in KEYS.items():
            held = F.coalesce(F.try_element_at(metadata, F.lit(name)), F.lit(""))
            lists += ([(prefix, field_words(held), word)] if word else []) + [(prefix, exact(held), weight)]
    return [(prefix, F.coalesce(terms, nothing), weight) for prefix, terms, weight in lists]


def postings(docs: DataFrame, key: str, text: str, fields: dict[str, str] | None = None, metadata: str | None = None, cjk: bool = False, language: str | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """(prefix, term, key, wdf): what term_lists() says, summed. Keys are unique, so all is counted inside the row; nothing is shuffled.

    more: columns of the row that its postings keep."""
    own = F.struct(F.lit("").alias("prefix"), F.transform("counted.terms", lambda t: F.struct(t["term"].alias("term"), t["n"].alias("n"))).alias("runs"))
    each = F.array(own, *field_runs(text, fields, metadata, cjk, language))
    rows = docs.withColumn("counted", T.term_counts(F.col(text))).select(key, *more, F.explode(each).alias("x")).select(key, *more, "x.prefix", F.explode("x.runs").alias("r"))
    return rows.select("prefix", F.col("r.term").alias("term"), key, *more, F.col("r.n").cast("long").alias("wdf"))


def field_runs(text: str, fields, metadata, cjk, language) -> list[Column]:
    """(prefix, runs) of a row's terms that aren't its text's own."""
    by: dict[str, list[Column]] = {}
    for prefix, terms, weight in term_lists(text, fields, metadata, cjk, language)[2:]:
        by.setdefault(prefix, []).extend([terms] * weight)
    return [F.struct(F.lit(prefix).alias("prefix"), run_lengths(F.concat(*lists)).alias("runs")) for prefix, lists in by.items()]


def tongue_of(text: str, language: str) -> Column:
    """The language by whose rules a text's words are stemmed; null: they are their own stems."""
    named = T.stemming_language(F.col(text), F.col(language))
    return F.when(named.isin(*S.LANGUAGES), named)


def stem_by_tongue() -> Column:
    return F.coalesce(*(F.when(F.col("tongue") == name, S.stem(F.col("word"), name)) for name in S.LANGUAGES))


def stem_postings(docs: DataFrame, key: str, text: str, language: str, more: tuple[str, ...]) -> DataFrame:
    """Postings of the stems of texts. Each different word of a language is stemmed once, in a dictionary that the texts' words meet in a join; a row
    can have several postings of one stem."""
    found = docs.select(key, *more, tongue_of(text, language).alias("tongue"), T.word_counts(F.col(text)).alias("c")).select(key, *more, "tongue", F.explode("c").alias("x"))
    found = written(found.select(key, *more, "tongue", F.col("x.term").alias("word"), F.col("x.n").cast("long").alias("wdf")), "words")
    known = written(found.filter("tongue is not null").groupBy("tongue", "word").agg(F.count("*").alias("rows")).select("tongue", "word", "rows", stem_by_tongue().alias("term")), "stems")
    often = F.col("rows") > COMMON_ROWS
    common = F.broadcast(known.filter(often).drop("rows"))
    some = found.filter("tongue is not null")
    kinds = (
        found.filter("tongue is null").withColumn("term", F.col("word")), some.join(common, ["tongue", "word"]),
        some.join(common, ["tongue", "word"], "left_anti").join(known.filter(~often).drop("rows"), ["tongue", "word"]),
    )
    return reduce(DataFrame.unionAll, (k.select(F.lit(STEM).alias("prefix"), "term", key, *more, "wdf") for k in kinds))


def text_length(text: str) -> Column:
    """What the postings of a row's text sum to."""
    return F.coalesce(F.size(T.tokens(F.col(text))) + 2 * F.size(T.identifiers(F.col(text))), F.lit(0)).cast("long")


def scored(docs: DataFrame, key: str, text: str, pairs: list[tuple[str, str]], fields: dict[str, str] | None = None, metadata: str | None = None, cjk: bool = False, language: str | None = None) -> DataFrame:
    """(key, score): BM25 of any of the terms over the best one's, so 1 is the best, where no index is stored: the query's terms are counted inside each row, in one scan.

    The counts, a few numbers a row, are written; statistics and scores come from those. Keys are unique. Rows whose text has no term aren't found and
    don't count as documents, but their fields count in the document frequencies.
    """
    lists = term_lists(text, fields, metadata, cjk, language)
    of: dict[str, list[str]] = {}
    for prefix, term in pairs:
        of.setdefault(prefix, []).append(term)
    asked = lambda terms, prefix: F.filter(terms, lambda t: t.isin(*of[prefix])) if prefix in of else F.array().cast("array<string>")
    few = [asked(terms, prefix).alias(f"l{i}") for i, (prefix, terms, _) in enumerate(lists)]
    size = F.col("c.words") + 2 * F.col("c.names")
    slim = docs.select(key, T.term_counts(F.col(text), of.get("", [])).alias("c"), *few[2:])
    times = lambda i, term: F.size(F.filter(f"l{i}", lambda t: t == term))
    own = lambda term: F.coalesce(F.get(F.filter("c.terms", lambda t: t["term"] == term), 0)["n"], F.lit(0))
    count = lambda p, term: sum((weight * times(i, term) for i, (prefix, _, weight) in enumerate(lists) if prefix == p and i > 1), F.lit(0) if p else own(term))
    rows = slim.select(key, size.cast("long").alias("len"), *(count(p, term).alias(f"w{k}") for k, (p, term) in enumerate(pairs)))
    rows = written(rows, "counts")
    names = [f"w{k}" for k in range(len(pairs))]
    whole = rows.agg(F.count_if(F.col("len") > 0).alias("n"), F.avg(F.when(F.col("len") > 0, F.col("len"))).alias("avg"), *(F.count_if(F.col(w) > 0).alias(f"df{w}") for w in names))
    parts = [F.when(F.col(w) > 0, impact(F.col(w), F.col("len"), F.col("avg")) * search.idf(F.col("n"), F.col(f"df{w}"))).otherwise(0.0) for w in names]
    found = rows.filter("len > 0").filter(reduce(lambda a, b: a | b, (F.col(w) > 0 for w in names), F.lit(False))).join(F.broadcast(whole)).select(key, sum(parts, F.lit(0.0)).alias("score"))
    most = found.agg(F.max("score").alias("most"))
    return found.join(F.broadcast(most)).select(key, (F.col("score") / F.col("most")).alias("score"))  # one row each


def impact(wdf: Column, length: Column, average: Column) -> Column:
    """A term's share of a score, before its idf."""
    return wdf * (search.K1 + 1) / (wdf + search.K1 * (1 - search.B + search.B * length / average))


#: A word in more rows is common: an index of so many times as many postings has that many such words at most.
COMMON_ROWS = 100_000
#: Documents of a stretch, in the order in which they are stored; stretches that a search reads first, and how many times as many in each next round.
STRETCH, FIRST_STRETCHES, MORE_STRETCHES = 256, 64, 16


@contextlib.contextmanager
def several_files(spark: SparkSession):
    """Rows that are written inside go to the files of their folders side by side, without being sorted again by folder."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, "32")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def store(docs: DataFrame, path: str, key: str, text: str, fields: dict[str, str] | None = None, metadata: str | None = None, cjk: bool = False, parts: int | None = None, language: str | None = None) -> None:
    """The full-text index as tables: blocks, terms and statistics. Keys are unique; documents whose text has no term can't be found, but their fields count in df.

    A block holds the postings of one term in one stretch of documents (STRETCH at most, so no block is large, however common the term) with
    their lengths, the greatest count and the least length, which bound what it adds to a score. Blocks lie in ranges of terms under a folder for
    each prefix, so a query's terms are found by folder and by the files' least and greatest terms; `terms` is the dictionary, sorted alike.
    """
    spark, seen, shift = docs.sparkSession, Observation(), STRETCH.bit_length() - 1
    runs = field_runs(text, fields, metadata, cjk, None)
    index = packed.counted(docs, key, text, shift, STEM if language else None, tongue_of(text, language) if language else None, F.array(*runs) if runs else None)
    index = written(index.observe(seen, F.sum("docs").alias("n"), F.sum("total").alias("total")).drop("docs", "total"), "postings")
    made = [index]
    if language:
        # each different word of a language is stemmed once, in a dictionary that the chunks' words meet in a join
        words = index.filter("tongue is not null").withColumnRenamed("term", "word")
        known = written(words.select("tongue", "word").distinct().withColumn("term", stem_by_tongue()), "stems")
        made.append(known)
        index = index.filter("tongue is null").unionByName(words.join(known.hint("shuffle_hash"), ["tongue", "word"]).select(index.columns))
    with several_files(spark):
        packed.blocks(index, shift, parts).write.mode("overwrite").partitionBy("prefix").parquet(f"{path}/blocks")
    drop(*made)
    terms = stored(spark, f"{path}/blocks").groupBy("prefix", "term").agg(F.sum("df").alias("df"), F.count("*").alias("blocks"))
    terms.repartitionByRange("prefix", "term").sortWithinPartitions("prefix", "term").write.mode("overwrite").parquet(f"{path}/terms")
    whole = seen.get  # counted by the tasks that made the postings
    n = whole["n"] or 0
    spark.createDataFrame([(n, whole["total"] / n if n else 1.0)], "n long, average double").coalesce(1).write.mode("overwrite").parquet(f"{path}/statistics")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """A table by prefix; the empty prefix comes back as null from its folder's name."""
    return spark.read.parquet(path).withColumn("prefix", F.coalesce(F.col("prefix").cast("string"), F.lit("")))


def _wanted(pairs: list[tuple[str, str]]) -> Column:
    by: dict[str, list[str]] = {}
    for prefix, term in pairs:
        by.setdefault(prefix, []).append(term)
    return reduce(lambda a, b: a | b, ((F.col("prefix") == p) & F.col("term").isin(*t) for p, t in by.items()), F.lit(False))


def top(spark: SparkSession, path: str, pairs: list[tuple[str, str]], k: int, read: list | None = None) -> DataFrame:
    """(key, score): the k best by score, then key, of a stored index; score is over the best one's.

    A stretch's bound is what its blocks can add together. Stretches are read by falling bound, some at first, then more; once the k-th score is
    above a stretch's bound, neither that nor any after it is read. read: gets the number of stretches read in each round, and of all.
    """
    whole = spark.read.parquet(f"{path}/statistics").first()
    known = spark.read.parquet(f"{path}/terms").filter(_wanted(pairs)).collect()  # a row a query term
    n, average = (whole["n"], whole["average"]) if whole else (0, 1.0)
    blocks = stored(spark, f"{path}/blocks").filter(_wanted([(r["prefix"], r["term"]) for r in known])).filter("most is not null")
    weight = F.create_map(*(F.lit(x) for r in known for x in (f"{r['prefix']}|{r['term']}", math.log((n - r["df"] + 0.5) / (r["df"] + 0.5) + 1.0)))) if known else F.create_map(F.lit(""), F.lit(0.0))
    idf = weight[F.concat("prefix", F.lit("|"), "term")]
    bounds = written(blocks.groupBy("stretch").agg(F.sum(impact(F.col("most"), F.col("least"), F.lit(average)) * F.greatest(idf, F.lit(0.0))).alias("bound")), "bounds")
    hits, least, taken, size = None, None, 0, FIRST_STRETCHES
    ranked = bounds.orderBy(F.desc("bound"), "stretch")
    all_, done = bounds.count(), None
    while taken < all_:
        if taken == 0 or size < 100_000:
            chosen = ranked.limit(taken + size)
            chosen = chosen if done is None else chosen.join(done, "stretch", "left_anti")
        else:  # what is left, however much that is
            chosen = bounds.join(done, "stretch", "left_anti")
        if least is not None:
            chosen = chosen.filter(F.col("bound") >= least - 1e-9)
        chosen = written(chosen.select("stretch"), "stretches")
        count = chosen.count()
        if read is not None:
            read.append(count)
        if not count:
            break
        few = F.broadcast(chosen) if count <= 100_000 else chosen
        each = blocks.join(few, "stretch").select(idf.alias("idf"), F.explode("postings").alias("p"))
        part = impact(F.col("p.wdf"), F.col("p.len"), F.lit(average)) * F.col("idf")
        found = each.groupBy(F.col("p.key").alias("key")).agg(F.sum(part).alias("score"))
        hits = written((found if hits is None else found.unionByName(hits)).orderBy(F.desc("score"), "key").limit(k), "hits")
        last = hits.agg(F.count("*").alias("n"), F.min("score").alias("least"), F.max("score").alias("most")).first()
        least = last["least"] if last["n"] == k else None
        done = chosen if done is None else written(done.unionByName(chosen), "stretches")
        taken, size = taken + size if size < 100_000 else all_, size * MORE_STRETCHES
    if read is not None:
        read.append(all_)
    if hits is None:
        return spark.createDataFrame([], "key long, score double")
    return hits.select("key", (F.col("score") / F.lit(last["most"])).alias("score")).orderBy(F.desc("score"), "key")


def store_words(docs: DataFrame, path: str, key: str, texts: list[str], parts: int | None = None) -> None:
    """A dictionary of all words of some columns with the rows that hold them, in sorted ranges: `a*` is a range of it."""
    words = F.array_distinct(F.filter(prefix_words([F.col(c) for c in texts]), lambda w: w != ""))
    rows = docs.withColumn("stretch", F.shiftright(F.monotonically_increasing_id(), STRETCH.bit_length() - 1)).select(F.col(key).alias("key"), "stretch", F.explode(words).alias("word"))
    held = rows.groupBy("word", "stretch").agg(F.collect_list("key").alias("keys"))
    ranged = held.repartitionByRange(parts, "word", "stretch") if parts else held.repartitionByRange("word", "stretch")
    ranged.sortWithinPartitions("word", "stretch").write.mode("overwrite").parquet(path)


def with_prefixes(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(key): rows that have a word with each of the query's prefixes. A prefix reads its range of the dictionary; lists are united, then intersected."""
    terms = list(dict.fromkeys(prefix_terms(query)))
    held = spark.read.parquet(path)
    if not terms:
        return held.select(F.explode("keys").alias("key")).filter("false")
    some = held.filter(reduce(lambda a, b: a | b, (F.startswith("word", F.lit(t)) for t in terms)))
    bits = sum((F.when(F.startswith("word", F.lit(t)), F.lit(1 << i)).otherwise(F.lit(0)) for i, t in enumerate(terms)), F.lit(0).cast("long"))
    each = some.select(bits.alias("bits"), F.explode("keys").alias("key"))
    return each.groupBy("key").agg(F.bit_or("bits").alias("bits")).filter(F.col("bits") == (1 << len(terms)) - 1).select("key")


def query_pairs(query: str, cjk: bool = False) -> list[tuple[str, str]]:
    """(prefix, term) of a query: its widened terms in the text, in paths and in metadata, its word parts, and its CJK pairs."""
    terms = [t for t in T.query_terms(query) if len(t) >= 2]
    parts = [p.lower() for p in re.findall(r"[A-Za-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", query)) if len(p) >= 2]
    pairs = [("", t) for t in terms] + [(p, t) for t in terms for p in ("QPATH", METADATA)] + [(WORD_PARTS, p) for p in parts]
    if cjk:
        for run in re.findall("[㐀-䶿一-鿿豈-﫿぀-ヿ가-힯]+", query):
            pairs += [(CJK, run[i : i + 2]) for i in range(max(1, len(run) - 1))]
    return list(dict.fromkeys(pairs))


def first_stage(k: int, filtered: bool = False, factor: int = 3) -> int:
    """Candidates that each side of a fusion gives."""
    return 2 * k * factor * (4 if filtered else 1)


def hybrid(vectors: DataFrame, query: list[float], texts: DataFrame, key: str, k: int = 10, filtered: bool = False) -> DataFrame:
    """The k best of both sides' candidates by fused score. vectors(vec_id, embedding), texts(key, score)."""
    n = first_stage(k, filtered)
    near = written(search.nearest(vectors, query, n).select(F.col("vec_id").alias(key), "score"), "candidates")
    best_ = written(texts.orderBy(F.desc("score"), key).limit(n), "candidates")
    return search.fused(near, best_, key).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), key).limit(k)


def prefix_terms(query: str) -> list[str]:
    """Lower-cased words (ASCII letters, digits, _ and anything beyond ASCII) that all must begin some word of a row."""
    return [w.lower() for w in re.findall("[A-Za-z0-9_\u0080-\U0010ffff]+", query)]


def prefix_words(texts: list[Column]) -> Column:
    return F.split(F.lower(F.concat_ws(" ", *texts)), r"[^a-z0-9_\x{80}-\x{10FFFF}]+")


def has_prefixes(texts: list[Column], query: str) -> Column:
    """Every term of the query begins a word of one of the texts; a query without terms finds nothing."""
    words, terms = prefix_words(texts), prefix_terms(query)
    begun = lambda term: F.exists(words, lambda w: F.startswith(w, F.lit(term)))
    return reduce(lambda a, b: a & b, map(begun, terms), F.lit(bool(terms)))


def variants(query: str, most: int = 4) -> list[tuple[str, str]]:
    """(text, origin) of a query's variants: as it is, widened, rewritten to its terms, and its first six terms if it has over two; each once."""
    squeezed = " ".join(query.split())
    terms = [w for w in dict.fromkeys(re.sub(r"[\x09-\x0d\x20-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+", " ", query.lower()).split()) if len(w.encode()) >= 2 and w not in T.QUESTION_WORDS]
    extra = [t for t in T.query_terms(query) if t not in query.lower()]
    found = [(squeezed, "original"), (" ".join([squeezed, *extra]), "expanded"), (" ".join(terms), "rewritten")]
    if len(terms) > 2:
        found.append((" ".join(terms[:6]), "keywords"))
    out: dict[str, tuple[str, str]] = {}
    for text, origin in found:
        compact = " ".join(w for w in re.sub(r"[\x09-\x0d\x20-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+", " ", text.lower()).split())
        if compact:
            out.setdefault(compact, (text, origin))
    return list(out.values())[:most]


def merge_key(path: Column, metadata: Column) -> Column:
    """What makes two hits one: the path and the places in it that the metadata names."""
    parts = [F.when(F.coalesce(F.try_element_at(metadata, F.lit(k)), F.lit("")) != "", F.concat(F.lit(f"|{k}="), F.try_element_at(metadata, F.lit(k)))) for k in ("chunk_index", "chunk_page", "chunk_sheet", "chunk_row_start", "chunk_slide", "chunk_symbol_name", "chunk_ocr_region")]
    return F.concat(path, *(F.coalesce(p, F.lit("")) for p in parts))


def multi_query(found: list[tuple[DataFrame, str]], key: str, vectors: DataFrame | None, query: str, embedding: list[float] | None, k: int) -> DataFrame:
    """(key, score, origin): the k best over a query's variants, each (key, score, snippet) with its origin.

    A score is weighted by origin, then gains BY_VECTOR times a positive cosine to the original query's embedding, and BY_PHRASE if the
    snippet holds the query; the best of each key stays (the first origin in the order of VARIANTS if they tie).
    """
    out = None
    for df, origin in found:
        part = df.select(key, (F.col("score") * VARIANTS[origin] + F.when(F.contains("snippet", F.lit(query)), BY_PHRASE).otherwise(0.0)).alias("score"), F.lit(-list(VARIANTS).index(origin)).alias("turn"), F.lit(origin).alias("origin"))
        out = part if out is None else out.unionByName(part)
    best = out.groupBy(key).agg(F.max(F.struct("score", "turn", "origin")).alias("b"))
    score = F.col("b.score")
    if vectors is not None and embedding is not None:
        near = vectors.select(F.col("vec_id").alias(key), F.greatest(F.lit(0.0), V.cosine(F.col("embedding"), V.vector(embedding))).alias("near"))
        # the cosine is a document's, whatever the variant, so it may be added after the best was taken
        best, score = best.join(near, key, "left"), score + BY_VECTOR * F.coalesce("near", F.lit(0.0))
    return best.select(key, F.round(score, 6).alias("score"), F.col("b.origin").alias("origin")).orderBy(F.desc("score"), key).limit(k)


def best(hits: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k of each group with their rank. Every task cuts its part of a group to k rows before anything is shuffled."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def numbered(hits: DataFrame, order: list, by: list[str] | None = None, letter: str = "S") -> DataFrame:
    """Hits with their citation, S1, S2, ... in the order, for each query if `by` names its key. Short lists: the top hits of a query."""
    return hits.withColumn("citation", F.concat(F.lit(letter), F.row_number().over(Window.partitionBy(*(by or [])).orderBy(*order))))


def looked_up(hits: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """The documents of hits, with the hits' columns. Hits are the side that is known to be short, and go to the documents where counted so."""
    few = hits.limit(10_001).count() <= 10_000
    return docs.join(F.broadcast(hits) if few else hits, key)


def citation_sets(answer: Column, context: Column) -> Column:
    """cited: what the answer cites, each once in order; missing: cited but not in the context; uncited: in the context but not cited."""
    cited = T.citations(answer)
    return F.struct(cited.alias("cited"), F.array_except(cited, context).alias("missing"), F.array_except(context, cited).alias("uncited"))


def with_sources(answer: Column, context: Column) -> Column:
    """An answer that cites nothing gets a line with its context's citations."""
    listed = F.array_join(F.transform(context, lambda c: F.concat(F.lit("["), c, F.lit("]"))), ", ")
    return F.when((F.size(T.citations(answer)) == 0) & (F.size(context) > 0), F.concat(answer, F.lit("\n\nSources: "), listed)).otherwise(answer)


def grounding_band(confidence: Column, contexts: Column) -> Column:
    """The band of a confidence, clamped to [0, 1]: grounded from 0.75, partial from 0.35, else weak; without a context no_context."""
    c = F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence))
    return F.when(contexts == 0, "no_context").when(c >= 0.75, "grounded").when(c >= 0.35, "partial").otherwise("weak")


def answer_status(answer: Column, context: Column, confidence: Column) -> Column:
    """no_context, unsupported_citations, uncited, or the band of the confidence."""
    sets = citation_sets(answer, context)
    return (
        F.when(F.size(context) == 0, "no_context").when(F.size(sets["missing"]) > 0, "unsupported_citations")
        .when(F.size(sets["cited"]) == 0, "uncited").otherwise(grounding_band(confidence, F.size(context)))
    )


#: Labels of the places in a context's headers, and their metadata keys.
LOCATORS = (("Chunk", "chunk_index"), ("Page", "chunk_page"), ("Slide", "chunk_slide"), ("Sheet", "chunk_sheet"), ("Heading", "chunk_heading"), ("Symbol", "chunk_symbol_name"), ("OCR region", "chunk_ocr_region"))


def context(hits: DataFrame, by: list[str], budget: int = 8000, most: int = 15, whole: int = 2000) -> DataFrame:
    """(by, files, size, text): a query's best hits as one text, each under a header; it ends before the first that overflows the budget.

    hits(by, rank, path, kind, language, score, content, snippet, metadata). A content shorter than `whole` stands whole, else its
    snippet. At most `most` hits of a query are put together.
    """
    value = lambda k: F.coalesce(F.try_element_at("metadata", F.lit(k)), F.lit(""))
    lines = [F.when(value(k) != "", F.concat(F.lit(f"{label}: "), value(k), F.lit("\n"))).otherwise("") for label, k in LOCATORS]
    source = F.when(value("chunk_of") != "", value("chunk_of")).otherwise(F.col("path"))
    about = F.concat(F.lit("Type: "), "kind", F.lit(", Language: "), "language", F.lit("\nRelevance: "), F.format_string("%.2f", F.col("score")), F.lit(f"\n{RULE}\n\n"))
    header = F.concat(F.lit(f"\n{RULE}\nFILE: "), source, F.lit("\n"), *lines, about)
    best = hits.filter(F.col("rank") <= most).withColumn("header", header)
    size = F.length("header") + F.length("content")
    upto = F.sum(size).over(Window.partitionBy(*by).orderBy("rank"))
    body = F.when(F.length("content") < whole, F.col("content")).otherwise(F.concat("snippet", F.lit("\n...\n")))
    kept = best.withColumn("upto", upto).filter(F.col("upto") <= budget).select(*by, "rank", "upto", F.concat("header", body, F.lit("\n")).alias("part"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "part"))), lambda x: x["part"])
    return kept.groupBy(*by).agg(F.count("*").alias("files"), F.max("upto").alias("size"), F.array_join(parts, "").alias("text"))
