"""Language identification by Bayesian evidence fusion.

log P(language | document) is the sum of: tempered byte-trigram likelihoods of the whole text (a naive Bayes model whose
counts come from all documents with a declared language), the likelihood of the declared markup language, that of the
address suffix, and the host's prior. Host priors are smoothed towards the host's registered domain, and that towards
the corpus. All tables come from grouped aggregation over all documents.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_small, map_batches, materialise, small_batches

BITS = 13
#: Trigrams a text counts as at most (neighbouring trigrams aren't independent), pseudo-counts of a parent level.
EVIDENCE, SMOOTHING = 60.0, 20.0
#: A document needs this posterior.
LEAST_POSTERIOR = 0.5
#: Old and bibliographic codes; the others come from Java's tables.
OLD_CODES = dict(zip("iw in ji alb arm baq bur chi cze dut fre geo ger gre ice mac mao may per rum slo tib wel".split(), "he id yi sq hy eu my zh cs nl fr ka de el is mk mi ms fa ro sk bo cy".split()))
UNKNOWN = "und"
# Subtags that name no single language.
NO_LANGUAGE = ("und", "mul", "mis", "zxx", "art", "root")
NO_WORD = re.compile(rb"[0-9@=_/\\]")
#: Bits that a trigram of an unknown language costs more than an even choice among all buckets.
UNKNOWN_BITS = 1.5


def buckets(text: str) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased text, its words separated by single spaces; words with digits and the like say nothing."""
    raw = text.lower().encode("utf-8", "replace")
    words = raw.split()
    if NO_WORD.search(raw):
        words = [w for w in words if not NO_WORD.search(w)]
    if not words:
        return np.zeros(0, np.int64)
    b = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def histogram(text: str) -> np.ndarray:
    return np.bincount(buckets(text), minlength=1 << BITS)


def languages_of(spark) -> dict[str, str]:
    """The shortest code of every registered language that Java knows, by its two- and three-letter codes (old ones too) and its English name.

    Some 300 languages, whatever the documents declare: that bounds the model (64 KB a language) wherever it goes.
    """
    locale = spark._jvm.java.util.Locale
    two = [c for c in locale.getISOLanguages() if c not in OLD_CODES]
    known = {c for x in locale.getAvailableLocales() if re.fullmatch("[a-z]{2,3}", c := x.getLanguage())} - set(OLD_CODES)
    out = {}
    for code in sorted(known.union(two), key=lambda c: (-len(c), c)):  # two letters last, so they win
        here = locale(code)
        out |= {here.getISO3Language(): code, code: code, here.getDisplayLanguage(locale.ENGLISH).lower(): code}
    shortest = {k: out.get(v, v) for k, v in out.items()} | OLD_CODES
    return {k: v for k, v in shortest.items() if k and v not in NO_LANGUAGE}


def primary_subtag(declared: Column, spark) -> Column:
    """The primary subtag's language in its shortest form ("de-AT", "deu", "German": de; "fil": fil).

    Null, which is undeclared, for what is no registered language: other words, empty tags, und, mul, mis, zxx, art and private ones.
    """
    table = F.create_map(*(F.lit(x) for pair in languages_of(spark).items() for x in pair))
    tag = F.lower(F.trim(declared))
    return F.coalesce(F.try_element_at(table, tag), F.try_element_at(table, F.regexp_extract(tag, "^([a-z]{2,3})[-_]", 1)))


def inputs(docs: DataFrame, text: str, declared: str | None, host: str | None, url: str | None) -> DataFrame:
    """text, declared, host, domain, suffix and own, a struct of the table's columns (so names can't clash); evidence that isn't there is null."""
    null = F.lit(None).cast("string")
    col = lambda n: F.col(f"`{n}`").cast("string") if n else null
    address = F.lower(F.regexp_extract(col(url), "^[a-z+]+://([^/:?#]+)", 1)) if url else F.lower(col(host))
    code = F.when(F.regexp_extract(col(url), "^[a-z+]+://[^/]+/([a-z]{2})(?:/|$)", 1) != "", F.regexp_extract(col(url), "^[a-z+]+://[^/]+/([a-z]{2})(?:/|$)", 1)) if url else null
    suffix = F.regexp_extract(address, r"\.([a-z]{2,})$", 1)
    return docs.select(
        F.coalesce(col(text), F.lit("")).alias("text"), (primary_subtag(col(declared), docs.sparkSession) if declared else null).alias("declared"), address.alias("host"),
        F.when(address.contains("."), F.regexp_extract(address, r"([^.]+\.[^.]+)$", 1)).alias("domain"),
        F.coalesce(code, F.when(suffix != "", suffix)).alias("suffix"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"),
    )


class TextModel:
    """Languages (the last is unknown) and log-probabilities of trigram buckets."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = [*languages, UNKNOWN]
        smooth = counts + 0.5
        flat = np.full((1, 1 << BITS), -(BITS + UNKNOWN_BITS) * np.log(2))
        logs = np.vstack([np.log(smooth / smooth.sum(1, keepdims=True)), flat]) if len(counts) else flat
        self.by_bucket = np.ascontiguousarray(logs.T)

    def __call__(self, text: str) -> tuple[np.ndarray, int]:
        h = histogram(text)
        n = int(h.sum())
        at = np.flatnonzero(h)
        return h[at] @ self.by_bucket[at] * min(1.0, EVIDENCE / max(n, 1)), n or len(text.encode("utf-8", "replace").split())


def fit(given: DataFrame) -> TextModel:
    """Trigram counts by declared language, over all documents; every declared language has a model, however few documents it has.

    What comes back is 8192 counts a language at most, as Arrow columns; languages are registered ones, so there are some hundreds at most.
    """
    languages = sorted(r["declared"] for r in given.filter(F.col("declared").isNotNull()).select("declared").distinct().collect())
    index = {x: i for i, x in enumerate(languages)}

    def run(batches):
        counts = np.zeros((len(index), 1 << BITS), np.int64)
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts[index[lang]] += histogram(text)
        at = np.flatnonzero(counts)
        yield {"at": at, "n": counts.ravel()[at]}

    sums = map_batches(given.filter(F.col("declared").isNotNull()).select("text", "declared"), run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(index) << BITS)
    counts[sums.column("at").to_numpy()] = sums.column("n").to_numpy()
    return TextModel(languages, counts.reshape(-1, 1 << BITS))


def score(given: DataFrame, model: TextModel, keep: list[str]) -> DataFrame:
    """The columns `keep`, with ll (by language) and n_grams (trigrams, or words if there is no trigram)."""
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

    known = given.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = known.value
        for b in batches:
            found = [model(t) for t in b.column(0).to_pylist()]
            cols = [*b.columns[1:], pa.array([x for x, _ in found], pa.list_(pa.float64())), pa.array([n for _, n in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[1:], "ll", "n_grams"])

    chosen = given.select("text", *(F.col(f"`{c}`") for c in keep))
    small_batches(given.sparkSession)
    return chosen.mapInArrow(run, StructType([*chosen.schema.fields[1:], StructField("ll", ArrayType(DoubleType())), StructField("n_grams", LongType())]))


def evidence(scored: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Log-likelihoods by declared language and by suffix, and log priors by host; each from one grouped aggregation."""
    best = (F.array_position("ll", F.array_max("ll")) - 1).cast("int").alias("best")
    table, _ = materialise(scored.select("declared", "suffix", "domain", "host", best).groupBy("declared", "suffix", "domain", "host", "best").agg(F.count("*").alias("n")), "evidence")
    whole = [0.0] * n
    for r in table.groupBy("best").agg(F.sum("n").alias("n")).collect():
        whole[r["best"]] = float(r["n"])
    total = sum(whole)
    base = [(x + 1) / (total + n) for x in whole]
    numbers = lambda values: F.array(*(F.lit(float(x)) for x in values))
    zeros = F.array_repeat(F.lit(0).cast("long"), n)

    def counted(rows: DataFrame, *keys: str) -> DataFrame:
        """c: the counts by language (at most n numbers a key); t: their sum."""
        each = rows.groupBy(*keys, "best").agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("best", "n"))).alias("m"), F.sum("n").alias("t"))
        return each.select(*keys, F.transform(zeros, lambda z, i: F.coalesce(F.col("m")[i], z)).alias("c"), "t")

    def likelihood(key: str, name: str) -> DataFrame:
        """log P(key | language): two pseudo-counts, half of them for this key."""
        by = counted(table.filter(F.col(key).isNotNull()), key)
        return materialise(by.select(key, F.zip_with("c", numbers(whole), lambda c, w: F.log((c + 1) / (w + 2))).alias(name)), name)[0]

    hosts = counted(table.filter(F.col("host").isNotNull()), "domain", "host")
    domains = counted(table.filter(F.col("host").isNotNull() & F.col("domain").isNotNull()), "domain")
    domains, _ = materialise(domains.select("domain", F.col("c").alias("dc"), F.col("t").alias("dt")), "domains")
    up = F.zip_with(F.coalesce("dc", zeros), numbers(base), lambda c, b: (c + SMOOTHING * b) / (F.coalesce(F.col("dt"), F.lit(0)) + SMOOTHING))
    prior = join_small(hosts, domains, "domain").select("host", F.zip_with("c", up, lambda c, u: F.log((c + SMOOTHING * u) / (F.col("t") + SMOOTHING))).alias("lp"))
    return likelihood("declared", "ld"), likelihood("suffix", "ls"), materialise(prior, "hosts")[0], [float(np.log(x)) for x in base]


def identify(docs: DataFrame, text: str = "text", declared: str | None = "lang", host: str | None = "source", url: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """The table (or the named columns of it) with lang_id, posterior and kept (columns of these names are replaced).

    A declared language is one that is registered, by any of its codes or its English name; other tags count as undeclared. Each has a model.
    Each text is read twice: to count trigrams, and for its log-likelihoods. Where the text itself isn't asked for, those are written
    beside the asked columns, once for evidence and result; else the texts are scored again rather than written.

    Rejected: a text without a word, a language that stays unknown, or a posterior below LEAST_POSTERIOR. Null text:
    empty; a null declared language, host or address is no evidence; ties go to the first language by name; repeated
    rows are judged alike; a very long text is read whole, its evidence tempered as any other's; an empty table gives no
    rows; no name of the table's columns can clash with a helper's.
    """
    own = [c for c in docs.columns if c not in ("lang_id", "posterior", "kept")]
    asked = [c for c in own if columns is None or c in columns]
    given = inputs(docs.select(*(F.col(f"`{c}`") for c in own)), text, declared, host, url)
    given = given.withColumn("own", F.struct(*(F.col("own")[c].alias(c) for c in asked)))
    model = fit(given)
    n = len(model.languages)
    facts = ["declared", "suffix", "domain", "host"]
    if text in asked:
        declared_ll, suffix_ll, priors, base = evidence(score(given, model, facts), n)
        scored = score(given, model, ["own", "declared", "suffix", "host"])
    else:
        scored, _ = materialise(score(given, model, ["own", *facts]), "scores")
        declared_ll, suffix_ll, priors, base = evidence(scored, n)
        scored = scored.drop("domain")
    for table, key in ((declared_ll, "declared"), (suffix_ll, "suffix"), (priors, "host")):
        scored = join_small(scored, table, key)
    add = lambda x, y: F.zip_with(x, y, lambda p, q: p + q)
    nothing = F.array_repeat(F.lit(0.0), n)
    total = add(add(add("ll", F.coalesce("ld", nothing)), F.coalesce("ls", nothing)), F.coalesce("lp", F.array(*(F.lit(x) for x in base))))
    top = F.array_max("total")
    names = F.array(*(F.lit(x) for x in model.languages))
    out = scored.select("own", "n_grams", total.alias("total")).withColumn("lang_id", names[F.array_position("total", top).cast("int") - 1])
    out = out.withColumn("posterior", 1 / F.aggregate("total", F.lit(0.0), lambda s, x: s + F.exp(x - top)))
    kept = (F.col("n_grams") > 0) & (F.col("lang_id") != UNKNOWN) & (F.col("posterior") >= LEAST_POSTERIOR)
    return out.select("own.*", "lang_id", "posterior", kept.alias("kept"))
