"""Text functions as Column expressions."""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Stop words that the tokenizer's results depend on (those its ASCII tokens can meet).
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should i you he she it we they what which who "
    "this that these those am of at by for with about against between into through during before after above below to from up down in "
    "out on off over under again further then once here there when where why how all each few more most other some such no nor not only "
    "own same so than too very can just don now int void return if else while switch case break continue default goto sizeof typedef "
    "struct class public private protected virtual static const new delete try catch throw namespace using include define ifdef ifndef "
    "endif pragma"
).split()


def counted(term: Column) -> Column:
    """Three characters or more and no stop word (a hash lookup, also inside array functions)."""
    return (F.length(term) >= 3) & ~term.isin(*(w for w in STOP_WORDS if len(w) >= 3))


def words(text: Column) -> Column:
    """All ASCII words, lower-cased."""
    return F.split(F.lower(text), "[^a-z0-9_]+")


def tokens(text: Column) -> Column:
    """ASCII words of three characters or more, lower-cased, without stop words."""
    return F.filter(words(text), counted)


def names(text: Column) -> Column:
    """Names before a parenthesis, then names after `class`; case kept."""
    return F.concat(F.regexp_extract_all(text, F.lit(r"\b([a-zA-Z_][a-zA-Z0-9_]*)\s*\("), 1), F.regexp_extract_all(text, F.lit(r"\bclass\s+([a-zA-Z_][a-zA-Z0-9_]*)"), 1))


def identifiers(text: Column) -> Column:
    """Names of three characters or more that aren't stop words."""
    return F.filter(names(text), counted)


_WORD, _CALL, _CLASS = re.compile("[a-z0-9_]{3,}"), re.compile(r"\b([a-zA-Z_][a-zA-Z0-9_]*)\s*\(", re.ASCII), re.compile(r"\bclass\s+([a-zA-Z_][a-zA-Z0-9_]*)", re.ASCII)
_ANY_WORD = re.compile(r"\w+")
_STOP = frozenset(w for w in STOP_WORDS if len(w) >= 3)


def _small_batches(rows: int = 512) -> None:
    """Lowers the session's batch size, never raises it: a batch's terms are held beside each other."""
    spark, key = SparkSession.getActiveSession(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark and not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def _structs(rows: list[Counter], **more: list[Counter]) -> pa.ListArray:
    """array<struct<term,n,...>> of each row's counts; more: counters that have a number of each term too."""
    ends, terms, n = [0], [], []
    for c in rows:
        terms += c
        n += c.values()
        ends.append(len(terms))
    names, arrays = ["term", "n"], [pa.array(terms, pa.string()), pa.array(n, pa.int32())]
    for name, counters in more.items():
        names.append(name)
        arrays.append(pa.array([m[t] for c, m in zip(rows, counters) for t in c], pa.int32()))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(arrays, names))


def _counts(text: str | None) -> tuple[Counter, list[str]]:
    """How often each token occurs in a text, and its identifiers."""
    c = Counter(_WORD.findall(text.lower()) if text else ())
    for w in _STOP.intersection(c):
        del c[w]
    return c, _identifiers(text) if text else []


def _identifiers(text: str) -> list[str]:
    if "(" not in text and "class" not in text:
        return []
    return [w for w in _CALL.findall(text) + _CLASS.findall(text) if len(w) >= 3 and w not in _STOP]


def term_counts(text: Column, only: Iterable[str] | None = None) -> Column:
    """(words, names, terms): how many tokens() and identifiers() a text has, and (term, n, words) of each different one: n counts names twice.

    only: the terms that are wanted, if not all. Texts are read once, in batches, in Python, which is many times as fast as array functions.
    Null is empty. The column can't be computed twice by moving a filter below it, so it must be selected before it is used in other ways.
    """
    wanted = None if only is None else frozenset(only)

    @F.arrow_udf("struct<words:int,names:int,terms:array<struct<term:string,n:int,words:int>>>")
    def run(texts: pa.Array) -> pa.Array:
        words, names, both, tokens = [], [], [], []
        for text in texts.to_pylist():
            c, named = _counts(text)
            words.append(c.total())
            names.append(len(named))
            if wanted is not None:
                c = Counter({t: c[t] for t in wanted.intersection(c)})
            tokens.append(c)
            if named:
                c = c.copy()
                for w in named:
                    if wanted is None or w in wanted:
                        c[w] += 2
            both.append(c)
        return pa.StructArray.from_arrays([pa.array(words, pa.int32()), pa.array(names, pa.int32()), _structs(both, words=tokens)], ["words", "names", "terms"])

    _small_batches()
    return run.asNondeterministic()(text)


def packed_counts(text: Column) -> Column:
    """(words, terms, times): how many tokens() a text has, its different tokens and identifiers between spaces (null: none), and as 32-bit integers how
    often each is a token. For steps in Python: a row is three values between there and the JVM, however many terms it has."""

    @F.arrow_udf("struct<words:int,terms:string,times:binary>")
    def run(texts: pa.Array) -> pa.Array:
        words, terms, times = [], [], []
        for text in texts.to_pylist():
            c, named = _counts(text)
            words.append(c.total())
            for w in named:
                c.setdefault(w, 0)
            terms.append(" ".join(c) if c else None)
            times.append(array("i", c.values()).tobytes())
        return pa.StructArray.from_arrays([pa.array(words, pa.int32()), pa.array(terms, pa.string()), pa.array(times, pa.binary())], ["words", "terms", "times"])

    _small_batches()
    return run.asNondeterministic()(text)


def word_counts(text: Column) -> Column:
    """(term, n) of the different words of a text, letters and digits of any script, lower-cased; null is empty."""

    @F.arrow_udf("array<struct<term:string,n:int>>")
    def run(texts: pa.Array) -> pa.Array:
        return _structs([Counter(_ANY_WORD.findall(text.lower()) if text else ()) for text in texts.to_pylist()])

    _small_batches()
    return run.asNondeterministic()(text)


def identifier_terms(name: Column) -> Column:
    """camelCase, acronym and digit parts, lower-cased, of two characters or more."""
    parted = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(parted, "[^A-Za-z0-9]+", " ")), " "), lambda t: F.length(t) >= 2)


def safe_term(text: Column) -> Column:
    """Letters, digits and _-./:# lower-cased, other runs one underscore, none at the ends; 180 characters at most."""
    bad = r"[^A-Za-z0-9_\-./:#]+"
    made = F.left(F.lower(F.regexp_replace(F.regexp_replace(text, "^" + bad, ""), "_?" + bad, "_")), F.lit(180))
    made = F.regexp_replace(made, "_+$", "")
    return F.when(made == "", "empty").otherwise(made)


def word_parts(text: Column) -> Column:
    """Alphanumeric words parted where a small letter meets a capital, lower-cased, of two characters or more, sorted, each once."""
    parted = F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(parted), "[^a-z0-9]+"), lambda t: F.length(t) >= 2)))


def cjk_bigrams(text: Column) -> Column:
    """Pairs of neighbouring Chinese, Japanese and Korean characters, a lone one as it is; sorted, each once."""
    runs = F.regexp_extract_all(text, F.lit(r"([\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]+)"), 1)
    grams = F.transform(runs, lambda r: F.when(F.length(r) < 2, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_sort(F.array_distinct(F.flatten(grams)))


def metadata_key(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))


def kept_lines(text: Column) -> Column:
    """Each line trimmed, blank ones dropped."""
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: s != ""), "\n")


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def history(text: Column, most: int = 700) -> Column:
    return F.left(collapsed(F.regexp_replace(text, r"[\x00-\x08\x0E-\x1F\x7F]", "")), F.lit(most))


def estimated_tokens(text: Column) -> Column:
    """A third of the UTF-8 lead bytes above 0xC0 and a quarter of all other bytes, 1 at least."""
    high = F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    rest = F.octet_length(text) - high
    return F.greatest((F.floor(rest / 4) + F.floor(high / 3)).cast("long"), F.lit(1).cast("long"))


def language_of(text: Column) -> Column:
    return F.when(text.rlike("[А-я]"), "russian").otherwise("english")


def plain_words(text: Column) -> Column:
    """ASCII punctuation and white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+", " "))


# Words that say nothing about what a question is about.
QUESTION_WORDS = (
    "what which where when why how does do did the and or is are was were a an to of for in on with that this "
    "как что где когда почему зачем это или для при про надо нужно"
).split()


def question_terms(text: Column) -> Column:
    """Words of two bytes or more that aren't question words, lower-cased, each once in order."""
    return F.array_distinct(F.filter(F.split(plain_words(F.lower(text)), " "), lambda t: (F.octet_length(t) >= 2) & ~t.isin(*QUESTION_WORDS)))


def overlap(claim: Column, context: Column) -> Column:
    """The share of the claim's terms that the context contains; 0 without terms."""
    terms, held = question_terms(claim), F.lower(context)
    n = F.size(terms)
    return F.when((n > 0) & held.isNotNull(), F.size(F.filter(terms, lambda t: F.contains(held, t))) / n).otherwise(0.0)


def claims(text: Column) -> Column:
    """The texts of cited_claims."""
    return F.transform(cited_claims(text), lambda p: p["claim"])


def cited_claims(text: Column) -> Column:
    """(claim, citations) of the first 12 sentences of 24 bytes or more without punctuation; citations are read before it goes."""
    parts = F.transform(F.split(text, r"[.!?\n]"), lambda s: F.struct(plain_words(s).alias("claim"), citations(s).alias("citations")))
    return F.slice(F.filter(parts, lambda p: F.octet_length(p["claim"]) >= 24), 1, 12)


def match_places(text: Column, term: str) -> Column:
    """(line from 1, place from 0) of every occurrence, overlapping ones too, ignoring case."""
    ahead = "(?=" + "".join("\\" + c if not c.isalnum() else c for c in term.lower()) + ")"

    def places(line, number):
        pieces = F.split(F.lower(line), ahead)
        ends = F.aggregate(pieces, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p))))
        starts = F.slice(ends, 1, F.size(pieces))
        first = F.startswith(F.lower(line), F.lit(term.lower()))
        return F.transform(F.filter(starts, lambda at: (at > 0) | first), lambda at: F.struct((number + 1).alias("line"), at.alias("place")))

    return F.flatten(F.transform(F.split(text, "\n"), places))


def byte_places(raw: Column) -> Column:
    """1 to the number of bytes; nothing for no bytes."""
    return F.when(F.octet_length(raw) > 0, F.sequence(F.lit(1), F.octet_length(raw))).otherwise(F.array().cast("array<int>"))


def byte_at(raw: Column, place: Column) -> Column:
    return F.conv(F.hex(F.substring(raw, place, F.lit(1))), 16, 10).cast("int")


def shift_add_hash(text: Column, signed: bool = False) -> Column:
    """h = 33 h + byte modulo 2^64 from 5381 over the UTF-8 bytes, in lowercase hex. It folds over the bytes' places, four bytes each.

    signed: bytes over 127 count as negative, as they do where characters are signed; ASCII texts have the same hash either way.
    """
    wide = lambda c: c.cast("decimal(38,0)")
    raw = F.encode(text, "UTF-8")
    value = lambda i: byte_at(raw, i) - F.when(byte_at(raw, i) > 127, 256).otherwise(0) if signed else byte_at(raw, i)
    # 2^64 more than needed, so that a negative byte never makes a negative number
    h = F.aggregate(byte_places(raw), wide(F.lit(5381)), lambda acc, i: wide((acc * 33 + value(i) + F.expr("18446744073709551616BD")) % F.expr("18446744073709551616BD")))
    half = F.expr("9223372036854775808BD")
    return F.lower(F.hex(F.when(h >= half, h - F.expr("18446744073709551616BD")).otherwise(h).cast("long")))


def combined_key(*parts: Column) -> Column:
    """One key of several values, in hex; null and empty differ."""
    return F.lower(F.hex(F.xxhash64(*(x for p in parts for x in (p.isNull(), p)))))


# Codes of languages and the names that they stand for.
LANGUAGE_NAMES = dict(
    x.split(":")
    for x in (
        "ar:arabic hy:armenian eu:basque ca:catalan da:danish nl:dutch en:english eng:english eo:esperanto et:estonian fi:finnish fr:french de:german el:greek hi:hindi hu:hungarian "
        "id:indonesian ga:irish it:italian lt:lithuanian ne:nepali no:norwegian nb:norwegian nn:norwegian pl:polish pt:portuguese ro:romanian ru:russian rus:russian sr:serbian es:spanish "
        "sv:swedish ta:tamil tr:turkish yi:yiddish default:auto detect:auto off:none disabled:none false:none"
    ).split()
)


def language_name(language: Column) -> Column:
    """The name of a language by its code or name, in lower case; empty means auto."""
    low = F.lower(language)
    return F.when(F.coalesce(low, F.lit("")) == "", "auto").otherwise(F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv)), low), low))


def stemming_language(text: Column, named: Column | None = None, configured: str = "auto") -> Column:
    """The configured language unless it is auto, else the one that is named if it is one of LANGUAGE_NAMES', else the text's."""
    if configured.lower() not in ("", "auto", "default", "detect"):
        return language_name(F.lit(configured))
    known = set(LANGUAGE_NAMES.values()) - {"auto", "none"}
    return language_of(text) if named is None else F.when(language_name(named).isin(*sorted(known)), language_name(named)).otherwise(language_of(text))


def query_terms(query: str) -> list[str]:
    """Terms that a query is widened to: its words and their singulars, parts of identifiers, file stems and extensions."""
    import re
    from pathlib import PurePosixPath

    def parts(s):
        s = re.sub("([a-z0-9])([A-Z])", r"\1 \2", s)
        return [t.lower() for t in re.findall("[A-Za-z0-9]+", re.sub("([A-Z])([A-Z][a-z])", r"\1 \2", s))]

    words = [w for w in re.split("[^a-z0-9_]+", query.lower()) if len(w) >= 3 and w not in STOP_WORDS]
    out = [x for w in words for x in ((w, w[:-1]) if len(w) > 3 and w.endswith("s") else (w,))] + parts(query)
    for raw in query.split():
        out += [*parts(raw), PurePosixPath(raw).stem.lower(), PurePosixPath(raw).suffix.lower()]
    return list(dict.fromkeys(t for t in out if len(t) >= 2))


def citations(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[((?:S|Q)\d+)\]"), 1))


def html_title(html: Column) -> Column:
    return collapsed(decoded(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def decoded(text: Column) -> Column:
    for name, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(c))
    return text


def html_text(html: Column) -> Column:
    """Without scripts, styles and tags; block tags break lines; title first."""
    body = F.regexp_replace(html, r"(?is)<(script|style|title)\b.*?</\1\s*>|<!--.*?-->", " ")
    body = F.regexp_replace(body, r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|header|footer|nav)\b[^>]*>", "\n")
    body = decoded(F.regexp_replace(body, r"<[^>]*>", " "))
    lines = F.filter(F.transform(F.split(body, "\n"), lambda s: collapsed(s)), lambda s: s != "")
    return F.concat(html_title(html), F.lit("\n\n"), F.array_join(lines, "\n"))


def snippet(text: Column, terms: list[str], around: int = 2, first: int = 20) -> Column:
    """The first line with a term and its neighbours, numbered; else the first lines."""
    lines = F.split(text, "\n")
    hit = F.lit(False)
    has = lambda s: hit if not terms else _any([F.contains(F.lower(s), F.lit(t)) for t in terms])
    at = F.array_position(F.transform(lines, has), True)
    start = F.when(at > 0, F.greatest(at - around, F.lit(1))).otherwise(1)
    n = F.when(at > 0, at + around - start + 1).otherwise(first)
    cut = F.slice(lines, start.cast("int"), n.cast("int"))
    return F.array_join(F.transform(cut, lambda s, i: F.format_string("%4d | %s", i + start.cast("int"), s)), "\n")


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out
