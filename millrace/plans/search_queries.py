"""Queries of full-text search, chunk emission, sources, requests, reports and schemas that came later, each with equivalent SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analytics, changes, documents, fulltext, schemas, search, shared, vector_index
from ..sources import files, questions
from .registry import NAMES, TF, TOKENS, query
from .table import Field, Policy, Rights, Table, from_json, from_params, from_url, written

AXIS = [1.0 if i % 2 == 0 else -0.5 for i in range(64)]
AXIS_SQL = "[" + ",".join(map(str, AXIS)) + "]::DOUBLE[]"
DISTANCE = f"list_sum(list_transform(list_zip(embedding, {AXIS_SQL}), lambda x: (x[1]::DOUBLE - x[2]) * (x[1]::DOUBLE - x[2])))"
TERMS = ["that", "for", "thth", "eran", "onan"]
TERMS_SQL = "('" + "', '".join(TERMS) + "')"

# --- full text

FIELD_WORDS = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9_]+'), lambda w: w <> '')"
PARTS_SQL = "list_distinct(list_filter(string_split_regex(lower(regexp_replace({0}, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda t: length(t) >= 2))"
POSTINGS = f"""e AS MATERIALIZED (SELECT doc_id, {TOKENS} AS t, {NAMES} AS i, coalesce(source, '') AS source, coalesce(lang, '') AS lang FROM documents),
u AS (SELECT doc_id, '' AS prefix, unnest(t) AS term, 1 AS w FROM e UNION ALL SELECT doc_id, '', unnest(i), 2 FROM e
UNION ALL SELECT doc_id, 'QSOURCE', unnest({FIELD_WORDS.format('source')}), 2 FROM e UNION ALL SELECT doc_id, 'QSOURCE', lower(source), 2 FROM e WHERE source <> ''
UNION ALL SELECT doc_id, 'QB', unnest({PARTS_SQL.format('source')}), 1 FROM e
UNION ALL SELECT doc_id, 'QLANG', unnest({FIELD_WORDS.format('lang')}), 1 FROM e UNION ALL SELECT doc_id, 'QLANG', lower(lang), 1 FROM e WHERE lang <> ''),
x AS (SELECT prefix, term, doc_id, CAST(sum(w) AS BIGINT) AS wdf FROM u GROUP BY ALL)"""


INDEXED = {"source": "source", "language": "lang"}


@query(f"WITH {POSTINGS} SELECT * FROM x")
def fulltext_index(c):
    return fulltext.postings(c.frame("documents"), "doc_id", "text", INDEXED)


PAIRS = [("", t) for t in TERMS] + [("QSOURCE", "src1"), ("QLANG", "en"), ("QB", "src1")]


SCORED = f"""WITH {POSTINGS}, l AS (SELECT doc_id, sum(wdf) AS len FROM x WHERE prefix = '' GROUP BY ALL), w AS (SELECT count(*) AS n, avg(len) AS a FROM l),
h AS (SELECT * FROM x WHERE (prefix, term) IN (VALUES {", ".join(f"('{p}', '{t}')" for p, t in PAIRS)})), d AS (SELECT prefix, term, count(*) AS df FROM h GROUP BY ALL),
s AS (SELECT doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1.0) * wdf * 2.5 / (wdf + 1.5 * (0.25 + 0.75 * len / a))) AS score FROM h JOIN d USING (prefix, term) JOIN l USING (doc_id), w GROUP BY doc_id)"""


@query(f"{SCORED} SELECT doc_id, round(score / (SELECT max(score) FROM s), 6) AS score FROM s")
def fulltext_search(c):
    return fulltext.scored(c.frame("documents"), "doc_id", "text", PAIRS, INDEXED).withColumn("score", F.round("score", 6))


def new_folder(c, name):
    spark = c.frame("documents").sparkSession
    return spark, f"{shared.folder(spark)}/{name}-{shared.uuid.uuid4().hex}"


@query(f"{SCORED} SELECT doc_id, round(score / (SELECT max(score) FROM s), 6) AS score FROM s ORDER BY score DESC, doc_id LIMIT 10")
def fulltext_top(c):
    """The ten best from a stored index, of which only blocks are read that may hold one of them."""
    spark, path = new_folder(c, "fulltext")
    fulltext.store(c.frame("documents"), path, "doc_id", "text", INDEXED)
    return fulltext.top(spark, path, PAIRS, 10).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@query()
def fulltext_stems(c):
    """The ten best by stems from a stored index; a test counts the stems of every text."""
    spark, path = new_folder(c, "stems")
    fulltext.store(c.frame("documents"), path, "doc_id", "text", language="lang")
    pairs = fulltext.query_stems(spark, "that eraning onhed", "english")
    return fulltext.top(spark, path, pairs, 10).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


BM25 = f"""l AS (SELECT doc_id, length({TOKENS}) + 2.0 * length({NAMES}) AS len, length({TOKENS}) + 3.0 * length({NAMES}) AS weight FROM documents),
w AS (SELECT count(*) AS n, avg(weight) AS a FROM l), h AS (SELECT * FROM tf WHERE term IN {TERMS_SQL}), d AS (SELECT term, count(*) AS df FROM h GROUP BY ALL),
b AS (SELECT doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / a))) AS score FROM h JOIN d USING (term) JOIN l USING (doc_id), w GROUP BY doc_id)"""


def text_scores(c):
    return search.bm25(c.frame("documents"), "doc_id", "text", TERMS).withColumn("score", F.round("score", 6))


@query(f"""WITH {TF}, {BM25}, t AS (SELECT doc_id, round(score, 6) AS s FROM b WHERE score > 0.1 ORDER BY round(score, 6) DESC, doc_id LIMIT 60),
v AS (SELECT vec_id AS doc_id, round(1 / (1 + {DISTANCE}), 6) AS s FROM embeddings WHERE len(embedding) = 64 ORDER BY {DISTANCE}, vec_id LIMIT 60),
m AS (SELECT coalesce(v.doc_id, t.doc_id) AS doc_id, round(0.6 * coalesce(v.s / (SELECT max(s) FROM v), 0) + 0.4 * coalesce(t.s / (SELECT max(s) FROM t), 0), 6) AS score FROM v FULL JOIN t ON v.doc_id = t.doc_id)
SELECT doc_id, score FROM m WHERE score >= 0.1 ORDER BY score DESC, doc_id LIMIT 10""")
def hybrid_search(c):
    return fulltext.hybrid(c.frame("embeddings"), AXIS, text_scores(c), "doc_id", 10)


COSINE = f"greatest(0, list_cosine_similarity(embedding::DOUBLE[], {AXIS_SQL}))"


@query(f"""WITH {TF}, {BM25}, s AS (SELECT doc_id, round(score, 6) AS score FROM b WHERE score > 0.1),
a AS (SELECT doc_id, score + CASE WHEN contains(text, 'that') THEN 0.08 ELSE 0 END AS score, 0 AS turn, 'original' AS origin FROM s JOIN documents USING (doc_id)
UNION ALL SELECT doc_id, n_chars / 300.0 * 0.97 + CASE WHEN contains(text, 'that') THEN 0.08 ELSE 0 END, -1, 'expanded' FROM documents WHERE lang = 'en'
UNION ALL SELECT doc_id, n_chars / 250.0 * 0.90 + CASE WHEN contains(text, 'that') THEN 0.08 ELSE 0 END, -3, 'keywords' FROM documents WHERE n_chars > 500),
m AS (SELECT doc_id, max(score) AS score, arg_max(origin, (score, turn)) AS origin FROM a GROUP BY doc_id)
SELECT m.doc_id, round(score::DOUBLE + 0.2 * coalesce({COSINE}, 0), 6) AS score, origin FROM m LEFT JOIN embeddings e ON e.vec_id = m.doc_id ORDER BY 2 DESC, 1 LIMIT 30""")
def multi_query_rerank(c):
    d = c.frame("documents")
    side = lambda rows, score: rows.select("doc_id", score.alias("score"), F.col("text").alias("snippet"))
    found = [(text_scores(c).join(d.select("doc_id", F.col("text").alias("snippet")), "doc_id"), "original"), (side(d.filter("lang = 'en'"), F.col("n_chars") / 300), "expanded"), (side(d.filter("n_chars > 500"), F.col("n_chars") / 250), "keywords")]
    return fulltext.multi_query(found, "doc_id", c.frame("embeddings"), "that", AXIS, 30)


@query("""WITH w AS (SELECT item_id, regexp_split_to_array(lower(text), '[^a-z0-9_\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark)
SELECT item_id FROM w WHERE len(list_filter(w, lambda x: starts_with(x, 'th'))) > 0 AND len(list_filter(w, lambda x: starts_with(x, 'an'))) > 0""")
def prefix_search(c):
    spark, path = new_folder(c, "words")
    fulltext.store_words(c.frame("benchmark"), path, "item_id", ["text"])
    return fulltext.with_prefixes(spark, path, "Th an").select(F.col("key").alias("item_id"))


@query("""WITH w AS (SELECT item_id, regexp_split_to_array(lower(text), '[^a-z0-9_\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark)
SELECT conv_id, turn FROM conversations WHERE turn IN (SELECT item_id FROM w WHERE len(list_filter(w, lambda x: starts_with(x, 'th'))) > 0)""")
def prefix_subquery(c):
    spark, path = new_folder(c, "words")
    fulltext.store_words(c.frame("benchmark"), path, "item_id", ["text"])
    found = fulltext.with_prefixes(spark, path, "th").select(F.col("key").alias("item_id"))
    return c.frame("conversations").join(found, F.col("turn") == F.col("item_id"), "left_semi").select("conv_id", "turn")


@query("SELECT lang, doc_id, 'S' || row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS citation FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) <= 15")
def citation_numbers(c):
    d = c.frame("documents").select("lang", "doc_id", "n_chars")
    return fulltext.numbered(fulltext.best(d, ["lang"], [F.desc("n_chars"), F.col("doc_id")], 15), [F.desc("n_chars"), F.col("doc_id")], ["lang"]).select("lang", "doc_id", "citation")


ANSWER = "regexp_replace(text, '\\.', ' [S' || (item_id % 4) || '].', 'g') || CASE WHEN item_id % 3 = 0 THEN ' [Q1]' ELSE '' END"
CONTEXT = "['S1', 'S2', 'Q1']"


@query(f"""WITH a AS (SELECT item_id, list_distinct(regexp_extract_all({ANSWER}, '\\[((?:S|Q)[0-9]+)\\]', 1)) AS c FROM benchmark)
SELECT item_id, array_to_string(list_sort(list_filter(c, lambda x: NOT list_contains({CONTEXT}, x))), ',') AS missing, array_to_string(list_filter({CONTEXT}, lambda x: NOT list_contains(c, x)), ',') AS uncited FROM a""")
def citation_sets(c):
    answer = F.concat(F.regexp_replace("text", F.lit(r"\."), F.concat(F.lit(" [S"), F.pmod("item_id", F.lit(4)), F.lit("]."))), F.when(F.pmod("item_id", F.lit(3)) == 0, " [Q1]").otherwise(""))
    sets = fulltext.citation_sets(answer, F.array(*map(F.lit, ("S1", "S2", "Q1"))))
    return c.frame("benchmark").select("item_id", sets.alias("s")).select("item_id", F.array_join(F.array_sort("s.missing"), ",").alias("missing"), F.array_join("s.uncited", ",").alias("uncited"))


@query("SELECT item_id, CASE WHEN item_id % 5 = 0 THEN 'no_context' WHEN item_id / 40.0 >= 0.75 THEN 'grounded' WHEN item_id / 40.0 >= 0.35 THEN 'partial' ELSE 'weak' END AS band FROM benchmark")
def confidence_band(c):
    return c.frame("benchmark").select("item_id", fulltext.grounding_band(F.col("item_id") / 40, F.pmod("item_id", F.lit(5))).alias("band"))


@query(f"SELECT d.doc_id, d.lang, v.distance FROM documents d JOIN (SELECT vec_id, round({DISTANCE}, 4) AS distance FROM embeddings WHERE len(embedding) = 64 ORDER BY {DISTANCE}, vec_id LIMIT 25) v ON d.doc_id = v.vec_id")
def hit_documents(c):
    hits = search.nearest(c.frame("embeddings"), AXIS, 25).withColumnRenamed("vec_id", "doc_id").drop("score")
    return fulltext.looked_up(hits, c.frame("documents"), "doc_id").select("doc_id", "lang", "distance")


RULE_SQL = "repeat('=', 60)"


@query(f"""WITH r AS (SELECT lang, doc_id, source, text, n_chars / 100000.0 AS score, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS rank FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL AND n_chars > 50 QUALIFY rank <= 15),
h AS (SELECT *, chr(10) || {RULE_SQL} || chr(10) || 'FILE: ' || coalesce(source, '?') || chr(10) || 'Page: ' || doc_id % 7 || chr(10) || 'Type: text, Language: ' || lang || chr(10) || 'Relevance: ' || format('{{:.2f}}', score::DOUBLE) || chr(10) || {RULE_SQL} || chr(10) || chr(10) AS header FROM r),
u AS (SELECT *, sum(length(header) + length(text)) OVER (PARTITION BY lang ORDER BY rank) AS upto FROM h)
SELECT lang, count(*) AS files, CAST(max(upto) AS BIGINT) AS size, md5(string_agg(header || CASE WHEN length(text) < 100 THEN text ELSE left(text, 40) || chr(10) || '...' || chr(10) END || chr(10), '' ORDER BY rank)) AS digest FROM u WHERE upto <= 3000 GROUP BY lang""")
def context_text(c):
    d = c.frame("documents").filter("lang IS NOT NULL AND text IS NOT NULL AND n_chars > 50")
    ranked = fulltext.best(d.select("lang", "doc_id", "n_chars"), ["lang"], [F.col("n_chars"), F.col("doc_id")], 15)
    hits = fulltext.looked_up(ranked.select("doc_id", "rank"), d, "doc_id")
    made = hits.select(
        F.col("lang").alias("of"), "rank", F.coalesce("source", F.lit("?")).alias("path"), F.lit("text").alias("kind"), F.col("lang").alias("language"), (F.col("n_chars") / 100000).alias("score"),
        F.col("text").alias("content"), F.left("text", F.lit(40)).alias("snippet"), F.create_map(F.lit("chunk_page"), F.pmod("doc_id", F.lit(7)).cast("string")).alias("metadata"),
    )
    return fulltext.context(made, ["of"], 3000, 15, 100).select(F.col("of").alias("lang"), "files", "size", F.md5("text").alias("digest"))


@query("""WITH r AS (SELECT role AS case_id, conv_id AS key, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS rank FROM conversations QUALIFY rank <= 50), c(case_id, expected) AS (VALUES ('user', 3), ('assistant', 9000000)),
h AS (SELECT case_id, min(rank) AS rank FROM r JOIN c USING (case_id) WHERE key = expected AND rank <= 20 GROUP BY ALL) SELECT c.case_id, h.rank IS NOT NULL AS found, coalesce(round(1.0 / h.rank, 6), 0)::DOUBLE AS reciprocal FROM c LEFT JOIN h USING (case_id)""")
def retrieval_eval(c):
    d = c.frame("conversations").filter("conv_id < 1000")
    cases = d.sparkSession.createDataFrame([("user", 3), ("assistant", 9_000_000)], "case_id string, expected long")
    ranked = c.frame("conversations").join(F.broadcast(cases), F.col("role") == F.col("case_id")).select("case_id", F.col("conv_id").alias("key"), "turn")
    results = fulltext.best(ranked, ["case_id"], [F.col("key"), F.col("turn")], 50)
    return vector_index.evaluated(cases, results, 20).withColumn("reciprocal", F.round("reciprocal", 6))


# --- documents

PIECES = "regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+[ \\t\\n\\x0B\\f\\r]*')"


@query(f"""WITH w AS (SELECT doc_id, source, {PIECES} AS w FROM documents), s AS (SELECT doc_id, source, w, unnest(generate_series(0, greatest(0, len(w) - 41), 180)) AS start FROM w WHERE len(w) > 0)
SELECT doc_id, source || '#chunk-' || start // 180 AS path, CAST(start // 180 AS VARCHAR) AS chunk, CAST(len(w[start + 1 : start + 220]) AS VARCHAR) AS tokens, CAST(count(*) OVER (PARTITION BY doc_id) AS VARCHAR) AS chunks,
md5(regexp_replace(array_to_string(w[start + 1 : start + 220], ''), '[ \\t\\n\\x0B\\f\\r]+\\z', '')) AS digest FROM s""")
def chunk_metadata(c):
    made = documents.chunks(c.frame("documents"), "doc_id", "text", F.col("source"))
    get = lambda k: F.try_element_at("metadata", F.lit(k))
    return made.select("doc_id", "path", get("chunk_index").alias("chunk"), get("chunk_token_count").alias("tokens"), get("chunk_count").alias("chunks"), F.md5("content").alias("digest"))


@query("SELECT doc_id, coalesce(NULLIF(CASE WHEN n_chars % 2 = 0 THEN 'r' || n_chars ELSE '' END, ''), 'full_image') AS region, CASE WHEN n_chars % 3 = 0 THEN lang END AS caption FROM documents")
def chunk_ocr(c):
    even, third = F.pmod("n_chars", F.lit(2)) == 0, F.pmod("n_chars", F.lit(3)) == 0
    metadata = F.map_filter(F.create_map(F.lit("ocr_region_0"), F.when(even, F.concat(F.lit("r"), "n_chars")).otherwise(""), F.lit("ocr_caption"), F.when(third, F.col("lang"))), lambda k, v: v.isNotNull())
    return c.frame("documents").select("doc_id", documents.ocr_region(metadata).alias("o")).select("doc_id", "o.region", "o.caption")


CODE = "'// ' || lang || chr(10) || 'namespace n' || doc_id || ' {' || chr(10) || 'class C' || doc_id || ' {' || chr(10) || '  int f' || n_chars || '(int a) {' || chr(10) || 'def g' || doc_id || '(x):' || chr(10) || '  pass'"
CODE_ROWS = "(1, 'namespace n' || doc_id || ' {', 'namespace', 'n' || doc_id, 'namespace:n' || doc_id), (2, 'class C' || doc_id || ' {', 'class', 'C' || doc_id, 'class:C' || doc_id), (3, 'int f' || n_chars || '(int a) {', 'function', 'f' || n_chars, 'class:C' || doc_id), (4, 'def g' || doc_id || '(x):', 'function', 'g' || doc_id, 'class:C' || doc_id)"


@query(f"SELECT doc_id, section, symbol, kind, name, scope FROM documents, LATERAL (VALUES {CODE_ROWS}, (0, NULL, NULL, NULL, NULL)) v(section, symbol, kind, name, scope) WHERE lang IS NOT NULL")
def chunk_code(c):
    made = c.frame("documents").filter("lang IS NOT NULL").select("doc_id", F.expr(CODE.replace("chr(10)", "'\\n'")).alias("code"))
    return documents.code_sections(made, "doc_id", "code").select("doc_id", "section", "symbol", "kind", "name", "scope")


# --- functions

LETTER = "chr(CAST(65 + ({0}) % 26 AS INTEGER))"


@query(f"""WITH n AS (SELECT o_orderkey, o_orderkey % 18000 AS i FROM orders)
SELECT o_orderkey, CASE WHEN i < 26 THEN {LETTER.format('i')} WHEN i < 702 THEN {LETTER.format('i // 26 - 1')} || {LETTER.format('i')} ELSE {LETTER.format('(i // 26 - 1) // 26 - 1')} || {LETTER.format('i // 26 - 1')} || {LETTER.format('i')} END AS letters FROM n""")
def column_names(c):
    return c.frame("orders").select("o_orderkey", files.column_letters(F.pmod("o_orderkey", F.lit(18000))).alias("letters"))


@query("SELECT item_id, lower(hex(CAST(list_reduce(list_prepend(5381::HUGEINT, list_transform(range(0, strlen(t)), lambda i: CASE WHEN CAST('0x' || substr(hex(encode(t)), CAST(2 * i + 1 AS INTEGER), 2) AS INTEGER) > 127 THEN CAST('0x' || substr(hex(encode(t)), CAST(2 * i + 1 AS INTEGER), 2) AS HUGEINT) - 256 ELSE CAST('0x' || substr(hex(encode(t)), CAST(2 * i + 1 AS INTEGER), 2) AS HUGEINT) END)), lambda h, b: (h * 33 + b + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT) AS UBIGINT))) AS hash FROM (SELECT item_id, 'é' || text AS t FROM benchmark)")
def qa_hash_signed(c):
    return c.frame("benchmark").select("item_id", T.shift_add_hash(F.concat(F.lit("é"), "text"), signed=True).alias("hash"))


@query("SELECT item_id, lpad(lower(hex(CAST(list_reduce(list_prepend(1469598103934665603::HUGEINT, list_transform(range(0, strlen(t)), lambda i: CAST('0x' || substr(hex(encode(t)), CAST(2 * i + 1 AS INTEGER), 2) AS HUGEINT))), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS UBIGINT))), 16, '0') AS hash FROM (SELECT item_id, text AS t FROM benchmark)")
def upload_hash(c):
    return c.frame("benchmark").select("item_id", files.content_hash(F.col("text")).alias("hash"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' WHEN 'es' THEN 'spanish' WHEN 'it' THEN 'italian' ELSE CASE WHEN regexp_matches(text, '[А-я]') THEN 'russian' ELSE 'english' END END AS language FROM documents")
def document_languages(c):
    return c.frame("documents").select("doc_id", T.stemming_language(F.col("text"), F.col("lang")).alias("language"))


# --- sources


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'text/html' WHEN 1 THEN 'text/x-python' WHEN 2 THEN 'image/png' WHEN 3 THEN 'application/json' END AS mime,
CASE page_id % 5 WHEN 0 THEN 'html' WHEN 1 THEN 'source' WHEN 2 THEN 'image' WHEN 3 THEN 'config' END AS kind, CASE page_id % 5 WHEN 4 THEN 'unsupported_extension' END AS issue FROM pages""")
def file_types(c):
    name = F.concat(F.lit("/a.b/x."), F.element_at(F.array(*map(F.lit, ("html", "PY", "png", "json", "zzz"))), (F.pmod("page_id", F.lit(5)) + 1).cast("int")))
    return c.frame("pages").select("page_id", files.file_type(name).alias("t")).select("page_id", "t.mime", "t.kind", "t.issue")


@query("SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'missing_extension' WHEN 2 THEN 'extension_not_allowed' WHEN 3 THEN 'file_too_large' WHEN 4 THEN 'mime_not_allowed' ELSE 'outside_folder' END AS verdict FROM pages")
def upload_checks(c):
    k = F.pmod("page_id", F.lit(6))
    name = F.when(k == 1, "plain").when(k == 2, "x.exe").otherwise("x.MD")
    mime = F.when(k == 4, "video/mp4").when(k == 0, "text/markdown; charset=utf-8").otherwise("")
    path = F.when(k == 5, "/data/in/../../etc/x.md").otherwise("/data/in/a/../x.md")
    return c.frame("pages").select("page_id", files.upload_check(name, mime, F.when(k == 3, 2000).otherwise(10), ["md", "txt"], ["text/*"], 1000, path, "/data/in").alias("verdict"))


@query("""SELECT o_custkey, o_orderkey AS key, CAST(round(o_totalprice) AS BIGINT) AS price, o_orderstatus AS status, 'a, "b"' AS note FROM orders""")
def csv_parse(c):
    line = F.concat_ws(";", F.col("o_orderkey").cast("string"), F.round("o_totalprice").cast("long").cast("string"), F.col("o_orderstatus"), F.lit('"a, ""b"""'))
    texts = c.frame("orders").select("o_custkey", F.concat(F.lit("key;price;status;note\n"), line).alias("text"))
    get = lambda k: F.try_element_at("cells", F.lit(k))
    return files.csv_rows(texts, "o_custkey", "text").select("o_custkey", get("key").cast("long").alias("key"), get("price").cast("long").alias("price"), get("status").alias("status"), get("note").alias("note"))


def pairs_of(c):
    b = c.frame("benchmark")
    tags = F.when(F.pmod("item_id", F.lit(2)) == 0, F.array(F.lit("Even"))).otherwise(F.array().cast("array<string>"))
    return b.select(F.lpad(F.col("item_id").cast("string"), 9, "0").alias("id"), F.col("text").alias("question"), F.concat(F.lit("!"), "text").alias("answer"), F.concat(F.lit("k"), F.pmod("item_id", F.lit(3))).alias("category"), F.array(F.concat(F.lit("Alias "), "item_id")).alias("aliases"), tags.alias("tags"), F.create_map(F.lit("n"), F.col("item_id").cast("string")).alias("metadata"))


@query("SELECT 'ALIAS ' || conv_id AS question, lpad(CAST(item_id AS VARCHAR), 9, '0') AS id, '!' || text AS answer, 'k' || item_id % 3 AS category FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN benchmark ON item_id = conv_id")
def qa_lookup(c):
    asked = c.frame("conversations").select("conv_id").distinct().select(F.concat(F.lit("ALIAS "), "conv_id").alias("question"))
    return questions.lookup(pairs_of(c), asked)


@query("SELECT 'qa://' || lpad(CAST(item_id AS VARCHAR), 9, '0') AS path, md5('Question: ' || text || chr(10) || chr(10) || 'Answer: !' || text) AS digest, 'Alias ' || item_id AS aliases, CASE WHEN item_id % 2 = 0 THEN 'Even' END AS tags, CAST(item_id AS VARCHAR) AS n FROM benchmark")
def qa_documents(c):
    get = lambda k: F.try_element_at("metadata", F.lit(k)).alias(k)
    return questions.as_documents(pairs_of(c)).select("path", F.md5("content").alias("digest"), get("aliases"), get("tags"), get("n"))


@query("WITH f AS (SELECT lpad(CAST(item_id AS VARCHAR), 9, '0') AS id FROM benchmark WHERE item_id % 3 = 1 AND item_id % 2 = 0) SELECT id, (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM f) > 7 AS has_more FROM (SELECT id FROM f ORDER BY id LIMIT 5 OFFSET 2)")
def qa_filtered(c):
    return questions.listed(pairs_of(c), category="k1", tag="EVEN", skip=2, most=5).select("id", "total", "has_more")


# --- requests

RIGHTS = Policy(
    {
        "orders": Rights({"o_orderkey": Field(), "o_custkey": Field(write=True), "o_totalprice": Field(write=True), "o_orderstatus": Field(sort=False), "o_orderpriority": Field(hidden=True)}, write=True, delete=True),
        "customer": Rights({"c_custkey": Field(), "c_mktsegment": Field(filter=False)}),
    },
    100,
    1000,
)


@query("SELECT c_mktsegment, count(*) AS n, max(o_totalprice) AS most FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY ALL HAVING count(*) > 5 AND max(o_totalprice) > 1000 ORDER BY n DESC, c_mktsegment LIMIT 1000")
def request_grouped(c):
    body = {"table": "orders", "fields": ["COUNT(*) as n", "MAX(o_totalprice) as most"], "group_by": ["customer.c_mktsegment"], "where": [{"field": "o_totalprice", "op": "gt", "value": 1000}], "having": ["n > 5", "MAX(o_totalprice) > 1000"], "order_by": ["-n", "c_mktsegment"], "limit": 5000}
    return from_json(c, body, RIGHTS)


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey > 10 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def request_readable(c):
    return from_url(c, "query=(table:[orders];filter:[o_orderkey>10];order_by:[o_totalprice DESC,o_orderkey ASC];limit:[20];offset:[5])", RIGHTS)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 1000 AND o_orderstatus IN ('F', 'O') ORDER BY o_orderkey LIMIT 40")
def request_params(c):
    return from_params(c, "orders", {"o_totalprice__gte": "1000", "o_orderstatus__in": "F,O", "values": "o_orderkey,o_totalprice", "order_by": "o_orderkey", "limit": "40"}, RIGHTS)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber < l_quantity AND l_orderkey > l_partkey")
def filter_columns(c):
    return Table.of(c, "lineitem").filter("l_linenumber < l_quantity & l_orderkey > l_partkey").values("l_orderkey", "l_linenumber").frame_of()


@query("SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name HAVING max(r_regionkey) >= 1 AND sum(c_acctbal) > 0")
def having_join(c):
    q = Table.of(c, "customer").group_by("nation.n_name").values("COUNT(*) as customers")
    return q.having("MAX(nation.region.r_regionkey) >= 1 & SUM(c_acctbal) > 0").frame_of()


@query("SELECT c_mktsegment, c_nationkey FROM customer GROUP BY ALL")
def group_only(c):
    return Table.of(c, "customer").group_by("c_mktsegment", "c_nationkey").frame_of()


@query("SELECT o_custkey AS customer, count(*) AS n FROM orders GROUP BY ALL")
def group_renamed(c):
    return Table.of(c, "orders").group_by("o_custkey").values("o_custkey as customer", "COUNT(*) as n").frame_of()


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_custkey = 7 THEN 1.5 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_custkey <> 8 UNION ALL SELECT (SELECT max(o_orderkey) FROM orders) + 1, 5, 9.5")
def request_writes(c):
    from .catalog import Catalog

    step = lambda rows: Catalog({"orders": rows}, (), ("orders",))
    rows = written(c, "PATCH", "orders", {"o_totalprice": 1.5}, RIGHTS, {"o_custkey": 7})
    rows = written(step(rows), "DELETE", "orders", {}, RIGHTS, {"o_custkey": 8})
    return written(step(rows), "POST", "orders", {"data": {"o_custkey": 5, "o_totalprice": 9.5}}, RIGHTS, key="o_orderkey").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 5000 GROUP BY ALL")
def raw_sql(c):
    return c.sql(c.frame("orders").sparkSession, "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > :least GROUP BY o_orderstatus", {"least": 5000})


@query("SELECT * FROM (VALUES ('customer', 1, 'c_custkey', NULL), ('customer', 4, 'c_nationkey', 'nation.n_nationkey')) v(tbl, position, col, refers_to) WHERE false UNION ALL SELECT 'nation', 1, 'n_nationkey', NULL UNION ALL SELECT 'nation', 2, 'n_name', NULL UNION ALL SELECT 'nation', 3, 'n_regionkey', 'region.r_regionkey'")
def table_columns(c):
    return c.columns(c.frame("nation").sparkSession, "nation", "N_").select("tbl", "position", "col", "refers_to")


@query("SELECT * FROM (VALUES ('pages'), ('part')) v(tbl)")
def table_listing(c):
    return c.tables(c.frame("nation").sparkSession, "PA").select("tbl")


@query("SELECT 'nation' AS tbl, count(*) AS rows FROM nation UNION ALL SELECT 'orders', count(*) FROM orders")
def table_counts(c):
    from .catalog import Catalog

    return Catalog({n: c.frame(n) for n in ("nation", "orders")}, ()).row_counts()


@query("SELECT o_orderkey, o_custkey FROM orders UNION ALL SELECT (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY c_custkey), -1 FROM customer WHERE c_custkey <= 30")
def insert_numbered(c):
    orders = c.frame("orders").select("o_orderkey", "o_custkey")
    new = c.frame("customer").filter("c_custkey <= 30").select(F.lit(-1).cast(orders.schema["o_custkey"].dataType).alias("o_custkey"))
    return changes.insert(orders, new, "o_orderkey")


@query("""WITH n AS (SELECT doc_id, lang, n_chars FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'new', n_chars + 1 FROM documents WHERE doc_id % 3 = 0),
o AS (SELECT doc_id, lang, n_chars FROM documents WHERE doc_id % 3 <> 0) SELECT * FROM o UNION ALL SELECT doc_id, arg_max(lang, n_chars), max(n_chars) FROM n GROUP BY doc_id""")
def upsert_repeated(c):
    d = c.frame("documents").select("doc_id", "lang", "n_chars")
    third = d.filter("doc_id % 3 = 0")
    return changes.upsert(d, third.unionByName(third.withColumns({"lang": F.lit("new"), "n_chars": F.col("n_chars") + 1})), "doc_id", "n_chars")


# --- reports


def span_of(c):
    """Events between the first and the last midnight of the table."""
    e = c.frame("events")
    edge = e.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(F.date_trunc("day", F.col("a")).alias("a"), F.date_trunc("day", F.col("b")).alias("b")).first()
    return analytics.between(e, str(edge["a"]), str(edge["b"]))


@query("""WITH s AS (SELECT date_trunc('day', min(ts)) AS a, date_trunc('day', max(ts)) AS b FROM events), e AS (SELECT * FROM events, s WHERE ts BETWEEN a AND b)
SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS answered, count(*) FILTER (event_type = 'error') AS unanswered, round(100.0 * count(*) FILTER (event_type <> 'error') / count(*), 4) AS answer_rate, round(avg(value), 4) AS avg_ms FROM e""")
def report_range(c):
    return analytics.counters(span_of(c), F.col("event_type") != "error", F.col("value"))


@query("SELECT event_type, count(*) AS total, count(*) FILTER (user_id % 3 = 0) AS helpful, count(*) FILTER (user_id % 3 = 1) AS not_helpful FROM events WHERE event_type <> '' GROUP BY ALL")
def report_feedback_categories(c):
    rating = F.element_at(F.array(*map(F.lit, ("up", "down", "other"))), (F.pmod("user_id", F.lit(3)) + 1).cast("int"))
    return analytics.feedback_by_category(c.frame("events").withColumn("rating", rating), "rating", "event_type")


@query("""WITH s AS (SELECT CAST(max(ts) AS DATE)::TIMESTAMP AS now FROM events), c AS (SELECT count(*) AS n, count(DISTINCT user_id) AS authors, count(*) FILTER (ts >= now - INTERVAL 1 DAY) AS recent, count(*) FILTER (ts >= now - INTERVAL 3 DAY) AS fresh FROM events, s)
SELECT n AS articles, authors, recent, CASE WHEN n = 0 THEN 100 ELSE CAST(floor(fresh * 100 / n::DOUBLE) AS BIGINT) END AS freshness FROM c""")
def article_freshness(c):
    now = c.frame("events").agg(F.to_date(F.max("ts")).alias("d")).first()["d"]
    return analytics.freshness(c.frame("events"), "ts", "user_id", f"{now} 00:00:00", 1, 3)


@query("SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', text, source)), 'src1') AND lang = 'en' AND n_chars % 2 = 0")
def article_list(c):
    d = c.frame("documents").withColumn("favourite", F.pmod("n_chars", F.lit(2)) == 0)
    return analytics.listed(d, "SRC1", ("text", "source"), {"lang": "en", "source": "all"}, "favourite").select("doc_id")


@query("SELECT lang AS kind, count(*) AS files, CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS lines, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY ALL")
def project_stats(c):
    d = c.frame("documents").select(F.col("lang").alias("kind"), F.col("doc_id").cast("string").alias("path"), "text")
    return analytics.project_stats(d.unionByName(d.filter("kind = 'en'")), "path", "text", "kind")


# --- vectors


@query("SELECT 1 AS version, 'm' AS model, coalesce(max(len(embedding)), 0) AS dimension, count(*) AS vectors, CAST(sum(CAST('0x' || md5(vec_id || '|' || len(embedding))[1:8] AS BIGINT)) AS BIGINT) AS digest FROM embeddings")
def index_metadata(c):
    return vector_index.metadata(c.frame("embeddings"), "m")


@query("SELECT b.vec_id, min(a.vec_id) AS first_id FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.vec_id % 9 <> 4 AND b.vec_id % 9 <> 4 AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.5 GROUP BY ALL")
def duplicates_of_categories(c):
    """All rows but those of an excluded category are judged."""
    return search.earlier_duplicates(c.frame("embeddings").filter("vec_id % 9 <> 4"), 0.5)


@query("SELECT item_id, CASE WHEN contains(lower(text), 'zebra') THEN 1.0::DOUBLE WHEN item_id % 2 = 0 THEN greatest(greatest(0.35, round(0.98 - 0.04 * item_id, 6)), 0.94)::DOUBLE ELSE greatest(0.35, round(0.98 - 0.04 * item_id, 6))::DOUBLE END AS score FROM benchmark")
def qa_score_aliases(c):
    aliases = F.when(F.pmod("item_id", F.lit(2)) == 0, F.array(F.lit("The Zebra"))).otherwise(F.array().cast("array<string>"))
    return c.frame("benchmark").select("item_id", F.round(search.answer_score(F.col("text"), F.lit(""), "zebra", F.col("item_id"), aliases), 6).alias("score"))


# --- schemas

MESSY = (
    ("table", " orders ", "", {}), ("column", "orders", "  id ", {"type": " int ", "defaultValue": "(NULL)"}), ("column", "orders", "at", {"type": "timestamp  without time zone", "defaultValue": "current_timestamp"}),
    ("column", "orders", "paid", {"type": "bool", "defaultValue": "(TRUE)"}), ("column", "orders", "sum", {"type": "numeric(10,2)", "defaultValue": "0"}), ("foreign_key", "orders", "c", {"onDelete": "no action", "references": " c  (id) "}),
)


@query("""SELECT * FROM (VALUES ('column', 'orders', 'id', 'type', 'INTEGER'), ('column', 'orders', 'id', 'defaultValue', ''), ('column', 'orders', 'at', 'type', 'TIMESTAMP'), ('column', 'orders', 'at', 'defaultValue', 'CURRENT_TIMESTAMP'),
('column', 'orders', 'paid', 'type', 'BOOLEAN'), ('column', 'orders', 'paid', 'defaultValue', 'true'), ('column', 'orders', 'sum', 'type', 'DECIMAL(10,2)'), ('column', 'orders', 'sum', 'defaultValue', '0'),
('foreign_key', 'orders', 'c', 'onDelete', 'NO_ACTION'), ('foreign_key', 'orders', 'c', 'references', 'c (id)')) v(object, tbl, name, property, value)""")
def schema_normalised(c):
    given = c.frame("nation").sparkSession.createDataFrame(list(MESSY), "object string, tbl string, name string, properties map<string,string>")
    return schemas.normalised(given).select("object", "tbl", "name", F.explode("properties").alias("property", "value"))


# --- relations and text functions


@query("SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' AND n_regionkey >= 2")
def filter_relation(c):
    return Table.of(c, "orders").filter(customer__c_mktsegment="BUILDING", customer__nation__n_regionkey__gte=2).values("o_orderkey", "customer.c_mktsegment").frame_of()


@query("SELECT page_id, array_to_string(list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace(url, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda t: length(t) >= 2), ' ') AS terms FROM pages")
def identifier_parts(c):
    return c.frame("pages").select("page_id", F.array_join(T.identifier_terms(F.col("url")), " ").alias("terms"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '京都,東京' ELSE '水' END AS grams FROM pages")
def cjk_grams(c):
    text = F.concat(F.when(F.pmod("page_id", F.lit(2)) == 0, "x東京都 ").otherwise("水-"), F.col("page_id").cast("string"))
    return c.frame("pages").select("page_id", F.array_join(T.cjk_bigrams(text), ",").alias("grams"))


@query("SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s, ' ')), lambda s: s <> ''), chr(10))) AS digest FROM documents")
def kept_lines(c):
    return c.frame("documents").select("doc_id", F.md5(T.kept_lines(F.col("text"))).alias("digest"))


@query("SELECT conv_id, turn, left(trim(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0E-\\x1F\\x7F]', '', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' '), 700) AS said FROM conversations")
def sanitized_turns(c):
    return c.frame("conversations").select("conv_id", "turn", T.history(F.col("text")).alias("said"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), a AS (SELECT *, coalesce(list_position(list_transform(l, lambda s: contains(lower(s), 'that') OR contains(lower(s), 'und')), true), 0) AS at_ FROM l),
s AS (SELECT *, CASE WHEN at_ > 0 THEN greatest(at_ - 2, 1) ELSE 1 END AS start_, CASE WHEN at_ > 0 THEN at_ + 2 ELSE 20 END AS end_ FROM a)
SELECT doc_id, md5(array_to_string(list_transform(l[start_ : end_], lambda s, i: printf('%4d | %s', CAST(i + start_ - 1 AS INTEGER), s)), chr(10))) AS digest FROM s""")
def snippets(c):
    return c.frame("documents").select("doc_id", F.md5(T.snippet(F.col("text"), ["that", "und"])).alias("digest"))


@query("""WITH p AS (SELECT 'T' || item_id % 7 AS title, min(item_id) AS item_id FROM benchmark GROUP BY item_id % 7) SELECT title, 'general' AS category, 'x,y' AS aliases, 'body ' || item_id AS body FROM p""")
def markdown_sources(c):
    n = F.col("item_id")
    content = F.concat(F.lit("---\ntitle: "), F.when(n < 7, "T").otherwise("t"), F.pmod(n, F.lit(7)), F.lit("\naliases: x, ,y\n---\nbody "), n)
    made = c.frame("benchmark").select(F.concat(F.lit("/in/"), F.lpad(n.cast("string"), 9, "0"), F.lit(".md")).alias("path"), content.alias("content"))
    return files.markdown_pairs(made).select("title", "category", F.array_join("aliases", ",").alias("aliases"), "body")
