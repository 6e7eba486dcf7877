"""Queries of retrieval, chunking, reports and text functions, each with equivalent SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analytics, changes, documents, retrieval
from ..operators.retrieval import MetadataFilter
from ..operators.selection import at_ranks
from ..sources import files
from ..streaming import limits
from .registry import LIMITED, NAMES, QUESTION_SQL, TF, TOKENS, plain_sql, query
from .table import Table

AXIS = [1.0 if i % 2 == 0 else -0.5 for i in range(64)]
PATH_SQL = "(source || '/' || lang || '.txt')"
TERMS = ["that", "for", "thth", "src1", "en"]


def path():
    return F.concat("source", F.lit("/"), "lang", F.lit(".txt"))


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'")
def count_rows(c):
    return Table.of(c, "orders").filter(o_orderstatus="O").values("COUNT(*) as n").frame_of()


@query("SELECT o_custkey, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL ORDER BY total DESC, o_custkey, o_orderstatus LIMIT 40")
def agg_group_order(c):
    q = Table.of(c, "orders").group_by("o_custkey", "o_orderstatus").values("COUNT(*) as n", "SUM(o_totalprice) as total").order_by("-total", "o_custkey", "o_orderstatus").limit(40)
    return q.frame_of().withColumn("total", F.round("total", 2))


@query("SELECT p_partkey, p_name FROM part ORDER BY lower(p_name), p_partkey LIMIT 50")
def order_nocase(c):
    return c.frame("part").orderBy(F.lower("p_name"), "p_partkey").limit(50).select("p_partkey", "p_name")


@query("SELECT count(value) AS n, round(sum(value), 2) AS total, min(value) AS least, max(value) AS most, round(avg(value), 4) AS mean FROM events")
def summary_metric(c):
    return analytics.summary(c.frame("events"), F.col("value"))


@query("""WITH r AS (SELECT event_type, round(value, 2) AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, min(v) AS least, max(v) AS most, round(avg(v), 2) AS mean, max(v) FILTER (i = n * 50 // 100) AS median, max(v) FILTER (i = n * 90 // 100) AS p90, max(v) FILTER (i = n * 95 // 100) AS p95, max(v) FILTER (i = n * 99 // 100) AS p99 FROM r GROUP BY ALL""")
def load_test(c):
    return analytics.load_test(c.frame("events"), "event_type", F.col("value"))


@query("""WITH r AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(v) FILTER (i = n * 50 // 100) AS p50, max(v) FILTER (i = n * 90 // 100) AS p90, max(v) FILTER (i = n * 99 // 100) AS p99, max(v) FILTER (i = n - 1) AS most FROM r GROUP BY ALL""")
def value_ranks(c):
    """Exact quantiles at full precision."""
    share = lambda p: lambda n: F.floor(n * p / 100)
    return at_ranks(c.frame("events"), F.col("value"), ["event_type"], {"p50": share(50), "p90": share(90), "p99": share(99), "most": lambda n: n - 1})


@query("""WITH t AS (SELECT role, length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) AS hi, strlen(text) AS b FROM conversations),
n AS (SELECT role, greatest(CAST(floor((b - hi) / 4.0) + floor(hi / 3.0) AS BIGINT), 1) AS n FROM t) SELECT role, CAST(sum(n) AS BIGINT) AS tokens, round(sum(n) / 1000.0 * 0.01, 6)::DOUBLE AS cost FROM n GROUP BY ALL""")
def token_cost(c):
    return analytics.token_cost(c.frame("conversations"), "role", T.estimated_tokens(F.col("text")))


@query(f"WITH RECURSIVE {LIMITED} SELECT count(*) AS total, count(*) FILTER (NOT allowed) AS rejected, round(100.0 * count(*) FILTER (NOT allowed) / count(*), 4) AS rejection_rate FROM decisions")
def limiter_rate(c):
    return analytics.limiter_rate(limits.limited(c.frame("events"), "user_id", 1, 20))


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 250")
def log_prune(c):
    return analytics.pruned(c.frame("events").select("event_id", "event_type"), [F.desc("event_id")], 500)


@query("""WITH g AS (SELECT md5(text) AS d, count(*) AS n FROM documents WHERE strlen(text) BETWEEN 1 AND 20000 GROUP BY ALL)
SELECT (SELECT count(*) FROM documents) AS seen, (SELECT count(*) FROM documents WHERE NOT coalesce(strlen(text) BETWEEN 1 AND 20000, false)) AS skipped, count(*) AS imported, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM g""")
def import_counts(c):
    return analytics.import_counts(c.frame("documents"), "doc_id", F.col("text"), 20000)


@query("SELECT CASE WHEN regexp_extract(url, '^(.*)/[^/]*$', 1) = '' THEN '.' ELSE regexp_extract(url, '^(.*)/[^/]*$', 1) END AS folder, count(*) AS n FROM pages GROUP BY ALL")
def folder_counts(c):
    return analytics.folder_counts(c.frame("pages"), F.col("url"))


KIND = "CASE WHEN v IS NULL OR trim(v) = '' THEN 'Empty' WHEN lower(trim(v)) IN ('true', 'false') THEN 'Boolean' WHEN regexp_full_match(trim(v), '[+-]?[0-9]+') THEN 'Integer' WHEN regexp_full_match(trim(v), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN 'Number' WHEN regexp_full_match(trim(v), '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'Date' ELSE 'Text' END"


@query(f"""WITH c AS (SELECT unnest([{{'col': 'o_orderkey', 'v': CAST(o_orderkey AS VARCHAR)}}, {{'col': 'o_totalprice', 'v': CAST(o_totalprice AS VARCHAR)}}, {{'col': 'o_orderstatus', 'v': o_orderstatus}}, {{'col': 'day', 'v': CAST(CAST(o_orderdate AS DATE) AS VARCHAR)}}]) AS x FROM orders),
k AS (SELECT x.col AS col, x.v AS v FROM c), n AS (SELECT col, {KIND} AS kind, count(*) AS n FROM k GROUP BY ALL)
SELECT col, kind, n, CASE WHEN count(*) FILTER (kind <> 'Empty') OVER w = 0 THEN 'Empty' WHEN count(*) FILTER (kind <> 'Empty') OVER w = 1 THEN max(kind) FILTER (kind <> 'Empty') OVER w WHEN count(*) FILTER (kind NOT IN ('Empty', 'Integer', 'Number')) OVER w = 0 THEN 'Number' ELSE 'Mixed' END AS merged FROM n WINDOW w AS (PARTITION BY col)""")
def column_profile(c):
    rows = c.frame("orders").select("o_orderkey", "o_totalprice", "o_orderstatus", F.to_date("o_orderdate").alias("day"))
    return files.profile(rows).select("col", F.explode("counts").alias("kind", "n"), "merged")


def with_metadata(c):
    d = c.frame("documents")
    page = F.pmod("n_chars", F.lit(50))
    entries = [F.lit("chunk_page_start"), page.cast("string"), F.lit("chunk_page_end"), (page + 3).cast("string"), F.lit("Lang"), F.coalesce("lang", F.lit("")), F.lit("origin"), F.coalesce("source", F.lit("")), F.lit("chars"), F.col("n_chars").cast("string")]
    return d.withColumn("metadata", F.create_map(*entries))


@query("SELECT doc_id FROM documents WHERE 12 BETWEEN n_chars % 50 AND n_chars % 50 + 3 AND lower(lang) = 'en' AND n_chars >= 100 AND contains(source, 'rc1') AND starts_with(source, 'src')")
def metadata_filter(c):
    wanted = [MetadataFilter("page", "12"), MetadataFilter("lang", "EN"), MetadataFilter("chars", "100", "gte"), MetadataFilter("origin", "RC1", "contains"), MetadataFilter("origin", "Src", "prefix"), MetadataFilter("chars", "", "exists")]
    return retrieval.filtered(with_metadata(c), "metadata", wanted).select("doc_id")


def boost_sql():
    pairs = ["'chunk_page_start ' || (n_chars % 50)", "'chunk_page_end ' || (n_chars % 50 + 3)", "'lang ' || lower(lang)", "'origin ' || source", "'chars ' || n_chars"]
    terms = [f"CASE WHEN contains({PATH_SQL}, '{t}') THEN 0.15 ELSE 0 END + CASE WHEN {' OR '.join(f'''contains({p}, '{t}')''' for p in pairs)} THEN 0.1 ELSE 0 END" for t in TERMS]
    return " + ".join([*terms, "CASE WHEN contains(lower(text), 'that and') THEN 0.05 ELSE 0 END"])


@query(f"SELECT doc_id, round((n_chars / 1000.0 + {boost_sql()})::DOUBLE, 4) AS score FROM documents ORDER BY score DESC, doc_id LIMIT 50")
def rerank(c):
    b = retrieval.boost(path(), F.col("metadata"), F.col("text"), "that and", TERMS)
    return with_metadata(c).select("doc_id", F.round(F.col("n_chars") / 1000 + b, 4).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)


@query(f"SELECT doc_id, round(n_chars / 100.0 * {' * '.join(f'''(CASE WHEN contains(lang || '.txt', '{t}') THEN 2 ELSE 1 END)''' for t in TERMS)} * CASE WHEN contains(source, 'src') THEN 1.2 ELSE 1 END, 4)::DOUBLE AS score FROM documents")
def path_boost(c):
    return c.frame("documents").select("doc_id", F.round(F.col("n_chars") / 100 * retrieval.path_weight(path(), TERMS), 4).alias("score"))


@query("""WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
u AS (SELECT *, sum(n_chars) OVER (ORDER BY rank) AS upto FROM r WHERE rank <= 15) SELECT doc_id, CAST(rank AS INTEGER) AS rank, CAST(upto AS BIGINT) AS upto FROM u WHERE upto <= 1000000""")
def context_budget(c):
    """All documents are ranked, long ones too; the budget has room for several of them."""
    return documents.within_budget(c.frame("documents"), [F.desc("n_chars"), F.col("doc_id")], F.col("n_chars"), 1_000_000).select("doc_id", "rank", "upto")


def answers(c):
    """Benchmark items as answers: the first sentence cites the next item, the rest nothing."""
    b = c.frame("benchmark")
    given = b.select("item_id", F.regexp_replace("text", r"\.", " [S1].").alias("answer"))
    return given, b.select((F.col("item_id") - 1).alias("item_id"), F.lit("S1").alias("citation"), F.col("text").alias("snippet"))


CLAIMS_SQL = f"""a AS (SELECT item_id, regexp_split_to_array(regexp_replace(text, '\\.', ' [S1].', 'g'), '[.!?\\n]') AS p FROM benchmark),
c AS (SELECT item_id, list_filter(list_transform(p, lambda s: {{'t': {plain_sql('s')}, 'c': list_distinct(regexp_extract_all(s, '\\[((?:S|Q)[0-9]+)\\]', 1))}}), lambda s: strlen(s.t) >= 24)[1:12] AS x FROM a),
k AS (SELECT item_id, unnest(x) AS x, generate_subscripts(x, 1) - 1 AS claim FROM c),
o AS (SELECT k.item_id, claim, x.t AS text, len(x.c) AS n, n.text AS snippet, list_distinct(list_filter(string_split({plain_sql('lower(x.t)')}, ' '), lambda w: strlen(w) >= 2 AND NOT list_contains({QUESTION_SQL}, w))) AS w FROM k LEFT JOIN benchmark n ON n.item_id = k.item_id + 1),
g AS (SELECT item_id, claim, text, CASE WHEN n = 0 OR snippet IS NULL OR len(w) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(w, lambda v: contains(lower(snippet), v)))::DOUBLE / len(w) END AS support, n FROM o),
s AS (SELECT item_id, claim, text, round(support, 6) AS support, CASE WHEN n = 0 THEN 'uncited' WHEN support >= 0.3 THEN 'grounded' WHEN support >= 0.12 THEN 'partial' ELSE 'unsupported' END AS status FROM g)"""


@query(f"WITH {CLAIMS_SQL} SELECT item_id, CAST(claim AS INTEGER) AS claim, text, support, status FROM s")
def grounded_claims(c):
    return retrieval.grounded_claims(*answers(c), "item_id").withColumn("support", F.round("support", 6))


@query(f"""WITH {CLAIMS_SQL}, v AS (SELECT item_id, bool_or(status = 'unsupported') AS bad, bool_or(status = 'uncited') AS bare FROM s GROUP BY ALL)
SELECT b.item_id, CASE WHEN n.item_id IS NULL THEN 'no_context' WHEN bad IS NULL THEN 'no_claims' WHEN bad THEN 'unsupported_claims' WHEN bare THEN 'uncited_claims' ELSE 'grounded' END AS verdict FROM benchmark b LEFT JOIN benchmark n ON n.item_id = b.item_id + 1 LEFT JOIN v ON v.item_id = b.item_id""")
def grounding(c):
    return retrieval.grounding(*answers(c), "item_id")


@query(f"""WITH e AS MATERIALIZED (SELECT doc_id, {TOKENS} AS t, {NAMES} AS i FROM documents), n AS (SELECT count(*) AS docs FROM documents),
d AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(list_concat(t, i))) AS term FROM e) GROUP BY ALL),
w AS (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM e), q AS MATERIALIZED (SELECT doc_id, n, term, count(*) AS c FROM w GROUP BY ALL),
s AS MATERIALIZED (SELECT doc_id, CAST('0x' || md5(term)[1:2] AS INTEGER) AS slot, sum(c * c / n::DOUBLE * ln(docs / (1.0 + df))) AS w FROM q JOIN d USING (term), n GROUP BY ALL),
l AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM s GROUP BY ALL) SELECT doc_id, slot, round(w / norm, 5) AS weight FROM s JOIN l USING (doc_id) WHERE norm > 0""")
def tfidf_embed(c):
    return retrieval.hashed_embeddings(c.frame("documents"), "doc_id", "text").withColumn("weight", F.round("weight", 5))


SAFE = "CASE WHEN {0} = '' THEN 'empty' ELSE {0} END"


def safe_sql(c):
    bad = "[^A-Za-z0-9_\\-./:#]+"
    return SAFE.format(f"regexp_replace(left(lower(regexp_replace(regexp_replace({c}, '^{bad}', ''), '_?{bad}', '_', 'g')), 180), '_+$', '')")


@query(f"WITH {TF} SELECT '' AS prefix, term, doc_id, CAST(tf AS BIGINT) AS wdf FROM tf UNION ALL SELECT 'XL', {safe_sql('lang')}, doc_id, 1 FROM documents WHERE lang IS NOT NULL UNION ALL SELECT 'XS', {safe_sql('source')}, doc_id, 1 FROM documents WHERE source IS NOT NULL")
def inverted_index(c):
    return retrieval.inverted_index(c.frame("documents"), "doc_id", "text", {"lang": "XL", "source": "XS"})


@query("""WITH s AS (SELECT doc_id, md5(text || CASE WHEN n_chars % 5 = 0 THEN 'x' ELSE '' END) AS h FROM documents WHERE n_chars % 7 <> 0 UNION ALL SELECT -1, 'gone')
SELECT status, count(*) AS n FROM (SELECT CASE WHEN s.h IS NULL THEN 'generated' ELSE 'reused' END AS status FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id AND s.h = md5(d.text)) GROUP BY ALL
UNION ALL SELECT 'stale', count(*) FROM s WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = s.doc_id AND md5(d.text) = s.h)""")
def embedding_reuse(c):
    d = c.frame("documents")
    wanted = d.select("doc_id", F.md5("text").alias("hash"))
    changed = F.concat("text", F.when(F.col("n_chars") % 5 == 0, "x").otherwise(""))
    held = d.filter("n_chars % 7 <> 0").select("doc_id", F.md5(changed).alias("hash"))
    gone = d.sparkSession.createDataFrame([(-1, "gone")], "doc_id long, hash string")
    return retrieval.reuse_counts(wanted, held.unionByName(gone).withColumn("embedding", F.array(F.lit(1.0))), ["doc_id", "hash"])


@query(f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {AXIS}::DOUBLE[]), 6) AS score FROM embeddings WHERE list_cosine_similarity(embedding::DOUBLE[], {AXIS}::DOUBLE[]) >= 0.05 ORDER BY vec_id LIMIT 1")
def duplicate_check(c):
    return retrieval.first_duplicate(c.frame("embeddings"), AXIS, 0.05).withColumn("score", F.round("score", 6))


@query("""WITH f AS (SELECT item_id FROM benchmark WHERE contains(lower(item_id || ' ' || text), 'thou')), t AS (SELECT count(*) AS total FROM f)
SELECT item_id, total, total > 15 AS has_more FROM (SELECT item_id FROM f ORDER BY item_id LIMIT 10 OFFSET 5), t""")
def qa_list(c):
    found = c.frame("benchmark").filter(F.contains(F.lower(F.concat_ws(" ", "item_id", "text")), F.lit("thou"))).select("item_id")
    return retrieval.page_of(found, ["item_id"], 5, 10)


@query("SELECT doc_id, 1 AS version, 'create' AS action FROM documents UNION ALL SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN 2 ELSE 3 END, 'update' FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 2, 'delete' FROM documents WHERE n_chars % 2 = 1")
def history_versions(c):
    d = c.frame("documents")
    created = changes.with_history(d.sparkSession.createDataFrame([], "doc_id long, version int, action string"), d.select("doc_id"), "doc_id", "create")
    removed = changes.with_history(created, d.filter("n_chars % 2 = 1").select("doc_id"), "doc_id", "delete")
    return changes.with_history(removed, d.filter("lang = 'en'").select("doc_id"), "doc_id", "update")


@query("WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), u AS (SELECT doc_id, unnest(l) AS content, generate_subscripts(l, 1) AS page FROM p), t AS (SELECT doc_id, page, trim(regexp_replace(content, '^\\s*Page\\s+[0-9]+:\\s*', ''), ' ') AS content FROM u) SELECT doc_id, CAST(page AS INTEGER) AS page, content FROM t WHERE content <> ''")
def chunk_pages(c):
    return documents.pages(c.frame("documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\f"))), "doc_id", "text")


@query("SELECT user_id, event_type AS sheet, event_id AS row, 'Row ' || event_id || ': ' || value AS content FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL")
def chunk_rows(c):
    lines = F.concat(F.lit("Sheet: "), "event_type", F.lit("\nRow "), "event_id", F.lit(": "), F.col("value").cast("string"))
    return documents.sheet_rows(c.frame("events").select("user_id", lines.alias("text")), "user_id", "text")


@query("SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(regexp_replace(url, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda t: length(t) >= 2))), ',') AS parts, " + safe_sql("url") + " AS term, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS meta FROM pages")
def url_terms(c):
    u = F.col("url")
    return c.frame("pages").select("page_id", F.array_join(T.word_parts(u), ",").alias("parts"), T.safe_term(u).alias("term"), T.metadata_key(u).alias("meta"))


@query(f"SELECT item_id, array_to_string(list_filter(string_split({plain_sql('lower(text)')}, ' '), lambda w: strlen(w) >= 2 AND NOT list_contains({QUESTION_SQL}, w)), ' ') AS words, {plain_sql('text')} AS plain FROM benchmark")
def plain_texts(c):
    words = F.filter(F.split(T.plain_words(F.lower("text")), " "), lambda t: (F.octet_length(t) >= 2) & ~t.isin(*T.QUESTION_WORDS))
    return c.frame("benchmark").select("item_id", F.array_join(words, " ").alias("words"), T.plain_words(F.col("text")).alias("plain"))


@query("""WITH b AS (SELECT item_id, unnest(string_split(lower(text), chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM benchmark),
p AS (SELECT item_id, line, unnest(list_filter(range(0, length(l)), lambda i: substr(l, CAST(i AS INTEGER) + 1, 3) = 'aha')) AS place FROM b) SELECT item_id, CAST(line AS INTEGER) AS line, CAST(place AS INTEGER) AS place FROM p""")
def match_places(c):
    return c.frame("benchmark").select("item_id", F.explode(T.match_places(F.col("text"), "aha")).alias("x")).select("item_id", "x.line", "x.place")


@query("SELECT item_id, lower(hex(CAST(list_reduce(list_prepend(5381::HUGEINT, list_transform(range(0, strlen(text)), lambda i: CAST('0x' || substr(hex(encode(text)), CAST(2 * i + 1 AS INTEGER), 2) AS HUGEINT))), lambda h, b: (h * 33 + b) % 18446744073709551616::HUGEINT) AS UBIGINT))) AS hash FROM benchmark")
def qa_hash(c):
    return c.frame("benchmark").select("item_id", T.shift_add_hash(F.col("text")).alias("hash"))


@query("SELECT json_object('n_nationkey', CAST(n_nationkey AS VARCHAR), 'n_name', n_name, 'n_regionkey', CAST(n_regionkey AS VARCHAR))::VARCHAR AS row FROM nation")
def json_rows(c):
    return c.frame("nation").select(F.to_json(F.struct(*(F.col(n).cast("string").alias(n) for n in ("n_nationkey", "n_name", "n_regionkey")))).alias("row"))


@query(f"SELECT doc_id, array_to_string(list_distinct({NAMES}), ',') <> '' AS has_names, CASE WHEN regexp_matches(text, '[А-я]') THEN 'russian' ELSE 'english' END AS stemmer FROM documents")
def document_kinds(c):
    return c.frame("documents").select("doc_id", (F.size(T.identifiers(F.col("text"))) > 0).alias("has_names"), T.language_of(F.col("text")).alias("stemmer"))
