"""The library's queries over the test tables, each with equivalent SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import analytics, changes, documents, keyed, schemas, search, shared, vector_index
from ..streaming import limits
from . import retrieval_queries, search_queries  # noqa: F401  they register their queries
from .registry import LIMITED, NAMES, QUERIES, SQL, TF, TOKENS, query  # noqa: F401
from .table import Policy, Table, from_json, from_url

POLICY = Policy({"orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")}, 10, 25)


@query("""SELECT n_name AS n_name, c_mktsegment AS c_mktsegment, round(sum(l_extendedprice), 2) AS revenue, count(*) AS lines
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY ALL HAVING sum(l_extendedprice) > 10000 ORDER BY revenue DESC, n_name, c_mktsegment LIMIT 100""")
def revenue_by_nation(c):
    q = Table.of(c, "lineitem").filter(l_shipdate__gte="1995-01-01").group_by("orders.customer.nation.n_name", "orders.customer.c_mktsegment")
    df = q.values("SUM(l_extendedprice) as revenue", "COUNT(*) as lines").having("revenue > 10000").frame_of()
    return df.withColumn("revenue", F.round("revenue", 2)).orderBy(F.desc("revenue"), "n_name", "c_mktsegment").limit(100)


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment FROM customer")
def select_fields(c):
    return Table.of(c, "customer").values("c_custkey as id", "c_name as name", "c_mktsegment").frame_of()


@query("SELECT * FROM nation")
def select_all(c):
    return Table.of(c, "nation").frame_of()


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 30 AND l_discount < 0.05 AND l_returnflag <> 'N'")
def filter_compare(c):
    return Table.of(c, "lineitem").filter(l_quantity__gte=30, l_discount__lt=0.05, l_returnflag__ne="N").values("l_orderkey", "l_linenumber", "l_quantity").frame_of()


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'P')")
def filter_in(c):
    return Table.of(c, "orders").filter(o_orderstatus__in=["O", "P"]).values("o_orderkey", "o_orderstatus").frame_of()


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND p_brand LIKE 'Brand%'")
def filter_like(c):
    return Table.of(c, "part").filter(p_name__like="%a%", p_brand__like="Brand%").values("p_partkey", "p_name").frame_of()


@query("SELECT p_partkey, p_size FROM part WHERE (p_size > 40 OR p_retailprice <= 950.5) AND p_type <> 'x' OR p_size = 1")
def filter_bool_tree(c):
    return Table.of(c, "part").filter("(p_size > 40 | p_retailprice__lte=950.5) & p_type != 'x' | p_size = 1").values("p_partkey", "p_size").frame_of()


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-06-01' AND o_orderdate < TIMESTAMP '1996-07-01'")
def filter_date_literal(c):
    return Table.of(c, "orders").filter("o_orderdate >= '1996-06-01' & o_orderdate < '1996-07-01'").values("o_orderkey", "o_orderdate").frame_of()


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000")
def join_inner_raw(c):
    return Table.of(c, "orders").join("customer", "o_custkey", "c_custkey").filter(o_totalprice__gt=100000).values("o_orderkey", "c_name").frame_of()


@query("SELECT n_name AS n_name, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY ALL")
def join_left_reverse(c):
    return Table.of(c, "nation").group_by("n_name").values("COUNT(customer.c_custkey) as customers").frame_of()


@query("SELECT o_orderkey, c_custkey FROM (SELECT * FROM orders WHERE o_totalprice > 200000) RIGHT JOIN customer ON o_custkey = c_custkey")
def join_right(c):
    return Table.of(c, "orders").filter(o_totalprice__gt=200000).join("customer", "o_custkey", "c_custkey", "right").values("o_orderkey", "c_custkey").frame_of()


@query("SELECT s_suppkey, n_name FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) FULL JOIN nation ON s_nationkey = n_nationkey")
def join_full(c):
    return Table.of(c, "supplier").filter(s_acctbal__gt=5000).join("nation", "s_nationkey", "n_nationkey", "full").values("s_suppkey", "n_name").frame_of()


@query("""SELECT r_name AS r_name, l_returnflag, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def join_fk_path(c):
    return Table.of(c, "lineitem").group_by("orders.customer.nation.region.r_name", "l_returnflag").values("COUNT(*) as lines").frame_of()


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def join_semi_exists(c):
    return c.frame("customer").join(c.frame("orders").filter("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def join_anti_notin(c):
    return c.frame("documents").join(c.frame("labels"), "doc_id", "left_anti").select("doc_id")


@query("""SELECT l_returnflag, count(l_orderkey) AS n, round(sum(l_quantity), 2) AS total, round(avg(l_discount), 6) AS mean, min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM lineitem GROUP BY ALL""")
def agg_five(c):
    df = Table.of(c, "lineitem").group_by("l_returnflag").values("COUNT(l_orderkey) as n", "SUM(l_quantity) as total", "AVG(l_discount) as mean", "MIN(l_extendedprice) as least", "MAX(l_extendedprice) as most").frame_of()
    return df.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 6)})


@query("SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY ALL HAVING count(*) >= 12 OR max(o_totalprice) > 400000")
def agg_having(c):
    return Table.of(c, "orders").group_by("o_custkey").values("COUNT(*) as n", "MAX(o_totalprice) as most").having("n >= 12 | most > 400000").frame_of()


@query("SELECT count(DISTINCT o_custkey) AS customers, count(*) AS n FROM orders")
def agg_distinct(c):
    return Table.of(c, "orders").values("COUNT(DISTINCT o_custkey) as customers", "COUNT(*) as n").frame_of()


@query("SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment <> ''")
def distinct_values(c):
    return c.frame("customer").filter("c_mktsegment <> ''").select("c_mktsegment").distinct()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topk_limit(c):
    return Table.of(c, "orders").order_by("-o_totalprice", "o_orderkey").limit(20).frame_of().select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 30")
def page_offset(c):
    return Table.of(c, "orders").values("o_orderkey").order_by("o_orderkey ASC").offset(30).limit(10).frame_of()


@query("SELECT p_partkey, p_name FROM part ORDER BY CASE WHEN lower(p_name) LIKE 's%' THEN 0 ELSE 1 END, lower(p_name), p_partkey LIMIT 50")
def order_case_prefix(c):
    first = F.when(F.lower("p_name").like("s%"), 0).otherwise(1)
    return c.frame("part").orderBy(first, F.lower("p_name"), "p_partkey").limit(50).select("p_partkey", "p_name")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000 ORDER BY o_totalprice, o_orderkey LIMIT 25")
def dsl_json(c):
    return from_json(c, {"table": "orders", "query": {"fields": ["o_orderkey", "o_totalprice"], "where": [{"field": "o_orderstatus", "op": "eq", "value": "F"}, {"field": "o_totalprice", "op": "gt", "value": 1000}], "order_by": ["o_totalprice ASC", "o_orderkey ASC"], "limit": 500}}, POLICY)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 5000 ORDER BY o_orderkey LIMIT 7")
def dsl_url(c):
    return from_url(c, "/q?query=(table:[orders];fields:[o_orderkey,o_orderstatus];filter:[o_orderstatus='O',o_totalprice>=5000];order_by:[o_orderkey ASC];limit:[7])", POLICY)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10")
def allowlist_clamp(c):
    return from_json(c, {"table": "orders", "fields": ["o_orderkey"], "order_by": ["o_orderkey ASC"]}, POLICY)


def answered():
    return F.col("event_type") != "error"


@query("SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS answered, count(*) FILTER (event_type = 'error') AS unanswered, round(100.0 * count(*) FILTER (event_type <> 'error') / count(*), 4) AS answer_rate, round(avg(value), 4) AS avg_ms FROM events")
def report_counters(c):
    return analytics.counters(c.frame("events"), answered(), F.col("value"))


@query("WITH v AS (SELECT CAST(trunc(value) AS BIGINT) AS v FROM events WHERE value IS NOT NULL), r AS (SELECT v, row_number() OVER (ORDER BY v) AS i, count(*) OVER () AS n FROM v) SELECT CAST(floor((max(v) FILTER (i = (n + 1) // 2) + max(v) FILTER (i = n // 2 + 1)) / 2.0) AS BIGINT) AS median_ms FROM r")
def report_median(c):
    return analytics.median(c.frame("events"), F.col("value"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY ALL ORDER BY n DESC, user_id LIMIT 20")
def report_topn(c):
    return analytics.top(c.frame("events"), "user_id")


@query("SELECT user_id, count(*) AS n, max(ts) AS last_ts FROM events WHERE event_type = 'error' GROUP BY ALL")
def report_missing(c):
    return analytics.missing(c.frame("events"), "user_id", answered())


@query("SELECT user_id, count(*) AS n, max(ts) AS last_ts FROM events WHERE event_type = 'error' GROUP BY ALL HAVING count(*) >= 3")
def report_gaps(c):
    return analytics.missing(c.frame("events"), "user_id", answered(), 3)


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS missing FROM events GROUP BY ALL),
s AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d) SELECT s.day AS day, coalesce(n, 0) AS n, coalesce(missing, 0) AS missing FROM s LEFT JOIN d USING (day)""")
def report_daily(c):
    return analytics.daily(c.frame("events"), answered())


@query("SELECT count(*) AS total, count(*) FILTER (event_type IN ('purchase', 'signup')) AS helpful, count(*) FILTER (event_type IN ('error')) AS not_helpful FROM events")
def report_feedback(c):
    return analytics.feedback(c.frame("events"), "event_type", ["purchase", "signup"], ["error"])


@query("""WITH r AS (SELECT value AS v FROM events ORDER BY ts DESC, event_id DESC LIMIT 1024), k AS (SELECT v, row_number() OVER (ORDER BY v NULLS FIRST) AS i, count(*) OVER () AS n FROM r)
SELECT round(max(v) FILTER (i = ceil(50 * (n - 1) / 100.0) + 1), 4) AS p50, round(max(v) FILTER (i = ceil(95 * (n - 1) / 100.0) + 1), 4) AS p95, round(max(v) FILTER (i = ceil(99 * (n - 1) / 100.0) + 1), 4) AS p99 FROM k""")
def latency_percentiles(c):
    return analytics.percentiles(c.frame("events"), F.col("value"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY ALL")
def category_counts(c):
    return analytics.category_counts(c.frame("documents"), "source")


@query("SELECT lang, count(*) AS n, count(DISTINCT source) AS sources, count(*) FILTER (n_chars > 2000) AS long_docs, CAST(floor(100.0 * count(*) FILTER (n_chars > 2000) / count(*)) AS BIGINT) AS long_share FROM documents GROUP BY ALL")
def article_stats(c):
    long = F.count_if(F.col("n_chars") > 2000)
    return c.frame("documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"), long.alias("long_docs"), F.floor(100 * long / F.count("*")).alias("long_share"))


@query(f"SELECT count(*) AS docs, CAST(sum(length({TOKENS})) AS BIGINT) AS terms, round(avg(length({TOKENS})), 4) AS avg_len FROM documents")
def corpus_stats(c):
    n = F.size(T.tokens(F.col("text")))
    return c.frame("documents").agg(F.count("*").alias("docs"), F.sum(n).alias("terms"), F.round(F.avg(n), 4).alias("avg_len"))


@query(f"SELECT doc_id, CAST(length({TOKENS}) AS INTEGER) AS n_tokens, md5(array_to_string({TOKENS}, ' ')) AS digest FROM documents")
def corpus_tokens(c):
    t = T.tokens(F.col("text"))
    return c.frame("documents").select("doc_id", F.size(t).alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("digest"))


@query(f"WITH {TF} SELECT term, count(*) AS df FROM tf GROUP BY ALL")
def doc_frequency(c):
    return search.document_frequency(c.frame("documents"), "text")


@query(f"WITH {TF}, d AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL) SELECT term, round(ln(((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5) + 1.0), 6) AS idf FROM d")
def idf(c):
    n = c.frame("documents").agg(F.count("*").alias("n"))
    return search.document_frequency(c.frame("documents"), "text").join(F.broadcast(n)).select("term", F.round(search.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query(f"SELECT doc_id, array_to_string({NAMES}, ',') AS names FROM documents WHERE length({NAMES}) > 0")
def identifiers(c):
    names = T.identifiers(F.col("text"))
    return c.frame("documents").filter(F.size(names) > 0).select("doc_id", F.array_join(names, ",").alias("names"))



@query(f"""WITH {TF}, l AS (SELECT doc_id, length({TOKENS}) + 2.0 * length({NAMES}) AS len, length({TOKENS}) + 3.0 * length({NAMES}) AS weight FROM documents),
w AS (SELECT count(*) AS n, avg(weight) AS a FROM l), h AS (SELECT * FROM tf WHERE term IN ('that', 'for', 'thth', 'eran', 'onan', 'und', 'der', 'les')), d AS (SELECT term, count(*) AS df FROM h GROUP BY ALL)
SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / a))), 6) AS score FROM h JOIN d USING (term) JOIN l USING (doc_id), w GROUP BY doc_id HAVING sum(ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / a))) > 0.1""")
def bm25_scores(c):
    return search.bm25(c.frame("documents"), "doc_id", "text", ["that", "for", "thth", "eran", "onan", "und", "der", "les"]).withColumn("score", F.round("score", 6))


AXIS = [1.0 if i % 2 == 0 else -0.5 for i in range(64)]
AXIS_SQL = "[" + ",".join(map(str, AXIS)) + "]::DOUBLE[]"
DISTANCE = f"list_sum(list_transform(list_zip(embedding, {AXIS_SQL}), lambda x: (x[1]::DOUBLE - x[2]) * (x[1]::DOUBLE - x[2])))"


@query(f"SELECT vec_id, round({DISTANCE}, 4) AS distance, round(1 / (1 + {DISTANCE}), 6) AS score FROM embeddings WHERE len(embedding) = 64 ORDER BY {DISTANCE}, vec_id LIMIT 10")
def knn_l2(c):
    return search.nearest(c.frame("embeddings"), AXIS, 10)


@query(f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {AXIS_SQL}), 6) AS cos FROM embeddings")
def cosine_scores(c):
    return c.frame("embeddings").select("vec_id", F.round(V.cosine(F.col("embedding"), V.vector(AXIS)), 6).alias("cos"))


@query("SELECT b.vec_id, min(a.vec_id) AS first_id FROM embeddings a JOIN embeddings b ON b.vec_id % 20 = 0 AND a.vec_id < b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.5 GROUP BY ALL")
def semantic_duplicates(c):
    vectors = c.frame("embeddings")
    return search.earlier_duplicates(vectors, 0.5, vectors.filter("vec_id % 20 = 0"))


@query("""WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.5),
r AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, e.b FROM r JOIN e ON r.other = e.a),
n AS (SELECT a AS vec_id, count(*) AS links FROM e GROUP BY ALL)
SELECT vec_id, min(other) AS class_id, coalesce(any_value(links), 0) AS links FROM r LEFT JOIN n USING (vec_id) GROUP BY vec_id""")
def semantic_classes(c):
    """Every row is judged, not only the query set of semantic_duplicates."""
    return search.similar_classes(c.frame("embeddings"), 0.5)


KNN_ALL = """WITH d AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) AS d FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND len(q.embedding) = len(v.embedding)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS INTEGER) AS rank FROM d) SELECT query_id, vec_id, rank, round(d, 4) AS distance, round(1 / (1 + d), 6) AS score FROM r WHERE rank <= 10"""


@query(KNN_ALL)
def knn_l2_all(c):
    """All queries (ids divisible by 20) against all rows."""
    vectors = c.frame("embeddings")
    return search.nearest_many(vectors, vectors.filter("vec_id % 20 = 0"), 10)


@query(KNN_ALL)
def knn_indexed(c):
    """The same queries against an index that was stored before: blocks in a folder a cell, read as far as the triangle inequality asks for."""
    vectors = c.frame("embeddings")
    path = f"{shared.folder(vectors.sparkSession)}/index-{shared.uuid.uuid4().hex}"
    vector_index.save_cells(vectors, path)
    return vector_index.search_cells(vectors.sparkSession, path, vectors.filter("vec_id % 20 = 0"), 10)


@query(f"""WITH v AS (SELECT vec_id AS doc_id, 1 / (1 + {DISTANCE}) AS s FROM embeddings), t AS (SELECT doc_id, n_chars / 1000.0 AS s FROM documents WHERE lang = 'en'),
m AS (SELECT coalesce(v.doc_id, t.doc_id) AS doc_id, 0.6 * coalesce(v.s / (SELECT max(s) FROM v), 0) + 0.4 * coalesce(t.s / (SELECT max(s) FROM t), 0) AS score FROM v FULL JOIN t ON v.doc_id = t.doc_id)
SELECT doc_id, round(score, 5) AS score FROM m WHERE score >= 0.1""")
def hybrid_fuse(c):
    v = c.frame("embeddings").select(F.col("vec_id").alias("doc_id"), V.score_of(V.squared_distance(F.col("embedding"), V.vector(AXIS))).alias("score"))
    t = c.frame("documents").filter("lang = 'en'").select("doc_id", (F.col("n_chars") / 1000.0).alias("score"))
    return search.fused(v, t, "doc_id").withColumn("score", F.round("score", 5))


@query("SELECT doc_id, round(max(s), 6) AS score FROM (SELECT doc_id, n_chars / 100.0 AS s FROM documents WHERE text LIKE '%that%' UNION ALL SELECT doc_id, 0.97 * n_chars / 100.0 FROM documents WHERE text LIKE '%the%' UNION ALL SELECT doc_id, 0.94 * n_chars / 90.0 FROM documents WHERE lang = 'de') GROUP BY ALL")
def multi_query_union(c):
    d = c.frame("documents")
    side = lambda cond, n: d.filter(cond).select("doc_id", (F.col("n_chars") / n).alias("score"))
    return search.best_of([(side("text LIKE '%that%'", 100.0), 1.0), (side("text LIKE '%the%'", 100.0), 0.97), (side("lang = 'de'", 90.0), 0.94)], "doc_id").withColumn("score", F.round("score", 6))


@query("SELECT md5(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY ALL")
def exact_dedup(c):
    return documents.first_of_equal(c.frame("documents"), "doc_id", "text")


WORDS_SQL = "list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"


@query(f"""WITH w AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents), s AS (SELECT doc_id, w, unnest(generate_series(0, greatest(0, len(w) - 41), 180)) AS start FROM w WHERE len(w) > 0)
SELECT doc_id, CAST(start // 180 AS INTEGER) AS chunk, CAST(start AS INTEGER) AS start, CAST(len(w[start + 1 : start + 220]) AS INTEGER) AS n_tokens, md5(array_to_string(w[start + 1 : start + 220], ' ')) AS digest FROM s""")
def chunk_plain(c):
    return documents.chunk_plain(c.frame("documents"), "doc_id", "text")


HEADING = r"^\s{0,3}#{1,6}\s+\S|^[A-Z][^.]*\.\z"


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\\n\\z', ''), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '\\n\\z', ''), chr(10)), 1) AS i FROM documents WHERE text <> ''),
h AS (SELECT *, regexp_matches(line, '{HEADING}') AS head, coalesce(bool_or(trim(line, ' ') <> '') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS led FROM l),
s AS (SELECT *, coalesce(sum(CASE WHEN head AND led THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i), 0) AS section FROM h)
SELECT doc_id, CAST(section AS INTEGER) AS section, CAST(min(i) - 1 AS INTEGER) AS start, coalesce(min_by(line, i) FILTER (head), min_by(line, i)) AS title, string_agg(line, chr(10) ORDER BY i) AS content FROM s GROUP BY doc_id, section HAVING trim(string_agg(line, chr(10) ORDER BY i), ' ') <> ''""")
def chunk_sections(c):
    return documents.sections(c.frame("documents"), "doc_id", "text", HEADING)


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1) AS path FROM pages")
def url_locator(c):
    return c.frame("pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/]+([^?#]*)", 1).alias("path"))


def decoded_sql(text):
    for name, c in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&amp;", "'&'")):
        text = f"replace({text}, '{name}', {c})"
    return text


ENTITIES = decoded_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
UNSEEN = "(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<title\\b.*?</title\\s*>|<!--.*?-->"
BREAKS = "(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|header|footer|nav)\\b[^>]*>"
BODY = decoded_sql(f"regexp_replace(regexp_replace(regexp_replace(html, '{UNSEEN}', ' ', 'g'), '{BREAKS}', chr(10), 'g'), '<[^>]*>', ' ', 'g')")
COLLAPSED = "trim(regexp_replace({0}, '[\\x09-\\x0D\\x20]+', ' ', 'g'))"


@query(f"SELECT page_id, {COLLAPSED.format(ENTITIES)} AS title, {COLLAPSED.format(ENTITIES)} || chr(10) || chr(10) || array_to_string(list_filter(list_transform(string_split({BODY}, chr(10)), lambda s: {COLLAPSED.format('s')}), lambda s: s <> ''), chr(10)) AS text FROM pages")
def html_text(c):
    return c.frame("pages").select("page_id", T.html_title(F.col("html")).alias("title"), T.html_text(F.col("html")).alias("text"))


@query(f"SELECT page_id, trim(regexp_replace({ENTITIES}, '[\\x09-\\x0D\\x20]+', ' ', 'g')) AS title FROM pages")
def html_title(c):
    return c.frame("pages").select("page_id", T.html_title(F.col("html")).alias("title"))


@query("SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS INTEGER) AS back FROM conversations WHERE role IN ('user', 'assistant') QUALIFY back <= 6")
def history_block(c):
    return documents.last_turns(c.frame("conversations")).select("conv_id", "turn", "role", "back")


@query("WITH t AS (SELECT doc_id, length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) AS hi, strlen(text) AS b FROM documents) SELECT doc_id, greatest(CAST(floor((b - hi) / 4.0) + floor(hi / 3.0) AS BIGINT), 1) AS tokens FROM t")
def token_estimate(c):
    return c.frame("documents").select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"))


@query("SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS lines FROM documents")
def line_counts(c):
    return c.frame("documents").select("doc_id", T.line_count(F.col("text")).cast("long").alias("lines"))


@query("SELECT item_id, text FROM benchmark WHERE text ILIKE '%that%' OR text ILIKE '%tion%' ORDER BY item_id DESC LIMIT 50")
def qa_search(c):
    return c.frame("benchmark").filter(F.col("text").ilike("%that%") | F.col("text").ilike("%tion%")).orderBy(F.desc("item_id")).limit(50)


@query("SELECT item_id, CASE WHEN contains(lower(text), 'that') THEN 1.0::DOUBLE ELSE greatest(0.35::DOUBLE, round(0.98::DOUBLE - 0.04::DOUBLE * item_id, 6)) END AS score FROM benchmark")
def qa_score(c):
    return c.frame("benchmark").select("item_id", F.round(search.answer_score(F.col("text"), F.lit(""), "that", F.col("item_id")), 6).alias("score"))


@query("SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents UNION ALL SELECT doc_id + 1000000, lang, n_chars FROM documents WHERE doc_id % 3 = 1")
def upsert(c):
    old = c.frame("documents").select("doc_id", "lang", "n_chars")
    new = old.filter("doc_id % 3 = 0").withColumn("n_chars", F.col("n_chars") + 1).unionByName(old.filter("doc_id % 3 = 1").withColumn("doc_id", F.col("doc_id") + 1000000))
    return changes.upsert(old, new, "doc_id")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 7 THEN 'seven' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 50 <> 8 UNION ALL SELECT -o_orderkey, 'new' FROM orders WHERE o_orderkey % 50 = 9")
def keyed_changes(c):
    """A stored table after an update, a removal and an upsert, each of which rewrote only the parts that it touched."""
    orders = c.frame("orders").select("o_orderkey", "o_orderstatus")
    path = f"{shared.folder(orders.sparkSession)}/orders-{shared.uuid.uuid4().hex}"
    table = keyed.KeyedTable.create(orders, path, "o_orderkey", 16)
    table.update(F.col("o_orderkey") % 50 == 7, {"o_orderstatus": F.lit("seven")})
    table.remove(F.col("o_orderkey") % 50 == 8)
    table.upsert(orders.filter("o_orderkey % 50 = 9").select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit("new").alias("o_orderstatus")))
    return table.read()


@query("SELECT doc_id, lang FROM documents WHERE lang <> 'de' UNION ALL SELECT doc_id, 'new' FROM documents WHERE lang = 'de'")
def insert_ignore(c):
    d = c.frame("documents").select("doc_id", "lang")
    return changes.insert_ignore(d.filter("lang <> 'de'"), d.withColumn("lang", F.lit("new")), "doc_id")


@query("SELECT d.doc_id FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels)")
def stale_delete(c):
    return changes.drop_stale(c.frame("documents").select("doc_id"), c.frame("labels"), "doc_id")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_rows(c):
    return changes.update(c.frame("customer").select("c_custkey", "c_mktsegment", "c_acctbal"), F.col("c_acctbal") < 0, {"c_mktsegment": F.lit("debt")}).drop("c_acctbal")


@query("SELECT c_custkey FROM customer WHERE NOT coalesce(c_acctbal < 0, false)")
def delete_rows(c):
    return changes.remove(c.frame("customer"), F.col("c_acctbal") < 0).select("c_custkey")


PLAN = (("TableAdded", "part", None), ("ColumnAdded", "nation", "n_code"), ("ColumnTypeChanged", "region", "r_regionkey"), ("ColumnOnlyInCurrent", "nation", "n_name"), ("TableOnlyInCurrent", "orders", None))
PLAN_SQL = ", ".join(f"('{k}', '{t}', {'NULL' if n is None else repr(n)})" for k, t, n in PLAN)


@query(f"""WITH d(change, tbl, col) AS (VALUES {PLAN_SQL}), r AS (SELECT *, CASE change WHEN 'TableAdded' THEN 'Safe' WHEN 'ColumnTypeChanged' THEN 'ManualReview' WHEN 'ColumnAdded' THEN 'Warning' ELSE 'Destructive' END AS risk,
CASE change WHEN 'TableAdded' THEN 10 WHEN 'ColumnAdded' THEN 40 WHEN 'ColumnTypeChanged' THEN 60 WHEN 'ColumnOnlyInCurrent' THEN 200 ELSE 280 END AS place FROM d)
SELECT change, tbl, col, risk, CASE risk WHEN 'Destructive' THEN 'RequiresConfirmation' WHEN 'ManualReview' THEN 'ManualReviewRequired' ELSE 'Allowed' END AS decision, CAST(row_number() OVER (ORDER BY place, tbl) AS INTEGER) AS step FROM r""")
def schema_plan(c):
    spark = c.frame("nation").sparkSession
    now = {n: c.frame(n).schema for n in ("nation", "region", "orders")}
    wanted = {"nation": c.frame("nation").drop("n_name").withColumn("n_code", F.lit(1)).schema, "region": c.frame("region").withColumn("r_regionkey", F.col("r_regionkey").cast("long")).schema, "part": c.frame("part").schema}
    return schemas.plan(schemas.difference(schemas.catalog_rows(spark, wanted), schemas.catalog_rows(spark, now)))


WANTED = (
    ("table", "orders", "", {}), ("column", "orders", "id", {"type": "bigint", "nullable": "false"}), ("column", "orders", "note", {"type": "string", "nullable": "true"}),
    ("column", "orders", "total", {"type": "double", "nullable": "false", "defaultValue": "0"}), ("index", "orders", "by_total", {"columns": "total,id"}), ("foreign_key", "orders", "customer", {"target": "customer.id"}),
    ("table", "customer", "", {}), ("column", "customer", "id", {"type": "bigint", "nullable": "false"}), ("view", "big_orders", "", {"definition": "SELECT 1"}),
)
CURRENT = (
    ("table", "orders", "", {}), ("column", "orders", "id", {"type": "int", "nullable": "false"}), ("column", "orders", "old", {"type": "int", "nullable": "true"}), ("column", "orders", "total", {"type": "double", "nullable": "true"}),
    ("index", "orders", "by_total", {"columns": "total"}), ("table", "gone", "", {}), ("column", "gone", "id", {"type": "int", "nullable": "true"}), ("view", "big_orders", "", {"definition": "SELECT 2"}), ("sequence", "numbers", "", {"start": "1"}),
)


def values_sql(rows):
    lit = lambda v: "NULL" if v is None else f"'{v}'"
    return "VALUES " + ", ".join(f"({', '.join(map(lit, (*at, p, v)))})" for *at, props in rows for p, v in [(None, None), *props.items()])


@query(f"""WITH w(object, tbl, name, property, v) AS ({values_sql(WANTED)}), c(object, tbl, name, property, v) AS ({values_sql(CURRENT)}),
wo AS (SELECT object, tbl, name FROM w WHERE property IS NULL), co AS (SELECT object, tbl, name FROM c WHERE property IS NULL),
lone AS (SELECT *, 'Added' AS change FROM wo ANTI JOIN co USING (object, tbl, name) UNION ALL SELECT *, 'OnlyInCurrent' FROM co ANTI JOIN wo USING (object, tbl, name)),
met AS (SELECT * FROM wo SEMI JOIN co USING (object, tbl, name)),
p AS (SELECT object, tbl, name, property, w.v AS wanted, c.v AS current FROM (SELECT * FROM w WHERE property IS NOT NULL) w FULL JOIN (SELECT * FROM c WHERE property IS NOT NULL) c USING (object, tbl, name, property)),
a AS (SELECT object, tbl, name, change, NULL::VARCHAR AS property, NULL::VARCHAR AS wanted FROM lone l WHERE object <> 'column' OR NOT EXISTS (SELECT 1 FROM lone t WHERE t.object = 'table' AND t.tbl = l.tbl AND t.change = l.change)
UNION ALL SELECT object, tbl, name, 'Changed', property, wanted FROM p JOIN met USING (object, tbl, name) WHERE wanted IS DISTINCT FROM current),
r AS (SELECT object, tbl, name, change, property, CASE WHEN object = 'sequence' THEN 'Unsupported' WHEN change = 'Added' THEN CASE WHEN object IN ('table', 'index', 'view') THEN 'Safe' ELSE 'Warning' END
WHEN change = 'OnlyInCurrent' THEN CASE WHEN object = 'index' THEN 'Warning' ELSE 'Destructive' END WHEN object <> 'column' THEN 'Warning'
WHEN property = 'type' OR property = 'nullable' AND wanted = 'false' THEN 'ManualReview' WHEN property = 'defaultValue' THEN 'Safe' ELSE 'Warning' END AS risk FROM a)
SELECT *, CASE risk WHEN 'Destructive' THEN 'RequiresConfirmation' WHEN 'ManualReview' THEN 'ManualReviewRequired' WHEN 'Unsupported' THEN 'Unsupported' ELSE 'Allowed' END AS decision FROM r""")
def schema_objects(c):
    spark = c.frame("nation").sparkSession
    wanted, current = (spark.createDataFrame(list(rows), "object string, tbl string, name string, properties map<string,string>") for rows in (WANTED, CURRENT))
    return schemas.object_plan(schemas.object_changes(wanted, current)).select("object", "tbl", "name", "change", "property", "risk", "decision")


@query(f"WITH RECURSIVE {LIMITED} SELECT event_id, user_id, allowed FROM decisions")
def rate_limit(c):
    return limits.limited(c.frame("events"), "user_id", 1, 20)


CASCADE = (limits.Stage("global_second", 1, limits.SECOND, False), limits.Stage("global_minute", 1, limits.MINUTE, False), limits.Stage("key_hour", 1, 60 * limits.MINUTE, True), limits.Stage("key_day", 3, 1440 * limits.MINUTE, True))


def stage_sql(i: int, name: str, limit: int, window: int, keyed: bool) -> str:
    """p{i + 1}: what passes stage i of p{i}; r{i}: the decisions. Stretches between empty windows go side by side, an event a step."""
    own = "key, " if keyed else ""
    by = "PARTITION BY key ORDER BY" if keyed else "ORDER BY"
    return f"""o{i} AS MATERIALIZED (SELECT event_id, key, us, dense_rank() OVER (ORDER BY {own}stretch) AS s, row_number() OVER (PARTITION BY {own}stretch ORDER BY us, event_id) AS k
FROM (SELECT *, sum(new) OVER ({by} us, event_id) AS stretch FROM (SELECT *, CASE WHEN us // {window} - lag(us // {window}) OVER ({by} us, event_id) > 1 THEN 1 ELSE 0 END AS new FROM p{i}))),
r{i} AS (SELECT s, 0::BIGINT AS k, CAST([] AS BIGINT[]) AS held, NULL::BIGINT AS event_id, NULL::BIGINT AS key, NULL::BIGINT AS us, NULL::BOOLEAN AS ok FROM (SELECT DISTINCT s FROM o{i})
UNION ALL SELECT s, k, CASE WHEN ok THEN list_append(held, us) ELSE held END, event_id, key, us, ok FROM
(SELECT o.s, o.k, list_filter(r.held, lambda x: x >= o.us - {window}) AS held, o.event_id, o.key, o.us, len(list_filter(r.held, lambda x: x >= o.us - {window})) < {limit} AS ok FROM r{i} r JOIN o{i} o ON o.s = r.s AND o.k = r.k + 1)),
p{i + 1} AS MATERIALIZED (SELECT event_id, key, us FROM r{i} WHERE k > 0 AND ok)"""


CASCADE_SQL = "p0 AS MATERIALIZED (SELECT event_id, user_id AS key, epoch_us(ts) AS us FROM events),\n" + ",\n".join(stage_sql(i, x.name, x.limit, x.window, x.keyed) for i, x in enumerate(CASCADE))
CASCADE_ROWS = " UNION ALL ".join([*(f"SELECT event_id, key AS user_id, '{x.name}' AS decision FROM r{i} WHERE k > 0 AND NOT ok" for i, x in enumerate(CASCADE)), f"SELECT event_id, key, 'allowed' FROM p{len(CASCADE)}"])


@query(f"WITH RECURSIVE {CASCADE_SQL} {CASCADE_ROWS}")
def rate_cascade(c):
    """Limits of all events, then of each user; an event that a user's limit rejects has cost the others."""
    return limits.cascaded(c.frame("events"), "user_id", CASCADE)


@query("SELECT date_trunc('hour', ts) AS start_at, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(c):
    return limits.windowed_counts(c.frame("events")).select(F.col("start").cast("timestamp_ntz").alias("start_at"), "event_type", "n")
