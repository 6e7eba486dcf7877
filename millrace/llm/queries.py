"""One query per operator, with production parameters, over its whole table; and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import align
from .langid import identify
from .lm import score_documents
from .media import media_digest
from .mixing import mix
from .packing import pack
from .phrases import remove_passages
from .pii import detect
from .quality import rules
from .simhash import near_duplicates
from .suffixes import remove_repeats
from .turns import damage, repair
from .warc import read, write


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def aligned_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(table(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), columns=["doc_id", "lang", "source"])


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "pages")), payloads=False)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "copy", "n_tokens", "weight", "position")


def op10_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_passages(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), *aligned_paths())


def op12_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(table(spark, sf_dir, "conversations")))


LANG = r"""(?is)<html\b(?:\s[^>]*?)??\s(?:xml:)?lang\s*=\s*(?:"([^">]*)"|'([^'>]*)'|([^\s"'>]+))"""


def langid_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of web pages: their text with entities decoded, declared markup language (lang or xml:lang of html, the first of them, in any
    case, with either quotes or none), address and host.

    A null or empty page has no text and is rejected, as is one of tags alone; equal pages are judged alike unless their addresses differ; a
    long page is read whole; ties go to the first language by name; an empty table gives no rows.
    """
    from pyspark.sql import functions as F

    from ..functions.text import decoded

    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    declared = F.concat(*(F.regexp_extract("html", LANG, i) for i in (1, 2, 3)))  # one of the three isn't empty
    pages = table(spark, sf_dir, "pages").select("page_id", "url", declared.alias("declared"), decoded(bare).alias("text"))
    return identify(pages, declared="declared", host=None, url="url", columns=["page_id", "declared"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = (op1_pack, op2_media, op3_pii, op4_quality, op5_langid, op6_warc, op7_simhash, op8_suffixes, op9_mixing, op10_phrases, op11_alignment, op12_language_model, op13_turns, langid_pages)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


WORDS = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
DOCS = "SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, " + WORDS.format("coalesce(text, '')") + " AS w FROM documents"

OP4 = f"""WITH d AS ({DOCS}),
x AS (SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 3)),
y AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM x) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM y) GROUP BY ALL),
l AS (SELECT doc_id, host, line, len({WORDS.format('line')}) AS n, regexp_replace(array_to_string({WORDS.format('lower(line)')}, ' '), '[0-9]', '0', 'g') AS k FROM (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS line FROM d)),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE n > 0 GROUP BY ALL),
c AS (SELECT host, k FROM l WHERE n > 0 GROUP BY ALL HAVING count(DISTINCT doc_id) > 20),
lost AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_line_words FROM l JOIN c USING (host, k) WHERE n > 0 GROUP BY ALL),
a AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda q: length(q))), 0) AS BIGINT) AS word_chars,
length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_line_words, 0) AS n_line_words
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN lost USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT *, NOT base_failed AND n_words - n_line_words >= 0.5 * n_words AS kept FROM b"""

OP6 = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) || '00' AS h FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(generate_series(0, 31), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, CAST(5 * k // 4 + 1 AS INT), 3) AS INT) >> CAST(7 - 5 * k % 4 AS INT)) & 31), 1)), '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM q"""

OP8 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, x, unnest(generate_series(0, length(x) // 2 - 50)) AS i FROM d WHERE length(x) >= 100),
k AS (SELECT doc_id, i, md5(substr(x, CAST(2 * i + 1 AS INT), 100)) AS h FROM p),
f AS (SELECT h, min(doc_id) AS first FROM k GROUP BY h HAVING min(doc_id) < max(doc_id)),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM k JOIN f USING (h) WHERE first < doc_id),
s AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM g) GROUP BY doc_id, n),
t AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM s),
u AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS e, string_agg(substr(x, CAST(2 * z + 1 AS INT), CAST(2 * (a - z) AS INT)), '' ORDER BY a) AS kept FROM t JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(x, CAST(2 * coalesce(e, 0) + 1 AS INT)))) AS kept_sha256 FROM d LEFT JOIN u USING (doc_id)"""

OP10 = f"""WITH d AS ({DOCS}),
p AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13),
x AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 12], ' ')) AS h FROM p),
f AS (SELECT h, min(doc_id) AS first FROM x GROUP BY h HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS j FROM x JOIN f USING (h) WHERE first < doc_id),
s AS (SELECT doc_id, list(j) AS js, count(*) AS n FROM g GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(array_to_string(CASE WHEN js IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, generate_series(1, len(w))), lambda z: NOT list_contains(js, z[2])), lambda z: z[1]) END, ' ')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)"""


def _op13() -> str:
    """Damage, faults and the cheapest repair, turn by turn over the four states; a state is nine digits of cost, the audit, chr(1) and the repaired lines."""
    crc = "list_reduce(list_prepend(4294967295, list_transform(range(0, strlen(k)), lambda i: CAST('0x' || substr(hex(encode(k)), CAST(2 * i + 1 AS INT), 2) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"

    def edit(state: str, cost: str, letter: str, line: str) -> str:
        return f"lpad(CAST(CAST(left({state}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({state}, 10, strpos({state}, chr(1)) - 10) || {letter} || substr({state}, strpos({state}, chr(1))) || {line}"

    def kept(state: str, initial: str, role: str) -> str:
        mine = f"left(role, 1) = '{initial}'"
        how = edit(state, f"CASE WHEN {mine} THEN 0 ELSE 3 END + CASE WHEN cut THEN 3 ELSE 0 END", f"CASE WHEN {mine} THEN 'K' ELSE 'R' END", f"CASE WHEN {mine} THEN role ELSE '{role}' END || ':' || text || chr(10)")
        return f"CASE WHEN NOT gone THEN {how} END"

    gone = lambda p: edit(f"s{p}", "4", "'D'", "''")
    system = "CASE WHEN NOT gone AND left(role, 1) = 's' THEN " + edit("s0", "CASE WHEN cut THEN 3 ELSE 0 END", "'K'", "role || ':' || text || chr(10)") + " END"
    user = lambda state: edit(state, "3", "'I'", "'user:' || chr(10)")
    first = "'000000000' || chr(1)"
    start = user(f"({first})")
    return f"""WITH RECURSIVE a AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
b AS (SELECT *, xor({crc}, 4294967295) % 20 AS d FROM a),
c AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(generate_series(1, CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM b),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM c),
f AS MATERIALIZED (SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS open,
coalesce(lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS wrong FROM o),
g AS MATERIALIZED (SELECT *, blank OR again AS gone, open AND NOT blank AND NOT again AS cut FROM f),
r AS (SELECT conv_id, 0::BIGINT AS i, n, {first} AS s0, NULL::VARCHAR AS s1, {start} AS s2, {edit(f"({start})", "3", "'I'", "'assistant:' || chr(10)")} AS s3 FROM (SELECT DISTINCT conv_id, n FROM g)
UNION ALL SELECT conv_id, i, n, s0, s1, s2, least(s3, {edit("s2", "3", "'I'", "'assistant:' || chr(10)")}) AS s3 FROM (SELECT conv_id, i, n, s0, s1, least(s2, {user("s0")}, {user("s1")}, {user("s3")}) AS s2, s3 FROM
(SELECT g.conv_id, g.i, g.n, {gone(0)} AS s0, least({gone(1)}, {system}) AS s1, least({gone(2)}, {kept("s0", "u", "user")}, {kept("s1", "u", "user")}, {kept("s3", "u", "user")}) AS s2, least({gone(3)}, {kept("s2", "a", "assistant")}) AS s3
FROM r JOIN g ON g.conv_id = r.conv_id AND g.i = r.i + 1))),
e AS (SELECT conv_id, least(s0, s3) AS s FROM r WHERE i = n),
t AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (wrong) AS illegal FROM g GROUP BY conv_id)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(left(s, 9) AS BIGINT), 0) AS cost,
coalesce(substr(s, 10, strpos(s, chr(1)) - 10), '') AS audit, sha256(coalesce(regexp_replace(substr(s, strpos(s, chr(1)) + 1), '\\n\\z', ''), '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN t USING (conv_id) LEFT JOIN e USING (conv_id)"""


def oracle_sql() -> dict[str, str]:
    """Tokenizers, XXH64, floating-point evidence, patterns with places and hash permutations have no plain SQL; tests hold brute force against those."""
    return {"op4_quality": OP4, "op6_warc": OP6, "op8_suffixes": OP8, "op10_phrases": OP10, "op13_turns": _op13()}
