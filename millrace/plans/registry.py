"""Where queries and their SQL are registered, and SQL that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import text as T
from .catalog import Catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Catalog.parquet(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


STOP = "[" + ",".join(f"'{w}'" for w in T.STOP_WORDS if len(w) >= 3) + "]"
TOKENS = f"list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda t: length(t) >= 3 and not list_contains({STOP}, t))"
NAMES = f"list_filter(list_concat(regexp_extract_all(text, '\\b([a-zA-Z_][a-zA-Z0-9_]*)\\s*\\(', 1), regexp_extract_all(text, '\\bclass\\s+([a-zA-Z_][a-zA-Z0-9_]*)', 1)), lambda t: length(t) >= 3 and not list_contains({STOP}, t))"
TF = f"tf AS (SELECT doc_id, term, sum(w) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term, 1.0::DOUBLE AS w FROM documents UNION ALL SELECT doc_id, unnest({NAMES}), 2.0 FROM documents) GROUP BY ALL)"
QUESTION_SQL = "[" + ",".join(f"'{w}'" for w in T.QUESTION_WORDS) + "]"

# one event of every user a step, with the accepted times of the last minute
LIMITED = """e AS MATERIALIZED (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
r AS (SELECT user_id, 0::BIGINT AS k, CAST([] AS BIGINT[]) AS m, NULL::BIGINT AS event_id, NULL::BOOLEAN AS allowed FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT user_id, k, CASE WHEN ok THEN list_append(m, us) ELSE m END, event_id, ok FROM (SELECT e.user_id, e.k, e.us, e.event_id, list_filter(r.m, lambda x: x > e.us - 60000000) AS m,
len(list_filter(r.m, lambda x: x > e.us - 60000000)) < 20 AND len(list_filter(r.m, lambda x: x > e.us - 1000000)) < 1 AS ok FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)),
decisions AS (SELECT event_id, user_id, allowed FROM r WHERE k > 0 UNION ALL SELECT event_id, user_id, NULL FROM events WHERE user_id IS NULL OR ts IS NULL)"""


def plain_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '[\\x09-\\x0D\\x20-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7E]+', ' ', 'g'), ' ')"
