"""Reports over a search log: query, ts, has_answer, ms, ..."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import at_ranks


def counters(log: DataFrame, answered: Column, ms: Column) -> DataFrame:
    n, a = F.count("*"), F.count_if(answered)
    return log.agg(n.alias("total"), a.alias("answered"), (n - a).alias("unanswered"), F.round(100 * a / n, 4).alias("answer_rate"), F.round(F.avg(ms), 4).alias("avg_ms"))


def median(log: DataFrame, ms: Column) -> DataFrame:
    """The middle value; of an even number the integer half of the two middle ones' sum."""
    middle = at_ranks(log, ms.cast("long"), [], {"low": lambda n: F.floor((n + 1) / 2) - 1, "high": lambda n: F.floor(n / 2)})
    return middle.select(F.floor((F.col("low") + F.col("high")) / 2).cast("long").alias("median_ms"))


def top(log: DataFrame, key: str, n: int = 20) -> DataFrame:
    return log.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def missing(log: DataFrame, key: str, answered: Column, least: int = 1) -> DataFrame:
    """Unanswered queries with their count and last time; least 3 gives the knowledge gaps."""
    return log.filter(~answered).groupBy(key).agg(F.count("*").alias("n"), F.max("ts").alias("last_ts")).filter(F.col("n") >= least)


def daily(log: DataFrame, answered: Column) -> DataFrame:
    """Every day from the first to the last, also those without an event."""
    days = log.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(~answered).alias("missing"))
    span = log.agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    return span.join(days, "day", "left").fillna(0, ["n", "missing"])


def between(log: DataFrame, start: str | None = None, end: str | None = None, ts: str = "ts") -> DataFrame:
    """Rows from start to end, both inclusive; every report takes what this leaves."""
    if start is not None:
        log = log.filter(F.col(ts) >= F.lit(start).cast(log.schema[ts].dataType))
    return log if end is None else log.filter(F.col(ts) <= F.lit(end).cast(log.schema[ts].dataType))


def kept_days(log: DataFrame, days: int, now: str, ts: str = "ts") -> DataFrame:
    """Rows of the last so many days before now."""
    return log.filter(F.col(ts) >= (F.lit(now).cast(log.schema[ts].dataType) - F.make_dt_interval(F.lit(days))))


# Ratings that say an answer helped, or didn't.
HELPFUL, NOT_HELPFUL = ("helpful", "positive", "up"), ("not_helpful", "negative", "down")


def feedback_by_category(log: DataFrame, kind: str, category: str, good: tuple[str, ...] = HELPFUL, bad: tuple[str, ...] = NOT_HELPFUL) -> DataFrame:
    """Ratings of each category that has a name."""
    k, named = F.col(kind), log.filter(F.coalesce(F.col(category), F.lit("")) != "")
    return named.groupBy(category).agg(F.count("*").alias("total"), F.count_if(k.isin(*good)).alias("helpful"), F.count_if(k.isin(*bad)).alias("not_helpful"))


def freshness(rows: DataFrame, updated: str, author: str, now: str, recent: int = 14, fresh: int = 45) -> DataFrame:
    """articles, authors, recent (updated in the last 14 days) and freshness: the whole percent updated in the last 45, 100 without articles."""
    at = F.lit(now).cast(rows.schema[updated].dataType)
    since = lambda days: F.count_if(F.col(updated) >= at - F.make_dt_interval(F.lit(days)))
    n = F.count("*")
    return rows.agg(n.alias("articles"), F.count_distinct(author).alias("authors"), since(recent).alias("recent"), F.when(n == 0, 100).otherwise(F.floor(since(fresh) * 100 / n)).cast("long").alias("freshness"))


def listed(rows: DataFrame, text: str = "", fields: tuple[str, ...] = (), equals: dict[str, str] | None = None, flag: str | None = None, since: tuple[str, str] | None = None) -> DataFrame:
    """Rows with the text in some field, the given values (all or empty: any), the flag set, and a time not before `since` (column, time)."""
    if text:
        rows = rows.filter(F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(text.lower())))
    for c, v in (equals or {}).items():
        if v not in ("", "all"):
            rows = rows.filter(F.col(c) == v)
    if flag:
        rows = rows.filter(F.col(flag))
    return rows if since is None else rows.filter(F.col(since[0]) >= F.lit(since[1]).cast(rows.schema[since[0]].dataType))


def feedback(log: DataFrame, kind: str, good: list[str], bad: list[str]) -> DataFrame:
    k = F.col(kind)
    return log.agg(F.count("*").alias("total"), F.count_if(k.isin(*good)).alias("helpful"), F.count_if(k.isin(*bad)).alias("not_helpful"))


def percentiles(log: DataFrame, value: Column, ps: tuple[int, ...] = (50, 95, 99), last: int = 1024) -> DataFrame:
    """Of the newest samples the one at rank ceil(p (n-1) / 100), without interpolation. At most `last` rows are ranked."""
    recent = log.orderBy(F.desc("ts"), F.desc("event_id")).limit(last).select(value.alias("v"))
    ranked = recent.select("v", F.row_number().over(Window.orderBy("v")).alias("i"), F.count("*").over(Window.partitionBy()).alias("n"))
    pick = lambda p: F.max(F.when(F.col("i") == F.ceil(p * (F.col("n") - 1) / 100) + 1, F.col("v")))
    return ranked.agg(*(F.round(pick(p), 4).alias(f"p{p}") for p in ps))


def category_counts(df: DataFrame, key: str) -> DataFrame:
    """The largest first, then by name."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first(key))


def project_stats(files: DataFrame, path: str, text: str, kind: str) -> DataFrame:
    """(kind, files, lines, bytes) of distinct files; a file that comes several times counts once."""
    size = F.struct((F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("lines"), F.octet_length(text).alias("bytes"))
    each = files.groupBy(kind, path).agg(F.min(size).alias("s"))
    return each.groupBy(kind).agg(F.count("*").alias("files"), F.sum("s.lines").alias("lines"), F.sum("s.bytes").alias("bytes"))


def summary(log: DataFrame, value: Column) -> DataFrame:
    return log.agg(F.count(value).alias("n"), F.round(F.sum(value), 2).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.avg(value), 4).alias("mean"))


def load_test(log: DataFrame, key: str, value: Column) -> DataFrame:
    """Per key least, most, mean and the values at ranks n // 2 and n p // 100, to two decimals."""
    rows = log.select(key, F.round(value, 2).alias("v")).filter("v is not null")
    whole = rows.groupBy(key).agg(F.min("v").alias("least"), F.max("v").alias("most"), F.round(F.avg("v"), 2).alias("mean"))
    return whole.join(at_ranks(rows, F.col("v"), [key], {name: _share(p) for name, p in (("median", 50), ("p90", 90), ("p95", 95), ("p99", 99))}), key)


def _share(percent: int):
    return lambda n: F.floor(n * percent / 100)


def token_cost(rows: DataFrame, key: str, tokens: Column, per_thousand: float = 0.01) -> DataFrame:
    n = F.sum(tokens)
    return rows.groupBy(key).agg(n.alias("tokens"), F.round(n / 1000 * per_thousand, 6).alias("cost"))


def limiter_rate(decisions: DataFrame) -> DataFrame:
    """Requests, rejected ones and their share in percent."""
    n, bad = F.count("*"), F.count_if(~F.col("allowed"))
    return decisions.agg(n.alias("total"), bad.alias("rejected"), F.round(100 * bad / n, 4).alias("rejection_rate"))


def pruned(log: DataFrame, order: list, most: int = 100_000) -> DataFrame:
    """The log itself while it has at most `most` rows, else its newest half of that number."""
    n = log.agg(F.count("*").alias("rows_in_log"))
    whole = log.join(F.broadcast(n.filter(F.col("rows_in_log") <= most)))  # one row or none
    half = log.orderBy(*order).limit(most // 2).join(F.broadcast(n.filter(F.col("rows_in_log") > most)))
    return whole.unionByName(half).drop("rows_in_log")


def import_counts(files: DataFrame, key: str, content: str, most: int) -> DataFrame:
    """Files seen, imported, skipped as too long or empty, and duplicates of an earlier file's content."""
    size = F.octet_length(content)
    bad = F.coalesce((size > most) | (size == 0), F.lit(True))
    by_content = files.filter(~bad).groupBy(F.md5(content).alias("digest")).agg(F.count("*").alias("n"))
    good = by_content.agg(F.count("*").alias("imported"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates"))
    return files.agg(F.count("*").alias("seen"), F.count_if(bad).alias("skipped")).join(F.broadcast(good))


def folder_counts(files: DataFrame, path: Column) -> DataFrame:
    """Files per parent folder, `.` for those without one."""
    folder = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return files.groupBy(F.when(folder == "", ".").otherwise(folder).alias("folder")).agg(F.count("*").alias("n"))
