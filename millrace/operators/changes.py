"""Copy-on-write changes: each returns the new table's rows. write_table puts them in place of the old."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written


def insert(table: DataFrame, rows: DataFrame, key: str | None = None) -> DataFrame:
    """The table and the new rows; missing columns are null. Rows without a `key` get numbers from its greatest one on."""
    if key:
        rows = numbered(table, rows, key)
    return table.unionByName(rows, allowMissingColumns=True)


def numbered(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Null keys become max + 1, max + 2, ...; the numbers that a partition needs are counted first, so no task holds all rows."""
    kind = table.schema[key].dataType
    if key not in rows.columns:
        rows = rows.withColumn(key, F.lit(None).cast(kind))
    part = F.shiftright(F.col("_at"), 33)
    # written, so that a row has the same place when partitions are counted and when rows are numbered
    marked = written(rows.filter(F.col(key).isNull()).withColumn("_at", F.monotonically_increasing_id()))
    counts = {r["p"]: r["n"] for r in marked.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # a row a partition
    first, upto = {}, 0
    for p in sorted(counts):
        first[p], upto = upto, upto + counts[p]
    given = rows.filter(F.col(key).isNotNull())
    most = table.agg(F.max(key)).unionByName(given.agg(F.max(key).alias(f"max({key})")))
    top = max([r[0] for r in most.collect() if r[0] is not None], default=0)
    if not first:
        return given
    start = F.create_map(*(F.lit(x) for kv in first.items() for x in kv))[part]
    number = (F.lit(top) + 1 + start + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast(kind)
    return given.unionByName(marked.withColumn(key, number).drop("_at"))


def update(table: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """Rows for which the condition is true; unknown leaves a row as it is."""
    hit = F.coalesce(where, F.lit(False))
    return table.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in values.items()})


def remove(table: DataFrame, where: Column) -> DataFrame:
    return table.filter(~F.coalesce(where, F.lit(False)))


def upsert(table: DataFrame, rows: DataFrame, key: str | list[str], order: Column | str | None = None) -> DataFrame:
    """New rows replace old ones of the same key. Of several new rows of one key the last by `order` stays (by all columns where it isn't given)."""
    keys = [key] if isinstance(key, str) else key
    one = kept_row(rows.select(*table.columns), rows, keys, order, F.max_by)
    return table.join(one.select(*keys), keys, "left_anti").unionByName(one)


def insert_ignore(table: DataFrame, rows: DataFrame, key: str | list[str], order: Column | str | None = None) -> DataFrame:
    """New rows whose key isn't there yet. Of several new rows of one key the first by `order` stays (by all columns where it isn't given)."""
    keys = [key] if isinstance(key, str) else key
    new = rows.join(table, keys, "left_anti")
    return table.unionByName(kept_row(new.select(*table.columns), new, keys, order, F.min_by))


def kept_row(chosen: DataFrame, rows: DataFrame, keys: list[str], order: Column | str | None, pick) -> DataFrame:
    whole = F.struct(*(F.col(c) for c in chosen.columns))
    by = F.struct((F.col(order) if isinstance(order, str) else order).alias("by"), whole.alias("whole")) if order is not None else whole
    return rows.groupBy(*keys).agg(pick(whole, by).alias("row")).select("row.*")


def drop_stale(table: DataFrame, snapshot: DataFrame, key: str) -> DataFrame:
    return table.join(snapshot.select(key).distinct(), key, "left_semi")


def with_history(history: DataFrame, changed: DataFrame, key: str, action: str) -> DataFrame:
    """One row more per changed key, its version one above the last."""
    last = history.groupBy(key).agg(F.max("version").alias("last"))
    made = changed.join(last, key, "left").withColumn("version", F.coalesce("last", F.lit(0)) + 1).withColumn("action", F.lit(action))
    return history.unionByName(made.select(*history.columns))


def write_table(df: DataFrame, path: str) -> None:
    """Into a new folder beside the old, then swapped, as the old may be what df reads.

    The old folder is moved aside before the new one takes its name, and removed last: at every moment one of the two is whole,
    and restore() puts the older one back where a crash came between.
    """
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path
    restore(spark, path)
    new, old, aside = p(f"{path}.new"), p(path), p(f"{path}.old")
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(new, True)
    df.write.parquet(f"{path}.new")
    if fs.exists(old) and not fs.rename(old, aside):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(new, old):
        raise OSError(f"cannot move the new table to {path}")
    fs.delete(aside, True)


def restore(spark, path: str) -> None:
    """After a crash inside write_table: the old table back in place if the new one hasn't taken it, else the leftover removed."""
    p = spark._jvm.org.apache.hadoop.fs.Path
    old, aside = p(path), p(f"{path}.old")
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(aside):
        if fs.exists(old):
            fs.delete(aside, True)
        elif not fs.rename(aside, old):
            raise OSError(f"cannot move {path}.old back")


def exported(df: DataFrame, path: str, kind: str = "json") -> None:
    """All rows as files of one kind: json lines, csv with a header, or xml with a row element each."""
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind == "xml":
        writer.option("rowTag", "row").xml(path)
    else:
        writer.json(path)
