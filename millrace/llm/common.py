"""Shared pieces of the training-data operators: shared folder, written tables, size-checked joins."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes (as JSON) of a side that may be broadcast; above either the join shuffles (AQE splits skewed keys).
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20
#: Rows a Python worker gets at a time: 512 very long texts still fit beside each other.
BATCH_ROWS = 512


_scopes: list[list[str]] = []
_folders: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where it is unset, a temporary one in local mode; a cluster must set it."""
    key = "spark.checkpoint.dir"
    path = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"set {key} to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set(key, path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in this application's part of the shared folder, which goes when the driver's Python ends."""
    folder = f"{shared_dir(spark)}/millrace-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_remove_at_exit, spark, folder)
    path = f"{folder}/{tag}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def _remove_at_exit(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Py4JError, OSError):  # the JVM may be gone already
        delete(spark, folder)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables that begin inside are removed at the end: what they lead to must be written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        delete(spark, *_scopes.pop())


def materialise(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: cuts lineage, and lost executors recompute nothing before it."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, *paths: str) -> None:
    """Remove written tables that no live result reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def join_small(left: DataFrame, right: DataFrame, on, how: str = "left", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join; right is broadcast only if it is counted to have at most `rows` rows and BROADCAST_BYTES, else both sides shuffle.

    right should be a written table: it is counted before it is joined.
    """
    size = F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in right.columns))))
    n, total = right.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return left.join(F.broadcast(right) if n <= rows and total <= BROADCAST_BYTES else right, on, how)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lowers the session's batch size, never raises it: Spark reads it when a plan runs, so it can't be set for one plan."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def wrapped(docs: DataFrame) -> DataFrame:
    """own (all columns of docs as one struct) and row, a number of the row: no name of docs can clash with a helper's."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), F.monotonically_increasing_id().alias("row"))


def wrapped_texts(table: DataFrame) -> DataFrame:
    """doc_id, the whole text (null: empty) and row of a wrapped table."""
    return table.select(F.col("own.doc_id").cast("long").alias("doc_id"), F.coalesce("own.text", F.lit("")).alias("text"), "row")


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow where fn yields dicts of columns (lists or arrays) in the schema's order."""
    small_batches(df.sparkSession)
    names = [x.strip().split(" ")[0] for x in _split_top(schema)]
    types = [_arrow(x.strip().split(" ", 1)[1]) for x in _split_top(schema)]

    def run(batches):
        for cols in fn(batches):
            arrays = [x if isinstance(x, pa.Array) and x.type == t else pa.array(x, type=t) for x, t in zip((cols[n] for n in names), types)]
            if len(arrays[0]):
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.mapInArrow(run, schema)


def _split_top(schema: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[last:i])
            last = i + 1
    return [*out, schema[last:]]


def _arrow(kind: str) -> pa.DataType:
    simple = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "float": pa.float32()}
    kind = kind.strip()
    if kind.startswith("array<"):
        return pa.list_(_arrow(kind[6:-1]))
    if kind.startswith("struct<"):
        return pa.struct([pa.field(*(lambda n, t: (n.strip(), _arrow(t)))(*x.split(":", 1))) for x in _split_top(kind[7:-1])])
    return simple[kind]


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id (long), the whole text (null: empty), and the named columns; nothing else, so other columns can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def utf8(column: pa.Array) -> list[bytes]:
    return column.cast(pa.large_binary()).to_pylist()
