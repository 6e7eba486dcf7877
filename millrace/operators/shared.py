"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_folders: set[str] = set()


def folder(spark: SparkSession) -> str:
    """This application's part of spark.checkpoint.dir, which goes when the driver's Python ends. Unset: a temporary folder in local mode; a cluster must set it."""
    key = "spark.checkpoint.dir"
    path = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"set {key} to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set(key, path)
    own = f"{path.rstrip('/')}/millrace-tables-{spark.sparkContext.applicationId}"
    if own not in _folders:
        _folders.add(own)
        atexit.register(_at_exit, spark, own)
    return own


def _at_exit(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Py4JError, OSError):  # the JVM may be gone already
        remove(spark, path)


def written(df: DataFrame, tag: str = "table") -> DataFrame:
    """df written and read back: lineage ends here, and lost executors recompute nothing before it."""
    spark, path = df.sparkSession, f"{folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._millrace_path = path
    return made


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop(*tables: DataFrame) -> None:
    """Remove what written() wrote, when nothing reads it any more."""
    for df in tables:
        remove(df.sparkSession, df._millrace_path)
