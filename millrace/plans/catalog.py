"""Tables and their declared foreign keys."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@dataclass(frozen=True)
class ForeignKey:
    table: str
    column: str
    target: str
    target_column: str


KEYS = (
    ForeignKey("nation", "n_regionkey", "region", "r_regionkey"),
    ForeignKey("customer", "c_nationkey", "nation", "n_nationkey"),
    ForeignKey("supplier", "s_nationkey", "nation", "n_nationkey"),
    ForeignKey("orders", "o_custkey", "customer", "c_custkey"),
    ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ForeignKey("lineitem", "l_partkey", "part", "p_partkey"),
    ForeignKey("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ForeignKey("labels", "doc_id", "documents", "doc_id"),
)


class Catalog:
    """Named DataFrames and the relations between them."""

    def __init__(self, frames: dict[str, DataFrame], keys: tuple[ForeignKey, ...] = KEYS, names: tuple[str, ...] | None = None):
        self.frames, self.keys, self.names = frames, keys, names or tuple(frames)

    @classmethod
    def parquet(cls, spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> Catalog:
        class Lazy(dict):
            def __missing__(self, name):
                if name not in names:
                    raise KeyError(f"unknown table {name}")
                self[name] = spark.read.parquet(f"{folder}/{name}.parquet")
                return self[name]

        return cls(Lazy(), names=names)

    def frame(self, name: str) -> DataFrame:
        return self.frames[name]

    def edge(self, left: str, right: str) -> tuple[str, str, str]:
        """Columns that join left to right, and how: inner along a key, left against one. Declared keys come first, then columns
        named after the other table, as in orders.customer_id = customer.id."""
        for k in self.keys:
            if (k.table, k.target) == (left, right):
                return k.column, k.target_column, "inner"
        for k in self.keys:
            if (k.table, k.target) == (right, left):
                return k.target_column, k.column, "left"
        a, b = self.frame(left).columns, self.frame(right).columns
        if f"{right}_id" in a and "id" in b:
            return f"{right}_id", "id", "inner"
        if f"{left}_id" in b and "id" in a:
            return "id", f"{left}_id", "left"
        raise ValueError(f"no relation between {left} and {right}")

    def owner(self, table: str, path: str) -> tuple[str, str]:
        """The table and the column that a.b.column names, from `table` on."""
        *tables, column = path.split(".")
        name = tables[-1] if tables else table
        if name not in self.names or column not in self.frame(name).columns:
            raise ValueError(f"no column {path} from {table}")
        return name, column

    def sql(self, spark: SparkSession, text: str, args: dict | list | None = None) -> DataFrame:
        """A statement over the catalog's tables, which become temporary views; values come as parameters, never as text."""
        for name in self.names:
            if re.search(rf"\b{re.escape(name)}\b", text):
                self.frame(name).createOrReplaceTempView(name)
        return spark.sql(text, args=args)

    def tables(self, spark: SparkSession, prefix: str = "", skip: int = 0, most: int = 100) -> DataFrame:
        """Tables whose name begins with the prefix in any case, by name, and the number of their columns."""
        rows = [(n, len(self.frame(n).columns)) for n in sorted(self.names) if n.lower().startswith(prefix.lower())]
        return spark.createDataFrame(rows[skip : skip + most], "tbl string, columns int")

    def columns(self, spark: SparkSession, table: str | None = None, prefix: str = "") -> DataFrame:
        """position, col, kind, nullable and, for foreign keys, the column referred to; of one table or of all."""
        rows = []
        for name in [table] if table else sorted(self.names):
            refers = {k.column: f"{k.target}.{k.target_column}" for k in self.keys if k.table == name}
            rows += [(name, i + 1, f.name, f.dataType.simpleString(), f.nullable, refers.get(f.name)) for i, f in enumerate(self.frame(name).schema) if f.name.lower().startswith(prefix.lower())]
        return spark.createDataFrame(rows, "tbl string, position int, col string, kind string, nullable boolean, refers_to string")

    def row_counts(self) -> DataFrame:
        """Rows of every table, one aggregation each in one plan."""
        out = None
        for name in sorted(self.names):
            part = self.frame(name).agg(F.lit(name).alias("tbl"), F.count("*").alias("rows"))
            out = part if out is None else out.unionByName(part)
        return out
