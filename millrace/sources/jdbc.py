"""Tables of a relational database, read in parallel ranges of a numeric column and written by appending."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..plans.catalog import KEYS, Catalog, ForeignKey


#: Types of a column by which a table may be read in ranges.
WHOLE = ("INT", "INTEGER", "BIGINT", "SMALLINT", "SERIAL", "BIGSERIAL", "INT4", "INT8")
SNAPSHOT = {
    "tables": "tbl string, kind string", "columns": "tbl string, position int, col string, kind string, nullable boolean", "primary_keys": "tbl string, position int, col string",
    "foreign_keys": "tbl string, name string, position int, col string, target string, target_col string", "indexes": "tbl string, name string, position int, col string, is_unique boolean",
}


def _rows(found, *columns: str) -> list[tuple]:
    """A result set of metadata as rows of texts, in the order in which they are asked for."""
    out = []
    while found.next():
        out.append(tuple(found.getString(c) for c in columns))
    found.close()
    return out


@dataclass(frozen=True)
class Database:
    """url: a JDBC address whose driver is on the class path; properties: user, password, driver and so on."""

    url: str
    properties: tuple[tuple[str, str], ...] = ()
    fetch: int = 10_000

    def reader(self, spark: SparkSession):
        return spark.read.format("jdbc").options(url=self.url, fetchsize=str(self.fetch), **dict(self.properties))

    def query(self, spark: SparkSession, sql: str) -> DataFrame:
        """What a SELECT of the database's own dialect returns, through one connection."""
        return self.reader(spark).option("query", sql).load()

    def table(self, spark: SparkSession, name: str, split: str | None = None, parts: int = 8) -> DataFrame:
        """A table; filters and columns are pushed to the database. With split (a whole-number column), `parts` connections
        each read a range between its least and greatest value, nulls in the first. A table without values in split, or
        without split, is read through one connection."""
        if split is None:
            return self.reader(spark).option("dbtable", name).load()
        column = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(self.url).quoteIdentifier(split)
        low, high = self.query(spark, f"SELECT MIN({column}) AS low, MAX({column}) AS high FROM {name}").first()
        if low is None:
            return self.table(spark, name)
        ranges = {"partitionColumn": split, "lowerBound": str(low), "upperBound": str(int(high) + 1), "numPartitions": str(parts)}
        return self.reader(spark).option("dbtable", name).options(**ranges).load()

    def catalog(self, spark: SparkSession, splits: dict[str, str | None], keys: tuple[ForeignKey, ...] = KEYS) -> Catalog:
        """Tables by name, each with its split column."""
        return Catalog({name: self.table(spark, name, split) for name, split in splits.items()}, keys)

    def snapshot(self, spark: SparkSession, schema: str | None = None) -> dict[str, DataFrame]:
        """What the database says of itself: tables (name, kind: TABLE or VIEW), columns, primary_keys, foreign_keys and indexes.

        Read on the driver through one connection: as many rows as the schema has columns and keys, whatever the tables hold.
        """
        jvm = spark._jvm
        properties = jvm.java.util.Properties()
        for k, v in self.properties:
            if k == "driver":
                jvm.java.lang.Class.forName(v)
            properties.setProperty(k, v)
        connection = jvm.java.sql.DriverManager.getConnection(self.url, properties)
        try:
            about = connection.getMetaData()
            kinds = spark.sparkContext._gateway.new_array(jvm.java.lang.String, 2)
            kinds[0], kinds[1] = "TABLE", "VIEW"
            tables = _rows(about.getTables(None, schema, "%", kinds), "TABLE_SCHEM", "TABLE_NAME", "TABLE_TYPE")
            out = {"tables": [(t, kind) for _, t, kind in tables], "columns": [], "primary_keys": [], "foreign_keys": [], "indexes": []}
            for owner, t, kind in tables:
                out["columns"] += [(t, int(i), c, k, yes == "YES") for c, k, i, yes in _rows(about.getColumns(None, owner, t, "%"), "COLUMN_NAME", "TYPE_NAME", "ORDINAL_POSITION", "IS_NULLABLE")]
                if kind == "TABLE":
                    out["primary_keys"] += [(t, int(i), c) for i, c in _rows(about.getPrimaryKeys(None, owner, t), "KEY_SEQ", "COLUMN_NAME")]
                    out["foreign_keys"] += [(t, name, int(i), c, other, d) for name, i, c, other, d in _rows(about.getImportedKeys(None, owner, t), "FK_NAME", "KEY_SEQ", "FKCOLUMN_NAME", "PKTABLE_NAME", "PKCOLUMN_NAME")]
                    out["indexes"] += [(t, name, int(i), c, free in ("0", "false")) for name, i, c, free in _rows(about.getIndexInfo(None, owner, t, False, True), "INDEX_NAME", "ORDINAL_POSITION", "COLUMN_NAME", "NON_UNIQUE") if c]
        finally:
            connection.close()
        return {name: spark.createDataFrame(sorted(rows, key=str), SNAPSHOT[name]) for name, rows in out.items()}

    def introspected(self, spark: SparkSession, schema: str | None = None) -> Catalog:
        """All tables and views with the relations that the database declares; a table with one whole-number key column is split by it."""
        held = {name: df.collect() for name, df in self.snapshot(spark, schema).items()}
        kinds = {(r["tbl"], r["col"]): r["kind"].upper() for r in held["columns"]}
        first: dict[str, list[str]] = {}
        for r in held["primary_keys"]:
            first.setdefault(r["tbl"], []).append(r["col"])
        splits = {r["tbl"]: next((c for c in first.get(r["tbl"], []) if len(first[r["tbl"]]) == 1 and kinds[r["tbl"], c].split()[0] in WHOLE), None) for r in held["tables"]}
        several = Counter((r["tbl"], r["name"]) for r in held["foreign_keys"])
        keys = tuple(ForeignKey(r["tbl"], r["col"], r["target"], r["target_col"]) for r in held["foreign_keys"] if several[r["tbl"], r["name"]] == 1)
        return self.catalog(spark, splits, keys)

    def append(self, df: DataFrame, name: str, parts: int = 8) -> None:
        """Insert rows, in batches, over at most `parts` connections. A lost executor's rows may be inserted twice unless the table has a key."""
        df.write.format("jdbc").options(url=self.url, dbtable=name, numPartitions=str(parts), batchsize=str(self.fetch), **dict(self.properties)).mode("append").save()
