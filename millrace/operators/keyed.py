"""A stored table in parts by the hash of its key: a change reads and writes the parts that it touches, and no others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import changes
from .shared import drop, written

PART = "_part"


class KeyedTable:
    """A Parquet table at `path`, a folder for each part of its keys. parts: as many as give files of a good size; fixed when it is made.

    Every change finds the parts it touches, makes their new rows, and puts those in their place; other folders keep their files. The new rows
    are written elsewhere before an old file goes. A crash while folders are replaced may leave some old and some new: an upsert, an insert or
    a removal that is run again completes it.
    """

    def __init__(self, spark: SparkSession, path: str, key: str | list[str], parts: int):
        self.spark, self.path, self.keys, self.parts = spark, path, [key] if isinstance(key, str) else key, parts

    @classmethod
    def create(cls, df: DataFrame, path: str, key: str | list[str], parts: int) -> KeyedTable:
        table = cls(df.sparkSession, path, key, parts)
        table._placed(df).repartition(parts, PART).write.partitionBy(PART).parquet(path)
        return table

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")

    def _placed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(PART, self._part())

    def _whole(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def read(self) -> DataFrame:
        return self._whole().drop(PART)

    def _of(self, touched: list[int]) -> DataFrame:
        """Rows of some parts: the condition is on folders, so others aren't opened."""
        return self._whole().filter(F.col(PART).isin(touched)).drop(PART)

    def _replace(self, touched: list[int], rows: DataFrame) -> None:
        made = written(self._placed(rows), "parts")
        made.repartition(len(touched), PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(self.path)
        held = {r[0] for r in made.select(PART).distinct().collect()}
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        for part in set(touched) - held:  # a part that lost all its rows
            p = fs_path(f"{self.path}/{PART}={part}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        drop(made)

    def _parts_of(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self._part().alias(PART)).distinct().collect())  # as many as the table has parts at most

    def _changed(self, touched: list[int], change) -> list[int]:
        if touched:
            self._replace(touched, change(self._of(touched)))
        return touched

    def upsert(self, rows: DataFrame, order: Column | str | None = None) -> list[int]:
        """New rows replace old ones of the same key; the parts that were touched."""
        return self._changed(self._parts_of(rows), lambda old: changes.upsert(old, rows, self.keys, order))

    def insert_ignore(self, rows: DataFrame, order: Column | str | None = None) -> list[int]:
        """Rows whose key isn't there yet; parts that get none aren't written."""
        old = self._of(self._parts_of(rows)) if self._parts_of(rows) else self.read()
        new = rows.join(old.select(*self.keys), self.keys, "left_anti")
        return self._changed(self._parts_of(new), lambda old: changes.insert_ignore(old, new, self.keys, order))

    def update(self, where: Column, values: dict[str, Column]) -> list[int]:
        """Rows for which the condition is true; a key can't be changed, as it says where its row lies."""
        if set(values) & set(self.keys):
            raise ValueError("a key stays as it is: remove the row and insert another")
        return self._changed(self._hit(where), lambda old: changes.update(old, where, values))

    def remove(self, where: Column) -> list[int]:
        return self._changed(self._hit(where), lambda old: changes.remove(old, where))

    def _hit(self, where: Column) -> list[int]:
        """Parts with a row that the condition holds for; only its columns are read."""
        return sorted(r[0] for r in self._whole().filter(where).select(PART).distinct().collect())

    def drop_stale(self, snapshot: DataFrame) -> list[int]:
        """Rows whose key isn't in the snapshot go."""
        stale = self.read().join(snapshot.select(*self.keys), self.keys, "left_anti")
        return self._changed(self._parts_of(stale), lambda old: old.join(snapshot.select(*self.keys).distinct(), self.keys, "left_semi"))
