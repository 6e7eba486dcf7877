"""Incremental ingestion: new files of a folder become documents, each content once."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import drop, written
from ..sources.files import MOST_BYTES, described

FILE = "path string, modificationTime timestamp, length long, content binary"
DOCUMENT = "digest string, path string, language string, content string, batch long"
STATUS = "batch long, seen long, issues long, repeated long, imported long"


def ingest(spark: SparkSession, folder: str, target: str, status: str, checkpoint: str, extensions: list[str] | None = None, files_per_batch: int = 10_000, most: int = MOST_BYTES) -> None:
    """Append documents (DOCUMENT) to target and a row of counts per batch (STATUS) to status; files seen before aren't read again.

    The first path of a content in a batch stays; contents that target holds are left out, as its index of digests (beside it) says. A batch is written under its
    number and replaces what a failed try of it left, so a restart neither loses nor doubles rows. Files over `most` bytes are an issue, and aren't
    read. The counts come with the jobs that write the files' contents and the documents.
    """

    index = Digests(spark, f"{target.rstrip('/')}.digests")

    def store(batch: DataFrame, number: int) -> None:
        seen, made = Observation(), Observation()
        files = described(batch, extensions, most=most).withColumn("digest", F.sha2("content", 256)).observe(seen, F.count("*").alias("seen"), F.count("issue").alias("issues"))
        firsts = files.filter("issue is null").groupBy("digest").agg(F.min_by(F.struct("path", "language", "content"), "path").alias("f")).select("digest", "f.*")
        firsts = written(firsts, "files")  # each content once; read by its digest, then by what is new
        new = firsts.join(index.held(firsts.select("digest"), number), "digest", "left_anti").select("digest", "path", "language", "content")
        new.observe(made, F.count("*").alias("imported")).write.mode("overwrite").parquet(f"{target}/batch={number}")
        index.add(documents(spark, target).filter(F.col("batch") == number).select("digest"), number)
        drop(firsts)
        counts = seen.get | made.get  # counted by the tasks that wrote
        row = (counts["seen"], counts["issues"], counts["seen"] - counts["issues"] - counts["imported"], counts["imported"])
        spark.createDataFrame([row], "seen long, issues long, repeated long, imported long").coalesce(1).write.mode("overwrite").parquet(f"{status}/batch={number}")

    def files() -> DataFrame:
        return spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(folder)

    # two readers, so that the content of a file that is too large is never read
    stream = files().filter(F.col("length") <= most).unionByName(files().select("path", "modificationTime", "length").filter(F.col("length") > most).withColumn("content", F.lit(None).cast("binary")))
    stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def documents(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(DOCUMENT).parquet(target)


def statuses(spark: SparkSession, status: str) -> DataFrame:
    return spark.read.schema(STATUS).parquet(status)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


class Digests:
    """Hexadecimal digests by their first two digits and by batch, with a Bloom filter of each such part: a lookup reads the parts that may hold
    one of the digests asked for, and no others. A batch's parts and filters replace what a failed try of it left."""

    #: Bits of a filter for each digest, and how many of them a digest sets: one in some 15,000 others seems to be there (a filter has 1024 bits at least).
    BITS, HASHES = 20, 14

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, digests: DataFrame, batch: int) -> None:
        per_digest, hashes = self.BITS, self.HASHES

        def filters(pdf: pd.DataFrame) -> pd.DataFrame:
            size = max(1024, per_digest * len(pdf)) // 8 * 8
            bits = np.zeros(size, bool)
            bits[_places(pdf["digest"].tolist(), hashes) % np.uint64(size)] = True
            return pd.DataFrame({"part": [pdf["part"].iloc[0]], "size": [size], "bits": [np.packbits(bits).tobytes()]})

        parted = digests.withColumn("part", F.left("digest", F.lit(2)))
        parted.repartition("part").sortWithinPartitions("part", "digest").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/batch={batch}")
        parted.groupBy("part").applyInPandas(filters, "part string, size long, bits binary").write.mode("overwrite").parquet(f"{self.path}.filters/batch={batch}")

    def held(self, digests: DataFrame, batch: int) -> DataFrame:
        """Those of the digests that a batch other than this one holds."""
        if not exists(self.spark, f"{self.path}.filters"):
            return digests.limit(0)
        filters = self.spark.read.schema("part string, size long, bits binary, batch long").parquet(f"{self.path}.filters").filter(F.col("batch") != batch)

        hashes = self.HASHES

        def maybe(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
            names, parts, batches = [], [], []
            places = _places(asked["digest"].tolist(), hashes)
            for size, bits, number in zip(known["size"], known["bits"], known["batch"]):
                some = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)[places % np.uint64(size)].all(1)
                names += asked["digest"][some].tolist()
                parts += asked["part"][some].tolist()
                batches += [number] * int(some.sum())
            return pd.DataFrame({"digest": pd.Series(names, dtype=object), "part": pd.Series(parts, dtype=object), "batch": pd.Series(batches, dtype="int64")})

        asked = digests.withColumn("part", F.left("digest", F.lit(2)))
        found = written(asked.groupBy("part").cogroup(filters.groupBy("part")).applyInPandas(maybe, "digest string, part string, batch long"), "maybe")
        return self.read(found).join(found, ["batch", "part", "digest"], "left_semi").select("digest").distinct()

    def read(self, found: DataFrame) -> DataFrame:
        """The parts that are named: 256 a batch at most, and few for digests that aren't there."""
        named: dict[int, list[str]] = {}
        for r in found.select("batch", "part").distinct().collect():
            named.setdefault(r["batch"], []).append(r["part"])
        wanted = reduce(lambda a, b: a | b, ((F.col("batch") == n) & F.col("part").isin(p) for n, p in named.items()), F.lit(False))
        return self.spark.read.schema("digest string, batch long, part string").parquet(self.path).filter(wanted)


def _places(digests: list[str], n: int) -> np.ndarray:
    """n places of each digest, from two numbers in its last 32 digits."""
    pairs = np.array([(int(d[-32:-16], 16), int(d[-16:], 16) | 1) for d in digests], np.uint64).reshape(-1, 2)
    with np.errstate(over="ignore"):
        return pairs[:, :1] + pairs[:, 1:] * np.arange(n, dtype=np.uint64)[None, :]
