"""Parsers by kind of file, tried in order, and lines of files as a data source of Spark's own reader."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as T
from .files import file_type


@dataclass(frozen=True)
class Parser:
    """name; supports: a condition on a row of files (path, content as text, type); parse: the text that comes out."""

    name: str
    supports: Callable[[Column], Column]
    parse: Callable[[Column], Column]


HTML = Parser("html", lambda t: t["kind"] == "html", T.html_text)
PLAIN = Parser("plain", lambda t: ~F.coalesce(t["binary"], F.lit(True)), lambda c: c)


@dataclass
class Registry:
    """Parsers in the order of their trial: added ones go before those that are there."""

    parsers: list[Parser] = field(default_factory=lambda: [HTML, PLAIN])

    def add(self, parser: Parser) -> None:
        self.parsers.insert(0, parser)

    def parsed(self, files: DataFrame) -> DataFrame:
        """files(path, content) with type, parser (the first that supports the file, else null) and text; one pass, all in expressions."""
        kind = file_type(F.col("path"))
        name, out = F.lit(None).cast("string"), F.lit(None).cast("string")
        for p in reversed(self.parsers):
            can = F.coalesce(p.supports(F.col("type")), F.lit(False))
            name, out = F.when(can, p.name).otherwise(name), F.when(can, p.parse(F.col("content"))).otherwise(out)
        return files.withColumn("type", kind).withColumns({"parser": name, "text": out})


class LineSource(DataSource):
    """format("millrace_lines"): (path, line, text) of text files, a partition a file; options path (a folder) and suffix.

    For folders that every executor sees. Shows how a source of one's own is registered: spark.dataSource.register(LineSource).
    """

    @classmethod
    def name(cls) -> str:
        return "millrace_lines"

    def schema(self) -> str:
        return "path string, line int, text string"

    def reader(self, schema) -> DataSourceReader:
        return LineReader(self.options)


class LineReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.suffix = options["path"], options.get("suffix", "")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)
        found = store.get_file_info(fs.FileSelector(path, recursive=True))
        return [InputPartition(x.path) for x in found if x.type == fs.FileType.File and x.path.endswith(self.suffix)] or [InputPartition(None)]

    def read(self, partition):
        from pyarrow import fs

        if partition.value is None:
            return
        store = fs.FileSystem.from_uri(self.folder)[0] if "://" in self.folder else fs.LocalFileSystem()
        with store.open_input_stream(partition.value) as f:
            rest, n = b"", 0
            while block := f.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                for line in lines:
                    n += 1
                    yield partition.value, n, line.decode("utf-8", "replace")
            if rest:
                yield partition.value, n + 1, rest.decode("utf-8", "replace")
