"""Files as documents: scanning, type by extension, plain text, Markdown, CSV profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

MOST_BYTES = 4096 * 1024
# Extensions with their media type and language.
TYPES = {
    "cpp": ("text/x-c++src", "C++"), "c": ("text/x-csrc", "C"), "cc": ("text/x-c++src", "C++"), "cxx": ("text/x-c++src", "C++"), "c++": ("text/x-c++src", "C++"),
    "h": ("text/x-chdr", "C/C++ Header"), "hpp": ("text/x-c++hdr", "C++ Header"), "hxx": ("text/x-c++hdr", "C++ Header"), "h++": ("text/x-c++hdr", "C++ Header"),
    "java": ("text/x-java-source", "Java"), "cs": ("text/x-csharp", "C#"), "py": ("text/x-python", "Python"), "js": ("text/javascript", "JavaScript"), "ts": ("text/typescript", "TypeScript"),
    "go": ("text/x-go", "Go"), "rs": ("text/x-rust", "Rust"), "swift": ("text/x-swift", "Swift"), "kt": ("text/x-kotlin", "Kotlin"), "scala": ("text/x-scala", "Scala"),
    "txt": ("text/plain", "Text"), "md": ("text/markdown", "Markdown"), "rst": ("text/x-rst", "reStructuredText"), "adoc": ("text/asciidoc", "AsciiDoc"),
    "yaml": ("application/x-yaml", "YAML"), "yml": ("application/x-yaml", "YAML"), "json": ("application/json", "JSON"), "xml": ("application/xml", "XML"),
    "html": ("text/html", "HTML"), "htm": ("text/html", "HTML"), "pdf": ("application/pdf", "PDF"), "csv": ("text/csv", "CSV"),
    "docx": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "DOCX"), "xlsx": ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "XLSX"),
    "pptx": ("application/vnd.openxmlformats-officedocument.presentationml.presentation", "PPTX"),
    "png": ("image/png", "Image"), "jpg": ("image/jpeg", "Image"), "jpeg": ("image/jpeg", "Image"), "tif": ("image/tiff", "Image"), "tiff": ("image/tiff", "Image"), "bmp": ("image/bmp", "Image"),
    "webp": ("image/webp", "Image"), "pbm": ("image/x-portable-bitmap", "Image"), "pgm": ("image/x-portable-graymap", "Image"), "ppm": ("image/x-portable-pixmap", "Image"), "pnm": ("image/x-portable-anymap", "Image"),
    "toml": ("application/toml", "TOML"), "ini": ("text/plain", "INI"), "cfg": ("text/plain", "Config"), "conf": ("text/plain", "Config"), "cmake": ("text/x-cmake", "CMake"),
}
# Extensions of source code.
SOURCE = tuple("cpp c cc cxx c++ h hpp hxx h++ java cs py js ts go rs swift kt scala".split())
BINARY = ("pdf", "docx", "xlsx", "pptx", "image")
# Extensions and the language that scan() names.
LANGUAGES = {"py": "python", "cpp": "cpp", "h": "cpp", "hpp": "cpp", "c": "c", "java": "java", "js": "javascript", "ts": "typescript", "go": "go", "rs": "rust", "md": "markdown", "html": "html", "htm": "html", "csv": "csv", "txt": "text", "json": "json", "xml": "xml", "yaml": "yaml", "yml": "yaml"}
SKIP = (".git", "node_modules", "__pycache__")


def looked_up(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def file_type(path: Column) -> Column:
    """extension, mime, language, kind (html, pdf, docx, xlsx, pptx, image, csv, source or config), binary, and issue for an extension that isn't known."""
    ext = extension_of(path)
    mime = looked_up({k: v[0] for k, v in TYPES.items()}, ext)
    kind = (
        F.when(mime == "text/html", "html").when(ext.isin("pdf", "docx", "xlsx", "pptx", "csv"), ext).when(F.startswith(mime, F.lit("image/")), "image")
        .when(ext.isin(*SOURCE), "source").when(mime.isNotNull(), "config")
    )
    return F.struct(ext.alias("extension"), mime.alias("mime"), looked_up({k: v[1] for k, v in TYPES.items()}, ext).alias("language"), kind.alias("kind"), kind.isin(*BINARY).alias("binary"), F.when(mime.isNull(), "unsupported_extension").alias("issue"))


def scan(spark: SparkSession, folder: str, extensions: list[str] | None = None, skip: tuple[str, ...] = SKIP, most: int = MOST_BYTES) -> DataFrame:
    """path, extension, language, length, content (text) and issue (null for good files). Spark leaves out files of no bytes.

    The limit on the length is a filter that the file source itself applies, so content over it is never read; the long files are
    listed from a scan without the content column, which opens none of them.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    small = described(raw.filter(F.col("length") <= most), extensions, skip, most)
    large = raw.select("path", "length").filter(F.col("length") > most).withColumn("content", F.lit(None).cast("binary"))
    return small.unionByName(described(large, extensions, skip, most))


def described(raw: DataFrame, extensions: list[str] | None = None, skip: tuple[str, ...] = SKIP, most: int = MOST_BYTES) -> DataFrame:
    """scan() of files that are read already (path, length, content)."""
    ext = extension_of(F.col("path"))
    parent = F.regexp_extract("path", r"^(.*)/", 1)
    for s in skip:
        raw = raw.filter(~F.contains(parent, F.lit(s)))
    if extensions:
        raw = raw.filter(ext.isin(*extensions))
    issue = F.when(F.col("length") > most, "too large").when(F.contains(F.substring("content", 1, 4096), F.lit(b"\0")), "binary")
    return raw.select("path", ext.alias("extension"), F.coalesce(looked_up(LANGUAGES, ext), F.lit("unknown")).alias("language"), "length", F.when(issue.isNull(), F.decode("content", "UTF-8")).alias("content"), issue.alias("issue"))


def folder_of(path: Column) -> Column:
    """The path without `.` and with each `x/..` taken back; a leading `..` stays, so nothing outside looks like inside."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    nothing = F.array().cast("array<string>")
    step = lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."), F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.array_append(acc, p))
    return F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.array_join(F.aggregate(parts, nothing, step), "/"))


def upload_check(name: Column, mime: Column, size: Column, extensions: list[str], mimes: list[str], most: int = MOST_BYTES, path: Column | None = None, folder: str = "") -> Column:
    """ok, or the first reason against a file: missing_filename, missing_extension, extension_not_allowed, file_too_large, mime_not_allowed, outside_folder.

    mimes may end in /*; an empty media type passes.
    """
    ext = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    kind = F.lower(F.trim(F.split_part(F.coalesce(mime, F.lit("")), F.lit(";"), F.lit(1))))
    allowed = kind == ""
    for m in (x.strip().lower() for x in mimes):
        if m:
            allowed = allowed | (F.startswith(kind, F.lit(m[:-1])) if m.endswith("/*") else kind == m)
    out = (
        F.when(F.coalesce(name, F.lit("")) == "", "missing_filename").when(ext == "", "missing_extension").when(~ext.isin(*(e.lower().lstrip(".") for e in extensions)), "extension_not_allowed")
        .when((size > most) if most > 0 else F.lit(False), "file_too_large").when(~allowed, "mime_not_allowed")
    )
    if path is not None:
        base = "/" + "/".join(p for p in folder.split("/") if p)
        out = out.when(~((folder_of(path) == base) | F.startswith(folder_of(path), F.lit(base.rstrip("/") + "/"))), "outside_folder")
    return out.otherwise("ok")


def content_hash(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes, 16 hex digits. It folds over the bytes' places, which are four bytes each: a text of 128 KB takes half a MB and some 0.1 s."""
    prime_low = 435  # the prime is 2^40 + 435
    raw = F.encode(text, "UTF-8")

    def step(h, i):
        x = h.bitwiseXOR(T.byte_at(raw, i).cast("long"))
        # x * (2^40 + 435) modulo 2^64, in signed longs: the shift drops what overflows, the product is taken in two halves
        low, high = x.bitwiseAND(F.lit(0xFFFFFFFF)) * prime_low, F.shiftrightunsigned(x, 32) * prime_low
        carried = F.shiftrightunsigned(low, 32) + high
        product = F.shiftleft(carried.bitwiseAND(F.lit(0xFFFFFFFF)), 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))
        shifted = F.shiftleft(x.bitwiseAND(F.lit(0xFFFFFF)), 40)
        # a sum without overflow: 63 bits, then the sign
        a, c = product.bitwiseAND(F.lit((1 << 62) - 1)), shifted.bitwiseAND(F.lit((1 << 62) - 1))
        part = a + c
        top = (F.shiftrightunsigned(product, 62) + F.shiftrightunsigned(shifted, 62) + F.shiftrightunsigned(part, 62)).bitwiseAND(F.lit(3))
        return F.shiftleft(top, 62).bitwiseOR(part.bitwiseAND(F.lit((1 << 62) - 1)))

    return F.lower(F.lpad(F.hex(F.aggregate(T.byte_places(raw), F.lit(1469598103934665603).cast("long"), step)), 16, "0"))


def memory(spark: SparkSession, rows: list[tuple], schema: str, key: str = "relative_path") -> DataFrame:
    """Rows that the driver holds as documents; of equal keys the first stays."""
    held: dict = {}
    at = spark.createDataFrame([], schema).columns.index(key)
    for r in rows:
        held.setdefault(r[at], r)
    return spark.createDataFrame(list(held.values()), schema)


def appended(docs: DataFrame, more: DataFrame, key: str = "relative_path") -> DataFrame:
    """docs and those of more whose key isn't there; of equal new keys the least row stays."""
    whole = F.struct(*(F.col(c) for c in docs.columns if c != key))
    new = more.join(docs, key, "left_anti").groupBy(key).agg(F.min(whole).alias("row")).select(key, "row.*")
    return docs.unionByName(new)


DELIMITERS = (",", ";", "\t", "|")


def delimiter_of(text: Column) -> Column:
    """Of , ; tab and | the one that the first record has most of outside quotes; the first of equal ones, a comma if it has none."""
    bare = F.regexp_replace(F.regexp_extract(text, r'\A((?:"(?:[^"]|"")*"|[^"\r\n])*)', 1), r'"(?:[^"]|"")*"', "")
    counts = F.array(*(F.struct((F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit("")))).alias("n"), F.lit(-i).alias("turn"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)))
    return F.array_max(counts)["d"]


def csv_fields(record: Column, delimiter: Column) -> Column:
    """A record's fields: quoted ones without their quotes, doubled quotes single."""
    d = F.concat(F.lit(r"\Q"), delimiter, F.lit(r"\E"))
    marked = F.regexp_replace(record, F.concat(d, F.lit(r'(?=(?:[^"]*"[^"]*")*[^"]*$)')), F.lit("\x01"))
    return F.transform(F.split(marked, "\x01"), lambda f: F.replace(F.regexp_replace(f, r'(?s)^\s*"(.*)"\s*$', "$1"), F.lit('""'), F.lit('"')))


def csv_records(text: Column) -> Column:
    """A text's records: line ends inside quotes don't end one."""
    return F.filter(F.regexp_extract_all(text, F.lit(r'((?:"(?:[^"]|"")*"|[^"\r\n])+)'), 1), lambda r: F.trim(r) != "")


def has_header(records: Column, delimiter: Column) -> Column:
    """The first record is a header if its fields are all there, different, and texts, and another record follows."""
    first = csv_fields(F.try_element_at(records, F.lit(1)), delimiter)
    plain = F.forall(first, lambda f: cell_kind(f) == "Text")
    return F.coalesce((F.size(records) > 1) & plain & (F.size(F.array_distinct(F.transform(first, lambda f: F.lower(F.trim(f))))) == F.size(first)), F.lit(False))


def csv_rows(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row, cells): each file's rows from 1 as maps of column to cell, the delimiter and header found in the file itself.

    Columns without a header are named A, B, ... as in a spreadsheet. A file is parsed in its own row; large ones belong to spark.read.csv.
    """
    made = files.select(key, csv_records(F.col(text)).alias("r"), delimiter_of(F.col(text)).alias("d")).withColumn("h", has_header(F.col("r"), F.col("d")))
    names = F.when(F.col("h"), F.transform(csv_fields(F.col("r")[0], F.col("d")), lambda f: F.trim(f)))
    body = F.when(F.col("h"), F.slice("r", 2, F.size("r"))).otherwise(F.col("r"))
    rows = made.select(key, "d", names.alias("names"), F.posexplode(body).alias("row", "record")).withColumn("cells", csv_fields(F.col("record"), F.col("d")))
    named = F.transform("cells", lambda c, i: F.struct(F.coalesce(F.try_element_at("names", i + 1), column_letters(i)).alias("name"), F.trim(c).alias("cell")))
    return rows.select(key, (F.col("row") + 1).alias("row"), F.map_from_entries(named).alias("cells"))


def column_letters(index: Column) -> Column:
    """0: A, 25: Z, 26: AA, and so on, up to seven letters."""
    start = F.struct((index.cast("long") + 1).alias("n"), F.lit("").alias("s"))
    step = lambda acc, _: F.when(acc["n"] > 0, F.struct(F.floor((acc["n"] - 1) / 26).alias("n"), F.concat(F.chr(65 + (acc["n"] - 1) % 26), acc["s"]).alias("s"))).otherwise(acc)
    return F.aggregate(F.sequence(F.lit(1), F.lit(7)), start, step, lambda acc: acc["s"])


def markdown_pairs(files: DataFrame) -> DataFrame:
    """Front matter between --- lines as title, category, aliases; the first file of a title stays."""
    head = F.regexp_extract("content", r"(?s)^---\r?\n(.*?)\r?\n---\r?\n", 1)
    get = lambda k: F.trim(F.regexp_extract(head, rf"(?m)^{k}:[ \t]*(.*?)[ \t]*$", 1))
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    title = F.when(get("title") != "", get("title")).otherwise(name)
    category = F.when(get("category") != "", get("category")).otherwise("general")
    aliases = F.filter(F.transform(F.split(get("aliases"), ","), lambda x: F.trim(x)), lambda x: x != "")
    pairs = files.select("path", title.alias("title"), category.alias("category"), aliases.alias("aliases"), F.regexp_replace("content", r"(?s)^---\r?\n.*?\r?\n---\r?\n", "").alias("body"))
    return pairs.groupBy(F.lower("title").alias("key")).agg(F.min_by(F.struct("title", "category", "aliases", "body", "path"), "path").alias("x")).select("x.*")


def cell_kind(c: Column) -> Column:
    """Empty, formula, boolean, integer, number, date or text, tested in that order."""
    s = F.trim(c)
    return (
        F.when(s.isNull() | (s == ""), "Empty").when(s.startswith("="), "Formula").when(F.lower(s).isin("true", "false"), "Boolean")
        .when(s.rlike(r"^[+-]?\d+$"), "Integer").when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), "Number")
        .when(s.rlike(r"^\d{4}-\d{2}-\d{2}$|^\d{2}[./]\d{2}[./]\d{4}$"), "Date").otherwise("Text")
    )


def profile(rows: DataFrame) -> DataFrame:
    """Counts of cell kinds by column, and the merged kind: equal kinds stay, integers and numbers are numbers, others mix."""
    cells = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("col"), cell_kind(F.col(c).cast("string")).alias("kind")) for c in rows.columns))).alias("x")).select("x.*")
    counts = cells.groupBy("col", "kind").agg(F.count("*").alias("n"))
    kinds = F.array_except(F.collect_set("kind"), F.array(F.lit("Empty")))
    merged = counts.groupBy("col").agg(kinds.alias("k"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("counts"))
    number = F.size(F.array_except("k", F.array(F.lit("Integer"), F.lit("Number")))) == 0
    return merged.select("col", "counts", F.when(F.size("k") == 0, "Empty").when(F.size("k") == 1, F.col("k")[0]).when(number, "Number").otherwise("Mixed").alias("merged"))
