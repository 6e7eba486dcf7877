"""Documents: exact duplicates, chunks, history, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of_equal(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The smallest key of each content: one aggregation by digest, no window over a hot content."""
    return docs.groupBy(F.md5(F.col(text)).alias("digest")).agg(F.min(key).alias(key), F.count("*").alias("copies"))


SPACE = r"[ \t\n\x0B\f\r]"


def steps(most: int, overlap: int) -> int:
    """Tokens between the starts of two windows."""
    return most - (most // 5 if overlap >= most else overlap)


def window_starts(n: Column, most: int, overlap: int) -> Column:
    """Where windows over n tokens begin; the last is the first that reaches the end; none for no token."""
    step = steps(most, overlap)
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), n - (most - step) - 1), F.lit(step))).otherwise(F.array().cast("array<int>"))


def with_(value: Column, fn) -> Column:
    """fn(value), with the value computed once."""
    return F.transform(F.array(value), fn)[0]


def carried(values: Column, step, first: Column) -> Column:
    """first, then what step(last, value) makes of each value in turn: one walk along the array."""
    start = F.struct(first.alias("last"), F.array(first).alias("all"))

    def more(acc, x):
        return with_(step(acc["last"], x), lambda y: F.struct(y.alias("last"), F.array_append(acc["all"], y).alias("all")))

    return F.aggregate(values, start, more, lambda acc: acc["all"])


def sums(values: Column) -> Column:
    """0 and the running sums of whole numbers."""
    return carried(values, lambda last, x: last + x, F.lit(0))


def chunk_plain(docs: DataFrame, key: str, text: str, most: int = 220, overlap: int = 40) -> DataFrame:
    """Windows of white-space tokens; stops with the first that reaches the end; an empty text has none.

    The windows are cut inside the row, so a row that leaves holds its own window only, never the whole text.
    """
    words = F.filter(F.split(F.col(text), SPACE + "+"), lambda w: w != "")
    cut = lambda w: F.transform(window_starts(F.size(w), most, overlap), lambda s, i: F.struct(i.alias("chunk"), s.alias("start"), F.slice(w, s + 1, most).alias("w")))
    made = docs.select(key, F.explode(with_(words, cut)).alias("x"))
    return made.select(key, "x.chunk", "x.start", F.size("x.w").alias("n_tokens"), F.md5(F.array_join("x.w", " ")).alias("digest"))


# Line patterns that begin a section, by kind of document.
HEADINGS = {
    "markdown": r"^\s{0,3}#{1,6}\s+\S",
    "word": r"^\s*Heading:\s",
    "slides": r"^\s*Slide\s+\d+\s*:",
}
# Lines that begin a symbol of code, with its kind, in the order of their trial; the first group is the name.
SYMBOLS = (
    (r"^\s*namespace\s+([A-Za-z_]\w*)", "namespace"),
    (r"^\s*class\s+([A-Za-z_]\w*)", "class"),
    (r"^\s*struct\s+([A-Za-z_]\w*)", "struct"),
    (r"^\s*enum\s+(?:class\s+)?([A-Za-z_]\w*)", "enum"),
    (r"^\s*def\s+([A-Za-z_]\w*)\s*\(", "function"),
    (r"^\s*async\s+def\s+([A-Za-z_]\w*)\s*\(", "function"),
    (r"^\s*(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)\s*\(", "function"),
    (r"^\s*(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>", "function"),
    (r"^\s*func\s+(?:\([^)]+\)\s*)?([A-Za-z_]\w*)\s*\(", "function"),
    (r"^\s*fn\s+([A-Za-z_]\w*)\s*\(", "function"),
    (r"^\s*impl\s+([A-Za-z_]\w*)", "impl"),
    (r"^\s*(?:public|private|protected|static|virtual|inline|constexpr|friend|\s)*[\w:<>\*&]+\s+([A-Za-z_~]\w*)\s*\([^;]*\)\s*(?:const\s*)?(?:\{|$)", "function"),
)
SCOPES = ("namespace", "class", "struct", "impl")
HEADINGS["code"] = "|".join(f"(?:{p})" for p, _ in SYMBOLS)


def section_array(text: Column, heading: str) -> Column:
    """(section, start line, title, content) structs: a section from each heading line on.

    Blank lines before the first heading belong to its section; other lines before it are a section of their own, with its first
    line as title. No text, no section.
    """

    def cut(lines, heads):
        first = F.coalesce(F.try_element_at(heads, F.lit(1)), F.size(lines))
        lead = F.size(F.filter(F.slice(lines, 1, first), lambda s: F.trim(s) != "")) > 0
        starts = F.when(lead | (F.size(heads) == 0), F.concat(F.array(F.lit(0)), heads)).otherwise(F.concat(F.array(F.lit(0)), F.slice(heads, 2, F.size(lines))))
        return with_(F.array_distinct(starts), lambda s: F.transform(s, lambda at, i: one(lines, at, F.coalesce(F.try_element_at(s, i + 2), F.size(lines)), i)))

    def one(lines, at, end, i):
        return with_(F.slice(lines, at + 1, end - at), lambda p: F.struct(i.alias("section"), at.alias("start"), F.element_at(F.concat(F.filter(p, lambda s: s.rlike(heading)), F.slice(p, 1, 1)), 1).alias("title"), F.array_join(p, "\n").alias("content")))

    lines = F.split(F.regexp_replace(text, r"\n\z", ""), "\n")
    heads = lambda w: F.filter(F.transform(w, lambda s, i: F.when(s.rlike(heading), i)), lambda i: i.isNotNull())
    return with_(lines, lambda w: with_(heads(w), lambda h: cut(w, h)))


def sections(docs: DataFrame, key: str, text: str, heading: str) -> DataFrame:
    """The sections of section_array that aren't blank, a row each; all cutting happens inside the document's row, and nothing is shuffled."""
    made = docs.filter(F.col(text) != "").select(key, F.explode(section_array(F.col(text), heading)).alias("x"))
    return made.select(key, "x.section", "x.start", "x.title", "x.content").filter(F.trim("content") != "")


def symbol_kind(line: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, kind in reversed(SYMBOLS):
        out = F.when(line.rlike(pattern), kind).otherwise(out)
    return out


def symbol_name(line: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, _ in reversed(SYMBOLS):
        out = F.when(line.rlike(pattern), F.regexp_extract(line, pattern, 1)).otherwise(out)
    return out


def code_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(section, start, symbol, kind, name, scope, content): sections from each symbol line on; symbol is that line, trimmed, of 120
    characters at most (null before the first); scope is the last namespace, class, struct or impl until there, as kind:name."""
    line = lambda x: F.when(x["title"].rlike(HEADINGS["code"]), x["title"])
    named = lambda x: F.struct(x.alias("x"), symbol_kind(line(x)).alias("kind"), symbol_name(line(x)).alias("name"))
    made = F.transform(section_array(F.col(text), HEADINGS["code"]), named)
    opened = lambda y: F.when(y["kind"].isin(*SCOPES), F.concat(y["kind"], F.lit(":"), y["name"]))
    scopes = lambda s: carried(F.transform(s, opened), lambda last, x: F.coalesce(x, last), F.lit(None).cast("string"))
    whole = with_(made, lambda s: with_(scopes(s), lambda o: F.transform(s, lambda y, i: F.struct(y.alias("y"), F.get(o, i + 1).alias("scope")))))
    out = docs.filter(F.col(text) != "").select(key, F.explode(whole).alias("z")).select(key, "z.y.x.section", "z.y.x.start", "z.y.x.title", "z.y.kind", "z.y.name", "z.scope", "z.y.x.content")
    return out.filter(F.trim("content") != "").select(key, "section", "start", F.when(F.col("kind").isNotNull(), F.left(F.trim("title"), F.lit(120))).alias("symbol"), "kind", "name", "scope", "content")


def ocr_region(metadata: Column) -> Column:
    """A scanned image is one section: its first region, or the whole image, and its caption."""
    region = F.coalesce(F.nullif(F.try_element_at(metadata, F.lit("ocr_region_0")), F.lit("")), F.lit("full_image"))
    return F.struct(region.alias("region"), F.try_element_at(metadata, F.lit("ocr_caption")).alias("caption"))


def chunks(docs: DataFrame, key: str, text: str, path: Column, strategy: str = "plain_text_token", most: int = 220, overlap: int = 40) -> DataFrame:
    """(key, path, content, metadata): every section of the strategy in windows of tokens, numbered through the document.

    The path gets `#chunk-i`; metadata says the chunk's document, number, count, strategy, tokens, budget, place (code points from, to)
    and the heading or symbol line of its section. most and overlap are what token_budget() made of the limits. Text between the
    first and last token of a window stays as it is.
    """
    overlap = min(overlap, most - 1)
    step = steps(most, overlap)
    kinds = {"markdown_heading": "markdown", "docx_heading": "word", "pptx_slide": "slides", "code_symbol": "code"}
    t = F.col(text)
    if strategy in kinds:
        heading = HEADINGS[kinds[strategy]]
        parts = F.transform(section_array(t, heading), lambda x: F.struct(F.when(x["title"].rlike(heading), F.trim(x["title"])).alias("title"), x["content"].alias("content")))
    elif strategy == "pdf_page":
        parts = F.transform(F.split(t, "\f"), lambda s, i: F.struct((i + 1).cast("string").alias("title"), s.alias("content")))
    else:
        parts = F.array(F.struct(F.lit(None).cast("string").alias("title"), t.alias("content")))
    # one character, a line or page break, stands between two sections
    placed = lambda a: with_(sums(F.transform(a, lambda x: F.length(x["content"]) + 1)), lambda n: F.transform(a, lambda x, i: F.struct(x["title"].alias("title"), x["content"].alias("content"), F.get(n, i).alias("at"))))
    parts = with_(parts, placed)
    size = lambda pieces: F.aggregate(pieces, F.lit(0), lambda n, p: n + F.length(p))

    def cut(part, pieces):
        before = F.length(F.regexp_extract(part["content"], rf"^({SPACE}*)", 1))
        block = F.transform(window_starts(F.size(pieces), most, overlap), lambda s: size(F.slice(pieces, s + 1, step)))
        return with_(sums(block), lambda upto: F.transform(window_starts(F.size(pieces), most, overlap), lambda s, i: made(part, F.slice(pieces, s + 1, most), part["at"] + before + F.get(upto, i))))

    def made(part, own, at):
        whole = F.regexp_replace(F.array_join(own, ""), SPACE + r"+\z", "")
        return F.struct(part["title"].alias("title"), whole.alias("content"), F.size(own).alias("n"), at.alias("at"))

    windows = F.flatten(F.transform(parts, lambda x: with_(F.regexp_extract_all(x["content"], F.lit(rf"([^ \t\n\x0B\f\r]+{SPACE}*)"), 1), lambda p: cut(x, p))))
    rows = docs.filter(t != "").select(F.col(key), path.alias("path"), windows.alias("w")).select(key, "path", F.size("w").alias("count"), F.posexplode("w").alias("i", "w"))
    text_of = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    entries = {
        "chunk_of": F.col("path"), "chunk_index": F.col("i"), "chunk_strategy": F.lit(strategy), "chunk_token_count": F.col("w.n"), "chunk_token_budget": F.lit(most),
        "chunk_count": F.col("count"), "chunk_char_start": F.col("w.at"), "chunk_char_end": F.col("w.at") + F.length("w.content"),
        "chunk_symbol" if strategy == "code_symbol" else "chunk_page" if strategy == "pdf_page" else "chunk_heading": F.col("w.title"),
    }
    metadata = F.map_filter(F.create_map(*(x for k, v in entries.items() for x in (F.lit(k), text_of(v)))), lambda k, v: v != "")
    return rows.select(key, F.concat("path", F.lit("#chunk-"), "i").alias("path"), F.col("w.content").alias("content"), metadata.alias("metadata"))


# The strategy of each type of document; others are plain text.
STRATEGIES = {"docx": "docx_heading", "pdf": "pdf_page", "pptx": "pptx_slide", "csv": "spreadsheet_table", "xlsx": "spreadsheet_table", "image": "image_ocr_region", "markdown": "markdown_heading", "code": "code_symbol"}


def strategy_of(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in STRATEGIES.items() for x in kv)), kind), F.lit("plain_text_token"))


def pages(docs: DataFrame, key: str, text: str, separator: str = "\f") -> DataFrame:
    """(page from 1, content) of the pages that aren't blank, without their `Page n:` labels."""
    cut = docs.select(key, F.posexplode(F.split(F.col(text), separator)).alias("page", "content"))
    content = F.trim(F.regexp_replace("content", r"^\s*Page\s+\d+:\s*", ""))
    return cut.select(key, (F.col("page") + 1).alias("page"), content.alias("content")).filter("content != ''")


def sheet_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(sheet, row, content) of `Row n: ...` lines; a `Sheet: name` line holds for the rows after it in its document."""
    lines = F.transform(F.split(F.col(text), "\n"), lambda s: F.trim(s))
    blocks = F.split(F.array_join(lines, "\n"), r"(?m)^(?=Sheet: )")
    block = docs.select(key, F.explode(blocks).alias("b"))
    name = F.regexp_extract("b", r"\ASheet: (.*)", 1)
    row = block.select(key, F.when(name != "", name).otherwise("Sheet").alias("sheet"), F.explode(F.filter(F.split("b", "\n"), lambda s: s.rlike(r"^Row\s+\d+:"))).alias("content"))
    return row.select(key, "sheet", F.regexp_extract("content", r"^Row\s+(\d+):", 1).cast("long").alias("row"), "content")


def token_budget(*limits: int) -> int:
    """The smallest positive limit, 1 at least."""
    return max(1, min((n for n in limits if n > 0), default=1))


def last_turns(turns: DataFrame, n: int = 6, roles: tuple[str, ...] = ("user", "assistant"), parts: int = 16) -> DataFrame:
    """The last n turns of each conversation, back = 1 for the last. Each of `parts` parts is cut to n first, so a very long conversation stays spread."""
    ranked = lambda df, keys: df.withColumn("back", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("turn"), F.desc("text")))).filter(F.col("back") <= n)
    some = turns.filter(F.col("role").isin(*roles)).withColumn("part", F.pmod(F.xxhash64("turn", "text"), F.lit(parts)))
    return ranked(ranked(some, ("conv_id", "part")).drop("part"), ("conv_id",))


def within_budget(rows: DataFrame, order: list, size: Column, budget: int, most: int = 15) -> DataFrame:
    """Rows of a ranked short list until the first that overflows the budget; that one and all after it go."""
    ranked = rows.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return ranked.withColumn("upto", F.sum(size).over(Window.orderBy("rank"))).filter(F.col("upto") <= budget)
