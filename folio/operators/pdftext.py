"""Text of paged documents: cleanup, sections, paragraphs, cutting of what is too long. Getting text out of PDF files is left to a given function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import WHITE, col, count_of, exploded, fields, is_blank, lines, sanitised, trim_space
from folio.storage import written

_BREAK = r"(?:\r\n|\r|\n){2,}"


def cleaned(text: str | Column) -> Column:
    """Runs of blanks as one, ligatures as letters, carriage returns as line feeds."""
    t = F.regexp_replace(col(text), r"\r\n?", "\n")
    for ligature, letters in {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}.items():
        t = F.replace(t, F.lit(ligature), F.lit(letters))
    return F.regexp_replace(t, r"[ \t]+", " ")


def is_section_header(line: str | Column) -> Column:
    """5 to 100 bytes and up to ten words: numbered, a chapter or section, or mostly capitals."""
    line = col(line)
    letters, upper = F.length(F.regexp_replace(line, r"[^\p{L}]", "")), F.length(F.regexp_replace(line, r"[^\p{Lu}]", ""))
    fits = F.octet_length(line).between(5, 100) & F.size(fields(line)).between(1, 10)
    named = line.rlike(rf"\A(?:[0-9]+\.|Chapter[{WHITE}]+[0-9]+|Section[{WHITE}]+[0-9]+)")
    return fits & (named | ((letters > 0) & (upper > 0.6 * letters)))


#: Patterns of section headers, in the order in which they are tried; letter case doesn't count.
SECTION_PATTERNS = (
    r"Chapter\s+[0-9]+\.?\s*.*",
    r"Section\s+[0-9]+\.?\s*.*",
    r"[0-9]+\.\s+[A-Z][^.]*",
    r"[A-Z][A-Z\s]{10,}",
    "Introduction",
    "Abstract",
    "Summary",
    "Conclusion",
    "References",
    "Bibliography",
    "Appendix",
)
#: What stands before each page's text in a document of several pages.
PAGE_MARKER = "--- Page "


def sections(docs: DataFrame, text: str = "text", min_bytes: int = 30) -> DataFrame:
    """A row for each section of ``min_bytes`` or more: section (from 1), title, content, line_start, line_end, start_page.

    The first pattern by which a document has any section decides its headers;
    without one, the header test of lines does. A section is what stands between
    its header's line and the next header; its page is that of the last page
    marker up to its header.
    """
    rest = [c for c in docs.columns if c != text]
    rows = docs.where(F.col(text).isNotNull()).withColumn("__l", F.transform(lines(text), lambda x: F.struct(x.alias("line"), trim_space(x).alias("t"))))

    def cut(is_header) -> Column:
        heads = F.filter(F.transform("__l", lambda x, i: F.when(is_header(x["t"]), i)), lambda i: i.isNotNull())

        def section(at: Column, k: Column, all_: Column) -> Column:
            end = F.coalesce(F.get(all_, k + 1), F.size("__l"))
            body = trim_space(F.array_join(F.transform(F.slice("__l", at + 2, end - at - 1), lambda x: x["line"]), "\n"))
            marks = F.filter(F.slice("__l", F.lit(1), at + 1), lambda x: x["t"].startswith(PAGE_MARKER))
            page = F.regexp_extract(F.coalesce(F.try_element_at(marks, F.lit(-1))["t"], F.lit("")), PAGE_MARKER + "([0-9]+)", 1).try_cast("int")
            return F.struct(F.get("__l", at)["t"].alias("title"), body.alias("content"), (at + 1).cast("int").alias("line_start"), (at + 1 + count_of(body, "\n")).cast("int").alias("line_end"), page.alias("start_page"))

        made = F.transform(F.array(heads), lambda h: F.transform(h, lambda at, k: section(at, k, h)))[0]
        return F.filter(made, lambda s: F.octet_length(s["content"]) >= min_bytes)

    some = lambda c: F.when(F.size(c) > 0, c)
    by_pattern = [some(cut(lambda t, p=p: t.rlike(rf"(?i)\A(?:{p})\z"))) for p in SECTION_PATTERNS]
    by_look = cut(lambda t: ~F.contains(t, F.lit(PAGE_MARKER.strip())) & is_section_header(t))
    found = exploded(rows, rest, F.coalesce(*by_pattern, by_look), "k", "s")
    return found.select(*rest, (F.col("k") + 1).alias("section"), "s.*")


def split_oversized(chunks: DataFrame, most: int = 500, min_bytes: int = 30) -> DataFrame:
    """Chunks of over ``most`` lines or bytes cut after the line with which a part reaches ``most`` of either; small parts are left out.

    ``identifier`` and ``type`` of parts get ``_split_k`` and ``_split``.
    """
    state = "struct<lines:int,bytes:int,ends:array<int>>"
    own = lines("content")
    total = F.size(own)
    start = F.struct(F.lit(0).alias("lines"), F.lit(0).alias("bytes"), F.array().cast("array<int>").alias("ends")).cast(state)

    def step(s: Column, x: Column) -> Column:
        n = s["lines"] + 1
        size = s["bytes"] + F.octet_length(x["line"]) + F.when(s["lines"] > 0, 1).otherwise(0)
        full = (n >= most) | (size >= most) | (x["k"] == total)
        return F.when(full, F.struct(F.lit(0).alias("lines"), F.lit(0).alias("bytes"), F.array_append(s["ends"], x["k"]).alias("ends"))).otherwise(F.struct(n.alias("lines"), size.alias("bytes"), s["ends"].alias("ends"))).cast(state)

    numbered = F.transform(own, lambda x, i: F.struct(x.alias("line"), (i + 1).cast("int").alias("k")))
    large = (F.octet_length("content") > most) | (F.col("line_end") - F.col("line_start") + 1 > most)
    rows = chunks.withColumn("__e", F.when(large, F.aggregate(numbered, start, step, lambda s: s["ends"])))

    def part(end: Column, k: Column) -> Column:
        first = F.coalesce(F.get(F.col("__e"), k - 1), F.lit(0))
        return F.struct(F.array_join(F.slice(own, first + 1, end - first), "\n").alias("content"), (F.col("line_start") + first).alias("line_start"), (F.col("line_start") + end - 1).alias("line_end"))

    parts = F.filter(F.transform("__e", part), lambda x: trim_space(x["content"]) != "")
    named = F.transform(parts, lambda x, k: F.struct(x["content"].alias("content"), x["line_start"].alias("line_start"), x["line_end"].alias("line_end"), F.concat("identifier", F.lit("_split_"), k.cast("string")).alias("identifier"), F.concat("type", F.lit("_split")).alias("type")))
    whole = F.array(F.struct("content", "line_start", "line_end", "identifier", "type"))
    rest = [c for c in chunks.columns if c not in ("content", "line_start", "line_end", "identifier", "type")]
    out = exploded(rows, rest, F.coalesce(named, whole), "__k", "c").select(*rest, "c.*")
    return out.where(F.octet_length(trim_space("content")) >= min_bytes)


def paragraphs(docs: DataFrame, text: str = "text", min_bytes: int = 20) -> DataFrame:
    """A row for each paragraph of ``min_bytes`` trimmed bytes or more: number, content, first and last line."""
    rest = [c for c in docs.columns if c != text]
    parts = F.split(F.regexp_replace(col(text), r"\r\n?", "\n"), _BREAK, -1)
    state = "struct<at:int,out:array<struct<n:int,content:string,line_start:int,line_end:int>>>"
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<n:int,content:string,line_start:int,line_end:int>>").alias("out")).cast(state)

    def step(s: Column, x: Column) -> Column:
        t = x["t"]
        row = F.struct(x["n"].alias("n"), t.alias("content"), s["at"].alias("line_start"), (s["at"] + count_of(t, "\n")).alias("line_end"))
        out = F.when(F.octet_length(t) >= min_bytes, F.array_append(s["out"], row)).otherwise(s["out"])
        return F.struct((s["at"] + count_of(x["p"], "\n") + 2).alias("at"), out.alias("out")).cast(state)

    numbered = F.transform(parts, lambda p, i: F.struct((i + 1).cast("int").alias("n"), p.alias("p"), trim_space(p).alias("t")))
    return exploded(docs, rest, F.aggregate(numbered, start, step, lambda s: s["out"]), "__k", "x").select(*rest, F.col("x.n").alias("paragraph"), "x.content", "x.line_start", "x.line_end")


#: Ends a page in a text that holds several.
PAGE_END = "\f"


def text_pages(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row for each page of texts in which a form feed ends a page: ``page`` from 1."""
    rest = [c for c in docs.columns if c != text]
    made = exploded(docs, rest, F.split(F.col(text), PAGE_END, -1), "__k", text)
    return made.withColumn("page", F.col("__k") + 1).drop("__k")


def likely_title(text: str | Column) -> Column:
    """Of the first five lines (the fifth with all that follows), the first of 11 to 149 trimmed bytes that is among the first two or mostly capitalised."""
    first = F.transform(F.split(col(text), "\n", 5), lambda x, i: F.struct(trim_space(x).alias("t"), i.alias("i")))

    def fits(x: Column) -> Column:
        words = fields(x["t"])
        capital = F.size(F.filter(words, lambda w: w.rlike(r"\A\p{Lu}")))
        return F.octet_length(x["t"]).between(11, 149) & ((x["i"] < 2) | (capital >= 0.6 * F.size(words)))

    return F.get(F.filter(first, fits), F.lit(0))["t"]


def pages_metadata(pages: DataFrame, text: str = "text", path: str = "path", page: str = "page") -> DataFrame:
    """(path, page_count, title): how many pages each document has, and what its first page is likely called."""
    return pages.groupBy(path).agg(F.max(page).cast("int").alias("page_count"), likely_title(F.min_by(text, page)).alias("title"))


def page_chunks(pages: DataFrame, text: str = "text", name: str = "path", page: str = "page", min_bytes: int = 20) -> DataFrame:
    """Paragraph chunks of pages with identifiers made of file, page and paragraph."""
    found = paragraphs(pages.withColumn(text, cleaned(text)), text, min_bytes)
    return found.withColumn("identifier", F.concat(sanitised(F.element_at(F.split(name, "/", -1), -1)), F.lit("_pg"), F.col(page).cast("string"), F.lit("_para"), F.col("paragraph").cast("string"))).withColumn("type", F.lit("paragraph"))


def paged_lines(pages: DataFrame, text: str = "text", path: str = "path", page: str = "page") -> DataFrame:
    """Cleaned pages that hold text, with ``first_line``: where a page's text begins in its document, in which a marker line stands before each page's."""
    some = pages.where(~is_blank(text)).withColumn(text, trim_space(cleaned(text)))
    before = Window.partitionBy(path).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    return some.withColumn("first_line", F.coalesce(F.sum(F.size(lines(text)) + 1).over(before), F.lit(0)).cast("int") + 2)


def chunk_document_pages(pages: DataFrame, text: str = "text", path: str = "path", page: str = "page", most: int = 500, min_bytes: int = 30) -> DataFrame:
    """From pages to chunks: a document's sections, or its pages' paragraphs where it has none; too large ones are cut, small ones left out.

    Columns: path, chunk_index, content, line_start, line_end, type, identifier,
    page. Lines are those of the document, in which a marker line stands before
    each page's text. Pages without text take no part; several rows of one page
    are in any order.
    """
    placed = paged_lines(pages, text, path, page).select(F.col(path).alias("path"), F.col(page).cast("int").alias("page"), F.col(text).alias("text"), "first_line")
    marker = F.concat(F.lit(PAGE_MARKER), F.col("page").cast("string"), F.lit(" ---\n"), F.col("text"))
    whole = placed.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first_line", marker.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    keep = ["path", "content", "line_start", "line_end", "type", "identifier", "page"]
    found = written(sections(whole, "text", min_bytes).select("path", "content", "line_start", "line_end", F.lit("document_section").alias("type"), sanitised("title").alias("identifier"), F.col("start_page").alias("page")), "sections")
    plain = placed.join(found.select("path").distinct(), "path", "left_anti")
    moved = [(F.col(c) + F.col("first_line") - 1).cast("int").alias(c) for c in ("line_start", "line_end")]
    parts = page_chunks(plain, min_bytes=min_bytes).select("path", "content", *moved, "type", "identifier", "page").select(*keep)
    made = split_oversized(found.select(*keep).unionByName(parts), most, min_bytes)
    order = Window.partitionBy("path").orderBy("line_start", "identifier")
    return made.withColumn("chunk_index", F.row_number().over(order) - 1).select("path", "chunk_index", "content", "line_start", "line_end", "type", "identifier", "page")


def read_pages(files: DataFrame, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, page, text) of files (path, content) by a function from a file's bytes to its pages' texts."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = [(p, k + 1, t) for p, c in zip(batch["path"], batch["content"], strict=True) for k, t in enumerate(extract(bytes(c)))]
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, page int, text string")
