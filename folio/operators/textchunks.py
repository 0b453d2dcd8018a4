"""Plain text: line classes, sections, chunks and statistics.

Everything is one row-local expression over a document's lines: a document is
one row, so no line crosses a shuffle, however many documents there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import WHITE, bound, count_of, exploded, lines, stem, trim_space

#: What makes a trimmed line a heading.
HEADINGS = (rf"\A[A-Z][A-Z{WHITE}]+\z", rf"\A#+[{WHITE}]+.*\z", r"\A=+\z", r"\A-+\z", rf"\A[0-9]+\.[{WHITE}]+[A-Z].*\z", r"\A[A-Z][^.!?]*:\z")
#: What makes a trimmed line a list item.
LIST_ITEMS = (rf"\A[-*+][{WHITE}]+.*\z", rf"\A[0-9]+\.[{WHITE}]+.*\z", rf"\A[a-z]\)[{WHITE}]+.*\z", rf"\A[IVX]+\.[{WHITE}]+.*\z")
#: Fixed value: white space but for the space; the bounds around the rare ones are what most letters fail at.
_OTHER_WHITE = r"[\t\n\x0B\f\r\x{85}\x{A0}[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]]"


def _any(c: Column, patterns: tuple[str, ...]) -> Column:
    return c.rlike(r"(?s)\A(?:" + "|".join(p.removeprefix(r"\A") for p in patterns) + ")")  # one anchor: no other place is tried


def _words(trimmed: Column) -> Column:
    """The words of a trimmed text that isn't empty; many times faster than to count matches of a word."""
    return F.split(trimmed, rf"[{WHITE}]+", -1)


def word_count(trimmed: Column) -> Column:
    """The number of words of a trimmed text that isn't empty: one more than its spaces, where these stand alone and no other white space is met."""
    return F.when(F.contains(trimmed, F.lit("  ")) | trimmed.rlike(_OTHER_WHITE), F.size(_words(trimmed))).otherwise(count_of(trimmed, " ") + 1)


def is_heading(trimmed: Column) -> Column:
    """A heading by pattern, or a short line most of whose words begin with a capital, digit or sign (ASCII)."""
    capital = lambda w: w.rlike(r"\A[\x{00}-\x{60}\x{7B}-\x{7F}]")
    most = lambda words: F.size(words).between(1, 8) & (F.size(F.filter(words, capital)) > 0.6 * F.size(words))
    titled = F.when(F.octet_length(trimmed) < 60, bound(_words(trimmed), most)).otherwise(False)  # longer lines aren't split
    return (trimmed != "") & (_any(trimmed, HEADINGS) | titled)


def is_list_item(trimmed: Column) -> Column:
    return _any(trimmed, LIST_ITEMS)


def clean_heading(trimmed: Column) -> Column:
    """Without leading hashes and one trailing colon."""
    return trim_space(F.regexp_replace(F.regexp_replace(trimmed, rf"\A#+[{WHITE}]*", ""), r":\z", ""))


def line_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row for each line: ``line_no`` from 1, ``line``, ``trimmed``, ``kind`` (blank, heading, list_item, text)."""
    rows = exploded(docs, [c for c in docs.columns if c != text], lines(text), "line_no", "line")
    rows = rows.withColumn("line_no", F.col("line_no") + 1).withColumn("trimmed", trim_space("line"))
    trimmed = F.col("trimmed")
    return rows.withColumn("kind", F.when(trimmed == "", "blank").when(is_heading(trimmed), "heading").when(is_list_item(trimmed), "list_item").otherwise("text"))


def _classified(text: str) -> Column:
    """Lines as structs (line, kind) of one document."""

    def one(x: Column) -> Column:
        t = x["trimmed"]
        return F.struct(x["line"].alias("line"), F.when(t == "", "blank").when(is_heading(t), "heading").when(is_list_item(t), "list_item").otherwise("text").alias("kind"), t.alias("trimmed"))

    trimmed = F.transform(lines(text), lambda x: F.struct(x.alias("line"), trim_space(x).alias("trimmed")))  # trimmed once for all tests
    return F.transform(trimmed, one)


_SECTION = "struct<type:string,title:string,content:string,line_start:int,line_end:int>"
_STATE = f"struct<at:int,para:array<string>,para_end:int,open:{_SECTION},done:array<{_SECTION}>>"


def _section(kind: Column, title: Column, content: Column, start: Column, end: Column) -> Column:
    return F.struct(kind.alias("type"), title.alias("title"), content.alias("content"), start.cast("int").alias("line_start"), end.cast("int").alias("line_end")).cast(_SECTION)


def sections(text: str, mode: str = "full") -> Column:
    """The sections of a text as structs (type, title, content, line_start, line_end).

    Paragraphs under a heading belong to its section; others and list items
    stand alone. A section comes at the place where it ends. ``full`` keeps
    every heading's section, ``compat`` only the last one's.
    """
    none = F.lit(None)
    nothing = none.cast(_SECTION)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("para"), F.lit(0).alias("para_end"), nothing.alias("open"), F.array().cast(f"array<{_SECTION}>").alias("done")).cast(_STATE)

    def closed(s: Column) -> tuple[Column, Column]:
        """(open, done) once the current paragraph has ended."""
        joined = F.array_join(s["para"], "\n")
        has = F.size(s["para"]) > 0
        o = s["open"]
        grown = _section(o["type"], o["title"], F.when(o["content"] == "", joined).otherwise(F.concat(o["content"], F.lit("\n"), joined)), o["line_start"], F.greatest(o["line_end"], s["para_end"]))
        alone = _section(F.lit("paragraph"), none, joined, s["para_end"] - F.size(s["para"]) + 1, s["para_end"])
        return F.when(has & o.isNotNull(), grown).otherwise(o), F.when(has & o.isNull(), F.array_append(s["done"], alone)).otherwise(s["done"])

    def put(at: Column, para: Column, para_end: Column, opened: Column, done: Column) -> Column:
        return F.struct(at.alias("at"), para.alias("para"), para_end.alias("para_end"), opened.alias("open"), done.alias("done")).cast(_STATE)

    empty = F.array().cast("array<string>")

    def step(s: Column, x: Column) -> Column:
        at = s["at"] + 1
        opened, done = closed(s)
        kept = F.when(opened.isNotNull(), F.array_append(done, _section(opened["type"], opened["title"], opened["content"], opened["line_start"], at - 1))).otherwise(done) if mode == "full" else done
        heading = put(at, empty, F.lit(0), _section(F.lit("heading"), clean_heading(x["trimmed"]), F.lit(""), at, F.lit(0)), kept)
        item = put(at, empty, F.lit(0), opened, F.array_append(done, _section(F.lit("list_item"), none, x["line"], at, at)))
        blank = put(at, empty, F.lit(0), opened, done)
        text_ = put(at, F.array_append(s["para"], x["line"]), at, s["open"], s["done"])
        return F.when(x["kind"] == "blank", blank).when(x["kind"] == "heading", heading).when(x["kind"] == "list_item", item).otherwise(text_)

    def finish(s: Column) -> Column:
        opened, done = closed(s)
        return F.when(opened.isNotNull(), F.array_append(done, _section(opened["type"], opened["title"], opened["content"], opened["line_start"], s["at"]))).otherwise(done)

    return F.aggregate(_classified(text), start, step, finish)


def split_lines(content: Column, size: int | Column) -> Column:
    """Blocks of ``size`` lines as structs (k, content, from, to), blank ones left out; from and to count from 0."""
    parts = lines(content)
    count = F.ceil(F.size(parts) / size).cast("int")
    blocks = F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda k: F.struct(k.alias("k"), F.array_join(F.slice(parts, k * size + 1, size if isinstance(size, Column) else F.lit(size)), "\n").alias("content"), (k * size).alias("from"), (F.least((k + 1) * size, F.size(parts)) - 1).alias("to")),
    )
    return F.filter(blocks, lambda b: trim_space(b["content"]) != "")


def chunk_text(docs: DataFrame, text: str = "text", path: str = "path", max_lines: int = 0, min_bytes: int = 20, mode: str = "full") -> DataFrame:
    """Chunks of plain text: ``chunk_index``, content, line_start, line_end, type, identifier, section_type, title.

    Null and blank texts have none. Sections under ``min_bytes`` trimmed bytes
    are left out; where none is left, the text is one ``text_document``.
    """
    rest = [c for c in docs.columns if c != text]
    rows = docs.where(F.col(text).isNotNull() & (trim_space(text) != "")).withColumn("__all", sections(text, mode))
    kept = F.filter(F.transform("__all", lambda s, i: F.struct(i.alias("i"), s.alias("s"))), lambda x: F.octet_length(trim_space(x["s"]["content"])) >= min_bytes)
    none = F.lit(None).cast("string")
    whole = F.array(
        F.struct(
            F.col(text).alias("content"), F.lit(1).alias("line_start"), F.size(lines(text)).alias("line_end"), F.lit("text_document").alias("type"), F.initcap(F.replace(stem(path), F.lit("_"), F.lit(" "))).alias("identifier"), none.alias("section_type"), none.alias("title")
        )
    )

    def named(x: Column) -> Column:
        s = x["s"]
        label = F.when(s["type"] == "heading", "Section").when(s["type"] == "list_item", "List Item").otherwise("Paragraph")
        name = F.when(F.coalesce(s["title"], F.lit("")) != "", s["title"]).otherwise(F.concat(stem(path), F.lit(" - "), label, F.lit(" "), (x["i"] + 1).cast("string")))
        return F.struct(s["content"].alias("content"), s["line_start"].alias("line_start"), s["line_end"].alias("line_end"), F.lit("text_section").alias("type"), name.alias("identifier"), s["type"].alias("section_type"), s["title"].alias("title"))

    made = F.transform(kept, named)
    if max_lines > 0:
        made = F.flatten(F.transform(made, lambda c: F.when(c["line_end"] - c["line_start"] + 1 > max_lines, _parts(c, max_lines)).otherwise(F.array(c))))
    chosen = F.filter(F.array(made, whole), lambda x: F.size(x) > 0)[0]
    return exploded(rows, rest, chosen, "chunk_index", "c").select(*rest, "chunk_index", "c.*")


def _parts(c: Column, size: int) -> Column:
    return F.transform(
        split_lines(c["content"], size),
        lambda b: F.struct(
            b["content"].alias("content"),
            (c["line_start"] + b["from"]).cast("int").alias("line_start"),
            (c["line_start"] + b["to"]).cast("int").alias("line_end"),
            F.concat(c["type"], F.lit("_part")).alias("type"),
            F.concat(c["identifier"], F.lit(" (Part "), (b["k"] + 1).cast("string"), F.lit(")")).alias("identifier"),
            c["section_type"].alias("section_type"),
            c["title"].alias("title"),
        ),
    )


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with counts of lines, headings, list items, words and sentences, and ratios."""
    seen = docs.withColumn("__lines", F.transform(_classified(text), lambda x: F.struct(x["line"].alias("line"), x["trimmed"].alias("t"), (x["kind"] == "heading").alias("h"), is_list_item(x["trimmed"]).alias("i"))))
    some = F.filter("__lines", lambda x: x["t"] != "")
    count = lambda test: F.size(F.filter(some, test))
    out = seen.withColumns(
        {
            "total_lines": F.size("__lines"),
            "size_bytes": F.octet_length(text),
            "empty_lines": F.size("__lines") - F.size(some),
            "content_lines": F.size(some),
            "heading_count": count(lambda x: x["h"]),
            "list_items": count(lambda x: x["i"]),
            "long_lines": count(lambda x: F.octet_length(x["line"]) > 80),
            "short_lines": count(lambda x: (F.octet_length(x["line"]) <= 80) & (F.octet_length(x["t"]) < 20)),
            "word_count": F.aggregate(some, F.lit(0), lambda n, x: n + word_count(x["t"])),
            "sentence_count": F.regexp_count(text, F.lit("[.!?]+")),  # no run of marks goes on over a line's end
        }
    ).drop("__lines")
    structure = F.when(F.col("heading_count") > 0, "sectioned").when(F.col("list_items") > 0, "list_based").otherwise("simple")
    return out.withColumns(
        {
            "empty_line_ratio": F.round(F.col("empty_lines") / F.col("total_lines"), 2),
            "avg_words_per_line": F.when(F.col("word_count") > 0, F.round(F.col("word_count") / F.col("content_lines"), 1)),
            "document_structure": structure,
        }
    )


def document_type(path: str | Column) -> Column:
    """readme, license, changelog, log or todo by the file's name; null otherwise."""
    path = F.col(path) if isinstance(path, str) else path
    name = F.lower(F.regexp_replace(path, r"\.[^./]*\z", ""))
    has = lambda *words: name.rlike("|".join(words))
    return F.when(has("readme"), "readme").when(has("license"), "license").when(has("changelog", "history"), "changelog").when(has("log"), "log").when(has("todo", "task"), "todo")


def content_flags(text: str) -> dict[str, Column]:
    """Legal, instruction and version hints, a language hint, and the indentation style."""
    low = F.lower(F.col(text))
    any_of = lambda *words: low.rlike("|".join(w.replace(".", "[.]") for w in words))
    return {
        "has_legal_content": any_of("copyright", "license"),
        "has_instructions": any_of("installation", "getting started"),
        "has_version_info": any_of("version", "v1.", "release"),
        "english_hint": any_of("english", "en-us"),
        "indentation_style": F.when(count_of(text, "\t") > count_of(text, "    "), "tabs").otherwise("spaces"),
    }

