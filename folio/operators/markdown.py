"""Markdown by lines: fences, headings, sections, tables, lists, front matter, statistics.

Headings and fences are those that the pass over blocks finds; statistics look at
each line by itself. Nesting comes from heading levels alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.nesting import nested
from folio.functions.text import WHITE, col, count_of, exploded, lines, staged, title_name, trim_space
from folio.operators import mdblocks

_SEPARATOR = rf"\A\|?([{WHITE}]*:?-+:?[{WHITE}]*\|)+[{WHITE}]*:?-+:?[{WHITE}]*\|?\z"


def is_table_row(line: Column) -> Column:
    """Two pipes or more with a separator pattern or something between them."""
    t = trim_space(line)
    return (F.octet_length(t) >= 3) & (count_of(t, "|") >= 2) & (t.rlike(_SEPARATOR) | t.rlike(rf"[^|{WHITE}]"))


def is_list_item(line: Column) -> Column:
    return trim_space(line).rlike(rf"\A(?:[-*+] |[0-9]+\.[{WHITE}]+)")


def is_code_worth_splitting(content: Column, most: int = 50) -> Column:
    """A code block of over ``most`` lines, or one that holds a whole function or class by its keywords."""
    low = F.lower(content)
    words = low.rlike(r"func |function |class |def |public static void main|module\.exports") | (F.contains(low, F.lit("const ")) & F.contains(low, F.lit("async")))
    return (F.size(lines(content)) > most) | words


def front_matter(text: str | Column) -> Column:
    """The lines between '---' on the first line and the next one; null without them."""
    found = F.regexp_extract(col(text), r"\A---[ \t]*\r?\n((?s:.+?))\r?\n---[ \t]*(?:\r?\n|\z)", 1)
    return F.when(found != "", found)


def front_value(text: str | Column, key: str) -> Column:
    """A top-level ``key: value`` of the front matter, quotes taken off."""
    found = F.regexp_extract(F.coalesce(front_matter(text), F.lit("")), rf"(?m)^{key}:[ \t]*[\"']?([^\r\n]*?)[\"']?[ \t]*$", 1)
    return F.when(found != "", found)


def front_values(text: str | Column) -> Column:
    """All top-level ``key: value`` lines of the front matter as a map, quotes taken off; of a repeated key the last."""
    found = F.filter(lines(F.coalesce(front_matter(text), F.lit(""))), lambda x: x.rlike(r"\A[A-Za-z0-9_-]+:"))
    value = lambda x: F.regexp_extract(x, r"\A[A-Za-z0-9_-]+:[ \t]*[\"']?(.*?)[\"']?[ \t\r]*\z", 1)
    pairs = F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"\A([A-Za-z0-9_-]+):", 1).alias("key"), value(x).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def line_table(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each line with ``in_code`` (an opening fence counts, its closing one doesn't), ``level`` and ``title`` of headings.

    Headings begin with signs or are underlined; they and fences are those of
    the text itself, not of its lists and quotes. An underlined heading of
    several lines counts at its first one.
    """
    rest = [c for c in docs.columns if c != text]
    made = exploded(_with_lines(docs, rest, text), rest, F.col("__rows"), "__i", "x").select(*rest, "x.line_no", "x.line", "x.is_fence", "x.in_code", "x.level")
    return made.withColumn("title", F.when(F.col("level") > 0, _heading("line")))


def _heading(line: str | Column) -> Column:
    return trim_space(F.regexp_replace(col(line), rf"\A {{0,3}}#+[{WHITE}]+|[{WHITE}]+#+[{WHITE}]*\z", ""))


def _with_lines(docs: DataFrame, kept: list[str], text: str) -> DataFrame:
    """``kept`` of ``docs`` with __rows: a struct for each line of each text."""
    found = docs.withColumn("__l", lines(text)).withColumn("__b", mdblocks.line_blocks(F.col("__l")))
    both = F.arrays_zip(F.col("__l").alias("line"), F.col("__b").alias("b"))
    starts = lambda x, i: (i == 0) | (F.get(F.col("__b"), i - 1)["block"] != x["b"]["block"])
    rows = F.transform(both, lambda x, i: F.struct(
        (i + 1).alias("line_no"), x["line"].alias("line"), (x["b"]["fence"] > 0).alias("is_fence"), ((x["b"]["kind"] == "code") & (x["b"]["fence"] < 2)).alias("in_code"),
        F.when((x["b"]["kind"] == "heading") & starts(x, i), x["b"]["level"]).otherwise(0).alias("level"),
    ))
    return found.select(*kept, rows.alias("__rows"))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Lines, code blocks, code lines and their percentage, table rows and list items of each document, row by row."""
    state = "struct<inside:boolean,blocks:int,code:int>"
    start = F.struct(F.lit(False).alias("inside"), F.lit(0).alias("blocks"), F.lit(0).alias("code")).cast(state)

    def step(s: Column, line: Column) -> Column:
        fence = trim_space(line).startswith("```")
        inside = F.when(fence, ~s["inside"]).otherwise(s["inside"])
        return F.struct(inside.alias("inside"), (s["blocks"] + F.when(fence & ~s["inside"], 1).otherwise(0)).alias("blocks"), (s["code"] + F.when(inside, 1).otherwise(0)).alias("code")).cast(state)

    out = docs.withColumn("__lines", lines(text)).withColumn("__s", F.aggregate("__lines", start, step))
    return out.select(
        *(c for c in docs.columns if c != text),
        F.size("__lines").alias("total_lines"),
        F.size(F.filter("__lines", lambda x: x.rlike(rf"\A#{{1,6}}[{WHITE}]+"))).alias("heading_count"),
        F.col("__s.blocks").alias("code_block_count"),
        F.col("__s.code").alias("code_lines"),
        F.floor(F.col("__s.code") * 100 / F.size("__lines")).cast("int").alias("code_percentage"),
        F.size(F.filter("__lines", is_table_row)).alias("table_rows"),
        F.size(F.filter("__lines", is_list_item)).alias("list_count"),
    )


def chunk_markdown(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str = "path") -> DataFrame:
    """A chunk for each heading's own lines, one for what precedes the first, and one for each code block worth splitting off.

    ``parent_context`` names the chain of headings above; ``context_level`` is
    the heading's level. A document without headings is one ``document`` chunk.
    Row by row: no line crosses a shuffle, and the text is gone over once.
    """
    rest = [c for c in docs.columns if c != text]
    named = docs.where(trim_space(text) != "").withColumn("__title", title(text, path))
    found = _with_lines(named, [*rest, "__title"], text)
    # A document's lines in parts that begin at its first line, at headings and at opening fences; a block of code is in one part.
    cuts = F.transform("__rows", lambda x, i: F.struct(i.alias("i"), x["level"].alias("level"), (x["is_fence"] & x["in_code"]).alias("opens")))
    found = found.withColumn("__cuts", F.filter(cuts, lambda c: (c["i"] == 0) | (c["level"] > 0) | c["opens"]))
    found = found.withColumn("__parts", staged(F.col("__cuts"), _part_lines, _part_code, _part_kept))
    heads = F.transform("__parts", lambda p, j: F.struct(j.alias("j"), p["level"].alias("level"), F.when(p["level"] > 0, _heading(p["own"][0]["line"])).alias("title")))
    found = found.withColumn("__heads", F.filter(heads, lambda h: (h["j"] == 0) | (h["level"] > 0)))
    found = found.withColumn("__nested", nested(F.transform("__heads", lambda h: F.struct(h["level"].alias("level"), F.lit(None).cast("string").alias("name"), F.lit(False).alias("opaque"), F.lit(False).alias("passing")))))
    sections = F.filter(F.transform(staged(F.col("__heads"), _section_lines, *(_above(n) for n in range(1, 6))), _section_chunk), lambda c: c["content"] != "")
    numbered = F.transform(F.filter("__parts", lambda p: p["opens"]), lambda p, k: F.struct((k + 1).alias("block"), p.alias("p")))
    blocks = F.transform(F.filter(numbered, lambda b: b["p"]["worth"]), _block_chunk)
    return exploded(found, rest, F.concat(sections, blocks), "__k", "c").select(*rest, "c.*")


_CHUNK = "struct<content:string,line_start:int,line_end:int,type:string,identifier:string,parent_context:string,context_level:int,language:string>"


def _joined(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda x: x["line"]), "\n")


def _is_code(x: Column) -> Column:
    return x["in_code"] | x["is_fence"]


def _part_lines(c: Column, j: Column) -> dict[str, Column]:
    return {"own": F.slice("__rows", c["i"] + 1, F.coalesce(F.get(F.col("__cuts"), j + 1)["i"], F.size("__rows")) - c["i"])}


def _part_code(p: Column, _: Column) -> dict[str, Column]:
    code = F.when(p["opens"], F.filter(p["own"], _is_code))
    return {"code": code, "content": _joined(F.filter(code, lambda x: ~x["is_fence"]))}


def _part_kept(p: Column, _: Column) -> dict[str, Column]:
    worth = p["opens"] & is_code_worth_splitting(p["content"])
    return {"worth": worth, "kept": F.when(worth, F.filter(p["own"], lambda x: ~_is_code(x))).otherwise(p["own"])}


def _section_lines(h: Column, k: Column) -> dict[str, Column]:
    """The lines of a section's parts, and the place of the heading above."""
    parts = F.slice("__parts", h["j"] + 1, F.coalesce(F.get(F.col("__heads"), k + 1)["j"], F.size("__parts")) - h["j"])
    return {"own": F.flatten(F.transform(parts, lambda p: p["kept"])), "up1": F.get(F.col("__nested"), k)["parent"]}


def _above(n: int):
    return lambda h, _: {f"up{n + 1}": F.get(F.col("__nested"), h[f"up{n}"])["parent"]}


def _section_chunk(h: Column) -> Column:
    own = h["own"]
    chain = F.filter(F.array(*(F.get(F.col("__heads"), h[f"up{n}"])["title"] for n in range(6, 0, -1))), lambda x: x.isNotNull())
    return F.struct(
        trim_space(_joined(own)),
        F.get(own, F.lit(0))["line_no"],
        F.get(own, F.size(own) - 1)["line_no"],
        F.when(h["level"] > 0, "section").otherwise("document"),
        F.coalesce(h["title"], F.col("__title")),
        F.array_join(chain, " > "),
        h["level"],
        F.lit(None),
    ).cast(_CHUNK)


def _block_chunk(b: Column) -> Column:
    p = b["p"]
    language = F.regexp_extract(p["own"][0]["line"], r"(?:`{3,}|~{3,})[ \t]*([A-Za-z0-9_+#-]*)", 1)
    return F.struct(
        p["content"],
        p["code"][0]["line_no"],
        F.get(p["code"], F.size(p["code"]) - 1)["line_no"],
        F.lit("code_block"),
        F.concat(F.col("__title"), F.lit(" - code "), b["block"].cast("string")),
        F.lit(""),
        F.lit(0),
        F.nullif(language, F.lit("")),
    ).cast(_CHUNK)


def title(text: str | Column, path: str | Column) -> Column:
    """The front matter's title, else the first level-one heading, else one made of the file's name."""
    first = F.regexp_extract(col(text), rf"(?m)^#[ \t]+([^\r\n]*?)[ \t#]*$", 1)
    return F.coalesce(front_value(text, "title"), F.when(first != "", first), title_name(path))


def code_languages(text: str | Column) -> Column:
    """Languages named by fences, distinct, in the order in which they appear."""
    return F.array_distinct(F.filter(F.regexp_extract_all(col(text), F.lit(r"(?m)^[ \t]*```([A-Za-z0-9_+#-]+)"), F.lit(1)), lambda x: x != ""))
