"""Markdown blocks: which lines make up headings, code, lists, quotes, tables and paragraphs.

One pass over a document's lines keeps the open block: a fence with its
character and length, a list or quote with its content, a paragraph that an
underline may still turn into a heading. Blocks inside of lists and quotes
belong to these. HTML blocks and link definitions are paragraphs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import exploded, lines, trim_space

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)\Z", re.S)
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]|\Z)")
_BREAK = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})\Z")
_UNDER = re.compile(r" {0,3}(=+|-+)[ \t]*\Z")
_ITEM = re.compile(r" {0,3}(?:[-*+]|[0-9]{1,9}[.)])(?:[ \t]|\Z)")
_QUOTE = re.compile(r" {0,3}>")
_RULE = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*\Z")
_LINE = pa.struct([("block", pa.int32()), ("kind", pa.string()), ("level", pa.int32()), ("fence", pa.int32())])


def _front(rows: list[str]) -> int:
    """How many lines the front matter takes: from a rule on the first line to the next one, with a line between."""
    if len(rows) > 2 and rows[0].rstrip() == "---":
        return next((i + 1 for i in range(2, len(rows)) if rows[i].rstrip() == "---"), 0)
    return 0


def _blocks(rows: list[str]) -> list[dict]:
    out: list[dict] = []
    block, kind, fence, quoted = 0, "", "", False  # the open block, and whether a quote's or list's paragraph goes on
    head = _front(rows)

    def add(new: bool, of: str, level: int = 0, mark: int = 0) -> None:
        nonlocal block, kind
        block += new
        kind = of
        out.append({"block": block, "kind": of, "level": level, "fence": mark})

    for i, raw in enumerate(rows):
        line = raw.rstrip("\r")
        if i < head:
            add(i == 0, "front")
            kind = "" if i == head - 1 else "front"
            continue
        if fence:
            found = _FENCE.match(line)
            ends = bool(found) and found[1][0] == fence[0] and len(found[1]) >= len(fence) and not found[2].strip()
            add(False, "code", 0, 2 if ends else 0)
            if ends:
                fence, kind = "", ""
            continue
        if not line.strip():
            inside = kind in ("list", "indented")
            out.append({"block": block if inside else 0, "kind": "blank", "level": 0, "fence": 0})
            quoted = False
            kind = kind if inside else ""
            continue
        deep = line.startswith(("    ", "\t"))
        if kind == "list" and (line.startswith(("  ", "\t")) or (_ITEM.match(line) and not _BREAK.match(line))):
            add(False, "list")
            quoted = True
            continue
        if deep and kind not in ("paragraph", "table") and not (quoted and kind in ("list", "quote")):
            add(kind != "indented", "indented")
            continue
        opens, atx = _FENCE.match(line), _ATX.match(line)
        if opens and not (opens[1][0] == "`" and "`" in opens[2]):
            fence = opens[1]
            add(True, "code", 0, 1)
        elif atx:
            add(True, "heading", len(atx[1]))
            kind = ""
        elif kind == "paragraph" and _UNDER.match(line):
            level = 1 if line.strip()[0] == "=" else 2
            for o in out:
                if o["block"] == block and o["kind"] == "paragraph":
                    o["kind"], o["level"] = "heading", level
            add(False, "heading", level)
            kind = ""
        elif _BREAK.match(line):
            add(True, "break")
            kind = ""
        elif _QUOTE.match(line):
            add(kind != "quote", "quote")
            quoted = True
        elif _ITEM.match(line) and not (kind == "paragraph" and not re.match(r" {0,3}(?:[-*+]|1[.)])[ \t]+\S", line)):
            add(True, "list")
            quoted = True
        elif quoted and kind in ("quote", "list"):  # the paragraph inside goes on
            add(False, kind)
        elif kind == "table" and "|" in line:
            add(False, "table")
        elif "|" in line and i + 1 < len(rows) and "|" in rows[i + 1] and _RULE.match(rows[i + 1].rstrip("\r")) and kind != "paragraph":
            add(True, "table")
        else:
            add(kind != "paragraph", "paragraph")
    return out


def line_blocks(rows: Column) -> Column:
    """(block, kind, level, fence) of each line of an array: the number and kind of its block, a heading's level, 1 and 2 for lines that open and close a fence.

    Kinds: heading, code (fenced), indented, list, quote, table, paragraph,
    break, front, blank.
    """

    @F.arrow_udf("array<struct<block:int,kind:string,level:int,fence:int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            yield pa.array([None if x is None else _blocks([y or "" for y in x]) for x in lists.to_pylist()], pa.list_(_LINE))

    return run.asNondeterministic()(rows)


def elements(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row for each block of each text: element (from 0), type, level, language, content, line_start, line_end.

    Types: heading, code, list, quote, table, paragraph. Code is without its
    fences or margin, a heading without its marks; rules and front matter have
    no row. Null texts have none.
    """
    rest = [c for c in docs.columns if c != text]
    found = docs.where(F.col(text).isNotNull()).withColumn("__l", lines(text)).withColumn("__b", line_blocks(F.col("__l")))
    joined = F.filter(F.transform(F.arrays_zip(F.col("__l").alias("line"), F.col("__b").alias("b")), lambda x, i: F.struct(x["line"].alias("line"), x["b"].alias("b"), (i + 1).alias("n"))), lambda x: x["b"]["block"] > 0)
    found = found.withColumn("__x", joined)
    first = F.filter(F.transform("__x", lambda x, i: F.struct(i.alias("i"), x["b"]["block"].alias("block"), x["b"]["kind"].alias("kind"), x["b"]["level"].alias("level"))), lambda s: (s["i"] == 0) | (F.get(F.col("__x"), s["i"] - 1)["b"]["block"] != s["block"]))
    found = found.withColumn("__s", first)

    def element(s: Column, k: Column) -> Column:
        end = F.coalesce(F.get(F.col("__s"), k + 1)["i"], F.size("__x"))
        return F.struct(s["kind"].alias("kind"), s["level"].alias("level"), F.slice("__x", s["i"] + 1, end - s["i"]).alias("own"))

    found = exploded(found, rest, F.filter(F.transform("__s", element), lambda e: ~e["kind"].isin("break", "front")), "element", "e")
    # blank lines at the end of a list or of indented code are no part of it
    size = F.col("e.own")
    filled = F.array_max(F.transform(size, lambda x, i: F.when(x["b"]["kind"] != "blank", i + 1)))
    found = found.withColumn("own", F.slice("e.own", F.lit(1), filled))
    own = F.col("own")
    plain = lambda test=None: F.array_join(F.transform(F.filter(own, test) if test else own, lambda x: x["line"]), "\n")
    atx = F.regexp_replace(F.regexp_replace(own[0]["line"], r"\A {0,3}#+[ \t]*", ""), r"(?:\A|[ \t])#+[ \t]*\r?\z", "")
    setext = F.array_join(F.transform(F.slice(own, F.lit(1), F.size(own) - 1), lambda x: trim_space(x["line"])), " ")
    heading = F.when(F.size(own) > 1, setext).otherwise(trim_space(atx))
    code = F.when(F.col("e.kind") == "code", plain(lambda x: x["b"]["fence"] == 0)).otherwise(F.array_join(F.transform(own, lambda x: F.regexp_replace(x["line"], r"\A(?: {4}|\t)", "")), "\n"))
    is_code = F.col("e.kind").isin("code", "indented")
    language = F.when(F.col("e.kind") == "code", F.nullif(F.regexp_extract(own[0]["line"], r"\A *(?:`+|~+)[ \t]*([^\s`]*)", 1), F.lit("")))
    return found.select(
        *rest, "element", F.when(is_code, "code").otherwise(F.col("e.kind")).alias("type"), F.col("e.level").alias("level"), language.alias("language"),
        F.when(is_code, code).when(F.col("e.kind") == "heading", heading).otherwise(plain()).alias("content"), own[0]["n"].alias("line_start"), F.element_at(own, -1)["n"].alias("line_end"),
    )
