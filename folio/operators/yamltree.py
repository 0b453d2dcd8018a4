"""YAML texts as node rows: paths, kinds and line ranges.

Lines become entries by expressions (an item for each dash, a key, or bare
text), whose columns give their levels; one pass over a document's entries tells
which holds which. Block scalars, and values in quotes or brackets that go on
over lines, hold what stands deeper than they do. A collection in brackets is
one node, with its number of items; its inner counts go into the statistics.
Complex keys (``? ``) are text. Of several documents the first is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.nesting import nested
from folio.functions.text import col, lines, staged

_START = r"\A(?:%[^\n]*\n|[ \t]*#[^\n]*\n|[ \t]*\n)*---(?=[ \t\n]|\z)[ \t]*"
_PROPERTIES = r"(?:[&!][^\s,\[\]{}]*(?:[ \t]+|\z))*"
_PLAIN = r"(?:[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[\-?:](?=\S)|\*(?=[^\s:]+[ \t]+:))(?:[^:#]|:(?=\S)|(?<=\S)#)*?"
_KEY = rf"\A{_PROPERTIES}(\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|{_PLAIN})[ \t]*:(?:[ \t]+|\z)(.*)\z"
_BLOCK = r"\A[|>][0-9+\-]*[ \t]*(?:#.*)?\z"
_QUOTED = r"\A(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*')[ \t]*(?:#.*)?\z"
#: Tokens of a collection in brackets: quoted texts, brackets, commas, colons before white space, comments, plain texts.
_FLOW = r"\"(?:[^\"\\]|\\.)*+\"|'(?:[^']|'')*+'|(?<=\s)#[^\n]*+|[\[\]{},]|:(?=[\s,\[\]{}])|(?<=[\"']):|(?:[^\s\[\]{},:]|:(?=[^\s,\[\]{}]))(?:[^\n\[\]{},:#]|:(?=[^\s,\[\]{}])|(?<=\S)#)*+"


def first_document(text: str | Column) -> Column:
    """(line, body): the number of lines before the first document's text, and that text."""
    t = col(text)
    head = F.regexp_extract(t, _START, 0)
    body = F.get(F.split(F.substring(t, F.length(head) + 1, F.length(t)), r"(?:\A|\n)(?:---|\.\.\.)(?=[ \t\n]|\z)", 2), F.lit(0))
    return F.struct((F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))).alias("line"), body.alias("body"))


_ENTRY = "struct<line:int,level:int,name:string,kind:string,value:string,opaque:boolean,passing:boolean>"


def _entry(line: Column, level: Column, name: Column, kind: str, value: Column, opaque: Column) -> Column:
    return F.struct(line.alias("line"), level.alias("level"), name.alias("name"), F.lit(kind).alias("kind"), value.alias("value"), opaque.alias("opaque"), F.lit(kind == "comment").alias("passing")).cast(_ENTRY)


def _entries(texts: Column) -> Column:
    """The entries of each line, outermost first: items by their dashes, then a key or bare text. The root comes before all."""
    no = F.lit(False)

    def shape(x: Column, i: Column) -> dict[str, Column]:
        return {
            "number": i + 1,
            "indent": F.length(F.regexp_extract(x["x"], r"\A( *)", 1)),
            "dashes": F.regexp_extract_all(F.regexp_extract(x["x"], r"\A *((?:-(?:[ \t]+|\z))*)", 1), F.lit(r"-(?:[ \t]+|\z)"), F.lit(0)),
        }

    def places(x: Column, _: Column) -> dict[str, Column]:
        before = lambda k: x["indent"] + F.aggregate(F.slice(x["dashes"], F.lit(1), k), F.lit(0), lambda s, d: s + F.length(d))
        return {"at": before(F.size(x["dashes"])), "columns": F.transform(x["dashes"], lambda _, k: before(k))}

    def parts(x: Column, _: Column) -> dict[str, Column]:
        return {"rest": F.substring(x["x"], x["at"] + 1, F.length(x["x"]))}

    def key(x: Column, _: Column) -> dict[str, Column]:
        return {"is_key": x["rest"].rlike(_KEY), "quoted": F.regexp_extract(x["rest"], _KEY, 1), "raw": F.btrim(F.regexp_replace(F.coalesce(F.nullif(F.regexp_extract(x["rest"], _KEY, 2), F.lit("")), F.when(x["rest"].rlike(_KEY), "").otherwise(x["rest"])), rf"\A{_PROPERTIES}", ""))}

    def value(x: Column, _: Column) -> dict[str, Column]:
        name = F.when(x["quoted"].rlike(r"\A[\"']"), F.substring(x["quoted"], F.lit(2), F.length(x["quoted"]) - 2)).otherwise(x["quoted"])
        return {"name": name, "value": F.when(x["raw"].rlike(r"\A[\"'\[{|>]"), x["raw"]).otherwise(F.regexp_replace(x["raw"], r"(?:\A|[ \t]+)#.*\z", ""))}

    def opens(x: Column, _: Column) -> dict[str, Column]:
        v = x["value"]
        return {"opaque": v.rlike(_BLOCK) | v.rlike(r"\A[\[{]") | (v.rlike(r"\A[\"']") & ~v.rlike(_QUOTED))}

    def made(x: Column) -> Column:
        n, inner = F.size(x["dashes"]), ~x["is_key"]
        last = lambda k: inner & (k == n - 1)
        items = F.transform(x["columns"], lambda c, k: _entry(x["number"], 2 * c + 1, F.lit(None), "item", F.when(last(k), x["value"]).otherwise(""), last(k) & x["opaque"]))
        closing = x["rest"].rlike(r"\A[\]}]")  # a bracket may close at its opener's column
        level = F.when(closing, 1 << 20).otherwise(2 * x["at"])
        own = F.when(x["is_key"], F.array(_entry(x["number"], level, x["name"], "key", x["value"], x["opaque"]))).when(n == 0, F.array(_entry(x["number"], level, F.lit(""), "text", x["value"], x["opaque"])))
        comment = F.array(_entry(x["number"], 2 * x["indent"], F.lit(""), "comment", F.lit(""), no))
        empty = F.array().cast(f"array<{_ENTRY}>")
        return F.when(x["x"].rlike(r"\A\s*\z"), empty).when(x["x"].rlike(r"\A\s*#"), comment).otherwise(F.concat(items, F.coalesce(own, empty)))

    shaped = staged(F.transform(texts, lambda x: F.struct(x.alias("x"))), shape, places, parts, key, value, opens)
    root = F.array(_entry(F.lit(0), F.lit(-1), F.lit(""), "root", F.lit(""), no))
    return F.concat(root, F.flatten(F.transform(shaped, made)))


def _folded(text: Column) -> Column:
    """Single line feeds between lines that begin at the margin as spaces, longer runs one shorter."""
    once = F.regexp_replace(text, r"(?<=[^\n])\n(?=[^\n \t])", " ")
    return F.regexp_replace(once, r"\n(\n+)(?=[^\n \t])", "$1")


def _flow(text: Column) -> Column:
    """Counts of a collection in brackets: items right in it, collections, keys and scalars in all, depth, and whether it closes."""
    tokens = F.filter(F.regexp_extract_all(text, F.lit(_FLOW), F.lit(0)), lambda t: ~t.startswith("#"))
    start = F.struct(*(F.lit(0).alias(c) for c in ("open", "deepest", "commas", "maps", "lists", "keys", "scalars", "aliases")), F.lit("").alias("before"))

    def step(s: Column, t: Column) -> Column:
        opens, closes = t.isin("[", "{"), t.isin("]", "}")
        now = s["open"] + opens.cast("int") - closes.cast("int")
        word = ~(opens | closes | t.isin(",", ":"))
        return F.struct(
            now.alias("open"),
            F.greatest(s["deepest"], now).alias("deepest"),
            (s["commas"] + ((t == ",") & (now == 1)).cast("int")).alias("commas"),
            (s["maps"] + (t == "{").cast("int")).alias("maps"),
            (s["lists"] + (t == "[").cast("int")).alias("lists"),
            (s["keys"] + (t == ":").cast("int")).alias("keys"),
            (s["scalars"] + (word & ~t.startswith("*")).cast("int")).alias("scalars"),
            (s["aliases"] + (word & t.startswith("*")).cast("int")).alias("aliases"),
            F.when(closes & (now == 0), s["before"]).otherwise(t).alias("before"),
        )

    def told(s: Column) -> Column:
        empty = (s["before"].isin("[", "{") & (s["commas"] == 0)).cast("int")
        last = (s["before"] == ",").cast("int")
        return F.struct((s["commas"] + 1 - empty - last).alias("n"), *(s[c] for c in ("deepest", "maps", "lists", "keys", "scalars", "aliases")), (s["open"] == 0).alias("closed"))

    return F.aggregate(tokens, start, step, told)


def _tree(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with __lines, __entries and __nested: a document's lines, entries and how these hold each other."""
    found = docs.withColumn("__d", first_document(F.col(text))).withColumn("__lines", lines("__d.body")).withColumn("__entries", _entries(F.col("__lines")))
    slim = F.transform("__entries", lambda e: F.struct(e["level"], F.when(e["kind"] != "item", e["name"]).alias("name"), e["opaque"], e["passing"]))
    return found.withColumn("__nested", nested(slim))


def _pairs() -> Column:
    """Entries that are something of their own: e, n (how they nest), i (their place)."""
    both = F.transform(F.arrays_zip(F.col("__entries").alias("e"), F.col("__nested").alias("n")), lambda x, i: F.struct(x["e"].alias("e"), x["n"].alias("n"), i.alias("i")))
    return F.filter(both, lambda x: x["n"]["parent"] > -2)


def _nodes() -> Column:
    """The root, keys and items of a document."""
    entry = lambda i: F.get(F.col("__entries"), i)

    def around(x: Column, _: Column) -> dict[str, Column]:
        return {"first": entry(x["n"]["first"]), "last": entry(x["n"]["last"])["line"]}

    def start(x: Column, _: Column) -> dict[str, Column]:
        below = (x["e"]["value"] == "") & F.coalesce(x["first"]["kind"] == "text", F.lit(False))  # the value begins on a line of its own
        return {"value": F.when(below, x["first"]["value"]).otherwise(x["e"]["value"]), "at": F.when(below, x["first"]["line"]).otherwise(x["e"]["line"])}

    def own(x: Column, _: Column) -> dict[str, Column]:
        v, first = x["value"], x["first"]["kind"]
        kind = F.when(v.startswith("*"), "alias").when(v.startswith("{"), "mapping").when(v.startswith("["), "sequence").when(v != "", "scalar").when(first == "item", "sequence").when(first == "key", "mapping").otherwise("scalar")
        nothing = F.array().cast("array<string>")
        return {"kind": kind, "more": F.when(v != "", F.slice("__lines", x["at"] + 1, F.greatest(x["last"] - x["at"], F.lit(0)))).otherwise(nothing), "is_block": v.rlike(_BLOCK)}

    def margin(x: Column, _: Column) -> dict[str, Column]:
        filled = F.filter(x["more"], lambda y: y.rlike(r"\S"))
        return {"margin": F.coalesce(F.array_min(F.transform(filled, lambda y: F.length(F.regexp_extract(y, r"\A( *)", 1)))), F.lit(0))}

    def joined(x: Column, _: Column) -> dict[str, Column]:
        block = F.array_join(F.transform(x["more"], lambda y: F.substring(y, x["margin"] + 1, F.length(y))), "\n")
        over = F.array_join(F.concat(F.array(x["value"]), F.transform(x["more"], lambda y: F.btrim(y))), "\n")
        return {"text": F.when(x["is_block"], block).otherwise(over)}

    def folded(x: Column, _: Column) -> dict[str, Column]:
        return {"text": F.when((x["kind"] == "scalar") & ~x["value"].startswith("|"), _folded(x["text"])).otherwise(x["text"]), "flow": F.when(x["kind"].isin("mapping", "sequence") & (x["value"] != ""), _flow(x["text"]))}

    def ended(x: Column, _: Column) -> dict[str, Column]:
        kept = F.when((F.size(x["more"]) == 0) | x["value"].rlike(r"\A.[0-9+]*-"), "").otherwise("\n")
        bare = F.regexp_replace(F.regexp_replace(x["text"], r"(?<=[\"'])[ \t]*#[^\"'\n]*\z", ""), r"\A[\"']|[\"']\z", "")
        text = F.when(x["kind"] != "scalar", "").when(x["is_block"], F.concat(F.when(F.size(x["more"]) == 0, "").otherwise(x["text"]), kept)).when(x["value"].rlike(r"\A[\"']"), bare).otherwise(x["text"])
        return {"text": text}

    def node(x: Column) -> Column:
        e, n, skipped = x["e"], x["n"], F.col("__d.line")
        return F.struct(
            x["i"].alias("node"), n["parent"].alias("parent"), n["last"].alias("last"), n["place"].alias("place"), n["depth"].alias("depth"), n["widest"].alias("widest"), n["path"].alias("path"),
            F.when(e["kind"] == "key", e["name"]).alias("key"), x["kind"].alias("kind"), (F.greatest(e["line"], F.lit(1)) + skipped).alias("line_start"), (F.when(e["kind"] == "root", F.size("__lines")).otherwise(x["last"]) + skipped).alias("line_end"),
            F.coalesce(x["flow"]["n"], F.when(x["kind"].isin("mapping", "sequence"), n["n_children"]), F.lit(0)).alias("n_children"),
            F.octet_length(x["text"]).alias("value_bytes"), F.size(F.split(x["text"], "\n", -1)).alias("value_lines"), x["flow"].alias("flow"),
        )

    own_ones = F.filter(_pairs(), lambda x: x["e"]["kind"].isin("root", "key", "item"))
    return F.transform(staged(own_ones, around, start, own, margin, joined, folded, ended), node)


def _broken(text: Column) -> Column:
    """Whether the places of entries show that a document is no YAML.

    A tab indents a line; something stands in a key or item that has a value
    already; keys and items, or keys of different columns, stand in one node; or
    brackets don't close.
    """
    entry = lambda i: F.get(F.col("__entries"), i)

    def around(x: Column, _: Column) -> dict[str, Column]:
        return {"up": entry(x["n"]["parent"]), "first": entry(F.get(F.col("__nested"), x["n"]["parent"])["first"])}

    def wrong(x: Column) -> Column:
        e, up, first = x["e"], x["up"], x["first"]
        has_value = (up["value"] != "") & ~up["opaque"]
        mixed = (x["n"]["place"] > 0) & ((first["kind"] != e["kind"]) | (first["level"] != e["level"]))
        return e["kind"].isin("key", "item") & (x["n"]["parent"] >= 0) & (has_value | mixed)

    open_ = F.exists("__nodes", lambda n: F.coalesce(~n["flow"]["closed"], F.lit(False)))
    tab = text.rlike(r"(?m)^ *\t+ *[^\s#]") & ~F.exists("__entries", lambda e: e["opaque"])
    return F.coalesce(tab | open_ | F.exists(staged(_pairs(), around), wrong), F.lit(False))


def with_nodes(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with __nodes (root first, in order of appearance) and __broken; null texts have one empty root."""
    found = _tree(docs.withColumn("__text", F.coalesce(F.col(text), F.lit(""))), "__text").withColumn("__nodes", _nodes())
    return found.withColumn("__broken", _broken(F.col("__text"))).drop("__text", "__d", "__lines", "__entries", "__nested")


def yaml_nodes(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row for each node of each text, without the text: path, key, kind, depth, lines, children, and size of scalars.

    Lines are those of the whole text, from a node's key or dash to its last
    line; the root has all of its document's. ``widest`` is the largest place of an item on the way to a node.
    Texts that are no YAML have no rows; columns named as the results are replaced.
    """
    found = with_nodes(docs, text).where(~F.col("__broken"))
    made = {f.name.lower() for f in found.schema["__nodes"].dataType.elementType.fields}
    rest = [c for c in docs.columns if c != text and c.lower() not in made]
    return found.select(*(F.col(f"`{c}`") for c in rest), F.inline("__nodes")).drop("flow", "last")


def signature(node: Column) -> Column:
    """What a node is, in a few words."""
    counted = lambda a, b: F.concat(F.lit(a), node["n_children"].cast("string"), F.lit(b))
    long = F.when(node["value_bytes"] > 50, F.concat(F.lit("scalar("), node["value_bytes"].cast("string"), F.lit(" chars)"))).otherwise("scalar")
    return F.when(node["kind"] == "mapping", counted("mapping{", " keys}")).when(node["kind"] == "sequence", counted("sequence[", " items]")).when(node["kind"] == "scalar", long).otherwise(node["kind"])


def is_complex(node: Column) -> Column:
    return node["kind"].isin("mapping", "sequence") | ((node["kind"] == "scalar") & (node["value_lines"] > 1))


def statistics(nodes: Column) -> dict[str, Column]:
    """Counts over a document's nodes: of collections, scalars (keys among them), aliases and keys, and the depth, the document's own included."""
    n = lambda test: F.size(F.filter(nodes, test))
    inner = lambda field: F.aggregate(nodes, F.lit(0), lambda s, x: s + F.coalesce(x["flow"][field], F.lit(0)))
    block = lambda kind: n(lambda x: (x["kind"] == kind) & x["flow"].isNull())
    keys = n(lambda x: x["key"].isNotNull())
    deepest = F.aggregate(nodes, F.lit(0), lambda s, x: F.greatest(s, F.when(x["kind"].isin("mapping", "sequence"), x["depth"] + F.coalesce(x["flow"]["deepest"], F.lit(1))).otherwise(0)))
    return {
        "mappings": block("mapping") + inner("maps"),
        "sequences": block("sequence") + inner("lists"),
        "scalars": keys + n(lambda x: x["kind"] == "scalar") + inner("scalars"),
        "aliases": n(lambda x: x["kind"] == "alias") + inner("aliases"),
        "keys": keys + inner("keys"),
        "max_depth": deepest + 1,
    }
