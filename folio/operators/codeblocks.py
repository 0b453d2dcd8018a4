"""Code and schema languages by lines and brace depth: declarations as chunks, and their counts.

Depth is a running sum over one document's lines, with string literals and
comments blanked first, over several lines as well. One pass over a document's
lines gives each the line that opens what it stands in and the last line of what
it opens, at any depth; a declaration ends there. This finds the constructs that matter for
retrieval; it is no compiler front end, and odd layouts stay in one chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.nesting import nested
from folio.functions.text import col, exploded, lines, trim_space

#: For declarations that are looked for at any depth.
ANY_DEPTH = 1 << 30
#: For declarations that are looked for right in the body of a class or an interface.
MEMBER = -1
#: Declarations whose names are part of the names of those inside.
_AROUND = ("message", "service", "class", "interface", "enum", "oneof")


@dataclass(frozen=True)
class Language:
    """How a language's declarations begin: (kind, pattern with the name in group 1, levels down to which it is looked for)."""

    name: str
    declarations: tuple[tuple[str, str, int], ...]
    imports: str
    public: str
    comment: str = "//"


GO = Language(
    "go",
    (
        ("method", r"^func\s+\([^)]*\)\s*(\w+)", 0),
        ("function", r"^func\s+(\w+)", 0),
        ("struct", r"^type\s+(\w+)(?:\[[^\]]*\])?\s+struct\b", 0),
        ("interface", r"^type\s+(\w+)(?:\[[^\]]*\])?\s+interface\b", 0),
        ("type", r"^type\s+(\w+)", 0),
        ("constant", r"^const\s+(\w+|\()", 0),
        ("variable", r"^var\s+(\w+|\()", 0),
    ),
    r'^\s*(?:import\s+)?(?:[\w.]+\s+)?"([^"]+)"\s*$',
    r"^[A-Z]",
)
PROTO = Language(
    "protobuf",
    (
        ("message", r"^\s*message\s+(\w+)", ANY_DEPTH),
        ("service", r"^\s*service\s+(\w+)", 0),
        ("rpc", r"^\s*rpc\s+(\w+)", 1),
        ("enum", r"^\s*enum\s+(\w+)", ANY_DEPTH),
        ("oneof", r"^\s*oneof\s+(\w+)", ANY_DEPTH),
    ),
    r'^\s*import\s+(?:public\s+|weak\s+)?"([^"]+)"',
    r".",
)
TERRAFORM = Language(
    "terraform",
    tuple((kind, rf'^{kind}\b((?:\s+"[^"]*")*)\s*\{{', 0) for kind in ("resource", "data", "module", "variable", "output", "provider", "locals", "terraform")),
    r'^\s*source\s*=\s*"([^"]+)"',
    r".",
    "#",
)
_MODIFIERS = r"(?:(?:public|private|protected|static|async|override|readonly|abstract|declare)\s+)*"
TYPESCRIPT = Language(
    "typescript",
    (
        ("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)", 0),
        ("interface", r"^\s*(?:export\s+)?interface\s+(\w+)", 0),
        ("enum", r"^\s*(?:export\s+)?(?:const\s+)?enum\s+(\w+)", 0),
        ("type_alias", r"^\s*(?:export\s+)?type\s+(\w+)", 0),
        ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)", 0),
        ("constant", r"^\s*(?:export\s+)?const\s+(\w+)", 0),
        ("variable", r"^\s*(?:export\s+)?(?:let|var)\s+(\w+)", 0),
        ("constructor", r"^\s*(?:public\s+|private\s+|protected\s+)?(constructor)\s*\(", MEMBER),
        ("method", rf"^\s+{_MODIFIERS}(?:get\s+|set\s+)?\*?\s*(#?[\w$]+)\??\s*(?:<[^(]*>)?\(", MEMBER),
        ("property", rf"^\s+{_MODIFIERS}(#?[\w$]+)[?!]?\s*(?:[:=;]|\z)", MEMBER),
    ),
    r"""^\s*import\b.*?["']([^"']+)["']""",
    r"^\s*export\b|\bpublic\b|^\s*constructor\b",
)
#: A Terraform block's attributes and blocks, each on its own line.
_ATTRIBUTE, _NESTED = r"\A\s*[\w-]+\s*=(?!=)", r'\A\s*[\w-]+(?:\s+"[^"]*")*\s*\{'
#: A protobuf field and an enum's value.
_FIELD, _VALUE = r"^\s*(?:repeated\s+|optional\s+|required\s+)?(?:map<[^>]*>|[\w.]+)\s+\w+\s*=\s*\d+", r"\A\s*\w+\s*=\s*-?\w+"
LANGUAGES = {x.name: x for x in (GO, PROTO, TERRAFORM, TYPESCRIPT)}


_LITERALS = (r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"', r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'", r"`[^`]*+`", r"/\*(?s:.*?)\*/")


def bare(text: str | Column, language: Language) -> Column:
    """The text without string literals, comments and heredocs; its line feeds stay, so that lines keep their numbers."""
    heredoc = (r"<<[-~]?(\w+)\n(?s:.*?)\n[ \t]*\1\b",) if language.name == "terraform" else ()
    comments = tuple(dict.fromkeys((f"{language.comment}[^\n]*+", "//[^\n]*+")))
    literals = _LITERALS if language.name != "terraform" else (_LITERALS[0], _LITERALS[3])  # an apostrophe is plain there
    pattern = "|".join((*heredoc, *comments, *literals))
    tokens = F.regexp_extract_all(col(text), F.lit(rf"(?:{pattern})|[^\"'`/#<]++|[\s\S]"), F.lit(0))
    blank = lambda t: F.regexp_replace(t, r"[^\n]", "")
    return F.array_join(F.transform(tokens, lambda t: F.when(F.length(t) > 1, F.when(t.rlike(rf"\A(?:{pattern})\z"), blank(t)).otherwise(t)).otherwise(t)), "")


def declaration_lines(docs: DataFrame, language: Language, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each line: depth before and after it, and the declaration it begins (kind, name), if any."""
    rest = [c for c in docs.columns if c != text]
    both = F.arrays_zip(lines(text).alias("line"), lines(bare(text, language)).alias("bare"))
    rows = exploded(docs, rest, both, "line_no", "x").select(*rest, (F.col("line_no") + 1).alias("line_no"), "x.line", "x.bare")
    change = F.length(F.regexp_replace("bare", r"[^{(\[]", "")) - F.length(F.regexp_replace("bare", r"[^})\]]", ""))
    before = Window.partitionBy(key).orderBy("line_no")
    rows = rows.withColumn("depth_after", F.sum(change).over(before)).withColumn("depth", F.col("depth_after") - change)
    opener = F.when((F.col("depth") == 0) & (F.col("depth_after") > 0), F.coalesce(*(F.when(F.col("line").rlike(p), k) for k, p, n in language.declarations if n == 0), F.lit("")))
    rows = rows.withColumn("__in", F.last(opener, ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1)))
    kind, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, pattern, level in reversed(language.declarations):
        place = (F.col("depth") == 1) & F.col("__in").isin("class", "interface") if level == MEMBER else F.col("depth") == 1 if level == 1 else F.col("depth") <= level
        hit = F.col("line").rlike(pattern) & F.col("bare").rlike(r"\S") & place
        kind, name = F.when(hit, k).otherwise(kind), F.when(hit, F.regexp_extract("line", pattern, 1)).otherwise(name)
    said = trim_space("line").rlike(r"\A(?://|/\*|\*|#)")
    silent = F.max(F.when(~said, F.col("line_no"))).over(before.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("kind", kind).withColumn("name", name).withColumn("comments", F.col("line_no") - 1 - F.coalesce(silent, F.lit(0))).drop("__in")
    if language.name != "protobuf":
        return rows.withColumn("stop", F.col("line_no"))
    # a statement goes on to the next semicolon or brace
    from_end = Window.partitionBy(key).orderBy(F.desc("line_no"))
    return rows.withColumn("stop", F.coalesce(F.last(F.when(F.col("bare").rlike("[;{}]"), F.col("line_no")), ignorenulls=True).over(from_end), F.col("line_no")))


def balanced(docs: DataFrame, language: Language, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ok): whether braces and brackets close again and never close too soon."""
    rows = declaration_lines(docs, language, text, key)
    return rows.groupBy(key).agg(((F.max_by("depth_after", "line_no") == 0) & (F.min("depth_after") >= 0)).alias("ok"))


def declarations(docs: DataFrame, language: Language, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each declaration: kind, name, qualified name, lines, content, signature, doc comment, visibility.

    It ends on the first line, from its own on, after which the depth is back
    at its level: the last line inside what its line opens, or that line itself.
    """
    rest = [c for c in docs.columns if c != text]
    per_doc = declaration_lines(docs, language, text, key).groupBy(*rest).agg(F.sort_array(F.collect_list(F.struct("line_no", "line", "depth", "depth_after", "kind", "name", "comments", "stop"))).alias("all"))
    around = lambda x: F.when(x["kind"].isin(*_AROUND), x["name"]).otherwise("")
    entries = F.concat(F.array(F.struct(F.lit(-(1 << 30)).alias("level"), F.lit("").alias("name"))), F.transform("all", lambda x: F.struct(x["depth"].cast("int").alias("level"), around(x).alias("name"))))
    per_doc = per_doc.withColumn("__held", nested(F.transform(entries, lambda x: x.withField("opaque", F.lit(False)).withField("passing", F.lit(False))), ""))

    def one(d: Column) -> Column:
        held = F.get(F.col("__held"), d["line_no"])  # the root comes before the first line
        last = F.get(F.col("__held"), d["stop"])["last"].cast("int")
        own = F.transform(F.slice("all", d["line_no"], last - d["line_no"] + 1), lambda x: x["line"])
        outer = F.get(F.col("__held"), held["parent"])["path"]
        labels = F.regexp_extract_all(d["name"], F.lit(r'"([^"]*)"'), F.lit(1))
        name = F.array_join(F.concat(F.array(d["kind"]), labels), ".") if language.name == "terraform" else F.concat(outer, F.when(outer == "", "").otherwise("."), d["name"])
        above = F.transform(F.slice("all", d["line_no"] - d["comments"], d["comments"]), lambda x: trim_space(F.regexp_replace(x["line"], r"\A\s*(?://+|/\*+|\*+/?|#+)|\*/\s*\z", "")))
        said = F.array_join(F.filter(above, lambda x: x != ""), "\n")
        seen = F.when(d["line"].rlike(language.public) if language.name != "go" else d["name"].rlike(language.public), "public").otherwise("private")
        inner = F.filter(F.slice("all", d["line_no"], last - d["line_no"] + 1), lambda x: (x["depth"] == d["depth"] + 1) & (x["line_no"] > d["line_no"]))
        within = lambda pattern: F.size(F.filter(inner, lambda x: x["line"].rlike(pattern)))
        blocks = {"terraform": {"attribute_count": _ATTRIBUTE, "nested_block_count": _NESTED}, "protobuf": {"inner_fields": _FIELD, "inner_values": _VALUE, "inner_rpcs": r"\A\s*rpc\s"}}.get(language.name, {})
        return F.struct(
            d["kind"].alias("kind"),
            d["name"].alias("name"),
            name.alias("qualified_name"),
            d["line_no"].alias("line_start"),
            last.alias("line_end"),
            d["depth"].alias("depth"),
            F.array_join(own, "\n").alias("content"),
            F.when(d["kind"].isin("function", "method", "constructor"), _head(own)).otherwise(trim_space(F.regexp_replace(d["line"], r"\{.*\z", ""))).alias("signature"),
            said.alias("documentation"),
            seen.alias("visibility"),
            F.size(F.filter(own, lambda x: x.rlike(_FIELD))).alias("field_count"),
            *(within(pattern).alias(n) for n, pattern in blocks.items()),
            *([_attributes(F.transform(inner, lambda x: x["line"]), d["line"]).alias("attributes")] if language.name == "terraform" else []),
        )

    made = F.transform(F.filter("all", lambda x: x["kind"].isNotNull()), one)  # within the row: no declaration carries the file's lines along
    return exploded(per_doc, rest, made, "__k", "d").select(*rest, "d.*")


def _head(own: Column) -> Column:
    """A function's lines up to its body, as one: receiver, parameters and results, however many lines they take."""
    k = F.array_position(F.transform(own, lambda x: x.rlike(r"\{\s*(?://.*)?\z")), True)
    head = F.array_join(F.transform(F.slice(own, F.lit(1), F.greatest(k.cast("int"), F.lit(1))), lambda x: F.regexp_replace(x, r"(?:\A|\s+)//.*\z", "")), " ")
    tidy = F.regexp_replace(F.regexp_replace(F.regexp_replace(head, r"\s+", " "), r"\( ", "("), r",? \)", ")")
    return trim_space(F.regexp_replace(tidy, r"\s*\{(?:(?:[^{}]|\{[^{}]*\})*\}[\s;]*)?\z", ""))


def imports(text: str | Column, language: Language) -> Column:
    """Imported names, distinct, in order of appearance."""
    return F.array_distinct(F.filter(F.regexp_extract_all(col(text), F.lit("(?m)" + language.imports), F.lit(1)), lambda x: x != ""))


_STRING, _NUMBER = r'"(?:[^"\\$%]|\\.|[$%](?!\{))*"', r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
_SCALAR = rf"(?:{_STRING}|{_NUMBER}|true|false)"


def _attributes(inner: Column, first: Column) -> Column:
    """name -> value, as written and without a comment after it, of the attributes right in a block; a block of one line has them between its braces."""
    alone = F.regexp_extract(first, r"\{(.*)\}\s*\z", 1)
    own = F.filter(F.concat(inner, F.when(alone != "", F.array(alone)).otherwise(F.array().cast("array<string>"))), lambda x: x.rlike(_ATTRIBUTE))
    value = lambda x: F.regexp_extract(x, r'\A\s*[\w-]+\s*=\s*((?:"(?:[^"\\]|\\.)*"|[^"#/]|/(?!/))*?)\s*(?:(?:#|//).*)?\z', 1)
    named = F.transform(own, lambda x: F.struct(F.regexp_extract(x, r"\A\s*([\w-]+)", 1).alias("key"), value(x).alias("value")))
    first_ones = F.filter(named, lambda p, i: F.array_position(F.transform(named, lambda q: q["key"]), p["key"]) == i + 1)
    return F.map_from_entries(first_ones)


def _number(text: Column) -> Column:
    """A number without a zero fraction or an exponent."""
    exact = F.regexp_replace(text.try_cast("double").cast("decimal(38,15)").cast("string"), r"\.?0+\z", "")
    return F.when(text.rlike(r"\A-?(?:0|[1-9][0-9]*)\z"), text).otherwise(F.when(exact.isin("", "-"), "0").otherwise(exact))


def terraform_literal(value: str | Column) -> Column:
    """What a value comes to that needs nothing else: a string in quotes, a number, a boolean or a list of these; ``<expression>`` for all others."""
    v = F.trim(col(value))
    items = F.regexp_extract_all(v, F.lit(_SCALAR), F.lit(0))
    plain = lambda x: F.when(x.rlike(rf"\A{_NUMBER}\z"), _number(x)).otherwise(x)
    listed = F.concat(F.lit("["), F.array_join(F.transform(items, plain), ", "), F.lit("]"))
    return F.when(v.rlike(rf"\A{_SCALAR}\z"), plain(v)).when(v.rlike(rf"\A\[\s*(?:{_SCALAR}(?:\s*,\s*{_SCALAR})*\s*,?)?\s*\]\z"), listed).otherwise("<expression>")


def terraform_signatures(found: DataFrame) -> DataFrame:
    """Terraform declarations whose ``signature`` says what matters for their kind of block, by their literals."""
    labels = F.regexp_extract_all("name", F.lit(r'"([^"]*)"'), F.lit(1))
    has = lambda k: F.map_contains_key("attributes", F.lit(k))
    got = lambda k, label=None: F.when(has(k), F.concat(F.lit(f"{label or k} = "), terraform_literal(F.col("attributes")[k])))
    label = lambda name: F.when(F.size(labels) > 0, F.concat(F.lit(f"{name} = "), labels[0]))
    parts = {
        "resource": [label("type"), *map(got, ("name", "id", "ami", "instance_type", "image"))],
        "data": [label("type")],
        "module": [got("source"), got("version")],
        "variable": [got("type"), F.when(has("default"), "has_default = true"), got("description")],
        "output": [got("description"), F.when(has("sensitive") & (terraform_literal(F.col("attributes")["sensitive"]) == "true"), "sensitive = true")],
        "locals": [F.concat(F.lit("local_values = "), F.size(F.map_keys("attributes")).cast("string"))],
        "provider": [label("provider"), got("alias")],
    }
    said = F.lit("")
    for kind, values in parts.items():
        said = F.when(F.col("kind") == kind, F.array_join(F.filter(F.array(*values), lambda x: x.isNotNull()), ", ")).otherwise(said)
    return found.withColumn("signature", said)


def terraform_annotations(found: DataFrame) -> DataFrame:
    """Terraform declarations with ``annotations``: block type, counts, and what the labels say for each type of block."""
    labels = F.regexp_extract_all("name", F.lit(r'"([^"]*)"'), F.lit(1))
    label = lambda k: F.get(labels, F.lit(k))
    only = lambda kind, value: F.when(F.col("kind").isin(kind), value)
    source = F.regexp_extract("content", r'(?m)^\s*source\s*=\s*"([^"]*)"', 1)
    values = {
        "block_type": F.col("kind"),
        "line_count": F.col("line_end") - F.col("line_start") + 1,
        "attribute_count": F.col("attribute_count"),
        "nested_block_count": F.col("nested_block_count"),
        "resource_type": only("resource", label(0)),
        "resource_name": only("resource", label(1)),
        "data_type": only("data", label(0)),
        "data_name": only("data", label(1)),
        "module_name": only("module", label(0)),
        "module_source": only("module", F.nullif(source, F.lit(""))),
        "variable_name": only("variable", label(0)),
        "output_name": only("output", label(0)),
        "provider_name": only("provider", label(0)),
        "local_count": only("locals", F.col("attribute_count")),
    }
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()))
    return found.withColumn("annotations", F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())))


def rpc_streams(signature: str | Column) -> Column:
    """Whether an rpc takes and gives streams, as a struct (takes, gives)."""
    parts = F.split(col(signature), r"\breturns\b", 2)
    streams = lambda k: F.coalesce(F.get(parts, F.lit(k)).rlike(r"\(\s*stream\s"), F.lit(False))
    return F.struct(streams(0).alias("takes"), streams(1).alias("gives"))


def rpc_signature(signature: str | Column) -> Column:
    """An rpc's name, request and response, with ``stream`` before those that stream."""
    part = r"\(\s*(stream\s+)?([\w.]+)\s*\)"
    text = F.regexp_replace(col(signature), r"\s+", " ")
    got = lambda k: F.regexp_extract(text, rf"rpc (\w+) ?{part} ?returns ?{part}", k)
    return F.when(got(1) != "", F.concat(F.lit("rpc "), got(1), F.lit("("), got(2), got(3), F.lit(") returns ("), got(4), got(5), F.lit(")")))


def proto_annotations(found: DataFrame) -> DataFrame:
    """Protobuf declarations with ``annotations``: kind, name, documentation, fields or values or rpcs right inside, and an rpc's types and streams."""
    named = lambda text, k: F.nullif(F.regexp_extract(F.regexp_replace(text, r"\s+", " "), r"rpc \w+ ?\( ?(?:stream )?([\w.]+) ?\) ?returns ?\( ?(?:stream )?([\w.]+) ?\)", k), F.lit(""))
    only = lambda kind, value: F.when(F.col("kind") == kind, value)
    streams = rpc_streams("content")
    values = {
        "type": F.col("kind"),
        "name": F.col("name"),
        "has_doc": F.col("documentation") != "",
        "field_count": F.when(F.col("kind").isin("message", "oneof"), F.col("inner_fields")),
        "value_count": only("enum", F.col("inner_values")),
        "rpc_count": only("service", F.col("inner_rpcs")),
        "signature": only("rpc", rpc_signature("content")),
        "request_type": only("rpc", named(F.col("content"), 1)),
        "response_type": only("rpc", named(F.col("content"), 2)),
        "streams_request": only("rpc", streams["takes"]),
        "streams_response": only("rpc", streams["gives"]),
    }
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()))
    return found.withColumn("annotations", F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())))


def go_header(text: str | Column) -> Column:
    """A Go file's package line and its first import block, each with a blank line after it."""
    package = F.regexp_extract(col(text), r"(?m)^package\s+\w+", 0)
    block = F.regexp_extract(col(text), r"(?m)^import\s*(?:\([^)]*\)|[^\n(]+)", 0)
    part = lambda x: F.when(x != "", F.concat(x, F.lit("\n\n"))).otherwise("")
    return F.concat(part(package), part(block))


def group_declarations(found: DataFrame, size: int = 3000, key: str = "doc_id", header: str | None = None) -> DataFrame:
    """Top-level declarations packed in order into ``code_group`` chunks of up to ``size`` bytes; larger ones stand alone.

    Each chunk begins with its file's ``header``, which the size doesn't count.
    """
    rest = [key, *([header] if header else [])]
    top = found.where("depth = 0").groupBy(*rest).agg(F.sort_array(F.collect_list(F.struct("line_start", "line_end", "content", "name"))).alias("all"))
    state = "struct<size:int,ends:array<int>>"

    def step(s: Column, x: Column) -> Column:
        """The number of each group's declarations so far, and the open group's bytes."""
        n, last = F.octet_length(x["content"]), F.size(s["ends"])
        fits = (last > 0) & (s["size"] + 2 + n <= size)
        grown = F.concat(F.slice(s["ends"], F.lit(1), F.greatest(last - 1, F.lit(0))), F.array(F.element_at(s["ends"], -1) + 1))
        return F.when(fits, F.struct((s["size"] + 2 + n).alias("size"), grown.alias("ends"))).otherwise(F.struct(n.alias("size"), F.array_append(s["ends"], F.coalesce(F.try_element_at(s["ends"], F.lit(-1)), F.lit(0)) + 1).alias("ends"))).cast(state)

    ends = F.aggregate("all", F.struct(F.lit(0).alias("size"), F.array().cast("array<int>").alias("ends")).cast(state), step, lambda s: s["ends"])
    made = top.withColumn("__e", ends)

    def group(end: Column, k: Column) -> Column:
        first = F.coalesce(F.get(F.col("__e"), k - 1), F.lit(0))
        own = F.slice("all", first + 1, end - first)
        return F.struct(
            F.array_join(F.transform(own, lambda x: x["content"]), "\n\n").alias("content"), own[0]["line_start"].alias("line_start"), F.element_at(own, -1)["line_end"].alias("line_end"), F.transform(own, lambda x: x["name"]).alias("names")
        )

    made = exploded(made, rest, F.transform("__e", group), "chunk_index", "c").select(*rest, "chunk_index", F.lit("code_group").alias("type"), "c.*")
    return made.withColumn("content", F.concat(header, "content")).drop(header) if header else made


def totals(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Number of declarations of each kind in each document."""
    return found.groupBy(key, "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("visibility") == "public").alias("n_public"))
