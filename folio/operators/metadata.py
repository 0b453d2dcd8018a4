"""File metadata in one schema for all formats: imports, definitions, symbols and text properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import col, lines, trim_space
from folio.operators import codeblocks, configs, csvchunks, jsonchunks, markdown, textchunks, yamltree
from folio.schema import DEFINITION, SYMBOL

_DEFINITIONS, _SYMBOLS = f"array<{DEFINITION.simpleString()}>", f"array<{SYMBOL.simpleString()}>"


def _properties(**values: Column) -> Column:
    """A map of the values that are not null, as text."""
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()))
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def _made(rows: DataFrame, language: str, path: str, key: str, imports: Column, definitions: Column, symbols: Column, properties: Column) -> DataFrame:
    return rows.select(
        key, F.col(path).alias("file_path"), F.lit(language).alias("language"), imports.cast("array<string>").alias("imports"), definitions.cast(_DEFINITIONS).alias("definitions"), symbols.cast(_SYMBOLS).alias("symbols"), properties.alias("properties")
    )


def _definition(kind: Column, name: Column, start: Column, end: Column, visibility: Column, signature: Column, documentation: Column) -> Column:
    parts = {"type": kind, "name": name, "line_start": start.cast("int"), "line_end": end.cast("int"), "visibility": visibility, "signature": signature, "documentation": documentation}
    return F.struct(*(v.alias(k) for k, v in parts.items()))


def _symbol(name: Column, kind: Column, start: Column, end: Column, exported: Column) -> Column:
    return F.struct(name.alias("name"), kind.alias("type"), start.cast("int").alias("line_start"), end.cast("int").alias("line_end"), exported.alias("is_export"))


def text_metadata(docs: DataFrame, text: str = "text", path: str = "path", key: str = "doc_id") -> DataFrame:
    """Headings as symbols; counts, ratios, type and content flags as properties."""
    some = textchunks.text_statistics(docs.where(F.col(text).isNotNull()), text)
    numbered = F.transform(textchunks._classified(text), lambda x, i: F.struct(x.alias("x"), (i + 1).alias("n")))
    headings = F.filter(numbered, lambda y: y["x"]["kind"] == "heading")
    symbols = F.transform(headings, lambda y: _symbol(textchunks.clean_heading(y["x"]["trimmed"]), F.lit("heading"), y["n"], y["n"], F.lit(True)))
    names = ("total_lines", "size_bytes", "empty_lines", "content_lines", "heading_count", "list_items", "long_lines", "short_lines", "word_count", "sentence_count", "empty_line_ratio", "avg_words_per_line", "document_structure")
    flags = textchunks.content_flags(text)
    style = flags.pop("indentation_style")
    properties = _properties(**{n: F.col(n) for n in names}, document_type=textchunks.document_type(path), indentation_style=style, **{n: F.when(c, "true") for n, c in flags.items()})
    return _made(some, "text", path, key, F.array(), F.array(), symbols, properties)


def csv_metadata(docs: DataFrame, text: str = "text", path: str = "path", key: str = "doc_id") -> DataFrame:
    """Headers as symbols and definitions; counts, delimiter, types and density as properties."""
    found = csvchunks.csv_metadata(docs.where(trim_space(text) != ""), text, path)
    heads = F.coalesce("headers", F.array().cast("array<string>"))
    kinds = F.col("column_types")
    definitions = F.transform(heads, lambda h, i: _definition(F.lit("column"), h, F.lit(1), F.lit(1), F.lit("public"), F.concat(h, F.lit(": "), F.coalesce(F.get(kinds, i), F.lit("text"))), F.lit("")))
    symbols = F.transform(heads, lambda h: _symbol(h, F.lit("column"), F.lit(1), F.lit(1), F.lit(True)))
    properties = _properties(row_count=F.col("row_count"), column_count=F.col("column_count"), has_headers=F.col("has_header"), delimiter=F.col("delimiter"), column_types=F.array_join("column_types", ","), data_density=F.format_number("data_density", 3))
    return _made(found, "csv", path, key, F.array(), definitions, symbols, properties)


def json_metadata(docs: DataFrame, text: str = "text", path: str = "path", key: str = "doc_id") -> DataFrame:
    """Top-level keys as symbols and, with signatures, definitions; validity, counts, depth and size as properties."""
    found = jsonchunks.json_metadata(docs.where(F.col(text).isNotNull()).withColumn("__t", F.col(text)), text)
    v = F.try_parse_json("__t")
    entries = F.array_sort(F.transform(F.map_entries(F.when(F.col("root_type") == "object", v).try_cast("map<string,variant>")), lambda e: F.struct(e["key"].alias("key"), jsonchunks.kind(e["value"]).alias("kind"), jsonchunks.signature(e["value"]).alias("signature"))))
    entries = F.coalesce(entries, F.array().cast("array<struct<key:string,kind:string,signature:string>>"))
    form = lambda e: F.when(e["kind"].isin("object", "array"), e["kind"]).otherwise("property")
    definitions = F.transform(entries, lambda e: _definition(form(e), e["key"], F.lit(None), F.lit(None), F.lit("public"), e["signature"], F.lit("")))
    symbols = F.transform(entries, lambda e: _symbol(e["key"], e["kind"], F.lit(None), F.lit(None), F.lit(True)))
    names = ("is_valid", "root_type", "object_count", "array_count", "primitive_count", "depth", "size_bytes")
    return _made(found, "json", path, key, F.array(), definitions, symbols, _properties(**{n: F.col(n) for n in names}))


def markdown_metadata(docs: DataFrame, text: str = "text", path: str = "path", key: str = "doc_id") -> DataFrame:
    """Headings and code languages as symbols and definitions; title, front matter and statistics as properties."""
    some = docs.where(F.col(text).isNotNull())
    rows = markdown.line_table(some.select(key, text), text, key).where("level > 0")
    heads = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("line_no", "level", "title"))).alias("heads"))
    stats = markdown.statistics(some.withColumn("__t", F.col(text)), text).join(heads, key, "left")
    own = F.coalesce("heads", F.array().cast("array<struct<line_no:int,level:int,title:string>>"))
    kind = lambda h: F.concat(F.lit("h"), h["level"].cast("string"))
    symbols = F.transform(own, lambda h: _symbol(h["title"], kind(h), h["line_no"], h["line_no"], F.lit(True)))
    code = F.transform(markdown.code_languages("__t"), lambda c: _definition(F.lit("code_block"), c, F.lit(None), F.lit(None), F.lit("public"), c, F.lit("")))
    headings = F.transform(own, lambda h: _definition(kind(h), h["title"], h["line_no"], h["line_no"], F.lit("public"), h["title"], F.lit("")))
    names = ("total_lines", "heading_count", "code_block_count", "code_lines", "code_percentage", "table_rows", "list_count")
    properties = _properties(title=markdown.title("__t", path), **{k: markdown.front_value("__t", k) for k in ("author", "version", "date", "description")}, code_languages=F.nullif(F.array_join(markdown.code_languages("__t"), ","), F.lit("")), **{n: F.col(n) for n in names})
    return _made(stats, "markdown", path, key, F.array(), F.concat(headings, code), symbols, properties)


def yaml_metadata(docs: DataFrame, text: str = "text", path: str = "path", key: str = "doc_id") -> DataFrame:
    """Keys as symbols and, with signatures, definitions; counts of nodes and lines, depth, size and features as properties.

    Keys in a sequence's eleventh and later items count in the totals only.
    What is no YAML has no symbols and ``valid`` false.
    """
    some = yamltree.with_nodes(docs.where(F.col(text).isNotNull()), text)
    trimmed = F.transform(lines(text), trim_space)
    count = lambda test: F.size(F.filter(trimmed, test))
    fine = ~F.col("__broken")
    keys = F.filter("__nodes", lambda n: fine & n["key"].isNotNull() & (n["widest"] < 10))
    symbols = F.transform(keys, lambda n: _symbol(n["key"], n["kind"], n["line_start"], n["line_end"], F.lit(True)))
    definitions = F.transform(F.filter(keys, yamltree.is_complex), lambda n: _definition(n["kind"], n["key"], n["line_start"], n["line_end"], F.lit("public"), yamltree.signature(n), F.lit("")))
    told = {"root_type": F.get("__nodes", F.lit(0))["kind"], **yamltree.statistics(F.col("__nodes"))}
    properties = _properties(
        valid=F.when(fine, "true").otherwise("false"),
        total_lines=F.size(trimmed),
        size_bytes=F.octet_length(text),
        comment_lines=count(lambda t: t.startswith("#")),
        empty_lines=count(lambda t: t == ""),
        content_lines=count(lambda t: (t != "") & ~t.startswith("#")),
        item_count=count(lambda t: t.rlike(r"\A-(?:\s|\z)")),
        document_count=F.size(F.filter(lines(text), lambda x: x.rlike(r"\A---(?:\s|\z)"))) + F.lit(1) - F.when(col(text).startswith("---"), 1).otherwise(0),
        **{n: F.when(fine, c) for n, c in told.items()},
        **{n: F.when(c, "true") for n, c in configs.features(text).items()},
    )
    return _made(some, "yaml", path, key, F.array(), definitions, symbols, properties)


def code_metadata(docs: DataFrame, language: codeblocks.Language, text: str = "text", path: str = "path", key: str = "doc_id") -> DataFrame:
    """Imports, declarations as definitions and symbols, and totals by kind as properties; files without declarations too."""
    found = codeblocks.declarations(docs.select(key, text), language, text, key)
    ordered = F.sort_array(F.collect_list(F.struct("line_start", "depth", "line_end", "kind", "qualified_name", "visibility", "signature", "documentation")))
    grouped = found.groupBy(key).agg(ordered.alias("all"))
    per_kind = codeblocks.totals(found, key).groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.concat(F.lit("total_"), "kind"), F.col("n").cast("string"))))).alias("totals"))
    rows = docs.join(grouped, key, "left").join(per_kind, key, "left")
    own = F.coalesce("all", F.array().cast("array<struct<line_start:int,depth:bigint,line_end:int,kind:string,qualified_name:string,visibility:string,signature:string,documentation:string>>"))
    definitions = F.transform(own, lambda d: _definition(d["kind"], d["qualified_name"], d["line_start"], d["line_end"], d["visibility"], d["signature"], d["documentation"]))
    symbols = F.transform(own, lambda d: _symbol(d["qualified_name"], d["kind"], d["line_start"], d["line_end"], d["visibility"] == "public"))
    package = F.regexp_extract(F.coalesce(F.col(text), F.lit("")), r"(?m)^\s*package\s+([\w.]+)", 1)
    syntax = F.regexp_extract(F.coalesce(F.col(text), F.lit("")), r"(?m)^\s*syntax\s*=\s*\"([^\"]+)\"", 1)
    named = _properties(package=F.nullif(package, F.lit("")), syntax=F.nullif(syntax, F.lit("")), complexity=F.size(own) + F.size(codeblocks.imports(text, language)))
    properties = F.map_concat(named, F.coalesce("totals", F.create_map().cast("map<string,string>")))
    return _made(rows, language.name, path, key, codeblocks.imports(text, language), definitions, symbols, properties)


def file_metadata(files: DataFrame, parser: str, text: str = "text", path: str = "path", key: str = "doc_id") -> DataFrame:
    """Metadata of files of one parser (a name of the default registry); files of unknown parsers count as text."""
    simple = {"csv": csv_metadata, "json": json_metadata, "markdown": markdown_metadata, "yaml": yaml_metadata}
    if parser in codeblocks.LANGUAGES:
        return code_metadata(files, codeblocks.LANGUAGES[parser], text, path, key)
    return simple.get(parser, text_metadata)(files, text, path, key)
