"""Which chunker takes a file: by extension, then by name."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions.text import base_name, col, extension
from folio.storage import written


@dataclass(frozen=True)
class Parser:
    name: str
    extensions: tuple[str, ...]
    chunk: Callable[..., DataFrame] | None = None
    names: tuple[str, ...] = ()
    refuses: str = ""

    def takes(self, path: str | Column) -> Column:
        """By extension or bare name, unless the refused pattern is met."""
        low = F.lower(base_name(path))
        ok = F.lower(extension(path)).isin(list(self.extensions)) | low.isin(list(self.names))
        return ok & ~low.rlike(self.refuses) if self.refuses else ok


@dataclass
class Registry:
    parsers: dict[str, Parser] = field(default_factory=dict)
    by_extension: dict[str, str] = field(default_factory=dict)

    def register(self, parser: Parser | None) -> None:
        """Adds a parser; a later owner of an extension replaces the earlier."""
        if parser is None or not parser.name:
            raise ValueError("a parser with a name is needed")
        if parser.name in self.parsers:
            raise ValueError(f"parser {parser.name} is registered already")
        self.parsers[parser.name] = parser
        self.by_extension |= dict.fromkeys(parser.extensions, parser.name)

    def get(self, name: str) -> Parser:
        if name not in self.parsers:
            raise KeyError(f"no parser {name}")
        return self.parsers[name]

    def for_extension(self, ext: str) -> Parser:
        return self.get(self.by_extension.get(ext if ext.startswith(".") else f".{ext}", ""))

    def for_file(self, path: str | Column, default: str | None = "text") -> Column:
        """Name of the parser for each path: its extension, the extension in lower case, then the file's name."""
        table = F.create_map(*(F.lit(x) for pair in self.by_extension.items() for x in pair))
        ext = extension(path)
        names = [F.when(p.takes(path), F.lit(p.name)) for p in self.parsers.values()]
        return F.coalesce(F.try_element_at(table, ext), F.try_element_at(table, F.lower(ext)), *names, F.lit(default))

    def all(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(p.name, list(p.extensions)) for p in self.parsers.values()], "name string, extensions array<string>")

    def chunk_files(self, files: DataFrame, text: str = "text", path: str = "path") -> DataFrame:
        """Chunks of all files, each by its own parser; a file without chunks is one whole chunk.

        Columns: path, chunk_index, total_chunks, content, line_start, line_end, type, identifier.
        The files are read once: they are written to the shared folder in a part
        for each parser, and a parser reads its own part. Paths are taken as unique.
        """
        return self.chunk_dealt(self.deal(files, text, path))

    def deal(self, files: DataFrame, text: str = "text", path: str = "path") -> DataFrame:
        """(path, text, parser) of all files, written to the shared folder in a part for each parser."""
        named = files.select(F.col(path).alias("path"), F.col(text).alias("text")).withColumn("parser", self.for_file("path"))
        return written(named, "files", by="parser")

    def chunk_dealt(self, named: DataFrame) -> DataFrame:
        """The chunks of files that ``deal`` has written."""
        from folio.operators.textchunks import chunk_text

        keep = ["path", "chunk_index", "content", "line_start", "line_end", "type", "identifier"]
        out, there = None, {r["parser"] for r in named.select("parser").distinct().collect()}  # at most as many as there are parsers
        for name, parser in self.parsers.items():
            if name not in there and (there or out is not None):
                continue  # it would be a plan for no files at all
            own = named.where(F.col("parser") == name).select("path", "text")
            made = (parser.chunk or chunk_text)(own).select(*(F.col(c).cast("int") if c in ("chunk_index", "line_start", "line_end") else c for c in keep))
            out = made if out is None else out.unionByName(made)
        # files without chunks are found by their paths; texts take no part in the join of the others
        made = written(out, "file_chunks")
        alone = named.select("path", "text").join(made.select("path").distinct(), "path", "left_anti")
        text = F.coalesce("text", F.lit(""))
        whole = alone.select("path", F.lit(0).alias("chunk_index"), text.alias("content"), F.lit(1).alias("line_start"), F.size(F.split(text, "\n", -1)).alias("line_end"), F.lit("file").alias("type"), base_name("path").alias("identifier"))
        every = made.unionByName(whole)
        return every.withColumn("total_chunks", F.count(F.lit(1)).over(Window.partitionBy("path")).cast("int"))


def default_registry() -> Registry:
    """Parsers of the ten formats; their names, extensions and bare names are fixed values."""
    from folio.operators import codeblocks, configs, csvchunks, jsonchunks, markdown, pdftext, textchunks

    def code(language: codeblocks.Language) -> Callable[[DataFrame], DataFrame]:
        def chunk(files: DataFrame) -> DataFrame:
            found = codeblocks.declarations(files, language, "text", "path")
            number = F.row_number().over(Window.partitionBy("path").orderBy("line_start", "depth"))
            return found.select("path", (number - 1).alias("chunk_index"), "content", "line_start", "line_end", F.col("kind").alias("type"), F.col("qualified_name").alias("identifier"))

        return chunk

    def grouped(files: DataFrame) -> DataFrame:
        found = codeblocks.declarations(files.withColumn("header", codeblocks.go_header("text")), codeblocks.GO, "text", "path")
        made = codeblocks.group_declarations(found, key="path", header="header")
        return made.withColumn("identifier", F.concat("path", F.lit(":"), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string")))

    def marked(files: DataFrame) -> DataFrame:
        found = markdown.chunk_markdown(files.withColumn("file", F.col("path")), "text", "path", "file")
        return found.withColumn("chunk_index", F.row_number().over(Window.partitionBy("path").orderBy("line_start")) - 1)

    def paged(files: DataFrame) -> DataFrame:
        """Texts of paged files, as tools print them: a form feed ends a page."""
        return pdftext.chunk_document_pages(pdftext.text_pages(files.select("path", "text")))

    out = Registry()
    for parser in (
        Parser("go", (".go",), grouped, refuses=r"_test\.go\z"),
        Parser("markdown", (".md", ".markdown"), marked),
        Parser("json", (".json",), jsonchunks.chunk_json),
        Parser("yaml", (".yaml", ".yml"), configs.chunk_yaml),
        Parser("pdf", (".pdf",), paged),
        Parser("text", (".txt", ".text", ".log", ".readme", ".changelog", ".license"), textchunks.chunk_text, ("readme", "license", "changelog", "authors", "contributors", "makefile")),
        Parser("csv", (".csv", ".tsv"), csvchunks.chunk_csv),
        Parser("terraform", (".tf", ".tfvars", ".hcl"), code(codeblocks.TERRAFORM)),
        Parser("typescript", (".ts", ".tsx"), code(codeblocks.TYPESCRIPT), refuses=r"\.(?:test|spec)\.tsx?\z"),
        Parser("protobuf", (".proto",), code(codeblocks.PROTO), refuses=r"_test\.proto|\.test\.proto|test_"),
    ):
        out.register(parser)
    return out


def with_metadata(chunks: DataFrame, extra: Sequence[tuple[str, Column]] = (), annotations: str | None = None) -> DataFrame:
    """``chunks`` with a ``metadata`` map of their own columns; annotations come last and win."""
    keys = [c for c in ("path", "identifier", "type", "line_start", "line_end", "chunk_index", "total_chunks") if c in chunks.columns]
    names = {"path": "source", "type": "chunk_type"}
    pairs = [x for c in keys for x in (F.lit(names.get(c, c)), col(c).cast("string"))] + [x for k, v in extra for x in (F.lit(k), v.cast("string"))]
    own = F.create_map(*pairs)
    return chunks.withColumn("metadata", merged(own, F.col(annotations)) if annotations else own)


def merged(first: Column, second: Column) -> Column:
    """Two maps as one; keys of the second win."""
    kept = F.map_filter(first, lambda k, v: ~F.array_contains(F.map_keys(F.coalesce(second, F.create_map().cast("map<string,string>"))), k))
    return F.map_concat(kept, F.coalesce(second, F.create_map().cast("map<string,string>")))
