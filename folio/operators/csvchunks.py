"""CSV held as text in a column: delimiter, records, headers, types, chunks.

Texts without quotes are split by lines and delimiter. Where quotes are well
placed, every second part between them is quoted, and only the others hold
delimiters. A fold over characters is left for misplaced quotes alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import bound, col, count_of, exploded, lines, title_name, trim_space

#: Delimiters in the order that decides ties, and their names.
DELIMITERS = {",": "comma", ";": "semicolon", "\t": "tab", "|": "pipe"}
#: Texts that count as booleans.
BOOLEANS = ("true", "false", "yes", "no", "y", "n", "1", "0", "on", "off")
_FLOAT = r"(?i)\A[+-]?(?:inf|infinity|nan|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)\z"


def delimiter(text: str | Column, path: str | Column | None = None) -> Column:
    """The most frequent delimiter of the first three lines; comma without any; tab for .tsv."""
    sample = F.array_join(F.slice(lines(text), 1, 3), "\n")
    counts = [count_of(sample, d) for d in DELIMITERS]
    most = F.greatest(*counts)
    found = F.lit(",")
    for d, n in reversed(list(zip(DELIMITERS, counts, strict=True))):
        found = F.when((n == most) & (n > 0), F.lit(d)).otherwise(found)
    return found if path is None else F.when(F.lower(col(path)).endswith(".tsv"), F.lit("\t")).otherwise(found)


def delimiter_name(d: Column) -> Column:
    return F.coalesce(*(F.when(d == k, F.lit(v)) for k, v in DELIMITERS.items()), F.lit("unknown"))


def quoted(cell: str | Column, d: str | Column = ",") -> Column:
    """A cell as CSV writes it: in quotes where it holds the delimiter, a quote or a line break."""
    cell = col(cell)
    d = F.lit(d) if isinstance(d, str) else d
    needs = F.contains(cell, d) | cell.rlike('["\r\n]')
    return F.when(needs, F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell)


def format_row(cells: Column, d: str | Column = ",") -> Column:
    """Cells quoted where they need it, with delimiters between."""
    d = F.lit(d) if isinstance(d, str) else d
    joined = F.aggregate(cells, F.lit(None).cast("string"), lambda s, c: F.when(s.isNull(), quoted(c, d)).otherwise(F.concat(s, d, quoted(c, d))))
    return F.coalesce(joined, F.lit(""))


def records(text: str | Column, d: Column) -> Column:
    """Records as arrays of cells; blank lines are left out, spaces before a cell dropped, quotes undone."""
    return bound(F.regexp_replace(col(text), r"\r\n", "\n"), lambda t: _records(t, d))


def _records(text: Column, d: Column) -> Column:
    plain = F.transform(F.filter(F.split(text, "\n", -1), lambda x: x != ""), lambda x: F.transform(F.split(x, F.concat(F.lit(r"\Q"), d, F.lit(r"\E")), -1), lambda c: F.ltrim(c)))
    state = "struct<cell:string,row:array<string>,rows:array<array<string>>,inside:boolean,held:boolean>"
    none = F.array().cast("array<string>")
    put = lambda cell, row, rows, inside, held: F.struct(cell.alias("cell"), row.alias("row"), rows.alias("rows"), inside.alias("inside"), held.alias("held")).cast(state)
    start = put(F.lit(""), none, F.array().cast("array<array<string>>"), F.lit(False), F.lit(False))

    def step(s: Column, c: Column) -> Column:
        # held: a quote inside quotes that either ends them or is the first of two
        quote = F.lit('"')
        within = s["inside"] & ~s["held"]
        append = put(F.concat(s["cell"], c), s["row"], s["rows"], s["inside"], F.lit(False))
        next_cell = put(F.lit(""), F.array_append(s["row"], s["cell"]), s["rows"], F.lit(False), F.lit(False))
        blank = (F.size(s["row"]) == 0) & (s["cell"] == "")
        next_row = put(F.lit(""), none, F.when(blank, s["rows"]).otherwise(F.array_append(s["rows"], F.array_append(s["row"], s["cell"]))), F.lit(False), F.lit(False))
        return (
            F.when(within & (c == quote), put(s["cell"], s["row"], s["rows"], F.lit(True), F.lit(True)))
            .when(within, append)
            .when(s["held"] & (c == quote), put(F.concat(s["cell"], quote), s["row"], s["rows"], F.lit(True), F.lit(False)))
            .when(c == d, next_cell)
            .when(c == "\n", next_row)
            .when((c == quote) & (s["cell"] == "") & ~s["held"], put(F.lit(""), s["row"], s["rows"], F.lit(True), F.lit(False)))
            .when((c == " ") & (s["cell"] == ""), s)
            .otherwise(append)
        )

    full = F.aggregate(F.split(F.concat(text, F.lit("\n")), ""), start, step, lambda s: s["rows"])
    return F.when(~F.contains(text, F.lit('"')), plain).when(_well_quoted(text, d), _by_quotes(text, d)).otherwise(full)


#: Stand in for the delimiters and line feeds outside of quotes.
_CELL, _ROW = "\x01", "\x02"


def _well_quoted(text: Column, d: Column) -> Column:
    """Quotes are even in number; each quoted part stands alone between delimiters, line feeds and the text's ends, or doubles a quote."""
    parts = F.split(text, '"', -1)
    last = F.size(parts) - 1
    begins = lambda p: p.startswith(d) | p.startswith("\n")
    ends = lambda p: F.rtrim(p).endswith(d) | p.rlike(r"\n *\z")

    def fits(p: Column, i: Column) -> Column:
        inner = (p == "") | ((begins(p) | (i == 0)) & (ends(p) | (i == last) | ((i == 0) & (F.trim(p) == ""))))
        return (i % 2 == 1) | inner

    return (last % 2 == 0) & ~text.rlike(f"[{_CELL}{_ROW}]") & F.forall(F.transform(parts, fits), lambda ok: ok)


def _by_quotes(text: Column, d: Column) -> Column:
    parts = F.split(text, '"', -1)
    last = F.size(parts) - 1

    def outside(p: Column, i: Column) -> Column:
        marked = F.regexp_replace(F.translate(F.replace(p, d, F.lit(_CELL)), "\n", _ROW), f"([{_CELL}{_ROW}]) +", "$1")
        return F.when((p == "") & (i > 0) & (i < last), F.lit('"')).otherwise(F.when(i == 0, F.ltrim(marked)).otherwise(marked))

    joined = F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, p).otherwise(outside(p, i))), "")
    return F.transform(F.filter(F.split(joined, _ROW, -1), lambda r: r != ""), lambda r: F.split(r, _CELL, -1))


def has_header(rows: Column) -> Column:
    """Scores a first row that is text, differs from the second and is short; a single row is a header."""
    score = F.aggregate(
        F.zip_with(
            rows[0],
            rows[1],
            lambda a, b: F.when((trim_space(a) != "") & ~trim_space(a).rlike(_FLOAT), 1).otherwise(0) + F.when(a != b, 1).otherwise(0) + F.when(F.octet_length(a) < 30, 1).otherwise(0),
        ),
        F.lit(0),
        lambda s, x: s + x,
    )
    return F.when(F.size(rows) < 2, True).when(F.size(rows[0]) != F.size(rows[1]), False).otherwise(score > F.size(rows[0]))


def cell_type(cell: str | Column) -> Column:
    """empty, boolean, integer, float, date or text."""
    c = trim_space(cell)
    low = F.lower(c)
    integer = c.rlike(r"\A[+-]?[0-9]+\z") & c.try_cast("bigint").isNotNull()
    shape = (F.octet_length(c).isin(10, 11, 12, 15)) & ((count_of(c, "-") == 2) | (count_of(c, "/") == 2) | F.contains(c, F.lit(" ")))
    return F.when(c == "", "empty").when(low.isin(*BOOLEANS), "boolean").when(integer, "integer").when(c.rlike(_FLOAT), "float").when(shape, "date").otherwise("text")


#: The order that decides ties between equally frequent types.
TYPE_ORDER = ("boolean", "integer", "float", "date", "text", "empty")


def _equals(value: str):
    return lambda x: x == F.lit(value)


def column_type(cells: Column, sample: int = 20) -> Column:
    """The most frequent type of a column's first cells; text for none."""
    names = F.array(*(F.lit(k) for k in TYPE_ORDER))
    pick = lambda n: F.when(F.array_max(n) > 0, F.element_at(names, F.array_position(n, F.array_max(n)).cast("int"))).otherwise("text")
    return bound(F.transform(F.slice(cells, 1, sample), cell_type), lambda types: bound(F.array(*(F.size(F.filter(types, _equals(k))) for k in TYPE_ORDER)), pick))


def parsed(docs: DataFrame, text: str = "text", path: str = "path") -> DataFrame:
    """``docs`` with delimiter, records, has_header, headers, rows (without the header) and ``ragged``."""

    def read(d: Column) -> Column:
        return bound(records(text, d), lambda r: bound(has_header(r), lambda h: parts(d, r, h)))

    def parts(d: Column, r: Column, h: Column) -> Column:
        body = F.when(h, F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0)))).otherwise(r)
        return F.struct(d.alias("delimiter"), r.alias("records"), h.alias("has_header"), F.exists(r, lambda x: F.size(x) != F.size(r[0])).alias("ragged"), F.when(h, r[0]).alias("headers"), body.alias("rows"))

    out = docs.withColumn("__p", bound(delimiter(text, path), read))
    return out.select(*docs.columns, "__p.*")


def rows_per_chunk(max_lines: int = 0, chunk_size: int = 0) -> Column:
    """500 unless lines or bytes are limited; one at least."""
    if max_lines > 0:
        return F.lit(max(1, max_lines - 5))
    if chunk_size > 0:
        sample = F.slice("rows", 1, 10)
        size = F.aggregate(F.flatten(sample), F.lit(0), lambda s, c: s + F.octet_length(c) + 1)
        mean = F.floor(size / F.greatest(F.size(sample), F.lit(1)))
        return F.greatest(F.lit(1), F.when(mean > 0, F.floor(chunk_size / mean)).otherwise(500)).cast("int")
    return F.lit(500)


def chunk_csv(docs: DataFrame, text: str = "text", path: str = "path", max_lines: int = 0, chunk_size: int = 0) -> DataFrame:
    """Chunks of CSV texts: one document up to 20 rows, else a header chunk and groups of rows; ragged ones stay whole."""
    rest = [c for c in docs.columns if c != text]
    found = parsed(docs.where(F.col(text).isNotNull() & (trim_space(text) != "")), text, path).withColumn("k", rows_per_chunk(max_lines, chunk_size))
    name, d, n = title_name(path), F.col("delimiter"), F.size("rows")
    make = lambda content, a, b, kind, label: F.struct(content.alias("content"), a.cast("int").alias("line_start"), b.cast("int").alias("line_end"), F.lit(kind).alias("type"), label.alias("identifier"))
    total = F.size(lines(text))
    head = F.when(F.col("has_header"), F.array(make(format_row(F.col("headers"), d), F.lit(1), F.lit(1), "csv_headers", F.concat(name, F.lit(" - Headers"))))).otherwise(F.array())
    first = F.when(F.col("has_header"), 2).otherwise(1)

    def group(i: Column) -> Column:
        lo, hi = i * F.col("k"), F.least((i + 1) * F.col("k"), n)
        return make(F.array_join(F.transform(F.slice("rows", lo + 1, F.col("k")), lambda r: format_row(r, d)), "\n"), first + lo, first + hi - 1, "csv_data", F.concat(name, F.lit(" - Rows "), (lo + 1).cast("string"), F.lit("-"), hi.cast("string")))

    groups = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / F.col("k")).cast("int") - 1, F.lit(0))), group)
    single = F.array(make(F.col(text), F.lit(1), total, "csv_document", name))
    fallback = F.array(make(F.col(text), F.lit(1), total, "csv_fallback", name))
    chunks = F.when(F.col("ragged"), fallback).when(n <= 20, single).otherwise(F.concat(head, groups))
    return exploded(found, rest, chunks, "chunk_index", "c").select(*rest, "chunk_index", "c.*")


def csv_metadata(docs: DataFrame, text: str = "text", path: str = "path") -> DataFrame:
    """Row and column counts, delimiter, header flag, column types and the share of cells that are not empty."""
    found = parsed(docs, text, path)
    cells = F.flatten("rows")
    filled = F.size(F.filter(cells, lambda c: trim_space(c) != ""))
    width = F.size(F.col("records")[0])
    types = F.transform(F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0))), lambda i: column_type(F.transform("rows", lambda r: F.get(r, i))))
    return found.select(
        *(c for c in docs.columns if c != text),
        F.size("rows").alias("row_count"),
        width.alias("column_count"),
        "has_header",
        "headers",
        delimiter_name(F.col("delimiter")).alias("delimiter"),
        types.alias("column_types"),
        F.round(F.when(F.size(cells) > 0, filled / F.size(cells)).otherwise(0.0), 3).alias("data_density"),
    )
