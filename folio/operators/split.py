"""Splitters: recursive by separators, by lines, sizes and limits, filters and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import WHITE, col, exploded, extension, lines, token_estimate, trim_space
from folio.operators.tokens import Tokenizer, count_tokens, split_by_tokens
from folio.storage import written

#: Separators from coarse to fine.
SEPARATORS = ("\n\n", "\n", " ", "")
_FOLD = "struct<cur:string,out:array<string>>"


def _fold(parts: Column, step) -> Column:
    start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out")).cast(_FOLD)
    done = lambda s: F.when(s["cur"] != "", F.array_append(s["out"], s["cur"])).otherwise(s["out"])
    return F.aggregate(parts, start, step, done)


def _packed(text: Column, separator: str, size: int | Column) -> Column:
    """Parts between separators, joined again while they stay within ``size`` bytes."""
    quoted = rf"\Q{separator}\E" if separator else ""

    def step(s: Column, part: Column) -> Column:
        room = (s["cur"] != "") & (F.octet_length(s["cur"]) + len(separator) + F.octet_length(part) <= size)
        flush = F.when(s["cur"] != "", F.array_append(s["out"], s["cur"])).otherwise(s["out"])
        put = lambda cur, out: F.struct(cur.alias("cur"), out.alias("out")).cast(_FOLD)
        return F.when(part == "", s).when(room, put(F.concat(s["cur"], F.lit(separator), part), s["out"])).otherwise(put(part, flush))

    return _fold(F.split(text, quoted, -1), step)


def _tail(text: Column, overlap: int) -> Column:
    """The last characters of a text that fit into ``overlap`` bytes; no character is cut."""
    if not overlap:
        return F.lit("")
    end = F.hex(F.substring(F.encode(text, "UTF-8"), -overlap, overlap))
    whole = F.unhex(F.regexp_replace(end, r"\A(?:[89AB][0-9A-F]){1,3}", "")).cast("string")  # without the rest of a cut character
    return F.when(F.octet_length(text) <= overlap, text).otherwise(whole)


def merge_with_overlap(chunks: Column, size: int, overlap: int) -> Column:
    """Chunks joined by line feeds while they fit; each new one begins with the end of the one before."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than the chunk size")

    def step(s: Column, part: Column) -> Column:
        put = lambda cur, out: F.struct(cur.alias("cur"), out.alias("out")).cast(_FOLD)
        room = F.octet_length(s["cur"]) + 1 + F.octet_length(part) <= size
        joined = put(F.concat(s["cur"], F.lit("\n"), part), s["out"])
        opened = put(F.concat(_tail(s["cur"], overlap), F.lit("\n"), part), F.array_append(s["out"], s["cur"]))
        return F.when(s["cur"] == "", put(part, s["out"])).when(room, joined).otherwise(opened)

    return F.when(F.size(chunks) > 1, _fold(chunks, step)).otherwise(chunks)


def recursive_split(text: str | Column, size: int | Column = 1000, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS) -> Column:
    """Chunks of a text of up to ``size`` bytes: paragraphs before lines before words before characters.

    A part that is too long goes on to the next separator; where overlaps are
    asked for, each level joins its chunks again with them, so that a chunk may
    come out longer than ``size`` by the overlap.
    """
    text = col(text)
    if not separators:
        return F.array(text)
    deeper = lambda part: F.when(F.octet_length(part) <= size, F.array(part)).otherwise(recursive_split(part, size, overlap, separators[1:]))
    parts = F.flatten(F.transform(_packed(text, separators[0], size), deeper))
    if overlap > 0:
        parts = merge_with_overlap(parts, size, overlap)
    return F.when(F.octet_length(text) <= size, F.array(text)).otherwise(parts)


def split_documents(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """A row for each chunk with ``chunk_index`` and ``total_chunks``; null texts have none."""
    made = docs.withColumn("__chunks", recursive_split(text, **options))
    rest = [c for c in docs.columns if c != text]
    return exploded(made, [*rest, F.size("__chunks").alias("total_chunks")], F.col("__chunks"), "chunk_index", "content")


def recommended_size(path: str | Column, length: str | Column, default: int = 2000) -> Column:
    """Tokens a chunk should hold, by file extension and byte length."""
    n, ext = col(length), F.lower(extension(path))
    base = F.when(ext.isin(".go", ".java", ".cs", ".cpp", ".cc", ".cxx", ".md", ".txt", ".rst"), 1024).when(ext.isin(".js", ".ts", ".py", ".rb"), 768).when(ext.isin(".c", ".h", ".json", ".xml", ".yaml", ".yml"), 512)
    grown = F.when(n > 200_000, base * 2).when(n > 50_000, F.floor(base * 1.5)).otherwise(base)
    return F.coalesce(grown, F.when(n > 200_000, 4096).when(n > 50_000, 2048).otherwise(default)).cast("int")


def limits(size: str | Column, ratio: float = 4.0) -> tuple[Column, Column]:
    """(least bytes, most lines) of a chunk of so many tokens."""
    size = col(size)
    return F.greatest(F.lit(20), F.floor(size * ratio * 0.25)).cast("int"), F.least(F.lit(200), F.greatest(F.lit(5), F.floor(size / (ratio * 2)))).cast("int")


def effective_overlap(size: str | Column, asked: str | Column | None = None, share: float = 0.1) -> Column:
    """The asked overlap or a tenth of the size; a quarter of the size where it would not be smaller than it."""
    size = col(size)
    wanted = F.floor(size * share) if asked is None else F.when(col(asked) > 0, col(asked)).otherwise(F.floor(size * share))
    return F.when(wanted >= size, F.floor(size / 4)).otherwise(wanted).cast("int")


def validate_options(size: int, overlap: int, largest: int = 100_000) -> None:
    if not 0 <= size <= largest:
        raise ValueError(f"chunk size must be in 0..{largest}")
    if overlap < 0 or (size and overlap >= size):
        raise ValueError("overlap must not be negative and must be below the chunk size")


def significant(content: str | Column, least: int = 50, share: float = 0.25, fewest: int = 3) -> Column:
    """True for content of at least ``least`` trimmed bytes, a quarter of whose signs are letters or digits."""
    trimmed = trim_space(content)
    solid = F.length(F.regexp_replace(trimmed, rf"[{WHITE}]", ""))
    useful = F.length(F.regexp_replace(trimmed, r"[^\p{L}\p{Nd}]", ""))
    return (F.octet_length(trimmed) >= least) & (solid > 0) & (useful >= fewest) & (useful >= share * solid)


def post_process(chunks: DataFrame, size: int | Column, max_lines: int | Column, least: int = 50, tokenizer: Tokenizer | None = None) -> DataFrame:
    """Chunks worth keeping, those of over twice ``size`` tokens cut into ``type``_part rows: by tokens with a tokenizer, which needs a fixed ``size``, else by lines."""
    from folio.operators.textchunks import split_lines

    kept = chunks.where(significant("content", least)).withColumn("token_count", count_tokens("content", tokenizer))
    shape = "array<struct<k:int,content:string,from:int,to:int>>"
    if tokenizer is None:
        blocks = split_lines(F.col("content"), max_lines)
    else:
        if isinstance(size, Column):
            raise ValueError("cuts by a tokenizer need one size for all chunks")
        kept = kept.withColumn("__t", split_by_tokens(F.when(F.col("token_count") > 2 * size, F.col("content")), size, tokenizer))
        count = lambda t: F.size(lines(t)) - 1
        before = F.aggregate(F.transform("__t", lambda x: count(x["content"])), F.array(F.lit(0)), lambda s, n: F.array_append(s, F.element_at(s, -1) + n))
        kept = kept.withColumn("__n", before)
        blocks = F.transform("__t", lambda x, k: F.struct(k.alias("k"), x["content"].alias("content"), F.get(F.col("__n"), k).alias("from"), F.get(F.col("__n"), k + 1).alias("to"))).cast(shape)
    blocks = F.filter(blocks, lambda b: F.octet_length(trim_space(b["content"])) >= least)
    whole = F.array(F.struct(F.lit(-1).alias("k"), F.col("content"), F.lit(0).alias("from"), F.lit(0).alias("to")))
    parts = F.when((F.col("token_count") > 2 * size) & (F.size(blocks) > 0), blocks).otherwise(whole)
    rest = [c for c in chunks.columns if c not in ("content", "type", "line_start", "line_end")]
    out = kept.withColumn("__p", F.explode(parts))
    cut = F.col("__p.k") >= 0
    made = out.select(
        *rest,
        F.col("__p.content").alias("content"),
        F.when(cut, F.concat("type", F.lit("_part_"), (F.col("__p.k") + 1).cast("string"))).otherwise(F.col("type")).alias("type"),
        (F.col("line_start") + F.when(cut, F.col("__p.from")).otherwise(0)).alias("line_start"),
        F.when(cut, F.col("line_start") + F.col("__p.to")).otherwise(F.col("line_end")).alias("line_end"),
    )
    return made.withColumn("token_count", count_tokens("content", tokenizer))


def split_files(files: DataFrame, registry, text: str = "text", path: str = "path", window: int = 4096) -> DataFrame:
    """From files to enriched chunks in one call.

    Each file is tested for content worth splitting, chunked by its own parser
    with sizes that follow its extension and length, and its chunks are filtered
    and cut. A file whose parser leaves nothing falls back to recursive
    splitting (``text_fallback``); one without significant content stays whole
    (``original``). ``enriched_content`` adds the file's header line and the end
    of the chunk before. Paths are taken as unique; null texts are left out.

    Columns: path, chunk_index, total_chunks, content, type, identifier,
    line_start, line_end, token_count, enriched_content.
    """
    given = files.where(F.col(text).isNotNull()).select(F.col(path).alias("path"), F.col(text).alias("text"))
    sized = given.withColumn("worth", significant("text")).withColumn("size", recommended_size("path", F.octet_length("text")))
    worth = sized.where("worth")
    keep = ["path", "content", "type", "identifier", "line_start", "line_end", "token_count"]
    chunks = registry.chunk_files(worth).where("type <> 'file'").select("path", "chunk_index", "content", "type", "identifier", "line_start", "line_end")
    made = chunks.join(worth.select("path", "size"), "path")
    made = written(post_process(made, F.col("size"), limits("size")[1]).select("chunk_index", *keep), "chunks")
    total = F.size(lines("text"))
    left = worth.join(made.select("path").distinct(), "path", "left_anti")
    pieces = left.withColumn("__c", recursive_split("text", F.col("size"), 0)).select("path", total.alias("n"), F.posexplode("__c").alias("chunk_index", "content"))
    fallback = pieces.select("chunk_index", "path", "content", F.lit("text_fallback").alias("type"), F.concat("path", F.lit("_part_"), F.col("chunk_index").cast("string")).alias("identifier"), F.lit(1).alias("line_start"), F.col("n").alias("line_end"), token_estimate("content").alias("token_count"))
    original = sized.where(~F.coalesce("worth", F.lit(False))).select(F.lit(0).alias("chunk_index"), "path", F.col("text").alias("content"), F.lit("original").alias("type"), F.col("path").alias("identifier"), F.lit(1).alias("line_start"), total.alias("line_end"), token_estimate("text").alias("token_count"))
    every = made.unionByName(fallback).unionByName(original)
    order = Window.partitionBy("path").orderBy("chunk_index", "line_start", "type")
    every = every.withColumn("chunk_index", F.row_number().over(order) - 1).withColumn("total_chunks", F.count(F.lit(1)).over(Window.partitionBy("path")).cast("int"))
    every = every.withColumn("__head", F.when(F.col("type") != "original", file_header("path", F.lit(""))).otherwise(""))
    return enrich(every, "path", "chunk_index", "__head", window).drop("__head")


def overlap_lines(content: str | Column, most: int = 3) -> Column:
    """Up to three last lines that say something: not blank, no closing brace, no comment. Null where there are none."""
    parts = lines(content)

    def speaks(line: Column) -> Column:
        t = trim_space(line)
        return (t != "") & ~t.startswith("}") & ~t.startswith("//") & ~t.startswith("/*")

    said = F.filter(parts, speaks)
    last = F.slice(said, F.greatest(F.size(said) - most + 1, F.lit(1)), F.lit(most))
    return F.when((F.size(parts) >= 2) & (F.size(said) > 0), F.array_join(last, "\n"))


def file_header(path: str | Column, language: str | Column, imports: str | Column | None = None) -> Column:
    """A comment line that names the file, and one with up to five imports."""
    head = F.concat(F.lit("// File: "), col(path), F.when(F.coalesce(col(language), F.lit("")) != "", F.concat(F.lit(" ["), col(language), F.lit("]"))).otherwise(""), F.lit("\n"))
    if imports is None:
        return head
    listed = F.concat(F.lit("// Imports: "), F.array_join(F.slice(col(imports), 1, 5), ", "), F.lit("\n"))
    return F.concat(head, F.when(F.size(col(imports)) > 0, listed).otherwise(""))


def enrich(chunks: DataFrame, doc: str = "doc_id", index: str = "chunk_index", header: str | None = None, window: int = 4096, tokenizer: Tokenizer | None = None) -> DataFrame:
    """``enriched_content``: a chunk after its file header and lines of the chunk before, while the token window lasts.

    The window function is partitioned by document: a task holds the chunks of some documents, never of all.
    """
    before = F.lag("content").over(Window.partitionBy(doc).orderBy(index))
    overlap = overlap_lines(F.col("__before"))
    marked = F.concat(F.lit("// Previous context:\n"), overlap, F.lit("\n// Current section:\n"))
    out = chunks.withColumn("__before", before).withColumn("__marked", marked).withColumn("__header", F.col(header) if header else F.lit(""))
    for name in ("content", "__header", "__marked"):
        out = out.withColumn(f"__n_{name}", count_tokens(name, tokenizer))
    own, head = F.col("__n_content"), F.col("__header")
    takes_head = (head != "") & (own + F.col("__n___header") <= window)
    left = window - own - F.when(takes_head, F.col("__n___header")).otherwise(0)
    takes_overlap = F.col("__marked").isNotNull() & (F.col("__n___marked") <= left)
    out = out.withColumn("enriched_content", F.concat(F.when(takes_overlap, F.col("__marked")).otherwise(""), F.when(takes_head, head).otherwise(""), F.col("content")))
    return out.drop("__before", "__marked", "__header", "__n_content", "__n___header", "__n___marked")


def truncate_to_tokens(content: str | Column, most: int) -> Column:
    """Whole lines from the start while the estimate stays within ``most`` tokens."""
    state = "struct<cur:string,full:boolean>"
    start = F.struct(F.lit("").alias("cur"), F.lit(False).alias("full")).cast(state)

    def step(s: Column, line: Column) -> Column:
        longer = F.when(s["cur"] != "", F.concat(s["cur"], F.lit("\n"), line)).otherwise(line)
        over = s["full"] | (token_estimate(longer) > most)
        return F.struct(F.when(over, s["cur"]).otherwise(longer).alias("cur"), over.alias("full")).cast(state)

    return F.aggregate(lines(content), start, step, lambda s: trim_space(s["cur"]))
