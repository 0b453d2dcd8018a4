"""Operator 7: substring dedup by relative Lempel-Ziv parsing of word sequences.

The reference is the whole corpus, cut by content into overlapping blocks: the
windows of ``window`` words that share a least-hash anchor form one block, so
that equal passages are cut alike wherever they stand. The index holds the first
occurrence of every block by anchor and content. A document is parsed greedily
from its start: while the next block continues the reference block where the
last one stood, the factor grows; else a new factor begins. A block that meets
its anchor but not its content in the index is a factor boundary: each window
that straddles it is looked up by itself. Factors of at least a window's length,
and shorter ones that such windows reach over, become the duplicate spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import words
from folio.llm.common import drop, flat, fresh, released, slices, small_batches, utf8, written

_Q = np.uint64(0x9E3779B97F4A7C15 | 1)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(_Q), -1, 2**64))
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, q, np.uint64)])) for q in (_Q, inverse))


class Text:
    """Word hashes of some texts, with the hash of any run of words at hand."""

    def __init__(self, array: pa.Array):
        self.data, offsets = utf8(array)
        self.lo, self.hi = words.spans(self.data, offsets)
        self.first = np.searchsorted(self.lo, offsets)  # word number where each text starts
        self.n = np.diff(self.first)
        hashes = words.several_hashes(self.data, self.lo, self.hi)
        self.hash = hashes[0]
        size = 1 << max(16, int(len(self.hash)).bit_length())
        self.up, self.down = _powers(size)
        #: Sums over two independent hashes of the words.
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * self.up[: len(h)])]) for h in hashes]

    def run(self, start: np.ndarray, length: np.ndarray | int, which: int = 0) -> np.ndarray:
        """Hash ``which`` (0 or 1, independent of each other) of runs of words."""
        sums = self.sums[which]
        return words.mix((sums[start + length] - sums[start]) * self.down[start] + np.asarray(length).astype(np.uint64))

    def windows(self, window: int) -> np.ndarray:
        """First words of all windows, text by text."""
        return flat(self.first[:-1], np.maximum(self.n - window + 1, 0))

    def blocks(self, window: int, gram: int) -> tuple[np.ndarray, ...]:
        """(text, first word, number of windows, anchor hash, content hash) of every block."""
        at = self.windows(window)
        if not len(at):
            empty = np.zeros(0, np.int64)
            return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
        grams = self.run(np.arange(len(self.hash) - gram + 1), gram)
        least, where = grams[at], np.zeros(len(at), np.int64)
        for k in range(1, window - gram + 1):
            other = grams[at + k]
            lower = other < least
            least = np.where(lower, other, least)
            where[lower] = k
        anchor = at + where
        text = np.repeat(np.arange(len(self.n)), np.maximum(self.n - window + 1, 0))
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        cut = np.flatnonzero(new)
        count = np.diff(np.append(cut, len(at)))
        start = at[cut]
        content = words.mix(self.run(start, count + window - 1, 1) + (anchor[cut] - start).astype(np.uint64) * _Q)
        return text[cut], start, count, least[cut], content


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


_BLOCK = "doc_id long, at int, n int, anchor long, content long"


def _blocks(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                t = Text(batch.column(1).slice(lo, hi - lo))
                text, start, count, anchor, content = t.blocks(window, gram)
                at = start - t.first[text]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).take(pa.array(text)), pa.array(at.astype(np.int32)), pa.array(count.astype(np.int32)), _signed(anchor), _signed(content)],
                    names=["doc_id", "at", "n", "anchor", "content"],
                )

    return small_batches(docs).where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(released(run), _BLOCK)


_WINDOW = "doc_id long, at int, one long, two long"


def _window_hashes(parts: DataFrame, window: int) -> DataFrame:
    """Two hashes of every window of the blocks ``spans`` (at, n) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                t = Text(part.column(1))
                spans = part.column(2)
                inside = spans.flatten()
                text = np.repeat(np.arange(part.num_rows), spans.value_lengths().to_numpy())
                at, n = inside.field("at").to_numpy().astype(np.int64), inside.field("n").to_numpy().astype(np.int64)
                n = np.clip(t.n[text] - window + 1 - at, 0, n)
                own, text = flat(at, n), np.repeat(text, n)
                start = own + t.first[text]
                one, two = (t.run(start, window, which) for which in (0, 1))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text)), pa.array(own.astype(np.int32)), _signed(one), _signed(two)], names=["doc_id", "at", "one", "two"])

    return parts.mapInArrow(released(run), _WINDOW)


def seeds(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, at, n, ref_doc, ref_at): runs of n windows from word ``at`` on, and where the index holds them earlier."""
    blocks = written(_blocks(docs, window, gram), "blocks")
    shared = blocks.groupBy("anchor").agg(F.count(F.lit(1)).alias("k"), F.min("content").alias("a"), F.max("content").alias("b")).where("k > 1").select("anchor", (F.col("a") != F.col("b")).alias("mixed"))
    met = written(blocks.join(written(shared, "anchors"), "anchor"), "met")  # of two tables: a frequent anchor can be split
    drop(blocks)
    place = F.struct("doc_id", "at")
    index = written(met.groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "at", "n", "mixed")).alias("f"), F.count(F.lit(1)).alias("k")), "index")
    again = index.where("k > 1").select("anchor", "content", F.col("f.doc_id").alias("ref_doc"), F.col("f.at").alias("ref_at"))
    whole = written(met.join(again, ["anchor", "content"]).where("doc_id <> ref_doc or at <> ref_at").select("doc_id", "at", "n", "ref_doc", "ref_at"), "whole")
    drop(met)
    #: Factor boundaries: the first block of each content whose anchor has several.
    edges = index.where("f.mixed").groupBy("f.doc_id").agg(F.collect_list(F.struct("f.at", "f.n")).alias("spans"))
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    loose = written(_window_hashes(texts.join(edges, "doc_id").select("doc_id", "text", "spans"), window), "windows")
    drop(index)
    earliest = loose.groupBy("one", "two").agg(F.min(place).alias("f"), F.count(F.lit(1)).alias("k")).where("k > 1").select("one", "two", F.col("f.doc_id").alias("ref_doc"), F.col("f.at").alias("ref_at"))
    single = loose.join(written(earliest, "earliest"), ["one", "two"]).where("doc_id <> ref_doc or at <> ref_at")
    single = written(single.select("doc_id", "at", F.lit(1).alias("n"), "ref_doc", "ref_at"), "single")
    drop(loose)
    return whole.union(single)


def parse(row: np.ndarray, at: np.ndarray, n: np.ndarray, ref_doc: np.ndarray, ref_at: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(row, start, length, ref_doc, ref_start) in words: the greedy factors of each row's seeds.

    A factor begins at the first word that no factor holds yet and goes on while
    the next windows continue its reference at the same distance.
    """
    order = np.lexsort((-n, at, row))
    row, at, n, ref_doc, ref_at = (x[order] for x in (row, at, n, ref_doc, ref_at))
    if not len(row):
        return row, at, n, ref_doc, ref_at
    new = np.ones(len(row), bool)
    #: Blocks of one text don't overlap in windows, so that seeds follow each other.
    new[1:] = (row[1:] != row[:-1]) | (ref_doc[1:] != ref_doc[:-1]) | (ref_at[1:] - at[1:] != ref_at[:-1] - at[:-1]) | (at[1:] > (at + n)[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    row, start, end, ref_doc, distance = row[first], at[first], (at + n)[last] + window - 1, ref_doc[first], (ref_at - at)[first]
    base = row << 40
    reached = np.maximum.accumulate(base + end) - base  # the furthest end in the text so far
    start = np.concatenate([start[:1], np.where(row[1:] == row[:-1], np.maximum(start[1:], reached[:-1]), start[1:])])
    keep = end > start
    return row[keep], start[keep], (end - start)[keep], ref_doc[keep], (start + distance)[keep]


_FACTOR = "array<struct<start:int,length:int,ref_doc:long,ref_start:int>>"


def factors(docs: DataFrame, window: int = 20, gram: int = 6) -> DataFrame:
    """(doc_id, factors): the parse of each document that repeats something; words between factors are literals.

    A factor is a run of ``length`` words from word ``start`` on that stands from
    word ``ref_start`` on in ``ref_doc`` as well, earlier. Factors don't overlap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            inside = lists.flatten()
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            row, *found = parse(row, *(inside.field(c).to_numpy().astype(np.int64) for c in ("at", "n", "ref_doc", "ref_at")), window)
            items = pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(found, (pa.int32(), pa.int32(), pa.int64(), pa.int32()), strict=True)], names=["start", "length", "ref_doc", "ref_start"])
            cuts = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(cuts, items)], names=["doc_id", "factors"])

    found = seeds(docs, window, gram)
    own = found.groupBy("doc_id").agg(F.collect_list(F.struct("at", "n", "ref_doc", "ref_at")).alias("seeds"))  # as many as a text has blocks and windows
    made = written(own.mapInArrow(run, f"doc_id long, factors {_FACTOR}"), "factors")
    drop(found)
    return made


def _cover(runs: pa.Array, n: np.ndarray, first: np.ndarray, total: int) -> np.ndarray:
    """True at the words inside each text's factors."""
    inside = runs.flatten()
    text = np.repeat(np.arange(len(runs)), runs.value_lengths().fill_null(0).to_numpy())
    edge = np.zeros(total + 1, np.int64)
    if len(text):
        at, k = inside.field("start").to_numpy().astype(np.int64), inside.field("length").to_numpy().astype(np.int64)
        np.add.at(edge, first[text] + np.minimum(at, n[text]), 1)
        np.add.at(edge, first[text] + np.minimum(at + k, n[text]), -1)
    return np.cumsum(edge[:-1]) > 0


def _kept(joined: DataFrame, schema: str, texts_too: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                data, offsets = utf8(part.column("text"))
                a, b = words.spans(data, offsets)
                at = np.searchsorted(a, offsets)
                gone = _cover(part.column("factors"), np.diff(at), at[:-1], len(a))
                keep = ~gone
                size = np.where(keep, b - a + 1, 0)
                out = np.full(int(size.sum()) + 1, 0x20, np.uint8)
                ends = np.cumsum(size)
                out[flat((ends - size)[keep], (b - a)[keep])] = data[flat(a[keep], (b - a)[keep])]
                raw, cuts = out.tobytes(), np.concatenate([[0], ends])[at]
                kept = [raw[x : max(x, y - 1)] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[at])
                if texts_too:
                    made = {"text": pa.array([k.decode() for k in kept], pa.string()), "__removed": pa.array(removed)}
                else:
                    made = {"n_words": pa.array(np.diff(at)), "n_removed": pa.array(removed), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept])}
                rest = {c: part.column(c) for c in part.schema.names if c not in ("factors", "text")}
                yield pa.RecordBatch.from_pydict(rest | made)

    return joined.mapInArrow(run, schema)


def _with_factors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, text, factors) of all rows; factors is null where nothing is to go."""
    texts = docs.select("doc_id", "text")
    return texts.join(factors(texts, window, gram), "doc_id", "left")


def dedup_substrings(docs: DataFrame, window: int = 20, gram: int = 6) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row.

    Words of a window that starts earlier too (smaller doc_id, or earlier in
    the same document) are removed. Null texts have no words; texts of fewer
    than ``window`` words lose none. Rows with a null id are neither compared
    nor changed. Ids are taken as unique: rows that repeat an id count as one
    document at the same places, so that repeated rows are all kept. Other
    columns are ignored; an empty table gives no rows.
    """
    return _kept(_with_factors(docs, window, gram), "doc_id long, n_words long, n_removed long, kept_sha256 string", False)


def remove_repeats(docs: DataFrame, window: int = 20, gram: int = 6) -> DataFrame:
    """``docs`` with repeated passages cut out of their texts, same columns.

    A text that loses words becomes its kept words joined by one space; a text
    that loses none stays as it is, null included. ``n_chars``, where there is
    one, follows the text.
    """
    changed = _with_factors(docs, window, gram).where("factors is not null")
    new = fresh("__text", docs.columns)
    cut = written(_kept(changed, "doc_id long, text string, __removed long", True).select("doc_id", F.col("text").alias(new)).dropDuplicates(["doc_id"]), "cut")
    out = docs.join(cut, "doc_id", "left").withColumn("text", F.coalesce(new, "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(new).isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*(f"`{c}`" for c in docs.columns))
