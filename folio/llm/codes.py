"""Operator 13: vectors compressed to one code a part, by Lloyd's rounds over distinct integer parts.

Components become integers, vectors are cut into equal parts, and equal parts at
a position count as one row with a weight. The rounds read the distinct rows
only: a task adds up weighted sums of its rows for each entry, which Spark adds
over tasks, so that what reaches the driver is as large as the codebooks. At
the end codes and errors are joined back to the vectors.

All arithmetic is exact: double-precision products where no sum can pass 2^53,
Python integers elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import small_batches
from folio.storage import drop, written

#: Integers of a greater size count as this.
WIDEST = 1 << 62
_LONG = (1 << 63) - 1
#: A key that holds more than this share of all rows is joined by a broadcast; there are at most so many of them.
_HOT_KEYS = 1000


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], n: int, share: int = _HOT_KEYS) -> DataFrame:
    """``rows`` with the columns of ``counted``, which has one row for each of their keys and its number of rows.

    ``counted`` names that number ``n_rows`` and each key is in it; null keys
    meet null keys. Of ``n`` rows, keys with more than one in ``share`` are at
    most ``share`` and are broadcast; the others are shuffled.
    """
    other = [c for c in counted.columns if c not in keys and c != "n_rows"]
    hot = F.col("n_rows") * share > n
    side = counted.select(*(F.col(c).alias(f"__{c}") for c in keys), *other, "n_rows")
    same = lambda right: [F.col(c).eqNullSafe(right[f"__{c}"]) for c in keys]
    few = F.broadcast(side.where(hot).drop("n_rows").withColumn("__hot", F.lit(True)))
    met = rows.join(few, same(few), "left")
    at_once = met.where("__hot").select(*rows.columns, *other)
    rest = met.where("__hot is null").select(*rows.columns)
    many = side.where(~hot).drop("n_rows")
    return at_once.unionByName(rest.join(many.hint("shuffle_merge"), same(many)).select(*rows.columns, *other))


def integers(vector: str = "embedding", scale: int = 1024) -> Column:
    """floor(scale * x) of each component, at most ``WIDEST`` in size."""
    wide = float(WIDEST)
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(wide)), F.lit(-wide))).cast("long"))


def finite(vector: str = "embedding") -> Column:
    """True for vectors that are not null and hold only finite components."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return F.coalesce(F.col(vector).isNotNull() & fine, F.lit(False))


class Codebooks:
    """The entries of each part position: exact nearest entries, and sums of a round."""

    def __init__(self, entries: list[np.ndarray]):
        """``entries`` are integer matrices, one a part position (object dtype where they pass longs)."""
        self.entries = entries

    def assign(self, part: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of and squared distance to the nearest entry of each row, ties to the lower index."""
        book = self.entries[part]
        reach = max(int(np.abs(x).max(initial=0)), max((abs(int(v)) for v in book.flat), default=0))
        if 4 * x.shape[1] * reach * reach < 1 << 53:
            a, b = x.astype(np.float64), book.astype(np.float64)
            far = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]
            at = far.argmin(axis=1)
            return at, far[np.arange(len(x)), at].astype(np.int64)
        at, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        wide = book.astype(object)
        for i, row in enumerate(x.tolist()):
            gaps = wide - np.array(row, object)
            far = [int(v) for v in (gaps * gaps).sum(axis=1)]
            at[i] = min(range(len(far)), key=far.__getitem__)
            error[i] = min(far[at[i]], _LONG)
        return at, error

    def text(self) -> str:
        return ",".join(str(int(v)) for book in self.entries for v in book.flat)

    def moved(self, totals: pa.Table) -> Codebooks:
        """The next round's entries: floors of the means; an entry without rows stays. ``totals``: part, entry, place (-1: weight), total."""
        new = [book.astype(object) for book in self.entries]
        sums = {(p, k, i): int(v) for p, k, i, v in zip(*(totals.column(c).to_pylist() for c in ("part", "entry", "place", "total")), strict=True)}
        for (p, k, i), total in sums.items():
            if i >= 0:
                new[p][k, i] = total // sums[p, k, -1]
        return Codebooks([b if max((abs(v) for v in b.flat), default=0) > _LONG else b.astype(np.int64) for b in new])


def _rows(batches: Iterator[pa.RecordBatch], slice_rows: int = 4096) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """Part position, rows and their integers, a slice of one position at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, slice_rows):
            some = batch.slice(lo, slice_rows)
            parts = some.column("part").to_numpy(zero_copy_only=False)
            for p in np.unique(parts):
                own = some.filter(pa.array(parts == p))
                values = own.column("value").flatten().to_numpy(zero_copy_only=False)
                yield int(p), own, values.reshape(own.num_rows, len(values) // max(own.num_rows, 1))


_TOTALS = "part int, entry int, place int, total decimal(38,0)"


def _round(distinct: DataFrame, books: Codebooks) -> Codebooks:
    """One round of Lloyd's: rows meet their nearest entries, entries move to their rows' means."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(b), b.shape[1] + 1), object) for b in books.entries]  # weight first
        for p, rows, x in _rows(batches):
            at, _ = books.assign(p, x)
            weight = rows.column("weight").to_numpy()
            reach = int(np.abs(x).max(initial=0))
            kind = np.int64 if (reach + 1) * int(weight.sum()) < _LONG else object
            own = np.zeros(sums[p].shape, kind)
            w = weight.astype(kind)
            np.add.at(own, at, np.column_stack([w, x.astype(kind) * w[:, None]]))
            used = np.unique(at)
            sums[p][used] += own[used].astype(object)
        for p, s in enumerate(sums):
            used = np.array([k for k in range(len(s)) if s[k, 0]], np.int32)
            if not len(used):
                continue
            width = s.shape[1]
            columns = [np.full(len(used) * width, p, np.int32), np.repeat(used, width), np.tile(np.arange(-1, width - 1, dtype=np.int32), len(used))]
            total = pa.array([Decimal(int(v)) for v in s[used].reshape(-1)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), total], names=["part", "entry", "place", "total"])

    summed = distinct.mapInArrow(run, _TOTALS).groupBy("part", "entry", "place").agg(F.sum("total").cast("decimal(38,0)").alias("total"))
    return books.moved(summed.toArrow())


def _first(kept: DataFrame, entries: int) -> list[list[int]]:
    """The integers of the rows with the smallest ids (nulls last; ties by integers): few from each partition, then of all."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("ints").asc()]
    return [list(r["ints"]) for r in kept.select("vec_id", "ints").orderBy(*order).limit(entries).collect()]


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error and codebooks_sha256 of each usable vector.

    Dropped are vectors that are null or hold null or non-finite components. A
    component x counts as floor(scale * x), at most 2^62 in size. All vectors
    count as long as the longest, made a multiple of ``parts``, with zeros at
    the end. A position's codebook starts as the parts of the ``entries`` (at
    most 256) smallest ids (repeated ids in the order of their integers, null
    ids last) and moves ``rounds`` times; where there are fewer rows, it has
    fewer entries. Repeated rows and ids each give their row. ``label_error``
    sums errors over equal labels, nulls together; errors and sums that pass a
    long count as the largest one. An empty table gives none.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    schema = T.StructType([T.StructField("vec_id", vectors.schema["vec_id"].dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType()), T.StructField("label_error", T.LongType()), T.StructField("codebooks_sha256", T.StringType())])
    usable = small_batches(vectors).select("vec_id", "embedding", "label").where(finite())
    found = usable.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    if not found["n"]:
        return vectors.sparkSession.createDataFrame([], schema)
    n, width = found["n"], -(-found["dim"] // parts)
    padded = F.concat(integers(scale=scale), F.array_repeat(F.lit(0).cast("long"), F.lit(width * parts) - F.size("embedding")))
    kept = written(usable.select("vec_id", "label", F.monotonically_increasing_id().alias("row"), padded.alias("ints")), "code_rows")
    first = _first(kept, entries)
    start = np.array(first, np.int64).reshape(len(first), width * parts)
    books = Codebooks([start[:, p * width : (p + 1) * width] for p in range(parts)])
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.struct(p.alias("part"), F.slice("ints", p * width + 1, F.lit(width)).alias("value")))
    placed = kept.select("vec_id", "label", "row", F.explode(cut).alias("p")).select("vec_id", "label", "row", "p.part", "p.value")
    distinct = written(placed.groupBy("part", "value").agg(F.count(F.lit(1)).alias("weight")), "code_parts")
    for _ in range(rounds):
        books = _round(distinct, books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, rows, x in _rows(batches):
            at, error = books.assign(p, x)
            yield pa.RecordBatch.from_arrays([rows.column("part"), rows.column("value"), rows.column("weight"), pa.array(at.astype(np.int32)), pa.array(error)], names=["part", "value", "n_rows", "entry", "part_error"])

    coded = written(distinct.mapInArrow(run, "part int, value array<long>, n_rows long, entry int, part_error long"), "codes")
    drop(distinct)
    joined = join_counted(placed, coded, ["part", "value"], n * parts).groupBy("row", "vec_id", "label")
    code = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "entry"))), lambda s: F.lpad(F.lower(F.hex(s["entry"])), 2, "0")), "")
    sum_long = lambda c: F.least(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("long")
    rows = written(joined.agg(code.alias("code"), sum_long("part_error").alias("error")).drop("row"), "coded_rows")
    drop(kept, coded)
    labels = rows.groupBy("label").agg(sum_long("error").alias("label_error"), F.count(F.lit(1)).alias("n_rows"))
    digest = hashlib.sha256(books.text().encode()).hexdigest()
    return join_counted(rows, labels, ["label"], n).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """The same in DuckDB SQL, for vectors of one length whose integers stay far below a long's bounds."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
f{r} AS (
  SELECT x.value, b.part, b.entry, list_sum(list_transform(list_zip(x.value, b.value), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS far
  FROM d x JOIN b{r} b ON x.part = b.part
),
a{r} AS (SELECT part, value, min(far) AS far, arg_min(entry, (far, entry)) AS entry FROM f{r} GROUP BY part, value)""")
        if r < rounds:
            steps.append(f"""
s{r} AS (
  SELECT a.part, a.entry, g.i, sum(d.weight * a.value[g.i])::BIGINT AS total, sum(d.weight)::BIGINT AS weight
  FROM a{r} a JOIN d ON d.part = a.part AND d.value = a.value, (SELECT unnest(range(1, (SELECT width + 1 FROM w))) AS i) g GROUP BY a.part, a.entry, g.i
),
b{r + 1} AS (
  SELECT b.part, b.entry, coalesce(m.value, b.value) AS value FROM b{r} b LEFT JOIN (
    SELECT part, entry, list((total - (((total % weight) + weight) % weight)) // weight ORDER BY i) AS value FROM s{r} GROUP BY part, entry
  ) m ON m.part = b.part AND m.entry = b.entry
)""")
    return f"""
WITH k AS (
  SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS ints
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
w AS (SELECT max(len(ints)) // {parts} AS width FROM k),
p AS (SELECT row, vec_id, label, u.part, ints[u.part * width + 1 : (u.part + 1) * width] AS value FROM k, w, (SELECT unnest(range(0, {parts})) AS part) u),
d AS (SELECT part, value, count(*) AS weight FROM p GROUP BY part, value),
o AS (SELECT row, row_number() OVER (ORDER BY vec_id NULLS LAST, ints) - 1 AS entry FROM k QUALIFY entry < {entries}),
b0 AS (SELECT p.part, o.entry, p.value FROM p JOIN o USING (row)),
{",".join(steps)},
e AS (
  SELECT p.row, p.vec_id, p.label, string_agg(printf('%02x', a.entry), '' ORDER BY p.part) AS code, sum(a.far)::BIGINT AS error
  FROM p JOIN a{rounds} a ON a.part = p.part AND a.value = p.value GROUP BY ALL
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(value, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
FROM e
"""


ORACLE_SQL = _oracle()
