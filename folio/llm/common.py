"""Helpers shared by the operators: shared storage, Arrow text access, appended columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.storage import drop, shared_dir, written

#: Rows in an Arrow batch; texts may be long, and a batch is held by Spark and by Python.
_BATCH, _BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "500"

__all__ = ["drop", "fresh", "flat", "held_out", "meet", "per_text", "released", "resident", "shared_dir", "slices", "small_batches", "utf8", "written"]

#: Python-side working set: texts are handled in slices of about this many bytes.
SLICE_BYTES = 1 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after bounding the session's Arrow batches where nobody has set them."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH, None) is None:
        conf.set(_BATCH, _BATCH_ROWS)
    return df


def meet(pairs: DataFrame, left: DataFrame, right: DataFrame, by: list[str], other: list[str]) -> DataFrame:
    """``pairs`` of block names with the blocks of both sides, spread over many tasks.

    ``left`` is named by ``by`` and ``right`` by ``other``. A block of the left
    side travels once for each pair; one of the right side once, to all of its pairs.
    """
    width = 4 * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.join(left, by).repartition(width, *other).join(right, other)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after each of whose batches Arrow gives back what it holds unused; it would keep that for the worker's life."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in run(batches):
            yield made
            del made
            pa.default_memory_pool().release_unused()

    return each


_resident: dict[str, object] = {}


def resident(key: str, build: Callable[[], object]) -> object:
    """``build()``, kept in this process until another key is asked for: a worker holds one model at a time."""
    if key not in _resident:
        _resident.clear()
        _resident[key] = build()
    return _resident[key]


def fresh(name: str, columns: list[str]) -> str:
    """``name``, made longer until no column is called so (letter case aside)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 2 modulo 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its offsets (one more than rows); nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array.cast(pa.large_string()), "")
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64, len(array) + 1, array.offset * 8)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(array: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string array that hold about ``limit`` bytes each, one row at least."""
    lengths = pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, lo = np.cumsum(lengths), 0
    while lo < len(array):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield lo, hi
        lo = hi


def flat(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of each run, one run after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def per_text(df: DataFrame, text: str | Column, schema: T.StructType, make: Callable[[], Callable[[pa.Array], pa.RecordBatch]]) -> DataFrame:
    """``df`` with the columns of ``schema`` computed from one text column.

    ``make`` runs once in each task and returns a function from an Arrow array
    of strings to a record batch with as many rows. A column of ``df`` that has
    the name of a computed one is replaced.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = make()
        for array in batches:
            parts = [work(array.slice(lo, hi - lo)) for lo, hi in slices(array)] or [work(array)]
            table = pa.Table.from_batches(parts).combine_chunks()
            yield pa.StructArray.from_arrays([c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in table.columns], names=table.column_names)
            pa.default_memory_pool().release_unused()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    applied = F.arrow_udf(run, schema).asNondeterministic()  # else a later filter would run it twice
    source = F.col(text) if isinstance(text, str) else text
    made = fresh("__made", df.columns)
    names = {n.lower() for n in schema.names}
    kept = [F.col(f"`{c}`") for c in small_batches(df).columns if c.lower() not in names]
    return df.select(*kept, applied(source).alias(made)).select(*kept, *(F.col(f"`{made}`.`{c}`").alias(c) for c in schema.names))
