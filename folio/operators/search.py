"""Vector search and filters over collections held as DataFrames.

Searches are exact: a block of queries meets every stored row once, as a product
of matrices whose best rows are scored again one by one. Queries go to the tasks
only while their checked size in bytes stays under a bound; larger sets are cut
into groups, and groups and blocks of rows meet in an equi-join whose keys are as
many as there are partitions at least.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Queries are broadcast up to so many bytes; past it they are dealt to groups of that size.
BROADCAST_BYTES = 64 << 20
#: A product of a batch of rows with some queries has so many scores at most.
_PRODUCT = 1 << 22


def as_doubles(vector: str | Column) -> Column:
    return (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def filter_condition(filters: Mapping[str, object] | None) -> Column | None:
    """AND of equality (text, integer, boolean) or membership (lists of text or integers); other values are skipped."""
    tests = []
    for key, value in (filters or {}).items():
        if isinstance(value, (str, int)):
            tests.append(F.col(key) == F.lit(value))
        elif isinstance(value, (list, tuple)) and all(isinstance(v, (str, int)) and not isinstance(v, bool) for v in value):
            tests.append(F.col(key).isin(list(value)))
    return reduce(lambda a, b: a & b, tests) if tests else None


def filtered(table: DataFrame, filters: Mapping[str, object] | None) -> DataFrame:
    test = filter_condition(filters)
    return table if test is None else table.where(test)


def _size(asked: DataFrame, query_vector: str) -> int:
    return asked.agg(F.sum(F.lit(8) * F.size(query_vector) + 64).alias("bytes")).first()["bytes"] or 0


def with_scores(table: DataFrame, queries: DataFrame, vector: str = "embedding", query_id: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """Every stored row with every query and their cosine ``score``; norms are taken once a row."""
    stored = table.withColumn("__v", as_doubles(vector)).withColumn("__n", norm(F.col("__v")))
    asked = queries.select(query_id, as_doubles(query_vector).alias("__q")).withColumn("__m", norm(F.col("__q")))
    size = _size(asked, "__q")
    if size <= BROADCAST_BYTES:
        met = stored.crossJoin(F.broadcast(asked))
    else:  # each block of rows meets each group of queries
        groups, blocks = -(-size // BROADCAST_BYTES), int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        asked = asked.withColumn("__g", dealt(query_id, groups)).withColumn("__b", every(blocks))
        met = stored.withColumn("__b", dealt("__v", blocks)).withColumn("__g", every(groups)).join(asked, ["__g", "__b"]).drop("__g", "__b")
    return met.withColumn("score", dot(F.col("__v"), F.col("__q")) / (F.col("__n") * F.col("__m"))).drop("__v", "__q", "__n", "__m")


def top_k(table: DataFrame, queries: DataFrame, k: int, threshold: float = 0.0, filters: Mapping[str, object] | None = None, id_col: str = "vec_id", vector: str = "embedding", query_id: str = "query_id", query_vector: str = "query_vector", skip_self: bool = False) -> DataFrame:
    """The k best rows of each query with ``score`` and ``rank``: highest first, ties to the smaller id.

    Rows under ``threshold`` are left out, zero by default as in the service
    this follows. The rank filter prunes within each task before the shuffle.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    rows = filtered(table, filters)
    if _size(queries, query_vector) <= BROADCAST_BYTES:
        found = _best_of_blocks(rows, queries, k, threshold, id_col, vector, query_id, query_vector, skip_self)
    else:
        found = with_scores(rows, queries, vector, query_id, query_vector).where(F.col("score") >= threshold)
        found = found.where(F.col(id_col) != F.col(query_id)) if skip_self else found
    best = Window.partitionBy(query_id).orderBy(F.desc("score"), id_col)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _vectors(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the lists of ``dim`` finite values that aren't all zero, and those as a matrix."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(lists), dim), False)
    at = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    x = pc.cast(lists.take(pa.array(at)).flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), dim)
    fine = np.isfinite(x).all(axis=1) & x.any(axis=1)
    return at[fine], x[fine]


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row with one vector; equal rows have equal ones."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum()))


def _best_of_blocks(rows: DataFrame, queries: DataFrame, k: int, threshold: float, id_col: str, vector: str, query_id: str, query_vector: str, skip_self: bool) -> DataFrame:
    """For each Arrow batch of rows, the k best of it for each query, with ``score``.

    Vectors that are null, all zero, of another length than a query's, or hold
    null or non-finite components have no score.
    """
    asked = queries.select(query_id, as_doubles(query_vector).alias("q")).toArrow()
    ids, lists = asked.column(0).combine_chunks(), asked.column(1).combine_chunks()
    dims = sorted({int(d) for d in pc.list_value_length(lists).to_pylist() if d})
    blocks = [(d, *_vectors(lists, d)) for d in dims]  # queries of one length each: places and vectors
    own = ids.to_pylist()
    kept = [f for f in rows.schema.fields if f.name.lower() not in (query_id.lower(), "score")]
    schema = T.StructType([*kept, queries.schema[query_id], T.StructField("score", T.DoubleType())])
    names = [f.name for f in kept]

    def best(stored: np.ndarray, vectors_: np.ndarray, keys: np.ndarray, q: np.ndarray, place: int, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best rows for one query, by their approximate scores first."""
        if skip_self:
            near = np.where(keys == own[place], -np.inf, near)
        least = np.partition(near, len(near) - k)[len(near) - k] if k < len(near) else -np.inf
        some = np.flatnonzero(np.isfinite(near) & (near >= max(least, threshold) - 1e-9))  # a product's last digits may differ
        exact = _cosines(vectors_[some], q)
        some, exact = some[exact >= threshold], exact[exact >= threshold]
        order = sorted(range(len(some)), key=lambda i: (-exact[i], keys[some[i]] is not None, 0 if keys[some[i]] is None else keys[some[i]]))[:k]
        return stored[some[order]], exact[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_here = np.array(batch.column(id_col).to_pylist(), object)
            for dim, places, q in blocks:
                at, x = _vectors(batch.column(vector), dim)
                if skip_self:  # a row without an id can't be told from the query
                    named = np.array([key is not None for key in ids_here[at]], bool)
                    at, x = at[named], x[named]
                if not len(at):
                    continue
                keys, unit = ids_here[at], x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                step = max(1, _PRODUCT // len(at))
                for lo in range(0, len(q), step):
                    some = q[lo : lo + step]
                    near = unit @ (some / np.sqrt((some * some).sum(axis=1, keepdims=True))).T
                    found = [best(at, x, keys, v, place, near[:, j]) for j, (v, place) in enumerate(zip(some, places[lo : lo + step].tolist(), strict=True))]
                    of = np.repeat(places[lo : lo + step], [len(f[0]) for f in found])
                    chosen = batch.select(names).take(pa.array(np.concatenate([f[0] for f in found])))
                    yield pa.RecordBatch.from_arrays([*chosen.columns, ids.take(pa.array(of)), pa.array(np.concatenate([f[1] for f in found]))], names=schema.names)

    return rows.mapInArrow(run, schema)


def search(table: DataFrame, query_vector: Iterable[float], k: int, threshold: float = 0.0, filters: Mapping[str, object] | None = None, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k best rows for one vector, with scores."""
    if k <= 0:
        raise ValueError("k must be positive")
    q = F.array(*(F.lit(float(x)) for x in query_vector))
    v = as_doubles(vector)
    scored = filtered(table, filters).withColumn("score", dot(v, q) / (norm(v) * norm(q)))
    return scored.where(F.col("score") >= threshold).orderBy(F.desc("score"), id_col).limit(k)


def delete_by_ids(table: DataFrame, ids: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Rows whose id is not among ``ids``; none given, all stay."""
    return table.join(ids.select(id_col), id_col, "left_anti").select(table.columns)


def delete_by_filter(table: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    """Rows that don't fulfil the filter; a null test keeps the row."""
    test = filter_condition(filters)
    if test is None:
        raise ValueError("a filter is needed")
    return table.where(~F.coalesce(test, F.lit(False)))
