"""Operator 8: approximate nearest neighbours by stable projections and kd-trees.

All vectors are projected to a few dimensions by one Gaussian (2-stable) matrix.
The upper levels of a kd-tree over the projected points are fitted on a bounded
sample and deal every row to a cell; a cell's blocks of bounded size carry its
lower levels. A query takes projected neighbours in ascending order and verifies
them on the original vectors, until a chi-square test says that no unseen point
is likely to be nearer. It searches its own cell first; what it finds there tells
by the same test which other cells it still has to see.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import drop, flat, meet, written
from folio.llm.vectors import bounded_sample, content, cosines, matrix, unit, usable

_SLACK = 1e-9


def projection(dim: int, low: int, seed: int = 8) -> np.ndarray:
    """The Gaussian matrix of one dimension; the same on every machine."""
    return np.random.default_rng((seed, dim, low)).standard_normal((dim, low))


def chi_square_below(x: np.ndarray, even_dim: int) -> np.ndarray:
    """Distribution function of chi-square with an even number of degrees of freedom."""
    half = np.asarray(x, float) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for k in range(1, even_dim // 2):
        term = term * half / k
        total = total + term
    return 1 - np.exp(-np.minimum(half, 700)) * total


def stopping_ratio(low: int, sure: float) -> float:
    """How many times the squared distance of the k-th neighbour a projected one must reach for the test to hold."""
    least, most = 0.0, 1000.0
    for _ in range(80):
        middle = (least + most) / 2
        least, most = (least, middle) if chi_square_below(np.array(middle), low) >= sure else (middle, most)
    return most


class Splits:
    """Upper levels of a kd-tree: axis and cut of every inner node, node k's children being 2k and 2k + 1."""

    def __init__(self, points: np.ndarray, levels: int):
        self.levels = levels
        self.axis, self.cut = np.zeros(1 << levels, np.int64), np.zeros(1 << levels)
        own = {1: np.arange(len(points))}
        for node in range(1, 1 << levels):
            rows = own.pop(node)
            if len(rows):
                self.axis[node] = int(np.argmax(np.ptp(points[rows], axis=0)))
                values = points[rows, self.axis[node]]
                self.cut[node] = np.median(values)
                right = values >= self.cut[node]
                own[2 * node], own[2 * node + 1] = rows[~right], rows[right]
            else:
                own[2 * node] = own[2 * node + 1] = rows

    def cells(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.levels):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] >= self.cut[node])
        return (node - (1 << self.levels)).astype(np.int32)


class KdTree:
    """Leaves of a median-split kd-tree: runs of points in ``order`` and their boxes."""

    def __init__(self, points: np.ndarray, leaf: int = 64):
        parts, done = [np.arange(len(points))], []
        while parts:
            own = parts.pop()
            if len(own) <= leaf:
                done.append(own)
                continue
            axis = int(np.argmax(points[own].max(axis=0) - points[own].min(axis=0)))
            half = len(own) // 2
            own = own[np.argpartition(points[own, axis], half)]
            parts += [own[:half], own[half:]]
        self.order = np.concatenate(done)
        self.size = np.array([len(x) for x in done])
        self.first = np.cumsum(self.size) - self.size
        self.low = np.minimum.reduceat(points[self.order], self.first, axis=0)
        self.high = np.maximum.reduceat(points[self.order], self.first, axis=0)

    def leaf_distances(self, query: np.ndarray) -> np.ndarray:
        """Squared distance of a point to every leaf's box."""
        return box_distances(query, self.low, self.high)


def box_distances(point: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    gap = np.maximum(0, np.maximum(low - point, point - high))
    return (gap * gap).sum(axis=-1)


class Index:
    """A block: original and projected vectors, their ids, and the tree."""

    def __init__(self, items: pa.StructArray, low: int):
        self.ids = items.field("ids")
        self.original = matrix(items.field("embedding"))
        self.to_low = projection(self.original.shape[1], low)
        scaled = unit(self.original)
        self.tree = KdTree(scaled @ self.to_low)
        self.unit = scaled[self.tree.order]
        self.projected = self.unit @ self.to_low
        self.square = (self.projected**2).sum(axis=1)
        self.verified = 0

    def search(self, query: np.ndarray, k: int, ratio: float, limit: float = np.inf, together: int = 256) -> np.ndarray:
        """Rows of at least the k nearest found; ties with the k-th may make it more.

        ``limit`` is a squared distance within which k are known already.
        """
        tree, point = self.tree, query @ self.to_low
        leaves = np.flatnonzero(tree.leaf_distances(point) <= ratio * limit + _SLACK)
        rows = flat(tree.first[leaves], tree.size[leaves])
        far = self.square[rows] - 2 * (self.projected[rows] @ point) + point @ point
        if limit < np.inf:
            inside = far <= ratio * limit + _SLACK
            rows, far = rows[inside], far[inside]
        way = np.argsort(far, kind="stable")
        seen, gaps, worst = np.zeros(0, np.int64), np.zeros(0), limit
        for at in range(0, len(way), together):
            # The unseen are at least this far in projection: would one nearer than ``worst`` be likely there?
            if far[way[at]] > ratio * worst + _SLACK:
                break
            own = rows[way[at : at + together]]
            self.verified += len(own)
            seen = np.concatenate([seen, own])
            gaps = np.concatenate([gaps, np.maximum(0, 2 - 2 * (self.unit[own] @ query))])
            if len(gaps) >= k:
                worst = min(limit, float(np.partition(gaps, k - 1)[k - 1]))
                keep = gaps <= worst + _SLACK
                seen, gaps = seen[keep], gaps[keep]
        return tree.order[seen]


def _search(batches: Iterator[pa.RecordBatch], k: int, low: int, ratio: float) -> Iterator[pa.RecordBatch]:
    kept: dict[tuple, Index] = {}
    for batch in batches:
        names = list(zip(*(batch.column(c).to_pylist() for c in ("dim", "cell", "c")), strict=True))
        for n, name in enumerate(names):
            if name not in kept:
                kept.clear()
                kept[name] = Index(batch.column("rows").slice(n, 1).flatten(), low)
            index = kept[name]
            asked = batch.column("asked").slice(n, 1).flatten()
            given, own = matrix(asked.field("embedding")), asked.field("vec_id").to_pylist()
            limits = asked.field("limit").to_numpy(zero_copy_only=False)
            out: tuple[list, list, list] = ([], [], [])
            for q, (query, who, limit) in enumerate(zip(unit(given), own, limits, strict=True)):
                rows = index.search(query, k + 1, ratio, limit)
                if not len(rows):
                    continue
                score = cosines(index.original[rows], np.repeat(given[q : q + 1], len(rows), axis=0))
                found = sorted((-s, i) for s, row in zip(score.tolist(), rows.tolist(), strict=True) for i in index.ids[row].as_py() if i != who)[:k]
                out[0].extend([who] * len(found))
                out[1].extend(i for _, i in found)
                out[2].extend(-s for s, _ in found)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])


def _with_cells(rows: DataFrame, splits: dict[int, Splits], low: int) -> DataFrame:
    """``rows`` (dim, embedding and others) with their cell and projection; cell 0 for vectors of other lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cell, points = np.zeros(batch.num_rows, np.int32), np.zeros((batch.num_rows, low))
            for dim in np.intersect1d(dims, list(splits)):
                own = np.flatnonzero(dims == dim)
                points[own] = unit(matrix(batch.column("embedding").take(pa.array(own)))) @ projection(int(dim), low)
                cell[own] = splits[int(dim)].cells(points[own])
            lists = pa.ListArray.from_arrays(pa.array((low * np.arange(batch.num_rows + 1)).astype(np.int32)), pa.array(points.ravel()))
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in batch.schema.names} | {"cell": pa.array(cell), "point": lists})

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("point", T.ArrayType(T.DoubleType()))]))


def _reach(asked: DataFrame, boxes: dict[int, tuple], low: int, ratio: float) -> DataFrame:
    """(vec_id, dim, cell) of the cells besides its own that each query's test doesn't exclude."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec, dims, own, limits = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "dim", "cell", "limit"))
            points = batch.column("point").flatten().to_numpy().reshape(-1, low)
            for dim, (cells, lower, upper) in boxes.items():
                for i in np.flatnonzero(dims == dim):
                    near = cells[(box_distances(points[i], lower, upper) <= ratio * limits[i] + _SLACK) & (cells != own[i])]
                    if len(near):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), vec[i])), pa.array(np.full(len(near), dim, np.int32)), pa.array(near.astype(np.int32))], names=["vec_id", "dim", "cell"])

    return asked.select("vec_id", "dim", "cell", "limit", "point").mapInArrow(run, "vec_id long, dim int, cell int")


def nearest(table: DataFrame, queries: DataFrame, k: int = 5, low: int = 16, sure: float = 0.96, block: int = 8192, query_block: int = 2048, levels: int = 12, sample_bytes: int = 32 << 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query, by cosine.

    ``low`` (even) is the projected dimension and ``sure`` the level of the
    stopping test. Cells are fitted on a sample of about ``sample_bytes``, to
    ``levels`` levels at most; every row is in a cell's blocks. Vectors that are
    null, zero or hold null or non-finite components, and null ids, take no part.
    Vectors of another length than the query's are no candidates. Exact copies
    are indexed once with the k + 1 smallest of their ids, which are all that a
    result can hold. Ties go to the smaller id. No queries or no candidates give
    no rows; other columns are ignored; repeated query ids count once.
    """
    ratio = stopping_ratio(low, sure)
    fit = usable() & F.col("vec_id").isNotNull()
    rows = table.where(fit).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", *content())
    by_content = Window.partitionBy("h1", "h2", "dim").orderBy("vec_id")
    fewest = rows.select("vec_id", "h1", "h2", "dim").distinct().withColumn("place", F.row_number().over(by_content)).where(F.col("place") <= k + 1)
    ids = fewest.groupBy("h1", "h2", "dim").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    first = rows.join(ids.select(F.col("ids")[0].alias("vec_id"), "h1", "h2", "ids"), ["vec_id", "h1", "h2"]).dropDuplicates(["vec_id", "h1", "h2"])
    index = written(first.select("dim", "h1", "ids", "embedding"), "index")
    sampled = bounded_sample(index, ["dim"], "h1", block, sample_bytes)
    splits = {dim: Splits(unit(x) @ projection(dim, low), min(levels, int(np.ceil(np.log2(n / block))))) for (dim,), (n, x) in sampled.items()}
    placed = written(_with_cells(index, splits, low), "cells")
    drop(index)
    bounds = [f(F.col("point")[j]).alias(f"{name}{j}") for j in range(low) for name, f in (("low", F.min), ("high", F.max))]
    boxes = {}
    for dim in splits:  # a few vector lengths, and cells that ``levels`` bounds
        own = placed.where(F.col("dim") == dim).groupBy("cell").agg(*bounds).toPandas()
        boxes[dim] = (own["cell"].to_numpy(), *(own[[f"{name}{j}" for j in range(low)]].to_numpy() for name in ("low", "high")))
    sizes = placed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n"))
    dealt = placed.join(sizes, ["dim", "cell"]).withColumn("c", F.pmod(F.xxhash64("h1"), F.col("n")).cast("int"))
    packed = written(dealt.groupBy("dim", "cell", "c").agg(F.collect_list(F.struct("ids", "embedding")).alias("rows")), "blocks")
    drop(placed)

    asked = queries.where(fit).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.size("embedding").alias("dim")).dropDuplicates(["vec_id"])
    asked = written(_with_cells(asked, splits, low), "asked")

    def searched(wanted: DataFrame) -> DataFrame:
        """What the queries (dim, cell, vec_id, embedding, limit) find in the cells named."""
        many = wanted.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("parts"))
        part = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("d")
        blocks = written(wanted.join(many, ["dim", "cell"]).groupBy("dim", "cell", part).agg(F.collect_list(F.struct("vec_id", "embedding", "limit")).alias("asked")), "asked-blocks")
        pairs = blocks.select("dim", "cell", "d").join(packed.select("dim", "cell", "c"), ["dim", "cell"])
        both = meet(pairs, blocks, packed, ["dim", "cell", "d"], ["dim", "cell", "c"])
        return both.select("dim", "cell", "c", "rows", "asked").mapInArrow(lambda it: _search(it, k, low, ratio), "query_id long, vec_id long, score double")

    here = written(searched(asked.select("dim", "cell", "vec_id", "embedding", F.lit(float("inf")).alias("limit"))), "own-cell")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    last = here.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.greatest(F.lit(0.0), 2 - 2 * F.col("score")).alias("limit"))
    known = written(asked.join(last, "vec_id", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf")))), "known")
    wanted = _reach(known, boxes, low, ratio).join(known.select("vec_id", "embedding", "limit"), "vec_id")
    found = here.union(searched(wanted))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
