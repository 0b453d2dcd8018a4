"""Operator 9: embedding near-dedup by dual traversal of cover trees.

The top level of each large label's cover tree is fitted on a bounded sample: a
net of centres, each of which covers the vectors nearest to it within a measured
radius. Pairs of centres whose radii leave no room for a link are dropped before
any vector moves. The blocks of the others become cover trees of their own:
nested levels whose radii halve. Two trees are walked together; a node pair is
dropped when its centres lie further apart than both covering radii and the
threshold allow, and taken whole when even its furthest pair links. A block pair
returns link counts and a spanning forest, not its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import drop, meet, written
from folio.llm.components import connected_components, merge_labels
from folio.llm.vectors import bounded_sample, content, cosines, matrix, unit, usable

_SLACK = 1e-7


class CoverTree:
    """Nodes over unit vectors in an order in which each node's points are one run lo..hi.

    ``first`` and ``count`` give a node's children (count 0: a leaf); ``radius``
    is the largest distance from the node's centre to any point below it.
    """

    def __init__(self, points: np.ndarray, leaf: int = 96):
        self.order: list[int] = []
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.lo: list[int] = []
        self.hi: list[int] = []
        self.first: list[int] = []
        self.count: list[int] = []
        self.points, self.leaf = points, leaf
        self._fill(self._new(), np.arange(len(points)), 0, 2.0)
        self.order = np.array(self.order)
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)
        self.lo, self.hi, self.first, self.count = (np.array(x) for x in (self.lo, self.hi, self.first, self.count))

    def children(self, node: int) -> np.ndarray:
        """A node's children, or itself where it is a leaf."""
        return np.arange(self.first[node], self.first[node] + self.count[node]) if self.count[node] else np.array([node])

    def _new(self) -> int:
        for x in (self.centre, self.radius, self.lo, self.hi, self.first, self.count):
            x.append(0)
        return len(self.lo) - 1

    def _square(self, own: np.ndarray, at: int) -> np.ndarray:
        return np.maximum(0, 2 - 2 * (self.points[own] @ self.points[at]))

    def _fill(self, node: int, own: np.ndarray, centre: int, scale: float) -> None:
        """Node ``node`` covers the points ``own``, all within ``scale`` of point ``centre``."""
        reach = math.sqrt(float(self._square(own, centre).max())) + 1e-9
        self.centre[node], self.radius[node] = centre, reach
        self.lo[node], self.hi[node] = len(self.order), len(self.order) + len(own)
        if len(own) <= self.leaf or reach < 1e-7:
            self.order += own.tolist()
            return
        while scale >= reach:
            scale /= 2
        parts, rest, at = [], own, centre
        while len(rest):  # a net of centres more than ``scale`` apart, the old centre first
            near = self._square(rest, at) <= scale * scale
            near |= rest == at
            parts.append((at, rest[near]))
            rest = rest[~near]
            at = int(rest[0]) if len(rest) else -1
        single = np.array([p[0] for p in parts if len(p[1]) == 1], np.int64)  # far from everything: leaves of several
        parts = [p for p in parts if len(p[1]) > 1]
        if len(single):
            parts += [(int(x[0]), x) for x in np.array_split(single, -(-len(single) // self.leaf))]
        children = [self._new() for _ in parts]
        self.first[node], self.count[node] = children[0], len(children)
        for child, (at, own) in zip(children, parts, strict=True):  # one after another, so that a node's points are one run
            self._fill(child, own, at, scale)


def links(a: np.ndarray, b: np.ndarray, ta: CoverTree, tb: CoverTree, least: float, original: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Linked pairs of points of a and b as index arrays; with True, every one of the first links with every one of the second."""
    reach = math.sqrt(max(0.0, 2 - 2 * least))
    stack = [(0, 0)]
    while stack:
        i, j = stack.pop()
        apart = math.sqrt(float(((a[ta.centre[i]] - b[tb.centre[j]]) ** 2).sum()))
        if apart > ta.radius[i] + tb.radius[j] + reach + _SLACK:
            continue
        if apart + ta.radius[i] + tb.radius[j] < reach - _SLACK:
            yield ta.order[ta.lo[i] : ta.hi[i]], tb.order[tb.lo[j] : tb.hi[j]], True
            continue
        if ta.count[i] or tb.count[j]:
            ka, kb = ta.children(i), tb.children(j)
        else:
            x, y = ta.order[ta.lo[i] : ta.hi[i]], tb.order[tb.lo[j] : tb.hi[j]]
            near = a[x] @ b[y].T
            r, c = np.nonzero(near >= least - 1e-9)
            if len(r):
                x, y = x[r], y[c]
                close = near[r, c] < least + 1e-9
                keep = np.ones(len(x), bool)
                keep[close] = cosines(original[0][x[close]], original[1][y[close]]) >= least
                yield x[keep], y[keep], False
            continue
        for lo in range(0, len(ka), 512):  # children that can still reach each other, block by block
            own = ka[lo : lo + 512]
            square = 2 - 2 * (a[ta.centre[own]] @ b[tb.centre[kb]].T)
            bound = ta.radius[own][:, None] + tb.radius[kb][None, :] + reach + _SLACK
            r, c = np.nonzero(square <= bound * bound + _SLACK)
            stack += zip(own[r].tolist(), kb[c].tolist(), strict=True)


def net(points: np.ndarray, count: int, enough: float) -> np.ndarray:
    """Rows of up to ``count`` centres, each as far as can be from those before, until all points lie within ``enough``.

    Any first part of them is a net: its centres lie at least its covering radius apart.
    """
    chosen, gap = [0], np.full(len(points), np.inf)
    while len(chosen) < count:
        gap = np.minimum(gap, np.maximum(0, 2 - 2 * (points @ points[chosen[-1]])))
        furthest = int(np.argmax(gap))
        if gap[furthest] <= enough * enough:
            break
        chosen.append(furthest)
    return np.array(chosen)


class _Block:
    def __init__(self, row: pa.StructArray):
        items = row.flatten()
        self.node, self.copies = items.field("node").to_numpy(), items.field("copies").to_numpy()
        self.original = matrix(items.field("embedding"))
        self.points = unit(self.original)
        self.tree = CoverTree(self.points)


_FOUND = "u long, v long, n long"


def _compare(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """For each block pair: rows (node, node, links it found for the node) and forest rows (u, v, 0)."""
    blocks: dict[tuple, _Block] = {}
    for batch in batches:
        names = [list(zip(*(batch.column(n).to_pylist() for n in ("label", "dim", *side)), strict=True)) for side in (("a", "c"), ("b", "d"))]
        for k, (left, right) in enumerate(zip(*names, strict=True)):
            pair = []
            for name, column in ((left, "rows"), (right, "other")):
                if name not in blocks:
                    if len(blocks) > 8:
                        blocks.clear()
                    blocks[name] = _Block(batch.column(column).slice(k, 1))
                pair.append(blocks[name])
            x, y = pair
            same = left == right
            node = x.node if same else np.concatenate([x.node, y.node])
            place = np.empty(len(node), np.int64)
            order = np.argsort(node, kind="stable")
            place[order] = np.arange(len(node))
            shift = 0 if same else len(x.node)
            parent, total = np.arange(len(node)), np.zeros(len(node), np.int64)
            for i, j, whole in links(x.points, y.points, x.tree, y.tree, least, (x.original, y.original)):
                if whole:
                    total[i] += y.copies[j].sum()
                    if not same:
                        total[shift + j] += x.copies[i].sum()
                    merge_labels(parent, place[i], np.full(len(i), place[shift + j[0]]))
                    merge_labels(parent, place[shift + j], np.full(len(j), place[i[0]]))
                else:
                    np.add.at(total, i, y.copies[j])
                    if not same:
                        np.add.at(total, shift + j, x.copies[i])
                    merge_labels(parent, place[i], place[shift + j])
            while not np.array_equal(up := parent[parent], parent):
                parent = up
            u, v = node[order], node[order][parent]
            moved, counted = u != v, total > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([node[counted], u[moved]])), pa.array(np.concatenate([node[counted], v[moved]])), pa.array(np.concatenate([total[counted], np.zeros(moved.sum(), np.int64)]))],
                names=["u", "v", "n"],
            )


Centres = dict[tuple[str, int], np.ndarray]


def _covered(reps: DataFrame, centres: Centres) -> DataFrame:
    """``reps`` with the number of the nearest centre of their label, and how far it is; 0 and 2 without centres."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.empty(batch.num_rows, object)
            keys[:] = list(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True))
            a, gap = np.zeros(batch.num_rows, np.int32), np.full(batch.num_rows, 2.0)
            for key in set(keys) & set(centres):
                own = np.flatnonzero([k == key for k in keys])
                near = unit(matrix(batch.column("embedding").take(pa.array(own)))) @ centres[key].T
                a[own] = near.argmax(axis=1)
                gap[own] = np.sqrt(np.maximum(0, 2 - 2 * near.max(axis=1)))
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in batch.schema.names} | {"a": pa.array(a), "gap": pa.array(gap)})

    return reps.mapInArrow(run, T.StructType([*reps.schema.fields, T.StructField("a", T.IntegerType()), T.StructField("gap", T.DoubleType())]))


def _near_centres(covers: DataFrame, centres: Centres, reach: float) -> DataFrame:
    """(label, dim, a, b), a <= b: the pairs of covers that a link can join."""
    rows = covers.select("label", "dim", "a", "radius").collect()  # as many as there are centres
    radii: dict[tuple, dict[int, float]] = {}
    for r in rows:
        radii.setdefault((r["label"], r["dim"]), {})[r["a"]] = r["radius"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, dim, a in zip(*(batch.column(c).to_pylist() for c in ("label", "dim", "a")), strict=True):
                own = radii[label, dim]
                b = np.array(sorted(x for x in own if x >= a), np.int32)
                apart = np.sqrt(np.maximum(0, 2 - 2 * (centres[label, dim][b] @ centres[label, dim][a])))
                b = b[apart <= own[a] + np.array([own[x] for x in b.tolist()]) + reach + 1e-6]
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(b), pa.string()), pa.array(np.full(len(b), dim, np.int32)), pa.array(np.full(len(b), a, np.int32)), pa.array(b)], names=["label", "dim", "a", "b"])

    spark = covers.sparkSession
    names = spark.createDataFrame([(r["label"], r["dim"], r["a"]) for r in rows], "label string, dim int, a int")
    return names.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, "label string, dim int, a int, b int")


def near_vectors(table: DataFrame, least: float = 0.98, block: int = 2048, centres: int = 4096, sample_bytes: int = 16 << 20) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Rows link when their labels are equal and not null, their vectors equally
    long, and the cosine at least ``least``. Rows with an unusable vector, a
    null label or a null id link with nothing: n_links 0 and a component of
    their own id. Exact copies count as links of each other but are compared
    once. A row is its vector: ``n_links`` counts the other rows that its vector
    links with, and rows that repeat an id have each their own vector's links
    and component. An empty table gives no rows.

    ``centres`` bounds the centres of all labels together and ``sample_bytes``
    the sample that they are chosen from; labels of up to ``block`` vectors, and
    those beyond the 64 largest, have none and are compared block by block.
    """
    spark = table.sparkSession
    reach = math.sqrt(max(0.0, 2 - 2 * least))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    takes_part = usable() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    keyed = rows.where(takes_part).select("vec_id", "label", "embedding", *content())
    key = ["label", "h1", "h2", "dim"]
    reps = keyed.groupBy(*key).agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
    reps = written(reps.withColumn("node", F.xxhash64(*key)), "vectors")  # a class of equal vectors, whatever its ids
    sampled = bounded_sample(reps, ["label", "dim"], "node", block, sample_bytes)
    total = sum(n for n, _ in sampled.values())
    wanted = {k: max(2, min(2 * -(-n // block), centres * n // max(1, total))) for k, (n, _) in sampled.items()}
    chosen = {k: unit(x)[net(unit(x), wanted[k], reach)] for k, (_, x) in sampled.items()}
    covered = written(_covered(reps.select("label", "dim", "node", "copies", "embedding"), chosen), "covered")
    covers = written(covered.groupBy("label", "dim", "a").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n"), F.max("gap").alias("radius")), "covers")
    dealt = covered.join(covers.select("label", "dim", "a", "n"), ["label", "dim", "a"]).withColumn("c", F.pmod(F.xxhash64("node", F.lit(9)), F.col("n")).cast("int"))
    packed = written(dealt.groupBy("label", "dim", "a", "c").agg(F.collect_list(F.struct("node", "copies", "embedding")).alias("rows")), "blocks")
    drop(covered)

    named = spark.createDataFrame(list(chosen), "label string, dim int")
    large = covers.join(F.broadcast(named), ["label", "dim"], "left_semi")
    alone = covers.join(F.broadcast(named), ["label", "dim"], "left_anti").select("label", "dim", "a", F.col("a").alias("b"))
    near = _near_centres(large, chosen, reach).union(alone) if chosen else alone
    numbers = [covers.select("label", "dim", F.col("a").alias(x), F.col("n").alias(f"{x}_n")) for x in ("a", "b")]
    pairs = near.join(numbers[0], ["label", "dim", "a"]).join(numbers[1], ["label", "dim", "b"])
    pairs = pairs.withColumn("c", F.explode(F.expr("sequence(0, a_n - 1)"))).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # a cover's names are many rows' work
    pairs = pairs.withColumn("d", F.explode(F.expr("sequence(0, b_n - 1)"))).where("a < b or c <= d").select("label", "dim", "a", "c", "b", "d")
    right = packed.select("label", "dim", F.col("a").alias("b"), F.col("c").alias("d"), F.col("rows").alias("other"))
    both = meet(pairs, packed, right, ["label", "dim", "a", "c"], ["label", "dim", "b", "d"])
    found = written(both.select("label", "dim", "a", "c", "b", "d", "rows", "other").mapInArrow(lambda it: _compare(it, least), _FOUND), "links")
    drop(packed)
    roots = connected_components(found.where("n = 0").select("u", "v"))
    counts = found.where("n > 0").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    classes = written(reps.select(*key, "node", "first").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("component", "node")), "classes")
    names = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    done = classes.select(*key, "root", (F.col("n") - 1).alias("n_links")).join(names, "root")
    out = keyed.drop("embedding").join(done, key).select("vec_id", "n_links", "component_id")
    rest = rows.where(~takes_part).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
