"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import drop, written


def merge_labels(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites a[i] with b[i] for all i in place; every root is the least member of its set."""
    while len(a):
        while True:  # every node points at its root
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up
        ra, rb = parent[a], parent[b]
        differ = ra != rb
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v); component is its least reachable node.

    Nodes without edges don't appear; loops and rows with a null end are
    ignored. A hub's edges are never gathered in one task: minima are summed
    up before the shuffle, and come back by joins whose skew Spark can split.
    Every round but the last moves an end to a smaller node, so that rounds end;
    their number grows with the square of the logarithm of the largest component.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = written(now, "edges")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        before = state
        both = now.union(now.select("v", "u"))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m")), "least")
        large = written(both.join(least, F.col("u") == F.col("x")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        lower = written(large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")), "lower")
        small = large.join(lower, F.col("u") == F.col("x")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, now = now, written(small.union(lower.select("x", "m")).distinct(), "edges")
        drop(old, least, large, lower)
