"""Vector tables: rows that can take part, exact copies, and blocks of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str = "embedding") -> Column:
    """True for vectors that are neither null nor zero and hold only finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def content(vector: str = "embedding") -> list[Column]:
    """Two 64-bit hashes that stand for a vector's exact content, and its length."""
    return [F.xxhash64(vector).alias("h1"), F.xxhash64(F.lit(17), F.col(vector)).alias("h2"), F.size(vector).alias("dim")]


def matrix(lists: pa.Array) -> np.ndarray:
    """Rows of equally long float lists as float64."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; very large or small ones are brought near one first."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row pair, in double precision on the vectors as given."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def bounded_sample(rows: DataFrame, by: list[str], draw: str, least: int, sample_bytes: int) -> dict[tuple, tuple[int, np.ndarray]]:
    """Rows and sampled vectors of the groups with more than ``least`` rows.

    Together the samples take about ``sample_bytes``; ``draw`` is a column of
    random longs. So that each large group has a few vectors in the sample, there
    are at most as many groups as 8 KB pieces of it, the largest ones; smaller
    groups are not in the result.
    """
    groups = max(1, sample_bytes >> 13)
    size = F.first(F.size("embedding")).alias("size")
    large = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), size).where(F.col("n") > least).orderBy(F.desc("n"), *by).limit(groups).collect()
    if not large:
        return {}
    rate = min(1.0, sample_bytes / sum(8.0 * r["n"] * r["size"] for r in large))
    named = rows.sparkSession.createDataFrame([tuple(r[c] for c in by) for r in large], rows.select(*by).schema)
    drawn = rows.join(F.broadcast(named), by).where(F.pmod(draw, F.lit(1 << 30)) <= rate * (1 << 30)).select(*by, "embedding").toArrow()
    keys = list(zip(*(drawn.column(c).to_pylist() for c in by), strict=True))
    out, at = {}, {}
    for place, key in enumerate(keys):
        at.setdefault(key, []).append(place)
    for r in large:
        key = tuple(r[c] for c in by)
        if key in at:
            out[key] = (r["n"], matrix(drawn.column("embedding").take(pa.array(at[key])).combine_chunks()))
    return out
