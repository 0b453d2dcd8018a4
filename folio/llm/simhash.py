"""Operator 2: SimHash near-dedup by tiled exact comparison.

Distinct fingerprints are dealt to tiles by the population counts of their two
half-words. Every pair of tiles whose counts differ by no more than the radius
is compared with numpy exclusive-or and bit counts, the others are skipped. A tile pair returns a spanning forest
of its links, not the links, so that a large group of near copies stays linear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm import words
from folio.llm.common import drop, flat, meet, per_text, released, slices, small_batches, utf8, written
from folio.llm.components import connected_components, merge_labels

_SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def shingle_hashes(array: pa.Array, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all word shingles of the texts, and where each text's start (one more than texts)."""
    data, offsets = utf8(array)
    data = np.where((data >= 0x41) & (data <= 0x5A), data + np.uint8(0x20), data)
    lo, hi = words.spans(data, offsets)
    if not len(lo):
        return np.zeros(0, np.uint64), np.zeros(len(array) + 1, np.int64)
    length = hi - lo + 1
    joined = np.full(int(length.sum()), 0x20, np.uint8)  # every word and one space
    new_hi = np.cumsum(length) - 1
    new_lo = new_hi - (hi - lo)
    joined[flat(new_lo, hi - lo)] = data[flat(lo, hi - lo)]
    n = words.counts_by_text(lo, offsets)
    made = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    first = flat(np.cumsum(n) - n, made)
    last = first + np.repeat(np.minimum(n, size), made) - 1
    raw, one = joined.tobytes(), xxhash.xxh64_intdigest
    found = [one(raw[a:b], seed) for a, b in zip(new_lo[first].tolist(), new_hi[last].tolist(), strict=True)]
    return np.array(found, np.uint64), np.concatenate([[0], np.cumsum(made)])


def majority(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each run of hashes, the bits that are set in over half of it; zero for an empty run."""
    out = np.zeros(len(at) - 1, np.uint64)
    n = np.diff(at)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    blocks = -(-n[full] // 255)  # byte counters hold 255
    cuts = flat(np.zeros(len(full), np.int64), blocks) * 255 + np.repeat(at[full], blocks)
    bytes_ = hashes.view(np.uint8).reshape(-1, 8)
    counters = np.empty((len(cuts), 8), np.uint64)
    for k in range(8):
        counters[:, k] = np.add.reduceat(_SPREAD[bytes_[:, k]], cuts)
    counts = np.add.reduceat(counters.view(np.uint8).reshape(len(cuts), 64), np.cumsum(blocks) - blocks, axis=0, dtype=np.int64)
    bits = counts * 2 > n[full][:, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


_FP = T.StructType([T.StructField("fp", T.LongType())])


def fingerprints(df: DataFrame, text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``df`` with ``fp``, the SimHash of each whole text as a signed long (zero without words)."""

    def make():
        def work(array: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(majority(*shingle_hashes(array, shingle, seed)).view(np.int64))], names=["fp"])

        return work

    return per_text(df, text, _FP, make)


def _halves(x: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_count(x & np.uint64(0xFFFFFFFF)), np.bitwise_count(x >> np.uint64(32))]).astype(np.int16)


def tile_links(a: np.ndarray, b: np.ndarray, radius: int, block: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a and b at ``radius`` or fewer differing bits, block by block."""
    orders = [np.lexsort((h[1], h[0])) for h in (_halves(a), _halves(b))]
    a_sorted, b_sorted = a[orders[0]], b[orders[1]]
    ha, hb = _halves(a_sorted), _halves(b_sorted)
    for i in range(0, len(a), block):
        x = a_sorted[i : i + block]
        xl, xh = ha[:, i : i + block].min(axis=1), ha[:, i : i + block].max(axis=1)
        for j in range(0, len(b), block):
            y = hb[:, j : j + block]
            apart = np.maximum(0, np.maximum(xl - y.max(axis=1), y.min(axis=1) - xh))
            if apart.sum() > radius:
                continue
            near = np.bitwise_count(x[:, None] ^ b_sorted[None, j : j + block]) <= radius
            r, c = np.nonzero(near)
            if len(r):
                yield orders[0][i + r], orders[1][j + c]


def _roots(node: np.ndarray, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """A spanning forest (u, v) of links between places of ``node``; v is the least node of u's tree."""
    order = np.argsort(node, kind="stable")  # a lower place is a lower node
    place = np.empty(len(node), np.int64)
    place[order] = np.arange(len(node))
    parent = np.arange(len(node))
    for i, j in links:
        merge_labels(parent, place[i], place[j])
    while not np.array_equal(up := parent[parent], parent):
        parent = up
    u, v = node[order], node[order][parent]
    keep = u != v
    return pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], names=["u", "v"])


def _forest(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            sides = [batch.column(s).slice(k, 1).flatten() for s in (0, 1)]
            fp = [s.field("fp").to_numpy().view(np.uint64) for s in sides]
            node = np.concatenate([s.field("node").to_numpy() for s in sides])
            yield _roots(node, ((i, len(fp[0]) + j) for i, j in tile_links(fp[0], fp[1], radius)))  # noqa: B023


def near_links(reps: DataFrame, radius: int = 3, tile: int = 32768) -> DataFrame:
    """Edges (u, v) that join all of (fp, node) within ``radius`` bits of each other into the same components.

    Tiles are named by the counts of both half-words and hold about ``tile``
    rows at most; pairs of names that lie further apart than the radius are never
    made. Work grows with the square of the distinct fingerprints, less those pairs.
    """
    spark = reps.sparkSession
    low, high = F.bit_count(F.col("fp").bitwiseAND(0xFFFFFFFF)).cast("int"), F.bit_count(F.shiftrightunsigned("fp", 32)).cast("int")
    named = reps.withColumn("p", 64 * low + high)
    counts = {r["p"]: r["count"] for r in named.groupBy("p").count().collect()}  # 33 x 33 rows at most
    chunks = {p: -(-n // tile) for p, n in counts.items()}
    if not chunks:
        return spark.createDataFrame([], "u long, v long")
    of = spark.createDataFrame(list(chunks.items()), "p int, n int")
    tiles = named.join(F.broadcast(of), "p").withColumn("c", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    tiles = written(tiles.groupBy("p", "c").agg(F.collect_list(F.struct("fp", "node")).alias("rows")), "tiles")
    near = [(p, q, chunks[p], chunks[q]) for p in chunks for q in chunks if p <= q and abs(p // 64 - q // 64) + abs(p % 64 - q % 64) <= radius]
    links = written(meet(_tile_pairs(spark, near), tiles, *_other(tiles)).select("rows", "other").mapInArrow(lambda it: _forest(it, radius), "u long, v long"), "links")
    drop(tiles)
    return links


def _tile_pairs(spark: SparkSession, near: list[tuple[int, int, int, int]]) -> DataFrame:
    """(p, c, q, d): every chunk of the tiles named p with every chunk of those named q."""
    pairs = spark.createDataFrame(near, "p int, q int, n int, m int").withColumn("c", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("d", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    return pairs.where("p < q or c <= d").select("p", "c", "q", "d")


def _other(tiles: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    return tiles.select(F.col("p").alias("q"), F.col("c").alias("d"), F.col("rows").alias("other")), ["p", "c"], ["q", "d"]


def simhash_components(docs: DataFrame, radius: int = 3, shingle: int = 3, tile: int = 32768) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row.

    Null and empty texts and texts without words have fingerprint zero and link
    like any other. Rows with equal ids are fingerprinted each for itself and
    share what their id reaches; a null id takes no part in linking and gets a
    null component. An empty table gives no rows; other columns are ignored.
    """
    fps = written(fingerprints(docs.select("doc_id", "text"), shingle=shingle).select("doc_id", "fp"), "fingerprints")
    reps = written(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "reps")
    #: An id of several rows may stand for several fingerprints: its rows are one node.
    several = fps.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("doc_id")
    repeated = fps.join(several, "doc_id").join(reps, "fp").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    roots = written(connected_components(near_links(reps, radius, tile).union(repeated)), "components")
    of = written(reps.join(roots, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "classes")
    drop(reps, roots)
    joined = fps.join(of, "fp", "left")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


_SKETCH = "doc_id long, key long, fp long, fp2 long, n int"
_SALT = np.uint64(0x5851F42D4C957F2D)


def distinct_shingles(array: pa.Array, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The different shingle hashes of each text in ascending order, and where each text's start."""
    hashes, at = shingle_hashes(array, size, seed)
    text = np.repeat(np.arange(len(array)), np.diff(at))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[first], np.concatenate([[0], np.cumsum(np.bincount(text[first], minlength=len(array)))]).astype(np.int64)


def set_keys(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each run of hashes as a set; zero for an empty one."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.mix(hashes ^ (_SALT << np.uint64(1))), dtype=np.uint64)])
    return words.mix(sums[at[1:]] - sums[at[:-1]])


def _sketches(docs: DataFrame, shingle: int, seed: int = 42) -> DataFrame:
    """Each row's set key, two independent SimHashes of its set of shingles and the set's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                hashes, at = distinct_shingles(batch.column(1).slice(lo, hi - lo), shingle, seed)
                found = (set_keys(hashes, at), majority(hashes, at), majority(words.mix(hashes ^ _SALT), at))
                columns = [pa.array(x.view(np.int64)) for x in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns, pa.array(np.diff(at).astype(np.int32))], names=["doc_id", "key", "fp", "fp2", "n"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(run), _SKETCH)


def _sets(docs: DataFrame, shingle: int, seed: int = 42) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(0)):
                hashes, at = distinct_shingles(batch.column(0).slice(lo, hi - lo), shingle, seed)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(set_keys(hashes, at).view(np.int64)), lists], names=["key", "items"])

    return small_batches(docs).select(F.col("text").cast("string")).mapInArrow(released(run), "key long, items array<long>")


def _candidates(batches: Iterator[pa.RecordBatch], radius: int, both: int) -> Iterator[pa.RecordBatch]:
    """A forest of the candidate pairs of each pair of tiles."""
    for batch in batches:
        for k in range(batch.num_rows):
            sides = [batch.column(s).slice(k, 1).flatten() for s in (0, 1)]
            fp = [s.field("fp").to_numpy().view(np.uint64) for s in sides]
            key, fp2, n = (np.concatenate([s.field(c).to_numpy() for s in sides]) for c in ("key", "fp2", "n"))
            fp2, n = fp2.view(np.uint64), n.astype(np.int64)

            def near() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for i, j in tile_links(*fp, radius):  # noqa: B023
                    d = np.bitwise_count(fp[0][i] ^ fp[1][j]).astype(np.int64)  # noqa: B023
                    j = j + len(fp[0])  # noqa: B023
                    d += np.bitwise_count(fp2[i] ^ fp2[j])  # noqa: B023
                    ok = (d <= both) & (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j]))  # noqa: B023
                    yield i[ok], j[ok]

            yield _roots(key, near())


def _candidate_links(nodes: DataFrame, radius: int, both: int, tile: int) -> DataFrame:
    """Edges (u, v) that join all nodes whose sketches lie near each other.

    Sets of a Jaccard similarity of 0.8 differ in size by a quarter at most, so
    tiles are bands of sizes a little wider than that, compared with the next.
    """
    spark = nodes.sparkSession
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.26))).cast("int")
    counts = {r["p"]: r["count"] for r in nodes.groupBy(band.alias("p")).count().collect()}  # bands of a logarithm: under 100 rows
    chunks = {p: -(-n // tile) for p, n in counts.items()}
    if not chunks:
        return spark.createDataFrame([], "u long, v long")
    of = F.create_map(*(F.lit(x) for p in chunks.items() for x in p))
    tiles = nodes.withColumn("p", band).withColumn("c", F.pmod(F.xxhash64("key"), of[F.col("p")]).cast("int"))
    tiles = written(tiles.groupBy("p", "c").agg(F.collect_list(F.struct("key", "fp", "fp2", "n")).alias("rows")), "tiles")
    near = [(p, q, chunks[p], chunks[q]) for p in chunks for q in (p, p + 1) if q in chunks]
    links = written(meet(_tile_pairs(spark, near), tiles, *_other(tiles)).select("rows", "other").mapInArrow(lambda it: _candidates(it, radius, both), "u long, v long"), "near")
    drop(tiles)
    return links


def common_counts(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many items each set of a shares with each of b; sets are (items, number of items of each)."""
    rows = [np.repeat(np.arange(len(n)), n) for _, n in (a, b)]
    out = np.zeros((len(a[1]), len(b[1])), np.float32)  # exact below 2**24
    found, at = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    item = [at[: len(a[0])], at[len(a[0]) :]]
    seen = [np.bincount(x, minlength=len(found)) for x in item]
    often = np.flatnonzero(seen[0] * seen[1] > 64)
    for lo in range(0, len(often), 4096):  # frequent items by a matrix product
        column = np.full(len(found), -1)
        column[often[lo : lo + 4096]] = np.arange(len(often[lo : lo + 4096]))
        sides = []
        for k in (0, 1):
            own = column[item[k]] >= 0
            side = np.zeros((out.shape[k], len(often[lo : lo + 4096])), np.float32)
            side[rows[k][own], column[item[k][own]]] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    rare = (seen[0] > 0) & (seen[1] > 0)
    rare[often] = False
    own = [rare[x] for x in item]
    order = np.argsort(item[1][own[1]], kind="stable")
    other = rows[1][own[1]][order]
    first = np.searchsorted(item[1][own[1]][order], item[0][own[0]])
    times = seen[1][item[0][own[0]]]
    np.add.at(out, (np.repeat(rows[0][own[0]], times), other[flat(first, times)]), 1)
    return out


def _set_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each pair of chunks of a candidate component: a forest of the pairs of Jaccard similarity 0.8 or more."""
    for batch in batches:
        for k in range(batch.num_rows):
            sides = [batch.column(s).slice(k, 1).flatten() for s in (0, 1)]
            key = [s.field("key").to_numpy() for s in sides]
            n = [s.field("n").to_numpy().astype(np.int64) for s in sides]
            common = common_counts(*((s.field("items").flatten().to_numpy(), m) for s, m in zip(sides, n, strict=True)))
            i, j = np.nonzero(9 * common >= 4 * (n[0][:, None] + n[1][None, :]))  # 0.8 of the union
            yield _roots(np.concatenate(key), iter([(i, j + len(key[0]))]))


def similar_links(docs: DataFrame, reps: DataFrame, shingle: int, radius: int, both: int, tile: int, chunk_items: int = 1 << 18, chunk_sets: int = 1024) -> DataFrame:
    """Edges (u, v) between keys that join all candidates of Jaccard similarity 0.8 or more into the same components.

    Candidates are gathered into components first. In each, one set is compared
    with all others, which settles the components of plain copies; the sets that
    it doesn't link meet all sets of their component in chunks of bounded size.
    Every edge is checked on the sets themselves, and no pair is written out.
    """
    nodes = reps.where("n > 0").select("key", "node", "fp", "fp2", "n")
    group = written(connected_components(_candidate_links(nodes, radius, both, tile)).select(F.col("node").alias("key"), F.col("component").alias("g")), "candidates")
    ids = nodes.join(group, "key").select(F.col("node").alias("doc_id"))
    sets = _sets(docs.join(ids.distinct(), "doc_id", "left_semi"), shingle).join(group, "key").dropDuplicates(["key"])
    sets = written(sets.select("key", "g", F.size("items").alias("n"), "items"), "sets")
    hubs = written(sets.where("key = g").select("g", F.col("n").alias("hub_n"), F.col("items").alias("hub")), "hubs")  # a component is named by one of its keys
    near = F.size(F.array_intersect("items", "hub")) * 9 >= (F.col("n") + F.col("hub_n")) * 4
    told = written(sets.join(hubs, "g").select("key", "g", "n", F.when(near, 0).otherwise(1).alias("kind")), "told")
    links = told.where("kind = 0 and key <> g").select(F.col("key").alias("u"), F.col("g").alias("v"))
    open_ = told.groupBy("g", "kind").agg(F.greatest(F.ceil(F.sum("n") / chunk_items), F.ceil(F.count(F.lit(1)) / chunk_sets)).cast("int").alias("chunks"))
    open_ = written(open_.join(told.where("kind = 1").select("g").distinct(), "g", "left_semi"), "open")
    dealt = told.join(open_, ["g", "kind"]).select("key", "g", "kind", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int").alias("c"))
    packed = written(sets.drop("g").join(dealt, "key").groupBy("g", "kind", "c").agg(F.collect_list(F.struct("key", "n", "items")).alias("rows")), "chunks")
    drop(sets, hubs)
    names = packed.select("g", "kind", "c")
    pairs = names.where("kind = 1").join(names.select("g", F.col("kind").alias("kind2"), F.col("c").alias("d")), "g").where("kind2 = 0 or c <= d")
    right = packed.select("g", F.col("kind").alias("kind2"), F.col("c").alias("d"), F.col("rows").alias("other"))
    both_ = meet(pairs, packed, right, ["g", "kind", "c"], ["g", "kind2", "d"])
    found = written(both_.select("rows", "other").mapInArrow(_set_links, "u long, v long"), "links")
    drop(packed)
    return links.union(found)


def near_dedup(docs: DataFrame, shingle: int = 5, radius: int = 20, both: int = 34, tile: int = 32768) -> DataFrame:
    """The rows of ``docs`` but one for each component of near copies: the one of smallest doc_id (rows with a null id stay).

    Near copies have a Jaccard similarity of at least 0.8 between their sets of
    ``shingle`` words. Candidates are texts whose SimHashes differ by ``radius``
    bits at most, and by ``both`` together with a second, independent one; sets
    that candidates connect are then compared exactly. Null and empty texts and texts without words are
    copies of each other.
    """
    all_ = written(_sketches(docs.select("doc_id", "text"), shingle).where("doc_id is not null"), "sketches")
    reps = written(all_.groupBy("key").agg(F.min("doc_id").alias("node"), *(F.first(c).alias(c) for c in ("fp", "fp2", "n"))), "reps")
    links = similar_links(docs.select("doc_id", "text"), reps, shingle, radius, both, tile)
    ends = [reps.select(F.col("key").alias(c), F.col("node").alias(f"{c}_node")) for c in ("u", "v")]
    joined = links.join(ends[0], "u").join(ends[1], "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))
    copies = all_.join(reps.select("key", "node"), "key").where("doc_id <> node").select(F.col("doc_id").alias("u"), F.col("node").alias("v")).distinct()
    roots = connected_components(joined.union(copies)).where("node <> component")
    gone = written(roots.select(F.col("node").alias("doc_id")), "copies")
    drop(all_, reps)
    return docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
