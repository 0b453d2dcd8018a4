"""Operator 3: packing of tokenised documents into sequences by a grouping genetic algorithm.

Pieces are dealt at random to shards of bounded size. Each shard evolves on
several islands; between epochs an island's elite moves to the next one. Genes
are whole sequences (bins): crossover injects well-filled bins of one parent
into the other, drops the bins that share a piece with them, and best-fits the
displaced pieces. Bins that stay badly filled go to a further round over far
fewer shards, so that leftovers of many shards share sequences.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folio.llm import words
from folio.llm.common import drop, released, resident, slices, small_batches, utf8, written
from folio.llm.memo import PieceTable


class WordCoder:
    """Ids of a word-level BPE file, each distinct word encoded once.

    Words are cut at ASCII white space, which the file's own splitting drops,
    and a final '.' or ',' after a letter is cut off, as its pattern does.
    """

    def __init__(self, path: str, together: int = 500):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are what runs side by side; each thread would hold memory of its own
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.together = together
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)
        self.final[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.table = PieceTable(self._encode)

    def _plain(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _encode(self, pieces: list[bytes]) -> list[list[int]]:
        parts = [p.decode() for p in pieces]
        out: list[list[int]] = [[]] * len(parts)
        letters = [i for i, p in enumerate(parts) if p.isalpha() and ord(max(p)) < 0x100]
        groups = [letters[k : k + self.together] for k in range(0, len(letters), self.together)]
        for group, ids in zip(groups, self._plain([" ".join(parts[i] for i in g) for g in groups]), strict=True):
            stops = (np.flatnonzero(self.final[ids]) + 1).tolist()
            if len(stops) == len(group):  # a word of letters ends with the only final token it has
                for i, a, b in zip(group, [0, *stops[:-1]], stops, strict=True):
                    out[i] = ids[a:b]
            else:
                for i, own in zip(group, self._plain([parts[i] for i in group]), strict=True):
                    out[i] = own
        seen = set(letters)
        rest = [i for i in range(len(parts)) if i not in seen]
        for i, own in zip(rest, self._plain([parts[i] for i in rest]), strict=True):
            out[i] = own
        return out

    def encode(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order and where each text's ids start (one more than texts)."""
        data, offsets = utf8(array)
        data = lower_simple(data)
        starts, ends = words.spans(data, offsets)
        starts, ends = words.cut_stops(data, starts, ends, words.simple_letters(data))
        ids, sizes = self.table.look_up(data, starts, ends)
        return ids, np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, offsets)]


def lower_simple(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and U+00C0-U+00DE; the file lowers the rest itself."""
    out = data.copy()
    out[(data >= 0x41) & (data <= 0x5A)] += 0x20
    two = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    out[two] += 0x20
    return out


def coder(path: str) -> WordCoder:
    return resident(f"words {path}", lambda: WordCoder(path))


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, draw long"


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 0) -> DataFrame:
    """A row for each piece of at most ``capacity`` ids of every document, with a random ``draw``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                ids, at = coder(path).encode(batch.column(1).slice(lo, hi - lo))
                doc, size = batch.column(0).slice(lo, hi - lo), np.diff(at) + 1
                full = np.empty(len(ids) + len(size), "<u4")  # with the end id after each text
                ends = at[1:] + np.arange(1, len(at)) - 1
                full[ends] = end_id
                keep = np.ones(len(full), bool)
                keep[ends] = False
                full[keep] = ids
                pieces = -(-size // capacity)
                row = np.repeat(np.arange(len(size)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(size[row] - start, capacity)
                begin = (np.cumsum(size) - size)[row] + start
                crc = np.fromiter((zlib.crc32(full[a : a + n]) for a, n in zip(begin, length, strict=True)), np.int64, len(row))
                draw = words.mix(np.arange(made, made + len(row), dtype=np.uint64) + (np.uint64(part) << np.uint64(36)))
                made += len(row)
                yield pa.RecordBatch.from_arrays(
                    [doc.take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc), pa.array((draw >> np.uint64(1)).astype(np.int64))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "draw"],
                )

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(run), PIECE)


Bins = list[list[int]]


class Shard:
    """The pieces of one shard and the steps of the genetic algorithm over them."""

    def __init__(self, lengths: np.ndarray, capacity: int, seed: tuple[int, ...]):
        self.length, self.capacity = lengths.tolist(), capacity
        self.rng = np.random.default_rng(seed)
        self.least = -(-int(lengths.sum()) // capacity)

    def fill(self, bin_: list[int]) -> int:
        return sum(self.length[i] for i in bin_)

    def fitness(self, bins: Bins) -> tuple[int, float]:
        """Fewer bins first, then the more unevenly filled ones."""
        return len(bins), -sum((self.fill(b) / self.capacity) ** 2 for b in bins)

    def best_fit(self, bins: Bins, items: list[int]) -> Bins:
        """Puts each item into the fullest bin that has room for it, or a new one."""
        bins = [list(b) for b in bins]
        room = sorted((self.capacity - self.fill(b), k) for k, b in enumerate(bins))
        for i in items:
            n = self.length[i]
            at = bisect.bisect_left(room, (n, -1))
            if at == len(room):
                left, k = self.capacity, len(bins)
                bins.append([])
            else:
                left, k = room.pop(at)
            bins[k].append(i)
            if left > n:
                bisect.insort(room, (left - n, k))
        return bins

    def decreasing(self, items: list[int], noise: float = 0.0) -> list[int]:
        size = self.length
        if noise:
            factor = 1 + noise * self.rng.standard_normal(len(items))
            return [items[k] for k in np.argsort([-size[i] * f for i, f in zip(items, factor, strict=True)], kind="stable")]
        return sorted(items, key=lambda i: -size[i])

    def crossover(self, giver: Bins, taker: Bins) -> Bins:
        """Whole well-filled bins of ``giver`` replace the bins of ``taker`` they overlap; the rest is best-fitted."""
        ranked = sorted(giver, key=lambda b: -self.fill(b))
        ranked = ranked[: max(1, len(ranked) // 2)]
        taken = [b for b in ranked if self.rng.random() < 0.5] or ranked[:1]
        inside = {i for b in taken for i in b}
        kept, displaced = [], []
        for b in taker:
            if inside.isdisjoint(b):
                kept.append(b)
            else:
                displaced += [i for i in b if i not in inside]
        return self.best_fit(taken + kept, self.decreasing(displaced))

    def mutate(self, bins: Bins, share: float = 0.1) -> Bins:
        """Dissolves some of the worst-filled bins and best-fits their pieces."""
        ranked = sorted(bins, key=self.fill)
        gone = max(2, int(len(ranked) * share * self.rng.random()))
        loose = [i for b in ranked[:gone] for i in b]
        return self.best_fit(ranked[gone:], self.decreasing(loose, 0.2))

    def evolve(self, population: list[Bins], size: int, generations: int) -> list[Bins]:
        """The population after some generations, best first; it stops at the lower bound."""
        everything = list(range(len(self.length)))
        pool = list(population)
        while len(pool) < size:
            pool.append(self.best_fit([], self.decreasing(everything, 0.05 * len(pool))))
            if len(pool[-1]) <= self.least:
                break
        pool.sort(key=self.fitness)
        for _ in range(generations):
            if len(pool[0]) <= self.least:
                break
            a, b = self.rng.integers(len(pool), size=2)
            child = self.mutate(self.crossover(pool[min(a, b)], pool[max(a, b)]))
            pool = sorted([*pool, child], key=self.fitness)[:size]
        return pool


def _assignment(bins: Bins, n: int) -> np.ndarray:
    out = np.zeros(n, np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out


def _bins(assignment: np.ndarray) -> Bins:
    order = np.argsort(assignment, kind="stable")
    cuts = np.flatnonzero(np.diff(assignment[order])) + 1
    return [x.tolist() for x in np.split(order, cuts)] if len(order) else []


_ITEM = "array<struct<length:long,draw:long,doc_id:long,piece:int,start:long,ids_crc32:long>>"
_ISLAND = f"shard long, island int, items {_ITEM}, elite array<binary>"


def _evolved(packed: DataFrame, capacity: int, size: int, generations: int, elite: int, epoch: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, islands, items, elites = batch.columns
            lengths, cuts = items.flatten().field("length").to_numpy(), items.value_lengths().to_numpy().cumsum()
            found = []
            for k, (shard, island, given) in enumerate(zip(shards.to_pylist(), islands.to_pylist(), elites.to_pylist(), strict=True)):
                own = lengths[cuts[k - 1] if k else 0 : cuts[k]]
                ga = Shard(own, capacity, (shard, island, epoch))
                pool = ga.evolve([_bins(np.frombuffer(x, np.int32)) for x in given], size, generations)
                found.append([_assignment(b, len(own)).tobytes() for b in pool[:elite]])
            yield pa.RecordBatch.from_arrays([shards, islands, items, pa.array(found, pa.list_(pa.binary()))], names=["shard", "island", "items", "elite"])

    return packed.select("shard", "island", "items", "elite").mapInArrow(run, _ISLAND)


_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, draw long, sequence_id long, offset long, poor boolean"


def _placed(whole: DataFrame, capacity: int, poor_fill: float, round_: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard = batch.column(0)[row].as_py()
                items = batch.column(1).slice(row, 1).flatten()
                length = items.field("length").to_numpy()
                ga = Shard(length, capacity, (0,))
                pools = [_bins(np.frombuffer(x, np.int32)) for isle in batch.column(2)[row].as_py() for x in isle]
                bins = min(pools, key=ga.fitness)
                order = np.array([i for b in bins for i in b], np.int64)
                sizes = np.array([len(b) for b in bins])
                number = np.repeat(np.arange(len(bins)), sizes)
                ends = np.cumsum(length[order])
                first = np.cumsum(sizes) - sizes
                base = (ends - length[order])[first]
                fill = np.add.reduceat(length[order], first)
                at = pa.array(order)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(items.field(n).take(at) for n in ("doc_id", "piece", "start", "length", "ids_crc32", "draw")),
                        pa.array((number + (np.int64(shard) << 16) + (np.int64(round_) << 58)).astype(np.int64)),
                        pa.array(ends - length[order] - base[number]),
                        pa.array((fill < poor_fill * capacity)[number]),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "draw", "sequence_id", "offset", "poor"],
                )

    return whole.mapInArrow(run, _PLACED)


def pack(docs: DataFrame, path: str, capacity: int = 2048, shard_pieces: int = 2048, islands: int = 2, population: int = 4, generations: int = 10, elite: int = 2, poor_fill: float = 0.97, rounds: int = 8, stalled: float = 0.9) -> DataFrame:
    """Every piece of every document with its place in a sequence.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Texts
    that are null or empty are one piece of the end id alone. Rows with equal or
    null ids are packed each for itself; other columns are not looked at; an
    empty table gives no rows. Only documents of more than ``capacity`` ids are
    cut. Shards hold about ``shard_pieces`` pieces whatever the documents are,
    as pieces are dealt by a random draw. Badly filled sequences stay as they are
    where dealing again leaves more than a ``stalled`` share of the pieces in
    such ones, and in the last of ``rounds``.
    """
    left = written(token_pieces(docs, path, capacity), "pieces")
    done: list[DataFrame] = []
    n = left.count()
    for round_ in range(rounds):
        shards = max(1, -(-n // shard_pieces))
        last = shards == 1 or round_ == rounds - 1
        packed = (
            left.groupBy((F.col("draw") % shards).alias("shard"))
            .agg(F.sort_array(F.collect_list(F.struct("length", "draw", "doc_id", "piece", "start", "ids_crc32")), asc=False).alias("items"))
            .withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
            .withColumn("elite", F.array().cast("array<binary>"))
        )
        evolved = _evolved(packed, capacity, population, generations, elite, 2 * round_)
        #: Migration: an island goes on with its own elite and that of the one before it.
        together = evolved.groupBy("shard").agg(F.first("items").alias("items"), F.sort_array(F.collect_list(F.struct("island", "elite"))).alias("isles"))
        migrated = together.select("shard", "items", F.posexplode("isles").alias("k", "isle"), "isles").select(
            "shard", F.col("k").alias("island"), "items", F.concat(F.col("isle.elite"), F.get(F.col("isles.elite"), (F.col("k") + islands - 1) % islands)).alias("elite")
        )
        again = _evolved(migrated, capacity, population, generations, elite, 2 * round_ + 1)
        whole = again.groupBy("shard").agg(F.first("items").alias("items"), F.sort_array(F.collect_list(F.struct("island", "elite"))).alias("isles")).select("shard", "items", F.col("isles.elite").alias("elites"))
        placed = written(_placed(whole, capacity, 0.0 if last else poor_fill, round_), f"placed-{round_}")
        drop(left)
        poor = placed.where("poor").count()
        if poor > stalled * n:
            done.append(placed)
            break
        done.append(placed.where(~F.col("poor")))
        if not poor:
            break
        n = poor
        left = placed.where("poor").select("doc_id", "piece", "start", "length", "ids_crc32", "draw")
        left = written(left.withColumn("draw", F.expr(f"shiftrightunsigned(xxhash64(draw, {round_}), 1)")), f"left-{round_}")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
