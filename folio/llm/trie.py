"""Operator 11: the trie of conversation prefixes, with rollups over subtrees.

Turns are told by two 64-bit hashes of role and text, so that texts move
nowhere, and a prefix by the xor of its turns' hashes at their places. Equal
conversations count as one with a weight. A node that more than ``heavy``
different conversations pass is an upper one; the subtrees below the upper
nodes are dealt to shards. A shard builds its forest level by level as a LOUDS
bitvector with arrays of labels (a node of k children is k ones and a zero),
takes parents from the bitvector and adds up members, leaves and savings in
reverse level order. What the shards' tops hold is then merged in the same way
in the trie of the upper nodes, of which there are at most 65,537.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.llm.common import small_batches
from folio.storage import drop, written

_NOTHING = hashlib.sha256(b"").hexdigest()
#: Ids of conversations are joined to text in ranges of 2 to this power.
_ID_RANGE_BITS = 10
#: There are at most this many upper nodes besides the root.
_UPPER = 1 << 16
#: Turns that a shard gets on average.
_SHARD_ROWS = 1 << 15


def _hashes(*parts: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), *parts) for seed in (11, 29)]


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), t1 and t2 (hashes of role and text) and chars of each turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    t1, t2 = _hashes(role, text)
    made = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(role).alias("by"), t1.alias("t1"), t2.alias("t2"), F.length(text).cast("long").alias("chars"))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "by", "t1", "t2")
    return made.select("conv_id", "t1", "t2", "chars", F.row_number().over(order).alias("pos"))


def rebuilt(conversations: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """conv_id, place (from 1), t1, t2, chars of the turns of each rebuilt conversation, and a row of place 0 for each.

    The first h = crc32(decimal id) % ``heads`` turns are those of the
    conversation ``group`` rounds the id down to (none if it isn't there), the
    others a conversation's own after its first h. Turns are ordered by number,
    nulls first; equal numbers by hashes of role and text.
    """
    turns = written(_turns(conversations), "turns")
    first = turns.where((F.col("pos") < heads) & (F.col("conv_id") % group == 0)).withColumnRenamed("conv_id", "base")
    known = first.groupBy("base").agg(F.count(F.lit(1)).alias("n_base"))
    ids = turns.where("pos = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h"))
    ids = ids.join(known, "base", "left").withColumn("shared", F.least(F.col("h"), F.coalesce("n_base", F.lit(0)))).drop("n_base")
    taken = first.join(ids.where("shared > 0"), "base").where("pos <= shared").select("conv_id", F.col("pos").cast("long").alias("place"), "t1", "t2", "chars")
    own = turns.join(ids, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("shared")).alias("place"), "t1", "t2", "chars")
    nothing = F.lit(0).cast("long")
    roots = ids.select("conv_id", nothing.alias("place"), nothing.alias("t1"), nothing.alias("t2"), nothing.alias("chars"))
    return taken.unionByName(own).unionByName(roots)


def _prefixes(rows: DataFrame) -> DataFrame:
    """``rows`` with x1, x2 (the prefix up to a turn), p1, p2 (without it) and n, the conversation's turns."""
    marks = [F.when(F.col("place") > 0, h).otherwise(0) for h in _hashes(F.col("place"), F.col("t1"), F.col("t2"))]
    whole = W.partitionBy("conv_id")
    so_far = whole.orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    made = rows.select("conv_id", "place", "chars", *(m.alias(f"m{i}") for i, m in enumerate(marks, 1)))
    made = made.select("*", *(F.bit_xor(f"m{i}").over(so_far).alias(f"x{i}") for i in (1, 2)), F.max("place").over(whole).alias("n"))
    return made.select("conv_id", "place", "chars", "n", "x1", "x2", *(F.col(f"x{i}").bitwiseXOR(F.col(f"m{i}")).alias(f"p{i}") for i in (1, 2)))


def _ends(rows: DataFrame) -> DataFrame:
    """conv_id (the smallest), weight and sha256 of the ids of each group of equal conversations.

    Ids are joined to text in ranges of ids, and the ranges of a group stream
    through one hash in ascending order: of a group only a range is held.
    """
    last = rows.where("place = n").select("n", "x1", "x2", "conv_id")
    key = ["n", "x1", "x2"]
    text = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    ranges = last.groupBy(*key, F.shiftright("conv_id", _ID_RANGE_BITS).alias("range")).agg(text.alias("ids"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, now, state, conv, weight = ["conv_id", "weight", "ends"], None, None, 0, 0
        for batch in batches:
            done: list[tuple] = []
            for *found, ids, c, w in zip(*(batch.column(x).to_pylist() for x in (*key, "ids", "conv_id", "weight")), strict=True):
                if found != now:
                    if state is not None:
                        done.append((conv, weight, state.hexdigest()))
                    now, state, conv, weight = found, hashlib.sha256(ids.encode()), c, w
                else:
                    state.update(b"," + ids.encode())
                    weight += w
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*done, strict=True)) or [[], [], []], (pa.int64(), pa.int64(), pa.string()), strict=True)], names=names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([weight]), pa.array([state.hexdigest()])], names=names)

    return ranges.repartition(*key).sortWithinPartitions(*key, "range").mapInArrow(run, "conv_id long, weight long, ends string")


class Louds:
    """A forest under one root, level by level: ``bits`` has k ones and a zero for a node of k children."""

    def __init__(self, place: np.ndarray, labels: np.ndarray, above: np.ndarray):
        """Nodes by depth (from 1), label and the label of the node above; a node whose upper label is none's stands under the root.

        ``node`` gives each input node's number in level order, from 1.
        """
        order = np.argsort(place, kind="stable")
        starts = np.flatnonzero(np.diff(place[order], prepend=-1))
        self.node = np.zeros(len(place), np.int64)
        up = np.zeros(len(place), np.int64)
        known, numbers, depth, n = np.zeros(0, labels.dtype), np.zeros(0, np.int64), -1, 1
        self.levels = [np.zeros(1, np.int64)]
        for lo, hi in zip(starts, np.append(starts[1:], len(order)), strict=True):
            level = order[lo:hi]
            if place[level[0]] != depth + 1:
                known = known[:0]
            at = np.searchsorted(known, above[level])
            hit = at < len(known)
            hit[hit] = known[at[hit]] == above[level][hit]
            up[level[hit]] = numbers[at[hit]]
            ranked = level[np.lexsort((labels[level], up[level]))]
            depth = place[level[0]]
            self.node[ranked] = np.arange(n, n + len(ranked))
            by_label = np.argsort(labels[level], kind="stable")
            known, numbers = labels[level][by_label], self.node[level][by_label]
            self.levels.append(np.arange(n, n + len(ranked)))
            n += len(ranked)
        self.size = n
        counts = np.bincount(up, minlength=n)
        # children of the root may lie on any level; in the bitvector they come first, as in any level order
        number = np.concatenate([[0], self.node])
        parents = np.concatenate([[0], up])[np.argsort(number)]
        self.order = np.argsort(parents[1:], kind="stable") + 1  # nodes by their ones in the bitvector
        self.bits = np.zeros(2 * n - 1, bool)
        ends = np.cumsum(counts + 1) - 1
        self.bits[:] = True
        self.bits[ends] = False

    def parents(self) -> np.ndarray:
        """The parent of each node: the zeros before its one."""
        ones = np.flatnonzero(self.bits)
        out = np.zeros(self.size, np.int64)
        out[self.order] = ones - np.arange(len(ones))
        return out

    def children(self) -> np.ndarray:
        zeros = np.flatnonzero(~self.bits)
        return np.diff(zeros, prepend=-1) - 1

    def add_up(self, values: np.ndarray, how: np.ufunc = np.add) -> np.ndarray:
        """Each node's value joined with those of all below it, by reverse level order."""
        out, up = values.copy(), self.parents()
        for level in self.levels[:0:-1]:
            how.at(out, up[level], out[level])
        return out


_NODES = "x1 long, x2 long, p1 long, p2 long, top boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_INPUT = ["place", "x1", "x2", "p1", "p2", "chars", "conv_id", "weight", "ends", "n_children", "n_leaves", "saved_tokens"]


def _forest(table: pa.Table) -> pa.Table:
    """Nodes with rollups of the rows of one shard: a row adds its weight, leaves, savings and children below to its node."""
    raw = {c: table.column(c).to_numpy() for c in _INPUT if c != "ends"}
    key = np.empty(len(table), [("place", np.int64), ("x1", np.int64), ("x2", np.int64)])
    for c in key.dtype.names:
        key[c] = raw[c]
    order = np.lexsort((key["x2"], key["x1"], key["place"]))
    changed = np.ones(len(order), bool)
    changed[1:] = key[order][1:] != key[order][:-1]
    of = np.zeros(len(order), np.int64)
    of[order] = np.cumsum(changed) - 1
    first = order[changed]
    pairs = lambda a, b: np.rec.fromarrays([raw[a][first], raw[b][first]], names="a,b").view(np.ndarray)
    labels, above = _numbers(pairs("x1", "x2"), pairs("p1", "p2"))
    trie = Louds(raw["place"][first], labels, above)
    at = trie.node[of]  # the node of each row
    n = trie.size

    def gathered(c: str) -> np.ndarray:
        out = np.zeros(n, np.int64)
        np.add.at(out, at, raw[c])
        return out

    conv = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(conv, at, raw["conv_id"])
    below, leaves = gathered("n_children"), gathered("n_leaves")
    members, conv = trie.add_up(gathered("weight")), trie.add_up(conv, np.minimum)
    children = trie.children() + below
    leaves[children == 0] += 1
    chars = np.zeros(n, np.int64)
    chars[trie.node] = raw["chars"][first]
    saved = trie.add_up((members - 1) * chars + gathered("saved_tokens"))
    leaves, up = trie.add_up(leaves), trie.parents()
    ends = np.full(n, _NOTHING, object)
    held = np.flatnonzero(table.column("ends").is_valid().to_numpy())
    ends[at[held]] = table.column("ends").take(pa.array(held)).to_pylist()
    top = up[trie.node] == 0
    mine = trie.node
    columns = [raw[c][first] for c in ("x1", "x2", "p1", "p2")]
    above_conv = pa.array(conv[up[mine]], mask=top)
    return pa.table([*columns, top, conv[mine], raw["place"][first], above_conv, members[mine], children[mine], leaves[mine], saved[mine], pa.array(ends[mine], pa.string())], names=[c.split()[0] for c in _NODES.split(", ")])


def _numbers(labels: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of hashes as numbers; equal pairs of both arrays have equal ones."""
    _, number = np.unique(np.concatenate([labels, above]), return_inverse=True)
    return number[: len(labels)], number[len(labels) :]


def prefix_trie(conversations: DataFrame, heavy: int = 100, group: int = 100, heads: int = 6) -> DataFrame:
    """One row for each distinct prefix of rebuilt conversations, the empty one included.

    conv_id is the smallest member, depth the number of turns, parent_conv_id
    the smallest member of the prefix one turn shorter (null for the empty
    one), n_convs the members, n_children the prefixes one turn longer,
    n_leaves the nodes of the subtree without any, saved_tokens the sum over
    the subtree of (members - 1) times the code points of a node's last text,
    ends_sha256 the digest of the ascending ids that end here. Rows without
    conv_id take no part, null roles and texts are empty, equal turn numbers
    are ordered by hashes of role and text and repeated rows are turns of their
    own. A table without ids gives no node. The turns of one conversation, as
    numbers without texts, are handled by one task.
    """
    spark = conversations.sparkSession
    rows = written(_prefixes(rebuilt(small_batches(conversations), group, heads)), "prefixes")
    apart = written(rows.join(_ends(rows), "conv_id"), "distinct_prefixes")  # a row of each group of equal conversations
    drop(rows)
    total = apart.count()
    key = ["place", "x1", "x2"]
    often = apart.where("place > 0").groupBy(*key).agg(F.count(F.lit(1)).alias("passing")).where(F.col("passing") > max(heavy, total // _UPPER)).select(*key)
    upper = written(often, "upper_nodes")
    marked = apart.join(F.broadcast(upper.withColumn("upper", F.lit(True))), key, "left")
    marked = marked.withColumn("upper", F.coalesce("upper", F.col("place") == 0))
    ends = F.when(F.col("place") == F.col("n"), F.col("ends"))
    weight = F.when(F.col("place") == F.col("n"), F.col("weight")).otherwise(0)
    zero = F.lit(0).cast("long")
    given = [*key, "p1", "p2", "chars", "conv_id", weight.alias("weight"), ends.alias("ends"), zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved_tokens"), "upper"]
    marked = marked.withColumn("root", F.min(F.when(~F.col("upper"), F.struct("place", "x1", "x2"))).over(W.partitionBy("conv_id"))).select("root", *given)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // _SHARD_ROWS + 1)
    shard = F.pmod(F.xxhash64("root"), F.lit(shards))
    low = written(marked.where(~F.col("upper")).withColumn("shard", shard).groupBy("shard").applyInArrow(_forest, _NODES), "lower_nodes")
    tops = low.where("top").groupBy((F.col("depth") - 1).alias("place"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("weight"), F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    own = marked.where("upper").groupBy(*key, "p1", "p2", "chars").agg(F.min("conv_id").alias("conv_id"), F.sum("weight").alias("weight"), F.max("ends").alias("ends"))
    # one row for each upper node: its own ends, and what the tops below it bring
    joined = own.join(tops.select(*key, *(F.col(c).alias(f"_{c}") for c in ("conv_id", "weight", "n_children", "n_leaves", "saved_tokens"))), key, "left")
    summed = joined.select(*key, "p1", "p2", "chars", F.least("conv_id", "_conv_id").alias("conv_id"), (F.col("weight") + F.coalesce("_weight", zero)).alias("weight"), "ends", *(F.coalesce(f"_{c}", zero).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")))
    high = written(summed.groupBy(F.lit(0).alias("one")).applyInArrow(_forest, _NODES), "upper_trie")
    drop(apart, upper)
    names = [c.split()[0] for c in _NODES.split(", ")][5:]
    above = high.select(F.col("depth").alias("_depth"), F.col("x1").alias("_x1"), F.col("x2").alias("_x2"), F.col("conv_id").alias("_conv_id"))
    under = low.join(F.broadcast(above), F.col("top") & (F.col("depth") - 1 == F.col("_depth")) & (F.col("p1") == F.col("_x1")) & (F.col("p2") == F.col("_x2")), "left")
    return under.withColumn("parent_conv_id", F.coalesce("_conv_id", "parent_conv_id")).select(*names).unionByName(high.select(*names))


#: crc32 of a short ASCII string: its bytes from the left, each in eight shifts of the reversed polynomial.
_CRC32 = """xor(list_reduce(list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1))::BIGINT), lambda c, b:
  list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)), xor(c, b)), 4294967295::BIGINT), 4294967295::BIGINT)"""

#: The same in DuckDB SQL; equal turn numbers go by role and text here.
ORACLE_SQL = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC32.format("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, 0 AS source, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h
),
seq AS (
  SELECT c.conv_id, coalesce(s.turns, []) AS turns FROM c LEFT JOIN (
    SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY source, pos) AS turns FROM r GROUP BY conv_id
  ) s USING (conv_id)
),
members AS (SELECT conv_id, len(turns) AS n, u.d, turns[1 : u.d] AS prefix FROM seq, LATERAL (SELECT unnest(range(0, len(turns) + 1)) AS d) u),
nodes AS (
  SELECT prefix, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CASE WHEN n = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ends
  FROM members GROUP BY prefix, d
),
children AS (SELECT prefix[1 : depth - 1] AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
whole AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.prefix = n.prefix),
below AS (
  SELECT w.prefix[1 : u.d] AS prefix, count(*) FILTER (WHERE n_children = 0) AS n_leaves,
    sum(CASE WHEN depth > 0 THEN (n_convs - 1) * length(w.prefix[depth].text) ELSE 0 END)::BIGINT AS saved_tokens
  FROM whole w, LATERAL (SELECT unnest(range(0, depth + 1)) AS d) u GROUP BY 1
)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, b.n_leaves, b.saved_tokens, sha256(w.ends) AS ends_sha256
FROM whole w JOIN below b ON b.prefix = w.prefix LEFT JOIN nodes p ON w.depth > 0 AND p.prefix = w.prefix[1 : w.depth - 1]
"""
