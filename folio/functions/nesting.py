"""One stack over a row's array: which entry holds which, by their levels."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is told of each entry: the entry around it (-1: none, -2: inside an opaque one, so no entry at all), the last
#: entry inside it, how many stand right in it and the first of them, its own place there, its depth, the largest
#: place of a nameless entry on the way to it, and the path of names and places to it.
NESTED = "array<struct<parent:int,last:int,n_children:int,first:int,place:int,depth:int,widest:int,path:string>>"
_PLACES = ("parent", "last", "n_children", "first", "place", "depth", "widest")
_FIELDS = [*(pa.field(n, pa.int32()) for n in _PLACES), pa.field("path", pa.string())]
#: How many entries a pass holds at a time as Python objects; arrays share a pass while they have no more in all.
_ENTRIES = 1 << 16


def _values(entries: pa.StructArray) -> Iterator[tuple]:
    """(level, name, opaque, passing) of each entry, a part of them as Python objects at a time."""
    for at in range(0, len(entries), _ENTRIES):
        part = entries.slice(at, _ENTRIES)
        yield from zip(*(part.field(n).to_pylist() for n in ("level", "name", "opaque", "passing")), strict=True)


class _Texts:
    """A column of texts that grows by one at a time and is kept as Arrow has it, but for the latest ones."""

    def __init__(self, size: int):
        self.offsets, self.known = np.zeros(size + 1, np.int32), np.zeros(size, bool)
        self.bytes, self.count, self.latest = bytearray(), 0, []

    def put(self, text: str | None) -> None:
        self.latest.append(text)
        if len(self.latest) == _ENTRIES:
            self._settle()

    def _settle(self) -> None:
        told = pa.array(self.latest, pa.string())
        _, offsets, data = told.buffers()
        own, to = np.frombuffer(offsets, np.int32, len(told) + 1), self.count + len(told)
        if len(self.bytes) + int(own[-1]) >= 1 << 31:
            raise OverflowError("the paths of one array take 2 GB or more")
        self.offsets[self.count + 1 : to + 1] = own[1:] + len(self.bytes)
        self.known[self.count : to] = told.is_valid().to_numpy(zero_copy_only=False)
        self.bytes += memoryview(data)[: own[-1]] if data else b""
        self.count, self.latest = to, []

    def done(self) -> pa.StringArray:
        if self.latest:
            self._settle()
        valid = None if self.known.all() else pa.py_buffer(np.packbits(self.known, bitorder="little"))
        return pa.StringArray.from_buffers(self.count, pa.py_buffer(self.offsets), pa.py_buffer(self.bytes), valid)


def _nest(ends: list[int], entries: pa.StructArray, root: str) -> pa.StructArray:
    """What is told of the entries of several arrays, which end at ``ends``; only the open entries and a part of the others are Python objects."""
    parent, last, n_children, first, place, depth, widest = told = [array("i", bytes(4 * len(entries))) for _ in _PLACES]
    paths, values = _Texts(len(entries)), _values(entries)
    start = 0
    for end in ends:
        stack: list[int] = []
        around: list[tuple] = []  # level, path and opaque of what is on the stack
        real = start - 1  # the latest entry that counts
        for i, (level, name, opaque, passes) in zip(range(start, end), values):  # the range first, so that no value is taken past its end
            if not passes:
                while stack and around[-1][0] >= level:
                    last[stack.pop()] = real - start
                    around.pop()
            up = stack[-1] if stack else -1
            inside = up >= 0 and around[-1][2] and around[-1][0] < level
            if inside or passes:
                real = i if inside else real
                parent[i], last[i], first[i], place[i], depth[i] = -2, i - start, -1, -1, -1
                paths.put(None)
                continue
            if up >= 0:
                before, at = around[-1][1], n_children[up]
                parent[i], place[i], depth[i], n_children[up] = up - start, at, depth[up] + 1, at + 1
                if at == 0:
                    first[up] = i - start
                widest[i] = widest[up] if name is not None else max(widest[up], at)
                path = f"{before or root}[{at}]" if name is None else f"{before}.{name}" if before and name else before or name
            else:
                parent[i], path = -1, ""
            first[i] = -1
            paths.put(path or root)
            stack.append(i)
            around.append((level, path, opaque))
            real = i
        while stack:
            last[stack.pop()] = real - start
        start = end
    return pa.StructArray.from_arrays([*(pa.array(np.frombuffer(x, np.int32)) for x in told), paths.done()], fields=_FIELDS)


def running_sums(values: Column) -> Column:
    """The sums of an array's integers up to and with each place, in one pass; nulls in it count as zero."""

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            sizes = np.where(lists.is_valid(), lists.value_lengths().fill_null(0), 0)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            sums = np.concatenate([[0], np.cumsum(lists.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))])
            own = sums[1:] - np.repeat(sums[ends[:-1]], sizes)
            yield pa.ListArray.from_arrays(pa.array(ends.astype(np.int32), mask=np.append(~lists.is_valid().to_numpy(zero_copy_only=False), False)), pa.array(own.astype(np.int32)))

    return run.asNondeterministic()(values.cast("array<int>"))


def nested(entries: Column, root: str = "root") -> Column:
    """How the entries of an array of structs (level, name, opaque, passing) hold each other, in one pass over the array.

    An entry stands in the nearest one before it of a lower level. What stands
    in an opaque entry is part of it and no entry of its own; a passing entry
    counts only there. A path is names joined by dots, with places in brackets
    for entries whose name is null; an empty name adds nothing, and where nothing
    was added a path is ``root``.
    """

    @F.arrow_udf(NESTED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            known = lists.is_valid().to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.where(known, lists.value_lengths().fill_null(0), 0))
            at = 0
            while at < len(lists):  # a pass for as many arrays as make up so many entries
                before = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + _ENTRIES, "right")))
                own = (ends[at:to] - before).astype(np.int32)
                offsets = pa.array(np.concatenate([[0], own]).astype(np.int32), mask=np.append(~known[at:to], False))
                yield pa.ListArray.from_arrays(offsets, _nest(own.tolist(), lists.slice(at, to - at).flatten(), root))
                pa.default_memory_pool().release_unused()  # else the worker keeps what a large array took
                at = to

    return run.asNondeterministic()(entries)  # else it would be moved into lambdas that use its result
