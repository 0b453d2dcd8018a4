"""Token ids of many short byte pieces, each distinct piece encoded once for as long as it stays in a bounded table."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pandas as pd

from folio.llm import words
from folio.llm.common import flat


def heads(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The first eight bytes of each span and its length in one number; spans of up to seven bytes have each their own."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at_each_byte = np.ndarray(len(data) + 1, np.uint64, padded, strides=(1,))
    size = (hi - lo).astype(np.uint64)
    shift = np.uint64(64) - np.uint64(8) * np.minimum(np.maximum(size, np.uint64(1)), np.uint64(8))
    return ((at_each_byte[lo] << shift) >> shift) ^ (size << np.uint64(56))


class PieceTable:
    """Distinct pieces and their ids; emptied when it would pass ``limit`` pieces.

    Pieces are found by a 64-bit hash in a sorted array and confirmed by their
    length and first eight bytes, or, with ``whole``, by all their bytes; one
    that meets another's hash is encoded by itself. A piece takes a few dozen bytes.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], limit: int = 900_000, whole: bool = False):
        self.encode, self.limit, self.whole = encode, limit, whole
        self._clear()

    def _clear(self) -> None:
        self.keys, self.heads = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.text, self.text_used = np.zeros(1 << 16, np.uint8), 0
        self.text_starts, self.text_sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _add(self, keys: np.ndarray, own: np.ndarray, pieces: list[bytes]) -> None:
        found = self.encode(pieces)
        sizes = np.fromiter((len(x) for x in found), np.int32, len(found))
        new = np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))
        if self.used + len(new) > len(self.ids):
            grown = np.zeros(max(self.used + len(new), len(self.ids) * 3 // 2), np.int32)
            grown[: self.used] = self.ids[: self.used]
            self.ids = grown
        self.ids[self.used : self.used + len(new)] = new
        starts = self.used + np.cumsum(sizes, dtype=np.int64) - sizes
        self.used += len(new)
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        if self.whole:
            self._keep(pieces, order, at)
        self.keys, self.heads, self.starts, self.lengths = (np.insert(old, at, x[order]) for old, x in ((self.keys, keys), (self.heads, own), (self.starts, starts), (self.lengths, sizes)))

    def _keep(self, pieces: list[bytes], order: np.ndarray, at: np.ndarray) -> None:
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        if self.text_used + len(raw) > len(self.text):
            grown = np.zeros(max(self.text_used + len(raw), len(self.text) * 3 // 2), np.uint8)
            grown[: self.text_used] = self.text[: self.text_used]
            self.text = grown
        self.text[self.text_used : self.text_used + len(raw)] = raw
        sizes = np.fromiter((len(p) for p in pieces), np.int64, len(pieces))
        starts = self.text_used + np.cumsum(sizes) - sizes
        self.text_used += len(raw)
        self.text_starts, self.text_sizes = np.insert(self.text_starts, at, starts[order]), np.insert(self.text_sizes, at, sizes[order])

    def _differ(self, rows: np.ndarray, data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The spans whose bytes aren't those of the piece that their hash found."""
        size = hi - lo
        other = self.text_sizes[rows] != size
        long = np.flatnonzero(~other & (size > 7))  # the rest is told by its head
        if len(long):
            same = data[flat(lo[long], size[long])] == self.text[flat(self.text_starts[rows[long]], size[long])]
            other[long] = ~np.logical_and.reduceat(same, np.cumsum(size[long]) - size[long])
        return other

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        return at, self.keys[np.minimum(at, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)

    def look_up(self, data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces data[lo[i]:hi[i]] in order, and how many each has."""
        raw, own = data.tobytes(), heads(data, lo, hi)
        codes, distinct = pd.factorize(words.span_hashes(data, lo, hi))
        if len(self.keys) + len(distinct) > self.limit:
            self._clear()
        known = self._find(distinct)[1]
        if not known.all():
            first = np.zeros(len(distinct), np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            first = first[~known]
            self._add(distinct[~known], own[first], [raw[lo[i] : hi[i]] for i in first.tolist()])
        rows = self._find(distinct)[0][codes]
        lengths = self.lengths[rows].astype(np.int64)
        other = self.heads[rows] != own
        if self.whole:
            other |= self._differ(rows, data, lo, hi)
        other = np.flatnonzero(other)
        if not len(other):
            return self.ids[flat(self.starts[rows], lengths)], lengths
        alone = dict(zip(other.tolist(), self.encode([raw[lo[i] : hi[i]] for i in other.tolist()]), strict=True))
        parts = [alone.get(i, self.ids[s : s + n]) for i, (s, n) in enumerate(zip(self.starts[rows], lengths, strict=True))]
        return np.concatenate(parts).astype(np.int32), np.array([len(x) for x in parts], np.int64)
