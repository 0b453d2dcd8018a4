"""Word spans and word hashes over the UTF-8 bytes of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

#: Bytes 0x20 and 0x09-0x0D end a word.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

_random = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _random.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_other = np.random.Generator(np.random.PCG64(20240301))
#: Byte values of the hashes, one table for each independent hash.
_BYTES = (_BYTE, _other.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambling (multiply and shift)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _places(n: int) -> np.ndarray:
    global _PLACE
    while len(_PLACE) < n:
        more = mix(_PLACE * _STEP + np.uint64(len(_PLACE))) | np.uint64(1)
        _PLACE = np.concatenate([_PLACE, more])
    return _PLACE


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of the texts data[offsets[i]:offsets[i+1]]; no word crosses texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~WHITE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = word[:-1]
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = word[1:]
    starts = np.flatnonzero(word & (~before | first[:-1]))
    ends = np.flatnonzero(word & (~after | first[1:])) + 1
    return starts, ends


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each span; spans are disjoint and ascending. ``which`` (0 or 1) picks one of two."""
    return several_hashes(data, starts, ends, (which,))[0]


def several_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: tuple[int, ...] = (0, 1)) -> list[np.ndarray]:
    """Independent hashes of each span."""
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in which]
    lengths = ends - starts
    places = _places(int(lengths.max()))
    base = int(starts[0])
    part, first = data[base : ends[-1]], starts - base
    small = np.int32 if len(part) < 2**31 else np.int64
    gaps = np.diff(np.append(starts, ends[-1]))
    at = np.arange(len(part), dtype=small)
    at -= np.repeat(first.astype(small), gaps)
    inside = at < np.repeat(lengths.astype(small), gaps)
    at *= inside
    place = places[at]
    out = []
    for k in which:
        x = _BYTES[k][part]
        x *= place
        x ^= x >> np.uint64(29)
        x *= inside
        out.append(mix(np.add.reduceat(x, first) + lengths.astype(np.uint64) * _STEP))
    return out


def counts_by_text(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of spans in each text."""
    return np.diff(np.searchsorted(starts, offsets))


def simple_letters(data: np.ndarray) -> np.ndarray:
    """True at bytes of A-Z, a-z and the two-byte letters U+00C0-U+00FF."""
    low = data | np.uint8(0x20)
    ascii_ = (low >= ord("a")) & (low <= ord("z"))
    lead = data == 0xC3
    follow = np.zeros(len(data), bool)
    follow[1:] = lead[:-1] & (data[1:] != 0x97) & (data[1:] != 0xB7)
    lead[:-1] &= follow[1:]
    if len(data):
        lead[-1] = False
    return ascii_ | lead | follow


def cut_stops(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans with one final '.' or ',' that follows a letter made a span of its own."""
    last = data[ends - 1]
    cut = (ends - starts > 1) & ((last == ord(".")) | (last == ord(",")))
    cut &= letters[np.maximum(ends - 2, 0)]
    at = np.flatnonzero(cut)
    if not len(at):
        return starts, ends
    new_ends = ends.copy()
    new_ends[at] -= 1
    return np.insert(starts, at + 1, ends[at] - 1), np.insert(new_ends, at + 1, ends[at])
