"""Operator 6: byte-level BPE encoding and decoding by a rank file.

Two tiers: a minimal perfect hash (hash and displace) resolves every pre-token
that is in the vocabulary as a whole; the others are merged with a heap of
candidate pairs over a linked list of their bytes, lowest rank first.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folio.llm import words
from folio.llm.common import per_text, resident, utf8
from folio.llm.memo import PieceTable

#: White space of more than one byte; texts that hold any are cut by the pattern itself.
WIDE_WHITE = re.compile(b"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")

_ONE_WORD = re.compile(b" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


class PerfectHash:
    """A minimal perfect hash of byte strings: n keys, n places, two small numbers a bucket."""

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        n = self.n = len(keys)
        self.buckets = max(1, n // per_bucket)
        for seed in range(100):
            self.seed = seed
            if self._build(keys):
                return
        raise ValueError("no perfect hash found; are the keys distinct?")

    def _three(self, key: bytes) -> tuple[int, int, int]:
        h = xxhash.xxh3_128_intdigest(key, self.seed)
        return h % self.buckets, (h >> 40) % self.n, (h >> 80) % max(1, self.n - 1) + 1

    def _build(self, keys: list[bytes]) -> bool:
        grouped: dict[int, list[tuple[int, int, int]]] = {}
        for i, key in enumerate(keys):
            b, f, g = self._three(key)
            grouped.setdefault(b, []).append((f, g, i))
        self.place = np.full(self.n, -1, np.int64)
        self.step, self.shift = np.zeros(self.buckets, np.int64), np.zeros(self.buckets, np.int64)
        free: list[int] | None = None
        for b, members in sorted(grouped.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:
                free = np.flatnonzero(self.place < 0).tolist() if free is None else free
                f, _, i = members[0]
                at = free.pop()
                self.shift[b], self.place[at] = (at - f) % self.n, i
                continue
            f, g, i = (np.array(x) for x in zip(*members, strict=True))
            if not any(self._settle(b, (f + step * g) % self.n, step, i) for step in range(64)):
                return False
        return True

    def _settle(self, b: int, base: np.ndarray, step: int, members: np.ndarray) -> bool:
        """Finds a shift by which all of a bucket's keys fall on free places."""
        if len(np.unique(base)) < len(base):
            return False
        width = 64
        lo = b * 7919 % self.n  # buckets start their search at different places
        for done in range(0, self.n, width):
            at = (base + lo + np.arange(done, done + width)[:, None]) % self.n
            hit = np.flatnonzero((self.place[at] < 0).all(axis=1))
            if len(hit):
                self.step[b], self.shift[b] = step, (lo + done + int(hit[0])) % self.n
                self.place[at[hit[0]]] = members
                return True
        return False

    def index(self, key: bytes) -> int:
        """The only key number that ``key`` can be."""
        b, f, g = self._three(key)
        return int(self.place[(f + int(self.step[b]) * g + int(self.shift[b])) % self.n])


@lru_cache(maxsize=4)
def load_ranks(path: str) -> tuple[bytes, ...]:
    """Tokens by rank from a rank file (base64 token and rank a line; ranks are 0 to n - 1)."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tuple(tokens)


class BytePairs:
    """Encodes pre-tokens by ranks; ``encode(text)`` gives a whole text's ids, ``decode(ids)`` its bytes."""

    def __init__(self, tokens: tuple[bytes, ...], pattern: str):
        self.tokens = tokens
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.hash = PerfectHash(list(tokens))
        self.pattern = regex.compile(pattern)
        sizes = np.fromiter((len(t) for t in tokens), np.int64, len(tokens))
        self.token_bytes, self.token_sizes = np.frombuffer(b"".join(tokens), np.uint8), sizes
        self.token_starts = np.cumsum(sizes) - sizes

    def pre_token(self, piece: bytes) -> list[int]:
        found = self.hash.index(piece)
        return [found] if self.tokens[found] == piece else self.merge(piece)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of a piece that is no token: the pair of lowest rank merges first, the leftmost of equals."""
        n, ranks = len(piece), self.ranks
        end = list(range(1, n + 1))  # of the part that starts here; 0 once it is merged into the one before
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue  # one of the two has changed since
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if i and (r := ranks.get(piece[before[i] : stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str) -> list[int]:
        return [i for m in self.pattern.finditer(text) for i in self.pre_token(m.group().encode())]

    def pieces(self, parts: list[bytes]) -> list[list[int]]:
        one = _ONE_WORD.fullmatch  # a single pre-token, whatever the pattern's other branches
        return [self.pre_token(p) if one(p) else self.encode(p.decode()) for p in parts]

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        from folio.llm.common import flat

        return self.token_bytes[flat(self.token_starts[ids], self.token_sizes[ids])]


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that the pattern never crosses: a word with the space before it, a stop after a letter, white space between.

    Of a run of white space before a word, the last character goes with the word if it is a
    space, else it is a span; what precedes it is one span. A run at a text's end is one span.
    """
    starts, ends = words.spans(data, offsets)
    stops = len(starts)
    lo, hi = words.cut_stops(data, starts, ends, words.simple_letters(data))
    lead = np.isin(lo, starts) if len(lo) != stops else np.ones(len(lo), bool)
    first = offsets[np.searchsorted(offsets, starts, "right") - 1]
    previous = np.maximum(np.concatenate([[0], ends[:-1]]), first) if stops else starts
    gap = starts - previous  # white space before each word
    space = (gap > 0) & (data[np.maximum(starts - 1, 0)] == 0x20)
    lo = lo.copy()
    lo[lead] -= space
    one = (gap > 0) & ~space
    rest = gap - (gap > 0)
    more = rest > 0
    tail_lo = np.maximum(offsets[:-1], 0)
    last = np.searchsorted(starts, offsets[1:]) - 1  # last word of each text
    has = (last >= 0) & (last >= np.searchsorted(starts, offsets[:-1]))
    if stops:
        tail_lo = np.where(has, ends[np.maximum(last, 0)], tail_lo)
    tail = offsets[1:] > tail_lo
    all_lo = np.concatenate([lo, starts[one] - 1, previous[more], tail_lo[tail]])
    all_hi = np.concatenate([hi, starts[one], previous[more] + rest[more], offsets[1:][tail]])
    order = np.argsort(all_lo, kind="stable")
    return all_lo[order], all_hi[order]


SCHEMA = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
IDS_SCHEMA = T.StructType([T.StructField("token_ids", T.ArrayType(T.IntegerType()))])


def coder(path: str, pattern: str) -> tuple[BytePairs, PieceTable]:
    """One coder a process: the rank file is on every machine, as the library that brings it."""

    def build() -> tuple[BytePairs, PieceTable]:
        pairs = BytePairs(load_ranks(path), pattern)
        return pairs, PieceTable(pairs.pieces, whole=True)

    return resident(f"bytes {path} {pattern}", build)


def encode_batch(array: pa.Array, path: str, pattern: str) -> tuple[BytePairs, np.ndarray, np.ndarray]:
    """The coder, the ids of all texts of an array in order, and where each text's ids start (one more than texts)."""
    pairs, table = coder(path, pattern)
    data, offsets = utf8(array)
    raw = data.tobytes()
    lo, hi = chunks(data, offsets)
    if WIDE_WHITE.search(raw):
        wide = np.array([WIDE_WHITE.search(raw, a, b) is not None for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
        keep = ~wide[np.searchsorted(offsets, lo, "right") - 1]
        ends = [a + np.cumsum([len(m.group().encode()) for m in pairs.pattern.finditer(raw[a:b].decode())]) for a, b in zip(offsets[:-1][wide].tolist(), offsets[1:][wide].tolist(), strict=True)]
        starts = [np.concatenate([[a], e[:-1]]) for a, e in zip(offsets[:-1][wide].tolist(), ends, strict=True)]
        lo, hi = np.concatenate([lo[keep], *starts]).astype(np.int64), np.concatenate([hi[keep], *ends]).astype(np.int64)
        order = np.argsort(lo, kind="stable")
        lo, hi = lo[order], hi[order]
    ids, sizes = table.look_up(data, lo, hi)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return pairs, ids, ends[np.searchsorted(lo, offsets)]


def bpe_digest(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with n_tokens, ids_sha256 and decoded_sha256 of each whole text.

    A null or empty text has no ids and the digests of the empty string. Texts
    are taken as they are: rows, repeated or not, and other columns are kept;
    columns named as the results are replaced. Very long texts and words are
    encoded whole.
    """

    def make():
        def work(array: pa.Array) -> pa.RecordBatch:
            pairs, ids, at = encode_batch(array, path, pattern)
            little = ids.astype("<u4")
            digests, decoded = [], []
            for a, b in zip(at[:-1], at[1:], strict=True):
                digests.append(hashlib.sha256(little[a:b]).hexdigest())
                decoded.append(hashlib.sha256(pairs.decode_bytes(ids[a:b])).hexdigest())
            return pa.RecordBatch.from_arrays([pa.array(np.diff(at)), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], names=SCHEMA.names)

        return work

    return per_text(df, text, SCHEMA, make)


def bpe_encode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with token_ids, the ids of each whole text (none for null or empty)."""

    def make():
        def work(array: pa.Array) -> pa.RecordBatch:
            _, ids, at = encode_batch(array, path, pattern)
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], names=IDS_SCHEMA.names)

        return work

    return per_text(df, text, IDS_SCHEMA, make)


def bpe_decode(df: DataFrame, path: str, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """``df`` with the text of each row's ids; bytes that are no UTF-8 become U+FFFD, a null id list gives null."""
    from pyspark.sql import functions as F

    @F.arrow_udf("string")
    def run(lists: pa.Array) -> pa.Array:
        tokens = load_ranks(path)
        return pa.array([None if x is None else b"".join(tokens[i] for i in x if i is not None).decode("utf-8", "replace") for x in lists.to_pylist()], pa.string())

    return df.withColumn(into, run(F.col(ids)))
