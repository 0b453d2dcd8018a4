"""Operator 12: SentencePiece (merge type) encoding and decoding by a model file.

A sequence of pieces is what merging makes of a text if and only if each two
neighbours, joined and merged again, come apart at the same place: the first
merge over any border would show in the pair as well. So a text is encoded
without merging it: Aho-Corasick gives the longest piece at each place, a piece
is taken if it stands beside the one before, else its longest own prefix is
tried; where none is left, the last piece is taken back and its end marked in a
bitfield, as the pieces up to a place are always the same.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import flat, per_text, resident, utf8
from folio.llm.memo import PieceTable

SPACE = "▁"
#: Fixed values of the model file: kinds of pieces that merge, and the others.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: What an unknown piece is decoded to.
UNKNOWN_TEXT = " ⁇ "


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a serialised message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, message[at : at + size]
        at += size


@lru_cache(maxsize=4)
def load_model(path: str) -> tuple[tuple[str, float, int], ...]:
    """(text, score, kind) of each piece by id.

    Models of another type than merging, or with a normaliser, user-defined or
    unused pieces, or without byte pieces, are refused: their rules differ.
    """
    with open(path, "rb") as file:
        message = file.read()
    found, trainer, normal = [], {}, {}
    for field, value in _fields(message):
        if field == 1:
            piece = dict(_fields(value))
            found.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
        elif field == 2:
            trainer = dict(_fields(value))
        elif field == 3:
            normal = dict(_fields(value))
    if trainer.get(3) != 2 or normal.get(2) or normal.get(4, 1) or not normal.get(3, 1) or not normal.get(5, 1):
        raise ValueError(f"{path}: only merge-type models with the identity normaliser, a first space and kept white space")
    kinds = {k for _, _, k in found}
    if kinds & {USER_DEFINED, UNUSED} or sum(k == BYTE for _, _, k in found) != 256:
        raise ValueError(f"{path}: only models with all byte pieces and without user-defined and unused ones")
    return tuple(found)


class Backtracker:
    """Encodes by a model; texts have a plain space in place of the model's mark."""

    def __init__(self, model: tuple[tuple[str, float, int], ...], keep_pairs: int = 1 << 20):
        self.texts = [t.replace(SPACE, " ") for t, _, _ in model]
        self.scores = {t.replace(SPACE, " "): s for t, s, k in model if k == NORMAL}
        self.ids = {self.texts[i]: i for i, (_, _, k) in enumerate(model) if k == NORMAL}
        self.bytes = {int(t[3:5], 16): i for i, (t, _, k) in enumerate(model) if k == BYTE}
        self.matcher = ahocorasick.Automaton()
        for t in self.ids:
            self.matcher.add_word(t, t)
        self.matcher.make_automaton()
        self.shorter = {t: next((t[:n] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ids), None) for t in self.ids}
        self.known: dict[tuple[str, str], bool] = {}
        self.keep_pairs = keep_pairs
        raw = [t.encode() for t in self.ids]
        self.beside = np.zeros((256, 256), bool)  # byte pairs that occur inside pieces; merging crosses no others
        for t in raw:
            b = np.frombuffer(t, np.uint8)
            self.beside[b[:-1], b[1:]] = True
        values = [bytes([int(t[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else UNKNOWN_TEXT.encode() if k == UNKNOWN else self.texts[i].encode() for i, (t, _, k) in enumerate(model)]
        self.values, self.value_starts, self.value_sizes = _table(values)
        self.digits, self.digit_starts, self.digit_sizes = _table([f"{i},".encode() for i in range(len(model))])
        self.is_byte = np.array([k == BYTE for _, _, k in model])

    def merged(self, text: str) -> list[str]:
        """The parts that merging leaves: the best score first, the leftmost of equals."""
        parts, scores = list(text), self.scores
        while True:
            best, at = -float("inf"), -1
            for i in range(len(parts) - 1):
                if (s := scores.get(parts[i] + parts[i + 1])) is not None and s > best:
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: str, right: str) -> bool:
        """Whether two neighbours stay apart when they are merged again."""
        found = self.known.get((left, right))
        if found is None:
            if len(self.known) >= self.keep_pairs:
                self.known.clear()
            found = self.known[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return found

    def parts(self, text: str) -> list[str]:
        """What merging would leave of ``text``, found by backtracking."""
        n, longest = len(text), {}
        if text in self.ids and self.fits("", text):
            return [text]
        for end, piece in self.matcher.iter(text):
            at = end - len(piece) + 1
            if len(piece) > len(longest.get(at, "")):
                longest[at] = piece
        failed = bytearray((n + 8) // 8)
        taken, at = [], 0
        following: str | None = longest.get(0) or text[:1]
        while at < n:
            last = taken[-1] if taken else ""
            while following is not None:
                end = at + len(following)
                if not failed[end >> 3] >> (end & 7) & 1 and self.fits(last, following):
                    break
                following = self._next(following)
            if following is not None:
                taken.append(following)
                at = end
                following = longest.get(at) or text[at : at + 1]
                continue
            if not taken:
                raise ValueError("no pieces fit; the model's pieces don't come from merging")
            failed[at >> 3] |= 1 << (at & 7)  # nothing goes on from here
            following = taken.pop()
            at -= len(following)
            following = self._next(following)
        return taken

    def _next(self, piece: str) -> str | None:
        """The next shorter candidate at a piece's place; a character that is no piece comes last."""
        shorter = self.shorter.get(piece)
        return shorter if shorter is not None else piece[0] if len(piece) > 1 else None

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of texts (marks as spaces, the first space included); characters that are no pieces go by bytes."""
        out = []
        for raw in pieces:
            ids: list[int] = []
            for part in self.parts(raw.decode()):
                found = self.ids.get(part)
                ids.extend([found] if found is not None else [self.bytes[b] for b in part.encode()])
            out.append(ids)
        return out

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans that no piece crosses: cut between bytes that stand beside each other in no piece, not inside a character."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cut = np.ones(len(data), bool)
        cut[1:] = ~self.beside[data[:-1], data[1:]] & ((data[1:] & 0xC0) != 0x80)
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        lo = np.flatnonzero(cut)
        return lo, np.append(lo[1:], len(data))

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 text of ids; the first space goes, runs of byte pieces that are no characters give U+FFFD each."""
        ids = ids[(ids >= 0) & (ids < len(self.value_sizes))]
        out = []
        edges = np.flatnonzero(np.diff(self.is_byte[ids].astype(np.int8))) + 1
        for part in np.split(ids, edges):
            raw = self.values[flat(self.value_starts[part], self.value_sizes[part])].tobytes()
            if len(part) and self.is_byte[part[0]]:
                raw = _characters(raw)
            elif not out and raw[:1] == b" " and self.texts[part[self.value_sizes[part] > 0][0]][:1] == " ":
                raw = raw[1:]
            if raw or len(part):
                out.append(raw)
        return b"".join(out)

    def decimal(self, ids: np.ndarray) -> bytes:
        return self.digits[flat(self.digit_starts[ids], self.digit_sizes[ids])][:-1].tobytes()


def _table(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.fromiter((len(v) for v in values), np.int64, len(values))
    return np.frombuffer(b"".join(values), np.uint8), np.cumsum(sizes) - sizes, sizes


def _characters(raw: bytes) -> bytes:
    """``raw`` with U+FFFD for each byte that belongs to no character."""
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode().encode())
                at += len(out[-1])
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�".encode())
            at += 1
    return b"".join(out)


SCHEMA = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
IDS_SCHEMA = T.StructType([T.StructField("token_ids", T.ArrayType(T.IntegerType()))])


def coder(path: str) -> tuple[Backtracker, PieceTable]:
    """One coder a process: the model file is on every machine, as the library that brings it."""

    def build() -> tuple[Backtracker, PieceTable]:
        found = Backtracker(load_model(path))
        return found, PieceTable(found.encode, whole=True)

    return resident(f"pieces {path}", build)


def encode_batch(array: pa.Array, path: str) -> tuple[Backtracker, np.ndarray, np.ndarray]:
    """The coder, the ids of all texts of an array in order, and where each text's ids start (one more than texts)."""
    found, table = coder(path)
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    text = pc.replace_substring(pc.fill_null(array.cast(pa.large_string()), ""), SPACE, " ")
    text = pc.if_else(pc.equal(pc.binary_length(text), 0), "", pc.binary_join_element_wise(pa.scalar("", pa.large_string()), text, pa.scalar(" ", pa.large_string())))
    data, offsets = utf8(text)
    lo, hi = found.spans(data, offsets)
    ids, sizes = table.look_up(data, lo, hi)
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return found, ids, ends[np.searchsorted(lo, offsets)]


def piece_digest(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` with n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256 of each whole text.

    A null or empty text has no ids and the digests of the empty string. Rows,
    repeated or not, and other columns are kept; columns named as the results
    are replaced. Very long texts and words are encoded whole. The model's mark
    for a space, where a text holds it, is decoded to a space.
    """

    def make():
        def work(array: pa.Array) -> pa.RecordBatch:
            found, ids, at = encode_batch(array, path)
            digests, decoded = [], []
            for a, b in zip(at[:-1], at[1:], strict=True):
                digests.append(hashlib.sha256(found.decimal(ids[a:b])).hexdigest())
                decoded.append(hashlib.sha256(found.decode(ids[a:b])).hexdigest())
            return pa.RecordBatch.from_arrays([pa.array(np.diff(at)), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], names=SCHEMA.names)

        return work

    return per_text(df, text, SCHEMA, make)


def piece_encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` with token_ids, the ids of each whole text (none for null or empty)."""

    def make():
        def work(array: pa.Array) -> pa.RecordBatch:
            _, ids, at = encode_batch(array, path)
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))], names=IDS_SCHEMA.names)

        return work

    return per_text(df, text, IDS_SCHEMA, make)


def piece_decode(df: DataFrame, path: str, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """``df`` with the text of each row's ids; ids that are null or no piece's are left out, a null list gives null."""

    @F.arrow_udf("string")
    def run(lists: pa.Array) -> pa.Array:
        found = coder(path)[0]
        return pa.array([None if x is None else found.decode(np.array([i for i in x if i is not None], np.int64)).decode() for x in lists.to_pylist()], pa.string())

    return df.withColumn(into, run(F.col(f"`{ids}`")))
