"""Tokens by an exchangeable tokenizer: spans, counts, cuts and truncation.

A tokenizer is a function that is made once in each task and gives the spans of
many texts' tokens at a time. Without one, a token is four bytes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.text import col, token_estimate

Spans = list[tuple[int, int]]
#: Bytes of text that a task turns into spans at a time.
_SLICE = 1 << 18


@dataclass(frozen=True)
class Tokenizer:
    """A tokenizer by name, and the sizes, in tokens, that suit its model.

    ``make`` runs in a task and returns a function from texts to the (start,
    end) of each text's tokens, in characters and in order.
    """

    name: str
    make: Callable[[], Callable[[list[str]], list[Spans]]]
    chunk_size: int = 512
    overlap: int = 64
    window: int = 4096


def word_tokenizer() -> Tokenizer:
    """Words between ASCII white space."""

    def make():
        word = re.compile(r"[^ \t\n\v\f\r]+")
        return lambda texts: [[m.span() for m in word.finditer(t)] for t in texts]

    return Tokenizer("words", make)


def file_tokenizer(path: str, name: str | None = None, **sizes: int) -> Tokenizer:
    """A tokenizer of a JSON file that every machine has; it needs the ``tokenizers`` library there. Special tokens are plain text."""

    def make():
        from tokenizers import Tokenizer as Library

        made = Library.from_file(path)
        made.encode_special_tokens = True
        return lambda texts: [e.offsets for e in made.encode_batch(texts, add_special_tokens=False)]

    return Tokenizer(name or path.rsplit("/", 1)[-1], make, **sizes)


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """A batch in parts of up to ``_SLICE`` bytes; a longer text is a part of its own. Spans take many times their text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (int(ends[at - 1]) if at else 0) + _SLICE, "right")))
        yield texts.slice(at, to - at)
        at = to


def _mapped(text: str | Column, tokenizer: Tokenizer, returns: str, kind: pa.DataType, work: Callable[[str, Spans], object]) -> Column:
    @F.arrow_udf(returns)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        spans_of = tokenizer.make()
        for batch in batches:
            for texts in _slices(batch):
                known = [t for t in texts.to_pylist() if t is not None]
                found = iter(zip(known, spans_of(known), strict=True))
                yield pa.array([work(*next(found)) if valid else None for valid in texts.is_valid().to_pylist()], kind)

    return run.asNondeterministic()(col(text))


def spans(text: str | Column, tokenizer: Tokenizer) -> Column:
    """The (start, end) of each token in characters; null for null."""
    fields = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    return _mapped(text, tokenizer, "array<struct<start:int,end:int>>", pa.list_(fields), lambda _, s: [{"start": a, "end": b} for a, b in s])


def count_tokens(text: str | Column, tokenizer: Tokenizer | None = None) -> Column:
    """How many tokens a text has: the tokenizer's, or a quarter of the bytes; also the latter where it finds none."""
    if tokenizer is None:
        return token_estimate(text)
    found = _mapped(text, tokenizer, "int", pa.int32(), lambda _, s: len(s))
    return F.coalesce(F.nullif(found, F.lit(0)), token_estimate(text))


def _cuts(text: str, found: Spans, most: int) -> list[dict]:
    """Pieces that cover a text, each of ``most`` tokens at most."""
    starts = [a for a, _ in found]
    n, first, out = len(starts), 0, []

    def open_(k: int) -> bool:
        return text[starts[k]].isspace() or text[starts[k] - 1].isspace()

    while first < n:
        last = min(first + most, n)
        if last < n:
            k = last
            while k > first and not (starts[k] > starts[k - 1] and open_(k)):
                k -= 1
            if k == first:  # no white space: between two characters at least
                k = last
                while k > first and starts[k] == starts[k - 1]:
                    k -= 1
                while k <= first or (k < n and starts[k] == starts[k - 1]):
                    k += 1
            last = k
        begin, end = (starts[first] if out else 0), (starts[last] if last < n else len(text))
        out.append({"content": text[begin:end], "tokens": last - first})
        first = last
    return out or ([{"content": text, "tokens": 0}] if text else [])


def split_by_tokens(text: str | Column, most: int, tokenizer: Tokenizer) -> Column:
    """Pieces (content, tokens) of up to ``most`` tokens that together are the text.

    Cuts stand before a token at white space, so that a piece's own tokens are
    those counted here; without any among ``most`` tokens, between characters. A
    character of more tokens than ``most`` stays whole. Empty texts have no piece.
    """
    if most < 1:
        raise ValueError("a piece has one token or more")
    kind = pa.list_(pa.struct([("content", pa.string()), ("tokens", pa.int32())]))
    return _mapped(text, tokenizer, "array<struct<content:string,tokens:int>>", kind, lambda t, s: _cuts(t, s, most))


def truncate(text: str | Column, most: int, tokenizer: Tokenizer | None = None) -> Column:
    """A text's first piece of up to ``most`` tokens; by the estimate, its first whole lines."""
    from folio.operators.split import truncate_to_tokens

    if tokenizer is None:
        return truncate_to_tokens(text, most)
    return F.coalesce(F.get(split_by_tokens(text, most, tokenizer), F.lit(0))["content"], F.when(col(text).isNotNull(), ""))
