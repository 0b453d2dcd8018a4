"""Operator 1: language ID by prediction by partial matching.

Each language has a variable-order byte context tree with escape probabilities
(method C, no exclusion), fitted on a bounded sample and then frozen. A text's
code length under every tree is summed byte by byte, and the shortest wins.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import fresh, held_out, per_text, resident, slices, utf8

ORDER = 4
UNKNOWN = "und"


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The last ORDER bytes and the byte itself at every byte, packed; a text is preceded by zeros."""
    where = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    packed = data.astype(np.int64)
    for k in range(1, ORDER + 1):
        packed[k:] |= np.where(where[k:] >= k, data[:-k], 0).astype(np.int64) << (8 * k)
    return packed


def gram_counts(sample: DataFrame) -> DataFrame:
    """(lang, gram, n) over all texts of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in sorted(set(langs)):
                own = batch.column(1).take(pa.array(np.flatnonzero(langs == lang)))
                for lo, hi in slices(own):
                    found, n = np.unique(grams(*utf8(own.slice(lo, hi - lo))), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    return sample.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Frozen counts: languages, and packed grams of ORDER + 1 bytes with the language and the count of each."""

    def __init__(self, languages: list[str], grams: np.ndarray, language: np.ndarray, counts: np.ndarray):
        self.uid, self.languages, self.grams, self.language, self.counts = uuid.uuid4().hex, languages, grams, language, counts

    def table(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct grams of the languages lo..hi, and their counts in each."""
        own = (self.language >= lo) & (self.language < hi)
        keys, at = np.unique(self.grams[own], return_inverse=True)
        counts = np.zeros((len(keys), hi - lo), np.int64)
        np.add.at(counts, (at, self.language[own] - lo), self.counts[own])
        return keys, counts


def training_rows(docs: DataFrame, lang: str = "lang", text: str = "text", id_col: str = "doc_id") -> DataFrame:
    return docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(id_col)).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(id_col, text).alias("draw"))


def fit(docs: DataFrame, rows_per_language: int = 300, sample_bytes: int = 8 << 20, max_row_bytes: int = 200_000) -> Model:
    """Learns every label from labelled rows that are not held out.

    The fit is bounded: about ``rows_per_language`` rows of a label (drawn by
    hash, of up to ``max_row_bytes`` bytes each), and fewer where all labels
    together would take more than about ``sample_bytes``; the first row by hash
    of each label is always in, or its shortest one if all are longer. Counts
    are kept for the grams that a language has.
    """
    rows = training_rows(docs).withColumn("size", F.octet_length("text")).where("size > 0")
    least = rows.groupBy("lang").agg(F.min("size").alias("shortest"), F.min_by("draw", F.struct("size", "draw")).alias("its_draw")).where(F.col("shortest") > max_row_bytes)
    rows = rows.join(F.broadcast(least.select("lang", "its_draw", "shortest")), "lang", "left")  # a row for each label
    rows = rows.where(F.when(F.col("shortest").isNull(), F.col("size") <= max_row_bytes).otherwise((F.col("draw") == F.col("its_draw")) & (F.col("size") == F.col("shortest"))))
    labels = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("size"), F.min(F.pmod("draw", F.lit(1 << 30))).alias("first")).toPandas().sort_values("lang")
    if not len(labels):
        return Model([], np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64))
    wanted = np.minimum(labels["n"], np.minimum(rows_per_language, sample_bytes / len(labels) / labels["size"]))
    labels["least"] = np.maximum(labels["first"] + 1, (wanted / labels["n"] * (1 << 30)).astype(np.int64))
    bars = docs.sparkSession.createDataFrame(labels[["lang", "least"]])
    drawn = rows.join(F.broadcast(bars), "lang").where(F.pmod("draw", F.lit(1 << 30)) < F.col("least"))  # a row for each label
    table = gram_counts(drawn).toPandas()
    number = {x: k for k, x in enumerate(labels["lang"])}
    return Model(list(number), table["gram"].to_numpy(np.int64), table["lang"].map(number).to_numpy(np.int32), table["n"].to_numpy(np.int64))


def _grouped(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the number of each row's key, and the sums of their counts."""
    found, at = np.unique(keys, return_inverse=True)
    sums = np.zeros((len(found), counts.shape[1]), counts.dtype)
    np.add.at(sums, at, counts)
    return found, at, sums


class Trees:
    """Context trees of some languages over one alphabet of byte classes (0: bytes never seen).

    ``value[k]`` holds the log2 probability of the last byte of each gram of k
    bytes, ``escape[k]`` that of leaving the context of k bytes; row 0 stands
    for grams that no language has. ``step[k]`` leads from a gram of k - 1 bytes
    and the next byte's class to the gram of k bytes.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        n_lang = counts.shape[1]
        keys = np.append(keys, 0)  # the zeros before a text are a context, though never a byte of one
        counted = np.concatenate([counts, np.zeros((1, n_lang), np.int64)])
        raw = [(keys >> (8 * (ORDER - k))) & 0xFF for k in range(ORDER + 1)]  # oldest byte first
        self.byte_class = np.zeros(256, np.int64)
        seen = np.unique(np.concatenate(raw))
        self.byte_class[seen] = np.arange(1, len(seen) + 1)
        a = self.classes = len(seen) + 1
        symbols = [self.byte_class[x] for x in raw]
        uniform = np.full(n_lang, -8.0)
        lower_keys, lower_value = np.zeros(0, np.int64), np.zeros((0, n_lang))
        self.step, self.value, self.escape = [None], [None], [None]
        total = counted.sum(axis=0)
        kinds = (_grouped(symbols[-1], counted)[2] > 0).sum(axis=0)
        with np.errstate(divide="ignore", invalid="ignore"):
            root_escape = np.where(total > 0, np.log2(kinds / (total + kinds)), 0.0)
        previous_keys = np.zeros(1, np.int64)  # grams of k - 1 bytes as numbers in base a
        suffix = lambda x, k: x % a ** (k - 1)
        for k in range(1, ORDER + 2):
            packed = np.zeros(len(keys), np.int64)
            for s in symbols[ORDER + 1 - k :]:
                packed = packed * a + s
            found, _, sums = _grouped(packed, counted)
            context = found // a
            contexts, at, n = _grouped(context, sums)
            kinds = _grouped(context, (sums > 0).astype(np.int64))[2]
            with np.errstate(divide="ignore", invalid="ignore"):
                direct = np.log2(sums / (n + kinds)[at])
                leave = np.where(n > 0, np.log2(kinds / (n + kinds)), 0.0)
            back = uniform[None, :] if k == 1 else lower_value[1 + np.searchsorted(lower_keys, suffix(found, k))]
            value = np.where(sums > 0, direct, leave[at] + back)
            first = (root_escape + uniform)[None, :] if k == 1 else np.zeros((1, n_lang))
            if k > 1:  # what it costs to leave a context of k - 1 bytes, by that gram's number
                out = np.zeros((len(previous_keys) + 1, n_lang))
                out[1 + np.searchsorted(previous_keys, contexts)] = leave
                self.escape.append(out)
                step = np.zeros((len(previous_keys) + 1, a), np.int32)
                step[1 + np.searchsorted(previous_keys, context), found % a] = np.arange(1, len(found) + 1)
            else:
                step = np.zeros((1, a), np.int32)
                step[0, found % a] = np.arange(1, len(found) + 1)
            self.step.append(step)
            self.value.append(np.concatenate([first, value]))
            lower_keys, lower_value, previous_keys = found, self.value[-1], found

    def code_lengths(self, array: pa.Array) -> np.ndarray:
        """Bits of every whole text under each language."""
        data, offsets = utf8(array)
        n_lang = self.value[1].shape[1]
        if not len(data):
            return np.zeros((len(array), n_lang))
        pad = self.byte_class[0]
        texts = len(offsets) - 1
        classes = np.full(len(data) + ORDER * texts, pad, np.int64)  # zeros before each text, as in training
        sizes = np.diff(offsets)
        where = np.arange(len(data)) + ORDER * (1 + np.repeat(np.arange(texts), sizes))
        classes[where] = self.byte_class[data]
        gram = [None, self.step[1][0][classes]]  # the gram of k bytes that ends here
        for k in range(2, ORDER + 2):
            before = np.zeros(len(classes), np.int32)
            before[1:] = gram[k - 1][:-1]
            gram.append(self.step[k][before, classes])
        at = where
        top = gram[ORDER + 1][at]
        bits = self.value[ORDER + 1][top]
        missing = np.flatnonzero(top == 0)
        place = at[missing]
        cost = np.zeros((len(missing), n_lang))
        for k in range(ORDER, 0, -1):  # fall back one byte of context at a time
            cost += self.escape[k][gram[k][place - 1]]
            own = gram[k][place]
            done = (own > 0) | (k == 1)
            bits[missing[done]] = cost[done] + self.value[k][own[done]]
            missing, place, cost = missing[~done], place[~done], cost[~done]
        out = np.zeros((texts, n_lang))
        full = np.flatnonzero(sizes)
        out[full] = -np.add.reduceat(bits, offsets[:-1][full], axis=0)
        return out


_SCHEMA = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])


def _trees(model: Model, together: int = 8) -> list[Trees]:
    """The model's trees for a few languages each: a gram takes no room for languages of other groups."""
    count = len(model.languages)
    return resident(model.uid, lambda: [Trees(*model.table(k, min(k + together, count))) for k in range(0, count, together)])


def code_lengths(array: pa.Array, model: Model) -> np.ndarray:
    """Bits of every whole text under each language of the model."""
    return np.concatenate([t.code_lengths(array) for t in _trees(model)], axis=1)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and bits_per_byte of each whole text.

    The score is the winner's share of the likelihood; ties go to the first
    language by name. A text that is null or has no letter is ``und`` with score
    0, as is every text under a model without languages. Columns named as the
    results are replaced, other ones and repeated rows are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the fit's sample

    def make():
        frozen = shared.value

        def work(array: pa.Array) -> pa.RecordBatch:
            letter = np.array([x is not None and any(map(str.isalpha, x)) for x in array.to_pylist()], bool)
            if not frozen.languages:
                return pa.RecordBatch.from_arrays([pa.array([UNKNOWN] * len(array)), pa.array(np.zeros(len(array))), pa.nulls(len(array), pa.float64())], names=_SCHEMA.names)
            bits = code_lengths(array, frozen)
            best = bits.argmin(axis=1)
            least = bits[np.arange(len(best)), best]
            share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
            size = np.diff(utf8(array)[1])
            names = [frozen.languages[k] if ok else UNKNOWN for k, ok in zip(best, letter, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.where(letter, share, 0.0)), pa.array(least / np.maximum(size, 1), mask=size == 0)], names=_SCHEMA.names)

        return work

    return per_text(docs, text, _SCHEMA, make)


def predict_languages(docs: DataFrame, **fitting) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte of every row of ``docs``."""
    model = fit(docs, **fitting)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")


def keep_identified(docs: DataFrame, slack_bits: float = 64.0, **fitting) -> DataFrame:
    """``docs`` without rows that are in no language.

    Those are the ``und`` ones, and texts that take more bits under every
    language's tree than they have themselves, by over ``slack_bits``.
    """
    columns = docs.columns
    aside = {c: fresh(f"__kept{i}", columns) for i, c in enumerate(columns) if c.lower() in _SCHEMA.names}
    own = docs.withColumns({new: F.col(f"`{c}`") for c, new in aside.items()})
    found = identify(own, fit(docs, **fitting))
    excess = (F.coalesce("bits_per_byte", F.lit(0.0)) - 8) * F.octet_length(F.col("text"))
    found = found.where((F.col("lang_pred") != UNKNOWN) & (excess <= slack_bits))
    return found.select(*(F.col(aside[c]).alias(c) if c in aside else F.col(f"`{c}`") for c in columns))
