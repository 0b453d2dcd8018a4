"""Operator 10: toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded first: case, accents, homoglyphs, and digits or signs that
stand for letters inside a word. The lexicon holds folded words and word
beginnings with weights learned from labelled rows; longer words in which a
beginning is harmless become exception phrases. A text's matched weight, as a
whole and by length, goes through a small logistic calibration.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import drop, fresh, held_out, per_text, resident, slices, written

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip("асеорхуіјѕһԁԛԝκαεοιρυνητωβгкмнт", "aceopxyijshdqwkaeoipuvntwbrkmht", strict=True)) | {"ı": "i", "ø": "o", "đ": "d", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe"}
#: Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}

_FOLD = str.maketrans(HOMOGLYPHS)
_SWAP = str.maketrans(SUBSTITUTES)
#: A substitute before a letter, with more of them at the word's end; or letters that end in signs. Numbers hold no letter.
_MIXED = re.compile(r"(?<![^\W_])(?:[a-z0-9@$!|€]*[0-9@$!|€][a-z0-9@$!|€]*[a-z][01345789@$€]*|[a-z]+[@$€]+)(?![^\W_])")
_JUNCTION = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower-case words of letters and digits, one space before and after each."""
    low = text.lower()
    if not low.isascii():
        low = "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c)).translate(_FOLD)
    low = _MIXED.sub(lambda m: m.group().translate(_SWAP), low)
    return " " + " ".join(_JUNCTION.findall(low)) + " "


def _terms(folded: str, least: int, most: int) -> set[str]:
    """Whole words (' word ') and word beginnings (' wor') of a folded text."""
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in range(least, min(most, len(w) - 1) + 1)}


class Lexicon:
    """Weighted terms, exception phrases, and the calibration (three numbers)."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...], calibration: tuple[float, float, float]):
        self.uid, self.weights, self.exceptions, self.calibration = uuid.uuid4().hex, weights, exceptions, calibration


class Matcher:
    """The automaton of a lexicon."""

    def __init__(self, lexicon: Lexicon):
        self.calibration = lexicon.calibration
        self.automaton = ahocorasick.Automaton()
        for term, weight in lexicon.weights.items():
            self.automaton.add_word(term, (len(term), weight))
        for phrase in lexicon.exceptions:
            self.automaton.add_word(phrase, (len(phrase), None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def features(self, text: str | None) -> tuple[float, float]:
        """Matched weight, and matched weight by the root of the length in words.

        Of matches that begin at one place, the longest counts; those inside an exception phrase don't.
        """
        if not text or not len(self.automaton):
            return 0.0, 0.0
        folded = fold(text)
        best: dict[int, tuple[int, float]] = {}
        covered: list[tuple[int, int]] = []
        for end, (size, weight) in self.automaton.iter(folded):
            start = end - size + 1
            if weight is None:
                covered.append((start, end))
            elif start not in best or best[start][0] < size:
                best[start] = (size, weight)
        if not best:
            return 0.0, 0.0
        covered.sort()
        begins = [a for a, _ in covered]
        reach = [-1, *accumulate((b for _, b in covered), max)]  # the furthest end among phrases that begin so early
        total = sum(w for s, (n, w) in best.items() if reach[bisect_right(begins, s)] < s + n - 1)
        return total, total / math.sqrt(folded.count(" "))

    def probability(self, text: str | None) -> float:
        total, dense = self.features(text)
        a, b, c = self.calibration
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, a + b * math.log1p(max(0.0, total)) + c * math.log1p(max(0.0, dense))))))


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression with an intercept, by Newton's method; slopes are not negative."""
    z = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, z.T @ (p - y) + ridge * w)
    return w


def sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic, draw) of up to ``rows`` labelled rows that are not held out, drawn by hash of their ids."""
    learn = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = learn.withColumn("draw", F.xxhash64("doc_id")).orderBy("draw").limit(rows)
    found = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # rows bounds its size
    return found.select("text", "toxic", "draw")


def _evidence(p: int, n: int, rate: float) -> float:
    """Twice the log-likelihood ratio of p bad rows among n against the overall rate."""
    part = lambda k, expected: k * math.log(k / expected) if k else 0.0
    return 2 * (part(p, n * rate) + part(n - p, n * (1 - rate)))


def _surroundings(bad: DataFrame, terms: list[str]) -> dict[str, int]:
    """In how many different surroundings (the word and its neighbours) each term stands in the bad rows.

    Copies of one bad text make all its words look bad; their surroundings are the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ahocorasick.Automaton()
        for k, t in enumerate(terms):
            own.add_word(t, (k, len(t)))
        own.make_automaton()
        for batch in batches:
            found = set()
            for text in batch.column(0).to_pylist():
                folded = fold(text)
                for end, (k, size) in own.iter(folded):
                    start = end - size + 1
                    stop = folded.find(" ", folded.find(" ", start + 1) + 1)
                    found.add((k, folded[folded.rfind(" ", 0, start) + 1 : stop if stop > 0 else None]))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([x for _, x in found], pa.string())], names=["k", "around"])

    if not terms:
        return {}
    counts = bad.select("text").mapInArrow(run, "k int, around string").distinct().groupBy("k").count().collect()
    return {terms[r["k"]]: r["count"] for r in counts}


def fit(docs: DataFrame, labels: DataFrame, rows: int = 16_000, shortest: int = 4, longest: int = 7, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Learns terms, weights, exceptions and calibration from ``rows`` labelled rows at most.

    The lexicon and its exception phrases have no bound of their own: they are
    words and word beginnings that stand in several of those rows.
    """
    drawn = written(sample(docs, labels, rows), "labelled")
    size = drawn.groupBy((F.col("toxic") == 1).alias("bad")).count().collect()
    bad, good = (sum(r["count"] for r in size if r["bad"] == x) for x in (True, False))
    if not bad or not good:
        return Lexicon({}, (), ((20.0 if bad else -20.0), 0.0, 0.0))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(0), 1 << 18):
                each = [_terms(fold(x), shortest, longest) for x in batch.column(0).slice(lo, hi - lo).to_pylist()]
                sizes = [len(x) for x in each]
                row = np.repeat(np.arange(lo, hi), sizes)
                yield pa.RecordBatch.from_arrays([pa.array([t for x in each for t in x], pa.string()), batch.column(1).take(pa.array(row)).cast(pa.int32())], names=["term", "toxic"])

    counts = drawn.select("text", "toxic").mapInArrow(split, "term string, toxic int").groupBy("term").agg(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("p"), F.count(F.lit(1)).alias("n"))
    counts = written(counts, "terms")
    rate, p, n = bad / (bad + good), F.col("p"), F.col("n")
    bar = 2 * math.log(max(2, counts.count())) + 6  # many terms are tried, and some look bad by chance
    weight = F.log((p + 0.5) / (bad + 1)) - F.log((n - p + 0.5) / (good + 1))
    strong = counts.withColumn("w", weight).where((F.col("w") > 2.5) & (p >= 0.6 * n) & (p >= 3))
    found = {r["term"]: (r["w"], r["p"], r["n"]) for r in strong.collect()}
    around = _surroundings(drawn.where("toxic = 1"), sorted(found))
    for t, (w, own, all_) in list(found.items()):
        here = min(own, around.get(t, 0))
        if _evidence(here, all_ - own + here, rate) < bar:
            del found[t]
        else:
            found[t] = (w, here, all_ - own + here)
    #: A beginning stays if it finds clearly more rows than each longer term; those it covers then go.
    most: dict[str, int] = {}
    for t, (_, own, _) in found.items():
        for k in range(shortest + 1, len(t)):
            most[t[:k]] = max(most.get(t[:k], 0), own)
    stems = {t: x for t, x in found.items() if x[1] >= 1.3 * most.get(t, 0)}
    kept = {t: x for t, x in stems.items() if not any(t[:k] in stems and stems[t[:k]][0] >= x[0] - 0.5 for k in range(shortest + 1, len(t)))}
    begun = docs.sparkSession.createDataFrame([(t,) for t in kept if not t.endswith(" ")], "stem string")
    longer = counts.where(F.col("term").endswith(" ") & (F.col("n") >= 3) & (F.col("p") <= 0.1 * F.col("n"))).select("term")
    starts = longer.withColumn("stem", F.explode(F.transform(F.sequence(F.lit(shortest), F.lit(longest)), lambda k: F.substring("term", F.lit(1), k + 1))))
    harmless = sorted({*exceptions, *(r["term"] for r in starts.join(F.broadcast(begun), "stem", "left_semi").select("term").distinct().collect())})
    lexicon = Lexicon({t: float(x[0]) for t, x in kept.items()}, tuple(harmless), (0.0, 1.0, 0.0))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Matcher(lexicon)
        for batch in batches:
            both = [own.features(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in both], pa.float64()), pa.array([x[1] for x in both], pa.float64()), batch.column(1).cast(pa.int32())], names=["total", "dense", "toxic"])

    seen = drawn.select("text", "toxic").mapInArrow(measure, "total double, dense double, toxic int").toPandas()
    drop(drawn, counts)
    w = _logistic(np.log1p(seen[["total", "dense"]].clip(lower=0).to_numpy()), (seen["toxic"] == 1).to_numpy(float))
    if min(w[1:]) < 0:  # one of the two carries nothing of its own
        w[:2], w[2] = _logistic(np.log1p(seen[["total"]].clip(lower=0).to_numpy()), (seen["toxic"] == 1).to_numpy(float)), 0.0
    lexicon.calibration = tuple(float(x) for x in w)
    return lexicon


_SCHEMA = T.StructType([T.StructField("score", T.DoubleType())])


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` from 0 to 1 of each whole text.

    Null and empty texts score as a text without matches. A column named score
    is replaced; other columns and repeated rows are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # the labelled sample bounds it

    def make():
        own = shared.value

        def work(array: pa.Array) -> pa.RecordBatch:
            one = resident(own.uid, lambda: Matcher(own)).probability
            return pa.RecordBatch.from_arrays([pa.array([one(x) for x in array.to_pylist()], pa.float64())], names=["score"])

        return work

    return per_text(docs, text, _SCHEMA, make)


def predict_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **fitting) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    found = score(docs.select("doc_id", "text"), fit(docs, labels, **fitting))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **fitting) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more."""
    columns = docs.columns
    aside, clash = fresh("__score", columns), [c for c in columns if c.lower() == "score"]
    own = docs.withColumn(aside, F.col(f"`{clash[0]}`")) if clash else docs
    found = score(own, fit(docs, labels, **fitting)).where(F.col("score") < threshold)
    return found.select(*(F.col(aside).alias(c) if c in clash else F.col(f"`{c}`") for c in columns))
