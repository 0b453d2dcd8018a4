"""Evaluation of retrieval and generation as joins and aggregates."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import WHITE_CHARACTERS, col, fields, trim_space

#: Bytes of truths that are sent to every task; with more, pairs meet by a shuffle.
TRUTH_BYTES = 64 << 20
#: Bytes of answers that a task compares at a time.
_SLICE = 1 << 18


def distinct_passages(rows: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """Trimmed passages without empty and repeated ones, each with the first place where it appears."""
    return rows.select(trim_space(text).alias("passage"), F.col(order).alias("first_seen")).where("passage <> ''").groupBy("passage").agg(F.min("first_seen").alias("first_seen"))


def select_cases(rows: DataFrame, order: str) -> DataFrame:
    """Selected rows with a query and an answer; of several for one query, the last."""
    some = rows.where("is_selected = 1 and trim(query_text) <> '' and trim(ground_truth_answer) <> ''")
    last = some.groupBy("query_id").agg(F.max_by(F.struct("query_text", "ground_truth_answer", "relevant_passage"), order).alias("c"))
    return last.select("query_id", "c.*")


def word_overlap(a: str | Column, b: str | Column) -> Column:
    """How many words of b over two bytes are in a, by the longer one's number of words; by a map built once a row."""
    both = F.array(F.struct(fields(a).alias("a"), fields(b).alias("b")))  # split once, not again for each word

    def share(x: Column) -> Column:
        known = F.array(F.map_from_arrays(F.array_distinct(x["a"]), F.transform(F.array_distinct(x["a"]), lambda w: F.lit(1))))
        common = F.transform(known, lambda m: F.size(F.filter(x["b"], lambda w: (F.octet_length(w) > 2) & F.map_contains_key(m, w))))[0]
        return F.when((F.size(x["a"]) == 0) | (F.size(x["b"]) == 0), 0.0).otherwise(common / F.greatest(F.size(x["a"]), F.size(x["b"])))

    return F.transform(both, share)[0]


def answers_match(generated: str | Column, truth: str | Column) -> Column:
    """One holds the other, or over half of the words agree; never for empty answers."""
    g, t = F.lower(trim_space(generated)), F.lower(trim_space(truth))
    return (col(generated) != "") & (col(truth) != "") & (F.contains(g, t) | F.contains(t, g) | (word_overlap(g, t) > 0.5))


def overlapping_pairs(truths: DataFrame, answers: DataFrame, truth_id: str, answer_id: str, text: str = "text") -> DataFrame:
    """Every pair of a truth and an answer that share a word of over two bytes: its ``overlap``, and whether they match.

    Up to ``TRUTH_BYTES`` of truths go to every task, as lists of truths by
    word; each answer meets them where it stands and nothing is shuffled. More
    truths and the answers meet through their words in a join. Whether one text
    holds the other is only looked up where all but two of one's words (those
    that a cut may have shortened) are in the other. Ids are unique.
    """
    size = truths.agg(F.sum(F.octet_length(text))).first()[0] or 0
    made = _met_locally if size <= TRUTH_BYTES else _met_by_join
    return made(truths, answers, truth_id, answer_id, text)


def _low(rows: DataFrame, key: str, text: str) -> DataFrame:
    return rows.select(F.col(key), F.lower(trim_space(text)).alias("t")).where("t <> ''")


def _met_locally(truths: DataFrame, answers: DataFrame, truth_id: str, answer_id: str, text: str) -> DataFrame:
    a, b = _low(truths, truth_id, text), _low(answers, answer_id, text)
    sent = truths.sparkSession.sparkContext.broadcast(a.toArrow())
    words = re.compile(f"[^{WHITE_CHARACTERS}]+").findall
    long = lambda w: len(w) > 2 or len(w.encode()) > 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = sent.value.column(0), sent.value.column(1).to_pylist()
        split = [words(t) for t in texts]
        sizes, known = np.array([len(x) for x in split]), [{w for w in x if long(w)} for x in split]
        longs, by_word = np.array([len(x) for x in known]), {}
        for k, own in enumerate(known):
            for w in own:
                by_word.setdefault(w, []).append(k)
        by_word = {w: np.array(x) for w, x in by_word.items()}

        def compared(t: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The truths that share a word with an answer, the overlaps, and whether they match."""
            found = words(t)
            counts = Counter(found)
            shared = [(by_word[w], n) for w, n in counts.items() if w in by_word]
            if not shared:
                return np.empty(0, np.int64), np.empty(0), np.empty(0, bool)
            met = np.concatenate([x for x, _ in shared])
            n = np.bincount(met, np.repeat([n for _, n in shared], [len(x) for x, _ in shared]), len(texts))
            common = np.bincount(met, minlength=len(texts))
            at = np.flatnonzero(common)
            overlap = n[at] / np.maximum(sizes[at], len(found))
            matches = overlap > 0.5
            may_hold = common[at] >= np.minimum(longs[at], sum(map(long, counts))) - 2
            for k in np.flatnonzero(may_hold & ~matches):
                matches[k] = t in texts[at[k]] or texts[at[k]] in t
            return at, overlap, matches

        for batch in batches:
            sums = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(sums):
                to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + _SLICE, "right")))
                made = [compared(x) for x in batch.column(1).slice(at, to - at).to_pylist()]
                place = np.repeat(np.arange(at, to), [len(x) for x, _, _ in made])
                truth, overlap, matches = (np.concatenate(x) for x in zip(*made))
                yield pa.RecordBatch.from_arrays([pa.chunked_array(ids.take(pa.array(truth))).combine_chunks(), batch.column(0).take(pa.array(place)), pa.array(overlap), pa.array(matches)], names=[truth_id, answer_id, "overlap", "matches"])
                at = to

    kinds = {f.name: f.dataType.simpleString() for f in (*a.schema.fields[:1], *b.schema.fields[:1])}
    return b.mapInArrow(run, f"`{truth_id}` {kinds[truth_id]}, `{answer_id}` {kinds[answer_id]}, overlap double, matches boolean")


def _met_by_join(truths: DataFrame, answers: DataFrame, truth_id: str, answer_id: str, text: str) -> DataFrame:
    """Words are counted within each answer first, so that a frequent word is one row a document."""
    sides = []
    for rows, key in ((truths, truth_id), (answers, answer_id)):
        low = _low(rows, key, text)
        words = low.select(key, F.explode(fields("t")).alias("w")).groupBy(key, "w").agg(F.count(F.lit(1)).alias("n"))
        sizes = words.groupBy(key).agg(F.sum("n").alias("total"), F.count_if(F.octet_length("w") > 2).alias("long"))
        sides.append((low, words.where(F.octet_length("w") > 2), sizes))
    (a, a_words, a_size), (b, b_words, b_size) = sides
    met = a_words.select(truth_id, "w").join(b_words, "w").groupBy(truth_id, answer_id).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("common"))
    met = met.join(a_size.withColumnsRenamed({"total": "a_total", "long": "a_long"}), truth_id).join(b_size.withColumnsRenamed({"total": "b_total", "long": "b_long"}), answer_id)
    met = met.withColumn("overlap", F.col("n") / F.greatest("a_total", "b_total"))
    may_hold = F.col("common") >= F.least("a_long", "b_long") - 2
    held = met.where(may_hold).select(truth_id, answer_id).join(a.withColumnRenamed("t", "a"), truth_id).join(b.withColumnRenamed("t", "b"), answer_id)
    held = held.where(F.contains("a", "b") | F.contains("b", "a")).select(truth_id, answer_id, F.lit(True).alias("held"))
    return met.join(held, [truth_id, answer_id], "left").select(truth_id, answer_id, "overlap", (F.coalesce("held", F.lit(False)) | (F.col("overlap") > 0.5)).alias("matches"))


def retrieval_hits(cases: DataFrame, found: DataFrame) -> DataFrame:
    """``cases`` with ``hit``: the passage ranked first is the labelled one."""
    first = found.where("rank = 1").select("query_id", trim_space("passage").alias("__p"))
    return cases.join(first, "query_id", "left").withColumn("hit", F.coalesce(F.col("__p") == trim_space("relevant_passage"), F.lit(False))).drop("__p")


def evaluated(cases: DataFrame, found: DataFrame, answers: DataFrame) -> DataFrame:
    """``cases`` with hit, passed, seconds and error: each against its own first passage and its own answer.

    ``found`` has query_id, rank and passage, ``answers`` query_id, answer, seconds
    and error. A case with an error, or without any answer, neither hits nor
    passes. Texts meet by query_id alone, so that the work grows with the cases.
    """
    own = answers.select("query_id", "answer", "seconds", F.col("error").alias("__e"))
    joined = retrieval_hits(cases, found).join(own, "query_id", "left")
    error = F.coalesce("__e", F.when(F.col("answer").isNull(), "no answer"))
    fine = error.isNull()
    passed = fine & F.coalesce(answers_match("answer", "ground_truth_answer"), F.lit(False))
    return joined.withColumn("error", error).withColumn("hit", F.col("hit") & fine).withColumn("passed", passed).drop("__e", "answer")


def summary(results: DataFrame) -> DataFrame:
    """One row: cases, retrieval, generation and overall accuracy in percent, mean seconds of cases without error, errors."""
    n = F.count(F.lit(1))
    share = lambda c: F.when(n > 0, F.count_if(c) * 100.0 / n).otherwise(0.0)
    hits, passes = F.count_if(F.col("hit")), F.count_if(F.col("passed"))
    return results.agg(
        n.alias("cases"),
        share(F.col("hit")).alias("retrieval_accuracy"),
        share(F.col("passed")).alias("generation_accuracy"),
        F.when(n > 0, (hits + passes) * 100.0 / (2 * n)).otherwise(0.0).alias("overall_accuracy"),
        F.avg(F.when(F.col("error").isNull(), F.col("seconds"))).alias("mean_seconds"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )


def drawn(rows: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """(draw, key): n draws with replacement, the same for the same rows. Draw k takes the row whose id hashes least with the seed and k."""
    least = lambda k: F.min_by(key, F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}:{k}"))))
    found = rows.where(F.col(key).isNotNull()).agg(F.array(*map(least, range(n))).alias("found"))
    return found.select(F.posexplode("found").alias("draw", key)).where(F.col(key).isNotNull())


def throughput(rows: DataFrame, started: str, ended: str) -> DataFrame:
    """One row: documents, the seconds from the first start to the last end, and documents a second (null without time)."""
    span = (F.max(F.unix_micros(ended)) - F.min(F.unix_micros(started))) / 1_000_000
    return rows.agg(F.count(F.lit(1)).alias("documents"), span.alias("seconds")).withColumn("per_second", F.when(F.col("seconds") > 0, F.col("documents") / F.col("seconds")))


def band(percent: str | Column) -> Column:
    p = col(percent)
    return F.when(p >= 90, "excellent").when(p >= 75, "good").when(p >= 60, "fair").otherwise("poor")
