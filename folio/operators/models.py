"""Embedders and language models as column functions: preparation in expressions, calls in Arrow batches with retries."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import col, is_blank

QUERY_PREFIX, DOCUMENT_PREFIX = "query: ", "passage: "
#: Roles as chat services name them.
ROLES = {"system": "system", "ai": "assistant", "assistant": "assistant"}


def query_input(text: str | Column, prefix: str = QUERY_PREFIX, strip_lines: bool = True) -> Column:
    """What a query is embedded as; null for blank text."""
    t = F.replace(col(text), F.lit("\n"), F.lit(" ")) if strip_lines else col(text)
    return F.when(~is_blank(text), F.concat(F.lit(prefix), t))


def document_input(text: str | Column, prefix: str = DOCUMENT_PREFIX, strip_lines: bool = True) -> Column:
    t = F.replace(col(text), F.lit("\n"), F.lit(" ")) if strip_lines else col(text)
    return F.concat(F.lit(prefix), t)


def retried(call: Callable[[list], list], retries: int = 3, delay: float = 2.0, cap: float = 30.0, jitter: float = 1.0, transient: tuple[type[BaseException], ...] = (TimeoutError, ConnectionError)) -> Callable[[list], list]:
    """``call`` tried again on transient errors, after a delay that doubles up to a cap."""

    def run(batch: list) -> list:
        wait = delay
        for attempt in range(retries + 1):
            try:
                out = call(batch)
                if len(out) != len(batch):
                    raise ValueError(f"{len(out)} results for {len(batch)} inputs")
                return out
            except transient:
                if attempt == retries:
                    raise
                time.sleep(min(cap, wait) + random.random() * max(0.0, jitter))
                wait *= 2
        raise AssertionError

    return run


def _placed(part: pd.Series, found: list) -> pd.Series:
    """Results at the places of the inputs that were not null."""
    rest = iter(found)
    return pd.Series([next(rest) if ok else None for ok in part.notna()], index=part.index, dtype=object)


def embedder(connect: Callable[[], Callable[[list[str]], list[Sequence[float]]]], batch: int = 32, **retrying) -> Callable[[Column], Column]:
    """A column function that embeds texts; ``connect`` runs once in each task and gives the batch call. Null gives null."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = retried(connect(), **retrying)
        for part in texts:
            some = part[part.notna()]
            found: list = []
            for lo in range(0, len(some), batch):
                found += call(some.iloc[lo : lo + batch].tolist())
            yield _placed(part, [[float(x) for x in v] for v in found])

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<float>")


def spaced(call: Callable[[list], list], interval: float) -> Callable[[list], list]:
    """``call``, begun ``interval`` seconds after the one before at the earliest."""
    begun = -interval

    def run(batch: list) -> list:
        nonlocal begun
        time.sleep(max(0.0, begun + interval - time.monotonic()))
        begun = time.monotonic()
        return call(batch)

    return run


def paced(rows: DataFrame, text: str, into: str, connect: Callable[[], Callable[[list[str]], list[Sequence[float]]]], slots: int = 8, interval: float = 0.0, batch: int = 32, **retrying) -> DataFrame:
    """``rows`` with ``into``, the embedding of ``text``, by at most ``slots`` calls at once over the whole cluster.

    Rows are dealt to as many partitions as there are slots, and each calls for
    itself, one call after the other, ``interval`` seconds apart. A result stays
    with its row. Speculative copies of tasks would add calls.
    """
    if slots < 1:
        raise ValueError("one slot at least")
    made = embedder(lambda: spaced(connect(), interval), batch, **retrying)
    return rows.repartition(slots).withColumn(into, made(F.col(text)))


def try_embedder(connect: Callable[[], Callable[[list[str]], list[Sequence[float]]]], batch: int = 32, **retrying) -> Callable[[Column], Column]:
    """Like ``embedder``, but a struct (vector, error): a batch that fails for good costs its own rows only."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        call = retried(connect(), **retrying)
        for part in texts:
            vectors, errors = ([None] * len(part) for _ in range(2))
            places = [k for k, ok in enumerate(part.notna()) if ok]
            for lo in range(0, len(places), batch):
                own = places[lo : lo + batch]
                try:
                    for k, v in zip(own, call(part.iloc[own].tolist()), strict=True):
                        vectors[k] = [float(x) for x in v]
                except Exception as e:  # noqa: BLE001 - whatever the service raises is this batch's status
                    for k in own:
                        errors[k] = f"{type(e).__name__}: {e}"
            yield pd.DataFrame({"vector": pd.Series(vectors, dtype=object), "error": pd.Series(errors, dtype=object)})

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "vector array<float>, error string")


def embedding_status(rows: DataFrame, result: str = "embedded") -> DataFrame:
    """One row for rows with a column of ``try_embedder``: given, embedded, failed, skipped (no input), status and a first error.

    The status is ok, partial (some failed), failed (all did), or empty.
    """
    error, vector = F.col(f"{result}.error"), F.col(f"{result}.vector")
    counts = rows.agg(F.count(F.lit(1)).alias("given"), F.count(vector).alias("embedded"), F.count(error).alias("failed"), F.min(error).alias("first_error"))
    status = F.when(F.col("given") == 0, "empty").when(F.col("failed") == 0, "ok").when(F.col("embedded") > 0, "partial").otherwise("failed")
    return counts.select("given", "embedded", "failed", (F.col("given") - F.col("embedded") - F.col("failed")).alias("skipped"), status.alias("status"), "first_error")


def http_embedder(url: str, timeout: float = 60.0) -> Callable[[], Callable[[list[str]], list]]:
    """A connector to a service that takes {"texts", "task"} at /embed and answers {"embeddings"}."""

    def connect():
        import json
        import urllib.request

        def call(texts: list[str]) -> list:
            request = urllib.request.Request(f"{url.rstrip('/')}/embed", json.dumps({"texts": texts, "task": "retrieval.passage"}).encode(), {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return json.load(answer)["embeddings"]

        return call

    return connect


def hashing_embedding(text: str | Column, dim: int = 64) -> Column:
    """A deterministic unit vector of hashed words, without a model: for tests and as a baseline."""
    words = F.filter(F.split(F.lower(col(text)), r"\s+"), lambda w: w != "")
    places = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.size(F.filter(places, lambda p: p == k)).cast("double"))
    length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(counts, lambda x: F.when(length > 0, x / length).otherwise(0.0).cast("float"))


def generator(connect: Callable[[], Callable[[list[str]], list[str]]], batch: int = 1, **retrying) -> Callable[[Column], Column]:
    """A column function from prompts to answers; ``connect`` runs once in each task."""

    def run(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = retried(connect(), **retrying)
        for part in prompts:
            some = part[part.notna()]
            found: list = []
            for lo in range(0, len(some), batch):
                found += call(some.iloc[lo : lo + batch].tolist())
            yield _placed(part, found)

    run.__annotations__ = {"prompts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")


def chat_service(url: str, model: str, temperature: float | None = None, timeout: float = 600.0) -> Callable[[], Callable[[list[str]], list[str]]]:
    """A connector to a chat service that streams JSON lines at /api/chat; the parts of each answer are joined."""

    def connect():
        import json
        import urllib.request

        def call(prompts: list[str]) -> list[str]:
            out = []
            for prompt in prompts:
                body = {"model": model, "messages": [{"role": "user", "content": prompt}], "stream": True} | ({"options": {"temperature": temperature}} if temperature is not None else {})
                request = urllib.request.Request(f"{url.rstrip('/')}/api/chat", json.dumps(body).encode(), {"Content-Type": "application/json"})
                with urllib.request.urlopen(request, timeout=timeout) as answer:
                    parts = [json.loads(line) for line in answer if line.strip()]
                if errors := [p["error"] for p in parts if "error" in p]:
                    raise RuntimeError(errors[0])
                out.append("".join(p.get("message", {}).get("content", "") for p in parts))
            return out

        return call

    return connect


def fake_answers(calls: DataFrame, responses: Sequence[str], number: str = "call_no", into: str = "answer") -> DataFrame:
    """Canned answers in turn: call number n (from 0) gets response n modulo their count."""
    if not responses:
        raise ValueError("at least one response is needed")
    table = F.array(*(F.lit(r) for r in responses))
    return calls.withColumn(into, F.element_at(table, (F.pmod(F.col(number), F.lit(len(responses))) + 1).cast("int")))


def service_role(role: str | Column) -> Column:
    """system, assistant, or user for everything else."""
    r = F.lower(col(role))
    return F.when(r == "system", "system").when(r.isin("ai", "assistant"), "assistant").otherwise("user")


def message_text(parts: str | Column, separator: str = " ") -> Column:
    """The parts of a message joined, blank ones left out."""
    return F.array_join(F.filter(col(parts), lambda p: ~is_blank(p)), separator)


def system_first(messages: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """(key, ok): whether system messages stand at the start only."""
    return messages.groupBy(key).agg((F.coalesce(F.max(F.when(F.col(role) == "system", F.col(turn))), F.min(turn)) == F.min(turn)).alias("ok"))
