"""Prompts and question-answering chains over tables of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import col, is_blank, template

RULE = "\n\n---\n\n"
#: Own wording; pass another template to change it. The question goes in before the context.
ANSWER_PROMPT = """Answer the question from the context below. If the context does not hold the answer, say that you do not know.

Context:
{{.context}}

Question: {{.query}}

Answer:"""
CHECK_PROMPT = """Decide whether the context below helps to answer the question. Reply with "yes" or "no" alone.

Context:
{{.context}}

Question: {{.query}}

Reply:"""


def contexts(found: DataFrame, query_id: str = "query_id", content: str = "page_content", rank: str = "rank") -> DataFrame:
    """(query_id, context): each query's retrieved contents in rank order, joined by a rule."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(rank).alias("rank"), F.col(content).alias("content"))))
    return found.groupBy(query_id).agg(F.array_join(F.transform(ordered, lambda x: x["content"]), RULE).alias("context"))


def with_prompts(questions: DataFrame, found: DataFrame, query_id: str = "query_id", query: str = "query", prompt: str = ANSWER_PROMPT, **names) -> DataFrame:
    """``questions`` with ``context`` and ``prompt``; the bare question where nothing was retrieved."""
    joined = questions.join(contexts(found, query_id, **names), query_id, "left")
    return joined.withColumn("prompt", F.when(F.col("context").isNull(), F.col(query)).otherwise(template(prompt, ("query", query), ("context", "context"))))


def says_yes(answer: str | Column, whole_word: bool = False) -> Column:
    low = F.lower(col(answer))
    return low.rlike(r"\byes\b") if whole_word else F.contains(low, F.lit("yes"))


def retrieval_qa(questions: DataFrame, found: DataFrame, generate: Callable[[Column], Column], query: str = "query", **names) -> DataFrame:
    """``questions`` with ``answer`` generated from the retrieved context, or from the question alone."""
    return with_prompts(questions, found, query=query, **names).withColumn("answer", generate(F.col("prompt")))


def validated_qa(questions: DataFrame, found: DataFrame, validate: Callable[[Column], Column], generate: Callable[[Column], Column], query: str = "query", query_id: str = "query_id", whole_word: bool = False, **names) -> DataFrame:
    """As ``retrieval_qa``, but the context is used only if the validator's reply says yes.

    The two kinds of question are split first, so that the validator sees only
    those that have a context. Blank questions are an error.
    """
    asked = questions.withColumn(query, F.when(is_blank(query), F.raise_error(F.lit("query cannot be empty"))).otherwise(F.col(query)))
    joined = with_prompts(asked, found, query_id, query, **names)
    bare = joined.where(F.col("context").isNull()).withColumn("used_context", F.lit(False))
    with_context = joined.where(F.col("context").isNotNull()).withColumn("__reply", validate(template(CHECK_PROMPT, ("query", query), ("context", "context"))))
    with_context = with_context.withColumn("used_context", says_yes("__reply", whole_word)).withColumn("prompt", F.when(F.col("used_context"), F.col("prompt")).otherwise(F.col(query))).drop("__reply")
    return bare.unionByName(with_context).withColumn("answer", generate(F.col("prompt")))
