"""Operator 5: preference formatting of paired conversations, in DataFrame functions only.

A pair is a chosen and a rejected conversation. Their longest common prefix of
turns is rendered once as the prompt; what each has beyond it becomes its
completion, cut into segments of which only assistant turns are to be learned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks around a turn.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
ASSISTANT = "assistant"


def _render(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE), turn["text"], F.lit(CLOSE))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _render), "")


def _after(turns: Column, n: Column) -> Column:
    return F.slice(turns, n + 1, F.greatest(F.size(turns) - n, F.lit(0)))


def _masked(turns: Column) -> Column:
    """Segments (text, learn): a turn's opening is context, an assistant's text and end mark are learned."""
    opening = lambda t: F.struct(F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE)).alias("text"), F.lit(False).alias("learn"))
    body = lambda t: F.struct(F.concat(t["text"], F.lit(CLOSE)).alias("text"), (t["role"] == ASSISTANT).alias("learn"))
    return F.flatten(F.transform(turns, lambda t: F.array(opening(t), body(t))))


def _mask_text(segments: Column) -> Column:
    """Spans of learned characters as 'start-end' (end exclusive), joined by commas."""
    start = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(state: Column, s: Column) -> Column:
        end = (state["at"] + F.length(s["text"])).cast("int")
        span = F.concat(state["at"].cast("string"), F.lit("-"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(s["learn"], F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(segments, start, add, lambda state: F.array_join(state["spans"], ","))


def preference_pairs(conversations: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Rows (pair_id, chosen_id, rejected_id, turns of each) for ``format_preferences``.

    ``pairs`` names them by (pair_id, chosen_id, rejected_id). Without it,
    conversation 2k is the chosen and 2k + 1 the rejected side of pair k, so
    that a pair costs one aggregation and no join, and a turn that thousands of
    conversations share brings none of them together.
    """
    turns = conversations.where("conv_id is not null").select(
        "conv_id", F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t")
    )
    sides = [F.sort_array(F.collect_list(F.when(F.col("side") == side, F.col("t")))) for side in ("chosen", "rejected")]
    if pairs is None:
        placed = turns.withColumn("pair_id", F.floor(F.col("conv_id") / 2).cast("long")).withColumn("side", F.when(F.pmod("conv_id", F.lit(2)) == 0, "chosen").otherwise("rejected"))
        ids = [F.max(F.when(F.col("side") == side, F.col("conv_id"))) for side in ("chosen", "rejected")]
        made = placed.groupBy("pair_id").agg(ids[0].alias("chosen_id"), ids[1].alias("rejected_id"), sides[0].alias("chosen"), sides[1].alias("rejected"))
        return made
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    a = whole.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen"))
    b = whole.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("rejected"))
    return pairs.select("pair_id", "chosen_id", "rejected_id").join(a, "chosen_id", "left").join(b, "rejected_id", "left").select("pair_id", "chosen_id", "rejected_id", *(F.coalesce(c, F.array().cast(whole.schema["turns"].dataType)).alias(c) for c in ("chosen", "rejected")))


def format_preferences(pairs: DataFrame) -> DataFrame:
    """pair_id, chosen_id, rejected_id, n_common, prompt, and of each side the completion and its learned spans.

    Turns are compared by role and text in the order of turn number (nulls
    first; null role or text counts as empty; equal numbers go by role, then
    text). A side without turns has an empty completion. Where one side is a
    prefix of the other, its completion is empty.
    """
    same = F.zip_with("chosen", "rejected", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    first = F.array_position(same, False)
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    found = pairs.withColumn("n_common", F.when(first > 0, F.least(first - 1, shorter)).otherwise(shorter).cast("int"))
    n = F.col("n_common")
    prompt = F.slice("chosen", F.lit(1), n)
    for side in ("chosen", "rejected"):
        found = found.withColumn(f"{side}_segments", _masked(_after(F.col(side), n)))
    return found.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        "n_common",
        _rendered(prompt).alias("prompt"),
        *(F.array_join(F.transform(f"{side}_segments", lambda s: s["text"]), "").alias(f"{side}_completion") for side in ("chosen", "rejected")),
        *(_mask_text(F.col(f"{side}_segments")).alias(f"{side}_learned") for side in ("chosen", "rejected")),
    )


_SIDE = """
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
"""

#: The same in DuckDB SQL.
ORACLE_SQL = f"""
WITH t AS ({_SIDE}),
s AS (SELECT floor(conv_id / 2.0)::BIGINT AS pair_id, ((conv_id % 2) + 2) % 2 = 0 AS is_chosen, * FROM t),
common AS (
  SELECT p.pair_id, count(m.k)::INT AS n_common FROM (SELECT DISTINCT pair_id FROM s) p LEFT JOIN (
    SELECT a.pair_id, a.k, min(CASE WHEN a.role = b.role AND a.text = b.text THEN 1 ELSE 0 END) OVER (PARTITION BY a.pair_id ORDER BY a.k) AS ok
    FROM s a JOIN s b ON a.pair_id = b.pair_id AND a.k = b.k AND a.is_chosen AND NOT b.is_chosen
  ) m ON p.pair_id = m.pair_id AND m.ok = 1 GROUP BY p.pair_id
),
parts AS (
  SELECT s.*, c.n_common, '<|' || role || '|>' || chr(10) AS opening, text || '<|end|>' || chr(10) AS body FROM s JOIN common c USING (pair_id)
),
spans AS (
  SELECT *, (sum(length(opening) + length(body)) OVER (PARTITION BY conv_id ORDER BY k) - length(body))::BIGINT AS lo FROM parts WHERE k > n_common
)
SELECT c.pair_id,
  max(CASE WHEN s.is_chosen THEN s.conv_id END) AS chosen_id,
  max(CASE WHEN NOT s.is_chosen THEN s.conv_id END) AS rejected_id,
  c.n_common,
  coalesce(string_agg(CASE WHEN s.is_chosen AND s.k <= c.n_common THEN s.opening || s.body END, '' ORDER BY s.k), '') AS prompt,
  coalesce(string_agg(CASE WHEN s.is_chosen AND s.k > c.n_common THEN s.opening || s.body END, '' ORDER BY s.k), '') AS chosen_completion,
  coalesce(string_agg(CASE WHEN NOT s.is_chosen AND s.k > c.n_common THEN s.opening || s.body END, '' ORDER BY s.k), '') AS rejected_completion,
  coalesce((SELECT string_agg(lo || '-' || (lo + length(body)), ',' ORDER BY k) FROM spans x WHERE x.pair_id = c.pair_id AND x.is_chosen AND x.role = 'assistant'), '') AS chosen_learned,
  coalesce((SELECT string_agg(lo || '-' || (lo + length(body)), ',' ORDER BY k) FROM spans x WHERE x.pair_id = c.pair_id AND NOT x.is_chosen AND x.role = 'assistant'), '') AS rejected_learned
FROM common c JOIN parts s ON s.pair_id = c.pair_id GROUP BY c.pair_id, c.n_common
"""
