"""Pairs by words: no pair crosses a shuffle while the truths are few."""

from pyspark.sql import functions as F

from folio.operators import evaluate

TRUTHS = [(1, "The quick brown fox"), (2, "a b c"), (3, "  "), (4, None), (5, "über Straße über fox"), (6, "ick bro"), (7, "the the fox")]
ANSWERS = [(10, "THE QUICK BROWN FOX"), (11, "the fox the fox jumps over the lazy dog again and again"), (12, ""), (13, None), (14, "say the quick brown foxes"), (15, "ÜBER straße"), (16, "no common sign"), (17, "fox")]


def test_both_ways_give_the_same_pairs(spark):
    a, b = spark.createDataFrame(TRUTHS, "i long, text string"), spark.createDataFrame(ANSWERS, "k int, text string")
    rows = lambda df: sorted(tuple(r) for r in df.select("i", "k", F.round("overlap", 9), "matches").collect())
    made = evaluate.overlapping_pairs(a, b, "i", "k")
    want = rows(evaluate._met_by_join(a, b, "i", "k", "text"))
    assert rows(made) == want and len(want) > 10 and {r[3] for r in want} == {True, False}
    assert made.schema["i"].dataType.simpleString() == "bigint" and made.schema["k"].dataType.simpleString() == "int"
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert rows(evaluate.overlapping_pairs(a.limit(0), b, "i", "k")) == rows(evaluate.overlapping_pairs(a, b.limit(0), "i", "k")) == []
