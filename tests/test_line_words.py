"""Words of lines are split once, and only where their number matters."""

import re

from pyspark.sql import functions as F

from folio.functions.text import WHITE_CHARACTERS
from folio.operators import textchunks

TEXT = "A b C d\n  One Two　three  \nlower words only\n- item One\n\n   \n" + "Long Line " * 20 + "\n9 8 x\nOne two\nEight Words Are Just Few Enough To Count\nNine Words Are One Too Many For A Title"


def test_kinds_of_lines(spark):
    docs = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    rows = textchunks.line_table(docs).orderBy("line_no")
    assert [r.kind for r in rows.collect()] == ["text", "heading", "text", "heading", "blank", "blank", "text", "heading", "text", "heading", "text"]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan  # of each word a text, to count them


def test_word_counts(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, ""), (3, " \t\n"), (4, "one two")], "doc_id long, text string")
    made = textchunks.text_statistics(docs)
    assert {r.doc_id: r.word_count for r in made.collect()} == {1: len(TEXT.split()), 2: 0, 3: 0, 4: 2}
    plan = made.select(F.col("word_count"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan


def test_words_of_lines_with_all_kinds_of_white_space(spark):
    between = [" ", "  ", "   ", *(f"x{w}y" for w in WHITE_CHARACTERS if w != "\n"), " \t", "　 ", "​", "ᚁ", "‰", "\x84", "᠎"]
    texts = [f"one{b}two thrée" for b in between] + [f"a b{b}\n{b}c. D!?" for b in between] + ["a", " a", "", " ", "\n", "　"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in textchunks.text_statistics(docs).collect()}
    for i, t in enumerate(texts):
        assert rows[i].word_count == len([w for w in re.split(f"[{re.escape(WHITE_CHARACTERS)}]+", t) if w]), repr(t)
        assert rows[i].sentence_count == len(re.findall("[.!?]+", t)), repr(t)


def test_words_of_plain_lines_are_not_cut_out(spark):
    line = F.col("t")
    plan = spark.createDataFrame([("Long line",)], "t string").select(textchunks.word_count(line).alias("n"))
    assert plan.first().n == 2
    told = spark.createDataFrame([(1, "Long line " * 20 + "\nshort one. Two!")], "doc_id long, text string")
    made = textchunks.text_statistics(told).select("word_count", "sentence_count")
    assert tuple(made.first()) == (43, 2)
    assert "replace(" in made._jdf.queryExecution().optimizedPlan().toString()  # spaces are counted
