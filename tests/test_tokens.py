"""Counts, cuts and truncation by a tokenizer."""

import random

import pytest
from pyspark.sql import functions as F
from test_operators import frame

from folio.operators import split, tokens


@pytest.fixture(scope="module")
def real():
    pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    return tokens.file_tokenizer(path), lambda t: len(library.encode(t, add_special_tokens=False).ids)


def test_pieces_have_the_tokens_that_were_counted(spark, real):
    tokenizer, count = real
    draw = random.Random(1)
    texts = ["", "x", "  lead and trail  ", "日本語のテキスト" * 40, "a" * 500, "\n\n\n", "👨‍👩‍👧" * 20]
    texts += [" ".join(draw.choice(["word", "unbelievable", "x=1;", "été", "\n", "don't"]) for _ in range(200)) for _ in range(10)]
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string")
    made = df.select("doc_id", "text", tokens.count_tokens("text", tokenizer).alias("n"), tokens.split_by_tokens("text", 30, tokenizer).alias("p"), tokens.truncate("text", 30, tokenizer).alias("t"))
    for r in made.collect():
        if r.text is None:
            assert (r.n, r.p, r.t) == (None, None, None)
            continue
        assert "".join(x.content for x in r.p) == r.text and r.t == (r.p[0].content if r.p else "")
        assert r.n == count(r.text) and sum(x.tokens for x in r.p) == r.n
        if r.doc_id >= 7:
            assert all(count(x.content) == x.tokens <= 30 for x in r.p)


def test_a_character_of_many_tokens_stays_whole(spark):
    three = tokens.Tokenizer("three", lambda: lambda texts: [[(i, i + 1) for i in range(len(t)) for _ in range(3)] for t in texts])
    pieces = frame(spark, "abcd").select(tokens.split_by_tokens("text", 2, three).alias("p")).first().p
    assert [(x.content, x.tokens) for x in pieces] == [("a", 3), ("b", 3), ("c", 3), ("d", 3)]
    assert [x.content for x in frame(spark, "abcd").select(tokens.split_by_tokens("text", 7, three).alias("p")).first().p] == ["ab", "cd"]


def test_large_chunks_are_cut_by_tokens(spark, real):
    tokenizer, count = real
    text = "\n".join(f"line {i} of the text, with some words" for i in range(60))
    chunks = frame(spark, text).select("doc_id", F.col("text").alias("content"), F.lit("text").alias("type"), F.lit(11).alias("line_start"), F.lit(70).alias("line_end"))
    rows = split.post_process(chunks, 100, 20, tokenizer=tokenizer).orderBy("line_start", "type").collect()
    assert "".join(r.content for r in rows) == text and len(rows) == 6
    assert all(r.token_count == count(r.content) <= 100 for r in rows)
    assert (rows[0].type, rows[0].line_start, rows[-1].line_end) == ("text_part_1", 11, 70)
    assert all(a.line_end == b.line_start for a, b in zip(rows, rows[1:]))
    small = split.post_process(chunks, 1000, 20, tokenizer=tokenizer).first()
    assert (small.type, small.token_count) == ("text", count(text))
    with pytest.raises(ValueError):
        split.post_process(chunks, F.col("line_start"), 20, tokenizer=tokenizer)


def test_enriched_by_tokens(spark, real):
    tokenizer, count = real
    rows = spark.createDataFrame([(1, 0, "first line\nsecond line"), (1, 1, "third line")], "doc_id long, chunk_index int, content string")
    fits = count("third line") + count("// Previous context:\nfirst line\nsecond line\n// Current section:\n")
    for window, marked in ((fits, True), (fits - 1, False)):
        out = split.enrich(rows, window=window, tokenizer=tokenizer).where("chunk_index = 1").first().enriched_content
        assert out.startswith("// Previous context:") == marked and out.endswith("third line")


def test_the_core_needs_no_other_part():
    import folio.operators.tokens as module

    assert "folio.llm" not in open(module.__file__).read() and tokens.word_tokenizer().window == 4096
