"""Odd columns, white space of several bytes, labels of long texts, many large labels."""

import base64
import random

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F

from folio.llm import bpe, components, langid, vectors


def test_stages_keep_odd_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60)
    for c in ("Score", "Lang_Pred", "TEXT_", "a.b", "BITS_per_byte", "Key", "n_Tokens"):
        docs = docs.withColumn(c, F.col("doc_id") * 2)
    columns = docs.columns
    docs = corpus_pipeline.written(docs, "odd")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sf), name)
        assert docs.columns == columns
        assert docs.where(" or ".join(f"`{c}` <> doc_id * 2" for c in columns[5:])).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() > 0


def test_white_space_of_several_bytes():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    draw = random.Random(2)
    texts = ["".join(draw.choice(["word", "été", " ", " ", "　", "  ", "\n", ".", "7", "'s"]) for _ in range(draw.randint(0, 40))) for _ in range(400)]
    texts += ["plain text only", "", " ", "  ", "  x", "x　", None]
    _, ids, at = bpe.encode_batch(pa.array(texts, pa.string()), path, public_tokenizers.PATTERN)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode_ordinary(t or ""), repr(t)


def test_a_label_of_long_texts_is_learned(spark):
    rows = [(i, "the words of this one " * 20, "en") for i in range(40)] + [(100 + i, "žluťoučký kůň úpěl ďábelské ódy " * (300 + i), "cs") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, max_row_bytes=1000)
    assert sorted(model.languages) == ["cs", "en"]
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    assert all(got[i] == lang for i, _, lang in rows)


def test_every_large_group_is_sampled(spark):
    rows = spark.range(200 * 60).select((F.col("id") % 200).alias("label"), F.col("id").alias("node"), F.array(*(F.rand(k) for k in range(8))).alias("embedding"))
    found = vectors.bounded_sample(rows.withColumn("draw", F.xxhash64("node")), ["label"], "draw", 50, 4 << 20)
    assert len(found) == 200 and all(n == 60 and len(x) for n, x in found.values())


def test_components_of_a_long_path(spark):
    n = 3000
    order = np.random.default_rng(1).permutation(n).tolist()
    edges = spark.createDataFrame(list(zip(order, order[1:])), "u long, v long")
    assert components.connected_components(edges).where("component = 0").count() == n


def test_deep_pages_take_linear_time():
    import time

    from folio.llm import html

    start = time.perf_counter()
    assert html.main_text("<div>" * 100_000 + "text of it" + "</div>" * 100_000) == "text of it"
    assert len(html.main_text("<font><p>one line of text</p>" * 20_000)) == 20_000 * 17 - 1
    assert html.main_text("<p><div>" + "<font>" * 8000 + "<h1>x</h1>" * 8000).count("x") == 8000
    assert time.perf_counter() - start < 20


def test_content_of_an_article_is_kept():
    from folio.llm import html

    page = "<body><nav><a>m</a></nav><article><p>Energy <math><mi>E</mi>=m</math> is a long enough sentence.</p><object>a fallback</object><script>x</script><form>f</form></article></body>"
    assert html.main_text(page) == "Energy E=m is a long enough sentence. a fallback"
