"""A tokenizer sees bounded parts of a batch."""

from pyspark.sql import functions as F

from folio.operators import tokens


def test_a_batch_is_cut_before_it_becomes_spans(spark):
    def make():
        def spans(texts):
            assert len(texts) == 1 or sum(map(len, texts)) <= 1 << 18
            return [[(0, len(t) // 2), (len(t) // 2, len(t))] for t in texts]

        return spans

    rows = spark.range(0, 3000, 1, 1).select("id", F.when(F.col("id") % 9 != 0, F.concat(F.repeat(F.lit("ab"), F.when(F.col("id") == 5, 400_000).otherwise(500).cast("int")), "id")).alias("text"))
    found = rows.select("id", F.octet_length("text").alias("n"), tokens.spans("text", tokens.Tokenizer("halves", make)).alias("s")).collect()
    assert [r.id for r in found] == list(range(3000))
    assert all((r.s is None) == (r.id % 9 == 0) and (r.s is None or r.s[1].end == r.n) for r in found)
