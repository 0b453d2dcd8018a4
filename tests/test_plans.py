"""Plans keep the shape that holds at scale."""

import pytest
from pyspark.sql import functions as F

from folio.operators import search, split, textchunks

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_prunes_before_the_shuffle(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    asked = v.where("vec_id < 10").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = plan(search.top_k(v, asked, 5).select("query_id", "vec_id", "rank"))
    assert "WindowGroupLimit" in found and "MapInArrow" in found and "NestedLoop" not in found
    assert "In(label, [1,2])" in plan(search.top_k(v, asked, 5, filters={"label": [1, 2]}))


def test_filters_reach_the_scan(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    found = plan(search.search(v, [1.0] * 64, 3, filters={"label": [1, 2]}))
    assert "In(label, [1,2])" in found and "TakeOrderedAndProject" in found


def test_chunking_has_no_shuffle_and_no_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("path", F.lit("a.txt"))
    for df in (textchunks.chunk_text(docs.select("doc_id", "text", "path")), split.split_documents(docs.select("doc_id", "text")), textchunks.text_statistics(docs.select("doc_id", "text"))):
        found = plan(df)
        assert "Exchange" not in found and "Python" not in found and "lang" not in found.split("ReadSchema")[-1]


def test_deletes_are_anti_joins(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label")
    assert "LeftAnti" in plan(search.delete_by_ids(v, v.where("label = 1")))


def test_core_stays_without_the_optional_part(monkeypatch):
    """A missing library of the optional subpackage leaves the core queries as they are."""
    import importlib

    import __spark_entry__
    from folio.plans import catalogue

    real = importlib.import_module

    def missing(name, *args):
        if name.startswith(("folio.llm", "corpus_pipeline")):
            raise ModuleNotFoundError("no module named xxhash", name="xxhash")
        return real(name, *args)

    monkeypatch.setattr(importlib, "import_module", missing)
    with pytest.warns(UserWarning, match="left out"):
        assert set(__spark_entry__.queries()) == set(catalogue.queries())
