"""A JSON text is one whole value, as in the SQL twins."""

import duckdb

from folio.operators import jsonchunks, split
from folio.sources import registry

TEXTS = [
    *('{"a": 1} and more', "12 monkeys", '"a" b', "[1] ]", "{}{}", "1,2", "[1]\f", '"\\ud800"', '"\\ude00"', "[,]", "[1,,2]", '{"a" 1}', "[1, 2", "01", "", " ", "{,}", '{"a":}'),
    *("42", " [1] \n", "[1,]", '{"a":1,}', "NaN", "[-inf, Infinity]", '{"a":1,"a":2}', '"\\ud83d\\ude00"', "9" * 5000, "[" * 3000 + "]" * 3000, '{"' + "k" * 60000 + '":1}'),
]


def test_one_whole_value(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(-1, None)], "doc_id long, text string")
    got = {r.doc_id: r.v for r in docs.select("doc_id", jsonchunks.is_valid("text").alias("v")).collect()}
    assert got.pop(-1) is None
    assert got == {i: duckdb.execute("SELECT json_valid(?::VARCHAR)", [t]).fetchall()[0][0] for i, t in enumerate(TEXTS)}
    meta = {r.doc_id: r.is_valid for r in jsonchunks.json_metadata(docs).collect()}
    assert meta == got | {-1: False}
    assert jsonchunks.properties(docs.where("doc_id = 0")).count() == 0 and jsonchunks.paths(docs.where("doc_id in (0, 1)")).count() == 0


FILES = {"1 text that only begins like JSON, with words that are significant and long enough to be kept": "json_invalid", "[" + ", ".join(['"words that are long enough"'] * 4) + ",]": "json_document"}


def test_chunks_say_whether_a_file_is_json(spark):
    files = spark.createDataFrame([("a.json", t) for t in FILES][:1], "path string, text string")
    assert [r.type for r in registry.default_registry().chunk_files(files).collect()] == ["json_invalid"]
    files = spark.createDataFrame([("b.json", t) for t in FILES][1:], "path string, text string")
    assert [r.type for r in registry.default_registry().chunk_files(files).collect()] == ["json_document"]


def test_enriched_chunks_say_whether_a_file_is_json(spark):
    files = spark.createDataFrame([(f"{k}.json", t) for k, t in zip("ab", FILES)], "path string, text string")
    assert {r.path[0]: r.type for r in split.split_files(files, registry.default_registry()).collect()} == dict(zip("ab", FILES.values()))
