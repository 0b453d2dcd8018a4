"""The pass over levels holds little more than its result."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from folio.functions import nesting

ENTRY = pa.struct([("level", pa.int32()), ("name", pa.string()), ("opaque", pa.bool_()), ("passing", pa.bool_())])


def _peak(entries):
    given = pa.array(entries, ENTRY)
    tracemalloc.start()
    try:
        made = nesting._nest([len(given)], given, "root")
        return tracemalloc.get_traced_memory()[1] / len(given), made
    finally:
        tracemalloc.stop()


def test_code_lines_take_few_bytes_each():
    levels = (0, 1, 1, 2, 1)  # a class for each five lines, in a root
    lines = [{"level": -1, "name": "", "opaque": False, "passing": False}] + [{"level": v, "name": f"C{i}" if v == 0 else "", "opaque": False, "passing": False} for i in range(20_000) for v in levels]
    size, made = _peak(lines)
    assert size < 150
    told = made.slice(1, 5).to_pylist()
    assert [(x["parent"], x["last"], x["n_children"], x["path"]) for x in told] == [(0, 5, 3, "C0"), (1, 2, 0, "C0"), (1, 4, 1, "C0"), (3, 4, 0, "C0"), (1, 5, 0, "C0")]


def test_arrays_of_all_lengths_in_a_batch(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    try:
        rows = spark.range(0, 300, 1, 1).withColumn("n", F.when(F.col("id") == 7, 70_000).when(F.col("id") % 5 > 0, F.col("id")))
        one = lambda i: F.struct(F.when(i == 0, -1).otherwise(i % 3).cast("int").alias("level"), F.lit(None).cast("string").alias("name"), F.lit(False).alias("opaque"), F.lit(False).alias("passing"))
        told = rows.withColumn("all", F.when(F.col("n").isNotNull(), F.transform(F.slice(F.sequence(F.lit(0), F.col("n")), 1, F.col("n").cast("int")), one)))
        got = {r.id: (r.s, r.p) for r in told.select("id", nesting.nested("all").alias("x")).select("id", F.when(F.col("x").isNotNull(), F.size("x")).alias("s"), F.element_at(F.col("x"), -1)["path"].alias("p")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert all(got[i][0] == (70_000 if i == 7 else i if i % 5 else None) for i in got)
    assert got[1] == (1, "root") and got[4] == (4, "root[1]") and got[11][1] == "root[3][0]"


def test_yaml_items_take_few_bytes_each():
    items = [{"level": -1, "name": "", "opaque": False, "passing": False}] + [{"level": v, "name": n, "opaque": False, "passing": False} for _ in range(20_000) for v, n in ((1, None), (2, "id"), (2, "tags"), (2, "note"))]
    size, made = _peak(items)
    assert size < 250
    assert made.slice(6, 1).to_pylist()[0]["path"] == "root[1].id"


def test_one_long_array_takes_a_part_of_it_at_a_time():
    levels = pa.array([-1] + [1, 2, 2, 2, 4] * 80_000, pa.int32())
    names = pa.array(["", *([None, "id", "tags", "note", ""] * 80_000)], pa.string())
    opaque = pa.array([False] + [False, False, False, True, False] * 80_000, pa.bool_())
    given = pa.StructArray.from_arrays([levels, names, opaque, pa.array([False] * len(levels), pa.bool_())], fields=list(ENTRY))
    tracemalloc.start()
    try:
        made = nesting._nest([len(given)], given, "root")
        size = tracemalloc.get_traced_memory()[1] / len(given)
    finally:
        tracemalloc.stop()
    assert size < 100  # 28 bytes of integers, the path, and a part's Python objects
    told = made.slice(len(given) - 5, 5).to_pylist()
    assert [(x["parent"], x["place"], x["path"]) for x in told] == [(0, 79_999, "root[79999]"), *((400_000 - 4, k, f"root[79999].{n}") for k, n in enumerate(("id", "tags", "note"))), (-2, -1, None)]
    assert made[0].as_py()["n_children"] == 80_000 and made[0].as_py()["last"] == 400_000


def test_parts_of_an_array_join_without_a_seam(monkeypatch):
    monkeypatch.setattr(nesting, "_ENTRIES", 3)
    entries = pa.array([{"level": v, "name": n, "opaque": n == "o", "passing": n == "c"} for v, n in ((0, "é"), (1, None), (2, "o"), (3, "x"), (3, "c"), (2, "a"), (0, ""), (5, None), (0, "b"))], ENTRY)
    made = nesting._nest([7, 9], entries, "root").to_pylist()
    assert [x["path"] for x in made] == ["root", "root[0]", "root[0].o", None, None, "root[0].a", "root", "root", "root"]
    assert [x["parent"] for x in made] == [-1, 0, 1, -2, -2, 1, -1, -1, -1]
