"""File lists and CSV records over many byte ranges."""

import csv
import io
import random

from pyspark.sql import functions as F

from folio.sources import csvfiles, files


def test_files_in_skipped_directories_are_never_opened(spark, tmp_path):
    root = tmp_path / "a build é" / "tree"  # the root's own name doesn't count
    for name in ("src/a.go", "src/deep/b c.go", "node_modules/x/big.go", ".git/objects/big", "src/vendor/big.go", "img/big.png", "gen/big.go"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x" * (1000 if "big" in name else 10))
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 100)  # opening a larger file fails
    try:
        for at in (str(root), f"file://{root}", str(root) + "/"):
            assert sorted(r.path for r in files.scan(spark, at, more_dirs=["gen"]).collect()) == ["src/a.go", "src/deep/b c.go"]
        assert files.scan(spark, str(root), include=["go"], more_dirs=["gen"], total_budget=15).count() == 1
        assert sorted(r.path for r in files.names(spark, str(root)).collect()) == ["gen/big.go", "src/a.go", "src/deep/b c.go"]
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    plan = files.names(spark, str(root))._jdf.queryExecution().toString()
    assert "content" not in plan.split("Physical Plan")[1]


def test_records_over_many_ranges_equal_one_reader(spark, tmp_path):
    draw = random.Random(6)
    rows = []
    for i in range(400):
        long = "line\n" * draw.choice([0, 0, 1, 40, 400])
        rows.append([str(i), draw.choice(['say "hi"', "a,b", "", " lead", long, f"x\r\ny{long}"]), *["z"] * draw.choice([0, 3, 6, 9])])
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerows([["h1", "h\n2"], *rows])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(out.getvalue() + "\n\n", newline="")
    (tmp_path / "in" / "b.csv").write_bytes(b'q,w\r\n1,"x\r\ny"\r\n2,\r\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = csvfiles.csv_fields(csvfiles.csv_records(spark, str(tmp_path / "in")), 5).cache()
        assert found.where("file like '%a.csv'").select("block").distinct().count() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = [r.fields for r in found.where("file like '%a.csv'").orderBy("block", "number").collect()]
    assert [[c.replace("\r\n", "\n") for c in r] for r in got] == [[c.lstrip(" ").replace("\r\n", "\n") if i == 1 and not c.startswith('"') else c for i, c in enumerate(r[:5])] for r in rows]
    assert [[c.replace("\r\n", "\n") for c in r.fields] for r in found.where("file like '%b.csv'").orderBy("number").collect()] == [["1", "x\ny"], ["2", ""]]
    kept = csvfiles.csv_records(spark, str(tmp_path / "in"), keep_header=True)
    assert kept.count() == 400 + 1 + 3 and kept.where(F.col("record").startswith("h1")).first().record == 'h1,"h\n2"'
