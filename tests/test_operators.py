"""Unit fixtures of the reference operators, re-authored."""

import pytest
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import chains, codeblocks, configs, csvchunks, evaluate, jsonchunks, markdown, models, pdftext, search, split, textchunks
from folio.operators.store import BatchConfig, Store, resolve_name
from folio.sources import files, registry


def frame(spark, text, path="some_file.txt", doc_id=0):
    return spark.createDataFrame([(doc_id, path, text)], "doc_id long, path string, text string")


def test_blank_text_has_no_chunks(spark):
    assert textchunks.chunk_text(frame(spark, " \n\t ")).count() == 0
    assert textchunks.chunk_text(frame(spark, None)).count() == 0


def test_sections_full_and_compat(spark):
    text = "FIRST PART\nsome words that are long enough\n\nSECOND PART\nother words that are long enough\n"
    full = textchunks.chunk_text(frame(spark, text)).orderBy("line_start").collect()
    assert [(r.identifier, r.line_start, r.line_end) for r in full] == [("FIRST PART", 1, 3), ("SECOND PART", 4, 6)]
    compat = textchunks.chunk_text(frame(spark, text), mode="compat").collect()
    assert [r.identifier for r in compat] == ["SECOND PART"]


def test_long_paragraph_is_cut_by_lines(spark):
    text = "\n".join(["a line of words that goes on and on, with more than sixty bytes in it."] * 50)
    rows = textchunks.chunk_text(frame(spark, text), max_lines=10).collect()
    assert len(rows) == 5 and {r.type for r in rows} == {"text_section_part"}
    assert [(r.line_start, r.line_end) for r in rows] == [(k * 10 + 1, k * 10 + 10) for k in range(5)]


@pytest.mark.parametrize("path, kind", [("README.txt", "readme"), ("LICENSE.txt", "license"), ("todo.txt", "todo"), ("application.log", None), ("history.txt", "changelog")])
def test_document_type(spark, path, kind):
    assert frame(spark, "x", path).select(textchunks.document_type("path").alias("t")).first().t == kind


def test_csv(spark):
    rows = "\n".join(f"n{i},{i},city" for i in range(50))
    made = csvchunks.chunk_csv(frame(spark, "Name,Age,City\n" + rows, "people_list.csv"), max_lines=10).collect()
    assert len(made) == 11 and made[0].type == "csv_headers" and made[0].content == "Name,Age,City"
    assert made[1].identifier == "People List - Rows 1-5" and (made[1].line_start, made[1].line_end) == (2, 6)
    small = csvchunks.chunk_csv(frame(spark, "a,b\n1,2\n3,4")).collect()
    assert [r.type for r in small] == ["csv_document"]
    ragged = csvchunks.chunk_csv(frame(spark, "a,b\n1,2,3\n")).collect()
    assert [r.type for r in ragged] == ["csv_fallback"]
    same = csvchunks.chunk_csv(frame(spark, "\n".join(["1,2,3"] * 30)), max_lines=15).collect()
    assert [r.type for r in same] == ["csv_data"] * 3
    quoted = csvchunks.parsed(frame(spark, 'a,b\n"x, ""y""\nz",2\n')).first()
    assert quoted.rows == [['x, "y"\nz', "2"]]


def test_csv_metadata(spark):
    got = csvchunks.csv_metadata(frame(spark, "name,n,x,ok,day\nann,10,1.5,true,2024-01-02\nbob,20,2.5,no,2024-02-03\n")).first()
    assert (got.row_count, got.column_count, got.has_header, got.delimiter) == (2, 5, True, "comma")
    assert got.column_types == ["text", "integer", "float", "boolean", "date"]


@pytest.mark.parametrize("text, name", [("a;b\n1;2", "semicolon"), ("a\tb\n1\t2", "tab"), ("a|b\n1|2", "pipe"), ("ab", "comma")])
def test_delimiters(spark, text, name):
    assert frame(spark, text).select(csvchunks.delimiter_name(csvchunks.delimiter("text")).alias("d")).first().d == name


def test_json(spark):
    kinds = lambda t, **k: [r.type for r in jsonchunks.chunk_json(frame(spark, t), **k).collect()]
    assert kinds('{"a": 1, "b": 2}') == ["json_document"]
    assert kinds('{"a": 1 "b": 2}') == ["json_invalid"]
    assert kinds("42") == ["json_document"]
    assert kinds("[" + ",".join('{"id": %d}' % i for i in range(25)) + "]") == ["json_array_slice"] * 5
    wide = '{"a": {"x": 1, "y": 2, "z": 3}, "b": [1, 2, 3, 4], "c": 1, "d": 2, "e": 3, "f": "a text of more than twenty bytes"}'
    assert [r.identifier for r in jsonchunks.chunk_json(frame(spark, wide)).collect()] == ["a", "b", "f"]
    meta = jsonchunks.json_metadata(frame(spark, wide)).first()
    assert (meta.is_valid, meta.root_type, meta.object_count, meta.array_count, meta.primitive_count, meta.depth) == (True, "object", 2, 1, 11, 3)


def test_yaml(spark):
    text = "database:\n  host: a\n  port: 1\nserver:\n  port: 2\n  tls: true\nlogging:\n  level: info\n  file: x\nname: x\n"
    assert [r.identifier for r in configs.chunk_yaml(frame(spark, text)).collect()] == ["database", "server", "logging"]
    assert [r.type for r in configs.chunk_yaml(frame(spark, "a: 1\nb: 2\nc: 3\n")).collect()] == ["yaml_document"]
    assert configs.chunk_yaml(frame(spark, "\n".join(f"- item {i}" for i in range(120)))).count() == 3


def test_markdown(spark):
    text = "---\ntitle: A Guide\nauthor: me\n---\nintro\n\n# One\ntext one\n## Two\ntext two\n```go\nfunc main() {}\n```\n# Three\n| a | b |\n|---|---|\n"
    rows = {r.identifier: r for r in markdown.chunk_markdown(frame(spark, text, "a.md")).collect()}
    assert rows["Two"].parent_context == "One" and rows["Two"].context_level == 2
    assert rows["A Guide - code 1"].type == "code_block" and rows["A Guide - code 1"].language == "go"
    assert "text two" in rows["Two"].content and "func" not in rows["Two"].content
    assert rows["Three"].parent_context == ""
    only = frame(spark, text, "read_me.md").select(markdown.title("text", "path").alias("t"), markdown.code_languages("text").alias("c")).first()
    assert (only.t, only.c) == ("A Guide", ["go"])
    assert frame(spark, "no heading", "read_me.md").select(markdown.title("text", "path").alias("t")).first().t == "Read Me"


def test_code(spark):
    go = 'package shop\n\nimport "fmt"\n\n// Price of an item.\ntype Price struct {\n\tCents int\n}\n\nfunc (p Price) Show() string {\n\treturn fmt.Sprint("{", p.Cents)\n}\n\nfunc hidden() {}\n'
    rows = {r.name: r for r in codeblocks.declarations(frame(spark, go), codeblocks.GO).collect()}
    assert rows["Price"].kind == "struct" and rows["Price"].documentation == "Price of an item." and (rows["Price"].line_start, rows["Price"].line_end) == (6, 8)
    assert rows["Show"].kind == "method" and rows["Show"].line_end == 12 and rows["hidden"].visibility == "private"
    grouped = codeblocks.group_declarations(codeblocks.declarations(frame(spark, go), codeblocks.GO)).collect()
    assert len(grouped) == 1
    proto = "message Outer {\n  message Inner {\n    string name = 1;\n    int32 n = 2;\n  }\n}\nservice Find {\n  rpc Get(Outer) returns (stream Outer);\n}\nenum E {\n  A = 0;\n}\n"
    rows = {r.qualified_name: r for r in codeblocks.declarations(frame(spark, proto), codeblocks.PROTO).collect()}
    assert set(rows) == {"Outer", "Outer.Inner", "Find", "Find.Get", "E"} and rows["Outer.Inner"].field_count == 2
    tf = 'variable "region" {\n  default = "north"\n}\nresource "disk" "main" {\n  size = 3\n}\nlocals {\n  a = 1\n}\n'
    assert {r.qualified_name for r in codeblocks.declarations(frame(spark, tf), codeblocks.TERRAFORM).collect()} == {"variable.region", "resource.disk.main", "locals"}
    ts = "export class Cart {\n  private items: string[] = [];\n  constructor() {\n  }\n  add(x: string): void {\n    this.items.push(x);\n  }\n}\nconst n = 1;\n"
    rows = {r.qualified_name: r for r in codeblocks.declarations(frame(spark, ts), codeblocks.TYPESCRIPT).collect()}
    assert {"Cart", "Cart.items", "Cart.constructor", "Cart.add", "n"} <= set(rows) and rows["Cart"].line_end == 8 and rows["Cart"].visibility == "public"
    ok = {r.doc_id: r.ok for r in codeblocks.balanced(frame(spark, tf).union(frame(spark, "a {\n", doc_id=1)), codeblocks.TERRAFORM).collect()}
    assert ok == {0: True, 1: False}


def py_split(text, size, overlap, seps):
    if len(text.encode()) <= size or not seps:
        return [text]
    parts, cur = [], ""
    pieces = list(text) if seps[0] == "" else text.split(seps[0])
    for p in pieces:
        if not p:
            continue
        if cur and len(cur.encode()) + len(seps[0]) + len(p.encode()) <= size:
            cur += seps[0] + p
        else:
            if cur:
                parts.append(cur)
            cur = p
    if cur:
        parts.append(cur)
    out = [x for p in parts for x in py_split(p, size, overlap, seps[1:])]
    if overlap and len(out) > 1:
        merged, cur = [], out[0]
        for p in out[1:]:
            tail = cur
            while len(tail.encode()) > overlap:
                tail = tail[1:]
            if len(cur.encode()) + 1 + len(p.encode()) <= size:
                cur += "\n" + p
            else:
                merged.append(cur)
                cur = tail + "\n" + p
        out = [*merged, cur]
    return out


@pytest.mark.parametrize("size, overlap", [(40, 0), (40, 10), (12, 4), (5, 0)])
def test_recursive_split_has_a_twin(spark, size, overlap):
    texts = ["", "short", "one two three four five six seven eight nine ten eleven", "a b\n\nc d e f g h i j\nk l m n o p q r s t u v w\n\n\nx y z", "é" * 30 + " ü " + "abc" * 20]
    for text in texts:
        got = spark.createDataFrame([(text,)], "text string").select(split.recursive_split("text", size, overlap).alias("c")).first().c
        assert got == py_split(text, size, overlap, split.SEPARATORS)


def test_split_options(spark):
    with pytest.raises(ValueError):
        split.validate_options(10, 10)
    with pytest.raises(ValueError):
        split.merge_with_overlap(F.array(), 5, 5)


def test_enrichment(spark):
    rows = spark.createDataFrame([(1, 0, "alpha\nbeta\n}"), (1, 1, "gamma"), (2, 0, "delta")], "doc_id long, chunk_index int, content string")
    got = {(r.doc_id, r.chunk_index): r.enriched_content for r in split.enrich(rows).collect()}
    assert got[1, 1] == "// Previous context:\nalpha\nbeta\n// Current section:\ngamma" and got[2, 0] == "delta"


def test_pdf_text(spark):
    pages = spark.createDataFrame([("dir/My Report.pdf", 2, "ﬁrst  paragraph of the page\n\nshort\n\n\nlast paragraph of this page\nwith a line")], "path string, page int, text string")
    rows = pdftext.page_chunks(pages).orderBy("paragraph").collect()
    assert [(r.identifier, r.content) for r in rows] == [("my_report_pdf_pg2_para1", "first paragraph of the page"), ("my_report_pdf_pg2_para3", "last paragraph of this page\nwith a line")]


def test_search(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0], i % 2) for i in range(6)], "vec_id long, embedding array<float>, label int")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, query_vector array<float>")
    assert [r.vec_id for r in search.top_k(rows, asked, 2).orderBy("rank").collect()] == [5, 4]
    assert [r.vec_id for r in search.top_k(rows, asked, 9, filters={"label": 0, "odd": 1.5}).orderBy("rank").collect()] == [4, 2, 0]
    with pytest.raises(ValueError):
        search.top_k(rows, asked, 0)
    with pytest.raises(ValueError):
        search.delete_by_filter(rows, {})
    kept = search.delete_by_filter(rows.withColumn("label", F.when(F.col("vec_id") > 0, F.col("label"))), {"label": 1})
    assert {r.vec_id for r in kept.collect()} == {0, 2, 4}


def test_many_queries_take_the_grouped_way(spark, monkeypatch):
    monkeypatch.setattr(search, "BROADCAST_BYTES", 200)
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(7)], "query_id long, query_vector array<float>")
    few = search.top_k(rows, asked, 2).select("query_id", "vec_id", "rank").collect()
    monkeypatch.setattr(search, "BROADCAST_BYTES", 10_000)
    assert sorted(few) == sorted(search.top_k(rows, asked, 2).select("query_id", "vec_id", "rank").collect())


def test_grouped_search_uses_all_partitions(spark, monkeypatch):
    monkeypatch.setattr(search, "BROADCAST_BYTES", 20_001 * 80 // 2)
    rows = spark.range(400).select(F.col("id").alias("vec_id"), F.array(F.rand(1), F.rand(2)).alias("embedding"))
    asked = spark.range(20_001).select(F.col("id").alias("query_id"), F.array(F.rand(3), F.rand(4)).alias("query_vector"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        met = search.with_scores(rows, asked)
        assert "BroadcastNestedLoopJoin" not in met._jdf.queryExecution().executedPlan().toString()
        spread = met.groupBy(F.spark_partition_id()).count().collect()
        assert len(spread) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(r["count"] for r in spread) == 400 * 20_001
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_quoted_csv_against_a_reader(spark):
    import csv
    import io
    import random

    r = random.Random(9)
    texts = []
    for _ in range(60):
        rows = [[r.choice(["a", "b c", 'say "hi"', "x,y", "two\nlines", '""', "7", '"'  , ", "]) for _ in range(3)] for _ in range(r.randrange(1, 6))]
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows(rows)
        texts.append((out.getvalue(), [[c.lstrip(" ") if c == c.lstrip(" ") else c for c in row] for row in rows]))
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, t string")
    got = {x.i: x.r for x in df.select("i", csvchunks.records("t", F.lit(",")).alias("r")).collect()}
    assert [got[i] for i in range(len(texts))] == [rows for _, rows in texts]


def test_misplaced_quotes_are_kept(spark):
    df = spark.createDataFrame([('a"b,"c d"\n"e" f,g"',)], "t string")
    assert df.select(csvchunks.records("t", F.lit(",")).alias("r")).first().r[0] == ['a"b', "c d"]


def test_json_without_a_limit_of_depth(spark):
    deep = "[" * 40 + '{"a": "x{[\\"]}", "b": [1, null, true]}' + "]" * 40
    meta = jsonchunks.json_metadata(spark.createDataFrame([(deep,), ("3",), ("{}",), ("[1,",), (None,)], "text string")).collect()
    assert [(m.is_valid, m.object_count, m.array_count, m.primitive_count, m.depth) for m in meta] == [(True, 1, 41, 4, 43), (True, 0, 0, 1, 1), (True, 1, 0, 0, 1), (False, 0, 0, 0, 0), (False, 0, 0, 0, 0)]


def test_overlaps_cut_no_character(spark):
    df = spark.createDataFrame([("aé日本😀",), ("ab",), ("",)], "t string")
    for n in range(12):
        got = [r.e for r in df.select(split._tail(F.col("t"), n).alias("e")).collect()]
        for t, e in zip(("aé日本😀", "ab", ""), got, strict=True):
            assert e == next(t[k:] for k in range(len(t) + 1) if len(t[k:].encode()) <= n)


def test_overlapping_pairs_against_all_pairs(spark):
    import random

    r = random.Random(4)
    word = lambda: r.choice(["the", "cat", "sat", "on", "mat", "a", "rug", "dog"])
    a = [(i, " ".join(word() for _ in range(r.randrange(5)))) for i in range(30)] + [(90, "  "), (91, None)]
    b = [(i, " ".join(word() for _ in range(r.randrange(9)))) for i in range(40)] + [(80, "xcat sat onx"), (81, "The CAT")]
    want = {}
    for i, x in a:
        for j, y in b:
            x_, y_ = (x or "").strip().lower(), (y or "").strip().lower()
            n = sum(len(w) > 2 and w in x_.split() for w in y_.split())
            if n:
                share = n / max(len(x_.split()), len(y_.split()))
                want[i, j] = (round(share, 9), x_ in y_ or y_ in x_ or share > 0.5)
    left, right = spark.createDataFrame(a, "i long, text string"), spark.createDataFrame(b, "j long, text string")
    got = {(p.i, p.j): (round(p.overlap, 9), p.matches) for p in evaluate.overlapping_pairs(left, right, "i", "j").collect()}
    assert got == want


def test_sections_of_paged_text(spark):
    text = "--- Page 1 ---\nChapter 1. Start\nsome words that are long enough to stay\n\nmore of them\n--- Page 2 ---\nchapter 2\nshort\nCHAPTER 3 end\nother words that are long enough to stay"
    rows = pdftext.sections(spark.createDataFrame([(1, text), (2, "Abstract\n" + "w1 " * 20 + "\nINTRODUCTION TEXT\n" + "v1 " * 20), (3, None), (4, "nothing here")], "doc_id long, text string")).collect()
    got = [(r.doc_id, r.section, r.title, r.line_start, r.line_end, r.start_page) for r in rows]
    assert got == [(1, 1, "Chapter 1. Start", 2, 5, 1), (1, 2, "CHAPTER 3 end", 9, 9, 2), (2, 1, "INTRODUCTION TEXT", 3, 3, None)]


def test_oversized_chunks_are_cut(spark):
    content = "\n".join(f"line number {i} of the text" for i in range(10))
    df = spark.createDataFrame([("a", content, 5, 14, "t"), ("b", "short but long enough to stay here", 1, 1, "t"), ("c", "tiny", 1, 1, "t")], "identifier string, content string, line_start int, line_end int, type string")
    rows = pdftext.split_oversized(df, most=60, min_bytes=10).orderBy("identifier").collect()
    assert [(r.identifier, r.type, r.line_start, r.line_end) for r in rows] == [("a_split_0", "t_split", 5, 7), ("a_split_1", "t_split", 8, 10), ("a_split_2", "t_split", 11, 13), ("a_split_3", "t_split", 14, 14), ("b", "t", 1, 1)]
    assert "\n".join(r.content for r in rows[:4]) == content


def test_files_to_enriched_chunks(spark):
    prose = "\n\n".join(f"SECTION {c}\n" + "many words of a text that goes on and on here. " * 3 for c in "ABC")
    rows = [("a.txt", prose), ("b.json", "no json, but words that are significant and long enough to be split at all"), ("c.txt", "- -- --- !!"), ("d.txt", ""), ("e.txt", None), ("f.go", "package p\n\n" + "\n\n".join(f"func F{i}() {{\n\tprintln(\"some text that is long\")\n}}" for i in range(4)))]
    rows.append(("g.txt", "\n".join(["word word word."] * 3 + ["", ""]) * 9))
    got = {}
    for r in split.split_files(spark.createDataFrame(rows, "path string, text string"), registry.default_registry()).collect():
        got.setdefault(r.path, []).append(r)
    assert set(got) == {"a.txt", "b.json", "c.txt", "d.txt", "f.go", "g.txt"}
    a = sorted(got["a.txt"], key=lambda r: r.chunk_index)
    assert [r.chunk_index for r in a] == [0, 1, 2] and {r.total_chunks for r in a} == {3} and all("// File: a.txt" in r.enriched_content and r.enriched_content.endswith(r.content) for r in a)
    assert [r.type for r in got["c.txt"]] == [r.type for r in got["d.txt"]] == ["original"] and got["c.txt"][0].enriched_content == "- -- --- !!"
    assert got["b.json"][0].type == "json_invalid" and got["f.go"][0].content.startswith("package p\n\nfunc F0")
    assert all(r.type == "text_section" or r.type == "text_fallback" for r in got["g.txt"])
    assert split.split_files(spark.createDataFrame([], "path string, text string"), registry.default_registry()).collect() == []


def test_go_groups_carry_package_and_imports(spark):
    go = 'package shop\n\nimport (\n\t"fmt"\n)\n\nimport "os"\n\nfunc a() {\n\tfmt.Println(1)\n}\n\nfunc b() {\n\tfmt.Println(2)\n}\n'
    docs = frame(spark, go).withColumn("header", codeblocks.go_header("text"))
    rows = codeblocks.group_declarations(codeblocks.declarations(docs, codeblocks.GO), size=40, header="header").orderBy("chunk_index").collect()
    head = 'package shop\n\nimport (\n\t"fmt"\n)\n\n'
    assert [r.content for r in rows] == [head + "func a() {\n\tfmt.Println(1)\n}", head + "func b() {\n\tfmt.Println(2)\n}"]
    assert len(codeblocks.group_declarations(codeblocks.declarations(docs, codeblocks.GO), header="header").collect()) == 1


def test_literals_over_lines_don_t_count(spark):
    go = "package p\n\nvar s = `\nfunc fake() {\n`\n\n/* type Gone struct {\n */\nfunc real() {\n\tx := '{'\n\t// {\n}\n\nfunc after() {}\n"
    rows = [(r.name, r.line_start, r.line_end) for r in codeblocks.declarations(frame(spark, go), codeblocks.GO).orderBy("line_start").collect()]
    assert rows == [("s", 3, 3), ("real", 9, 12), ("after", 14, 14)]
    tf = 'resource "a" "b" {\n  text = <<-EOT\n    variable "x" {\n    it\'s {\n  EOT\n}\noutput "c" {\n  value = 1 # {\n}\n'
    rows = [(r.qualified_name, r.line_start, r.line_end) for r in codeblocks.declarations(frame(spark, tf), codeblocks.TERRAFORM).orderBy("line_start").collect()]
    assert rows == [("resource.a.b", 1, 6), ("output.c", 7, 9)]


@pytest.mark.parametrize(
    "text, broken",
    [
        ("---\nname: test\n  invalid: indentation\n    more: problems\n- list item without proper structure\n", True),
        ("a: 1\n\tb: 2\n", True),
        ("a: 1\nb:\n- x\n- y\nc:\n  d: 1\n", False),
        ("- a: 1\n  b: 2\n- c\n", False),
        ("a: text that\n  goes on\nb: 2", False),
        ("a: |\n  x: y\n   z: w\n", False),
        ("a: 1\n- b\n", True),
    ],
)
def test_broken_yaml(spark, text, broken):
    assert [r.type for r in configs.chunk_yaml(frame(spark, text, "a.yaml")).collect()] == ["yaml_invalid" if broken else "yaml_document"]


def test_front_values(spark):
    got = frame(spark, "---\ntitle: 'A'\nmy-key: b c\nlist:\n  - x\ntitle: B\n---\ntext").select(markdown.front_values("text").alias("m")).first().m
    assert got == {"my-key": "b c", "list": "", "title": "B"}


def test_failed_batches_cost_their_own_rows(spark):
    def connect():
        def call(texts):
            if any("bad" in t for t in texts):
                raise ValueError("refused")
            return [[float(len(t)), 1.0] for t in texts]

        return call

    rows = spark.createDataFrame([("a",), ("bad",), (None,), ("ccc",)], "t string").coalesce(1)
    made = rows.withColumn("embedded", models.try_embedder(connect, batch=1)("t"))
    assert [(r.embedded.vector, r.embedded.error) for r in made.collect()] == [([1.0, 1.0], None), (None, "ValueError: refused"), (None, None), ([3.0, 1.0], None)]
    status = models.embedding_status(made).first()
    assert (status.given, status.embedded, status.failed, status.skipped, status.status) == (4, 2, 1, 1, "partial")
    assert models.embedding_status(made.where("t = 'bad'")).first().status == "failed" and models.embedding_status(made.limit(0)).first().status == "empty"


def test_payloads_come_back(spark):
    from folio.operators.store import documents, payloads

    docs = spark.createDataFrame([(1, "text", 3, True, ["a", "b"], None), (2, None, None, None, None, 1.5)], "id long, page_content string, n int, ok boolean, tags array<string>, x double")
    got = {r.id: (r.page_content, r.metadata) for r in documents(payloads(docs, metadata=("n", "ok", "tags", "x")).drop("page_content")).collect()}
    assert got == {1: ("text", {"n": "3", "ok": "true", "tags": '["a","b"]'}), 2: (None, {"x": "1.5"})}


def test_annotations_signatures_and_titles(spark):
    tf = 'module "net" {\n  source = "./net"\n  size = 3\n  rule "in" {\n    port = 1\n  }\n}\nlocals {\n  a = 1\n  b = { c = 2 }\n}\n'
    notes = {r.kind: r.annotations for r in codeblocks.terraform_annotations(codeblocks.declarations(frame(spark, tf), codeblocks.TERRAFORM)).collect()}
    assert notes["module"] == {"block_type": "module", "line_count": "7", "attribute_count": "2", "nested_block_count": "1", "module_name": "net", "module_source": "./net"}
    assert notes["locals"]["local_count"] == "2"
    rpc = spark.createDataFrame([("rpc Get(stream A) returns (B)",), ("rpc Get(A) returns (stream B)",)], "s string").select(codeblocks.rpc_streams("s").alias("r")).collect()
    assert [(x.r.takes, x.r.gives) for x in rpc] == [(True, False), (False, True)]
    values = spark.createDataFrame([('{"a": 1, "b": 2}',), ("[true, 1]",), ("[]",), ("3",)], "t string")
    assert [r.s for r in values.select(jsonchunks.signature(F.parse_json("t")).alias("s")).collect()] == ["object{2 properties}", "array[2] of boolean", "array[0]", "number"]
    pages = spark.createDataFrame([("p", 1, "short\n\nnot a title but long enough\nThe Title Of This\nrest"), ("p", 2, "second page")], "path string, page int, text string")
    got = pdftext.pages_metadata(pages).first()
    assert (got.page_count, got.title) == (2, "The Title Of This")


def test_indented_json(spark):
    import json

    texts = ['{"b": [1, {"c": null, "d": []}, "x, {y}: \\"z\\" \\\\"], "a": {}, "e": -1.5e3, "f": [[true], [{}]]}', "[]", "3", '"a: b"', '[1]']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.p for r in df.select(jsonchunks.indented(F.to_json(F.parse_json("t"))).alias("p")).collect()]
    assert [json.loads(g) for g in got] == [json.loads(t) for t in texts]
    want = [json.dumps(json.loads(t), indent=2, sort_keys=True) for t in texts]
    assert [g.replace("-1500.0", "X").replace("-1.5E3", "X").replace("-1500", "X") for g in got] == [w.replace("-1500.0", "X") for w in want]
    lines = [r.n for r in df.select(jsonchunks.indented_lines(F.to_json(F.parse_json("t"))).alias("n")).collect()]
    assert lines == [len(w.split("\n")) for w in want]
    shown = spark.createDataFrame([('["<a> & b"]',)], "t string").select(jsonchunks.indented(F.col("t")).alias("p")).first().p
    assert shown == '[\n  "\\u003ca\\u003e \\u0026 b"\n]'


def test_json_paths(spark):
    rows = spark.createDataFrame([(1, '{"a": {"b": [1, {"c": null}]}, "d": []}'), (2, "7"), (3, "{")], "doc_id long, text string")
    got = sorted((r.doc_id, r.path, r.value_type, r.level) for r in jsonchunks.paths(rows).collect())
    assert got == [(1, "a", "object", 1), (1, "a.b", "array", 2), (1, "a.b[0]", "primitive", 3), (1, "a.b[1]", "object", 3), (1, "a.b[1].c", "primitive", 4), (1, "d", "array", 1), (1, "root", "object", 0), (2, "root", "primitive", 0)]
    assert jsonchunks.paths(rows.limit(0)).collect() == []


def test_throughput(spark):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) AS a, timestamp'2024-01-01 00:00:01' + make_interval(0, 0, 0, 0, 0, 0, id) AS b FROM range(5)")
    got = evaluate.throughput(rows, "a", "b").first()
    assert (got.documents, got.seconds, got.per_second) == (5, 5.0, 1.0) and evaluate.throughput(rows.limit(0), "a", "b").first().per_second is None


def test_store_versions(spark, tmp_path):
    connect = lambda: lambda texts: [[float(len(t)), 1.0] for t in texts]
    store = Store(spark, str(tmp_path / "store"), connect=connect, config=BatchConfig(embedding_batch_size=1), most=3)
    rows = lambda *x: spark.createDataFrame(list(x), "id string, page_content string")
    done = store.add(rows(("a", "one"), ("b", "two"), ("b", "two"), ("c", " "))).first()
    assert (done.given, done.blank, done.written) == (4, 1, 2)
    for k in range(5):
        store.add(rows(("a", f"again {k}"), (f"n{k}", "new")))
        store.delete(rows(("b", "x")).select("id"))
        held = {r.id: r.page_content for r in store.read("documents").collect()}
        assert held == {"a": f"again {k}"} | {f"n{j}": "new" for j in range(k + 1)}
    assert len(store._versions("documents")) <= 4
    asked = spark.createDataFrame([(1, "again 4")], "query_id long, q string").withColumn("query_vector", F.array(F.lit(7.0), F.lit(1.0)))
    assert [r.id for r in store.retriever(1)(asked).collect()] == ["a"]


def test_json_property_lines(spark):
    wide = '{\n"a": {"x": 1, "y": {}, "z": [1]},\n"b": 1,\n"c": 1,\n"d": 2,\n"e": 3,\n"f": "a text, of {more} than [twenty] bytes"}'
    rows = {r.identifier: (r.line_start, r.line_end) for r in jsonchunks.chunk_json(frame(spark, wide)).collect()}
    assert rows == {"a": (2, 10), "f": (7, 9)}  # as many lines as an indented print has


def test_budget_keeps_files_in_order(spark, tmp_path):
    for i in range(12):
        (tmp_path / f"f{i:02}.txt").write_text("x" * (i + 1))
    kept = sorted(r.path for r in files.scan(spark, str(tmp_path), total_budget=30).collect())
    assert kept == [f"f{i:02}.txt" for i in range(7)]


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), models.hashing_embedding)
    docs = spark.createDataFrame([("a", "red apple"), ("b", "green pear"), ("", "blue sky"), (None, " ")], "id string, page_content string")
    done = store.add(docs).first()
    assert (done.given, done.blank, done.written) == (4, 1, 3)
    store.add(spark.createDataFrame([("a", "red cherry")], "id string, page_content string"))
    assert store.read("documents").count() == 3 and store.collections() == ["documents"]
    asked = spark.createDataFrame([(1, "red cherry")], "query_id long, q string").withColumn("query_vector", models.hashing_embedding("q"))
    assert store.similar(asked, 1).first().id == "a"
    store.delete(spark.createDataFrame([("b",)], "id string"))
    store.delete_where({"page_content": "blue sky"})
    assert [r.id for r in store.read("documents").collect()] == ["a"]
    store.drop("documents")
    assert not store.exists("documents")
    with pytest.raises(KeyError):
        store.read("documents")
    assert resolve_name(None, "n") == "n" and BatchConfig(batch_size=5000).clamped().batch_size == 1000


def test_models(spark):
    rows = spark.createDataFrame([(0, "a\nb"), (1, " "), (2, None)], "i int, t string")
    assert [r.q for r in rows.select(models.query_input("t").alias("q")).collect()] == ["query: a b", None, None]
    length = models.embedder(lambda: lambda texts: [[float(len(t))] for t in texts])
    assert [r.v for r in rows.orderBy("i").select(length("t").alias("v")).collect()] == [[3.0], [1.0], None]
    calls = []

    def flaky(batch):
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return batch

    assert models.retried(flaky, delay=0, jitter=0)(["x"]) == ["x"] and len(calls) == 3
    with pytest.raises(ValueError):
        models.fake_answers(rows, [])


def test_chains(spark):
    asked = spark.createDataFrame([(1, "why?"), (2, "when?"), (3, "who?")], "query_id long, query string")
    found = spark.createDataFrame([(1, 2, "second"), (1, 1, "first"), (2, 1, "odd")], "query_id long, rank int, page_content string")
    echo = lambda p: p
    got = {r.query_id: r.answer for r in chains.retrieval_qa(asked, found, echo).collect()}
    assert "first\n\n---\n\nsecond" in got[1] and "Question: why?" in got[1] and got[3] == "who?"
    yes = lambda p: F.when(F.contains(p, F.lit("first")), "YES, it does").otherwise("no")
    got = {r.query_id: (r.used_context, r.answer) for r in chains.validated_qa(asked, found, yes, echo).collect()}
    assert got[1][0] and got[2] == (False, "when?") and got[3] == (False, "who?")
    with pytest.raises(Exception, match="query cannot be empty"):
        chains.validated_qa(spark.createDataFrame([(1, " ")], "query_id long, query string"), found, yes, echo).collect()


def test_template_never_expands_retrieved_text(spark):
    row = spark.createDataFrame([("{{.query}}", "q")], "c string, q string")
    assert row.select(T.template("{{.query}} {{.context}}", ("query", "q"), ("context", "c")).alias("p")).first().p == "q {{.query}}"


def test_evaluation(spark):
    rows = spark.createDataFrame([("Paris is the capital", "paris"), ("no idea", "the city of paris"), ("", "x")], "g string, t string")
    assert [r.m for r in rows.select(evaluate.answers_match("g", "t").alias("m")).collect()] == [True, False, False]
    bands = spark.createDataFrame([(95.0,), (80.0,), (60.0,), (1.0,)], "p double").select(evaluate.band("p").alias("b")).collect()
    assert [r.b for r in bands] == ["excellent", "good", "fair", "poor"]


def test_scan_and_registry(spark, tmp_path):
    root = tmp_path / "tree"
    (root / ".git").mkdir(parents=True)
    (root / "docs").mkdir()
    (root / ".git" / "config").write_text("x")
    (root / "docs" / "a.txt").write_text("plain words of a text that is long enough")
    (root / "pic.png").write_bytes(b"\x89PNG")
    (root / "bad.md").write_bytes(b"# T\nok \xff\xfe end of it, long enough")
    (root / "main.go").write_text("package main\n\nfunc main() {\n}\n")
    rows = {r.path: r for r in files.scan(spark, str(root)).collect()}
    assert set(rows) == {"docs/a.txt", "bad.md", "main.go"} and "ok � end" in rows["bad.md"].text
    assert {r.path for r in files.scan(spark, str(root), include=["go"]).collect()} == {"main.go"}
    assert {r.path for r in files.scan(spark, str(root), exclude=[".GO"]).collect()} == {"docs/a.txt", "bad.md"}
    made = registry.default_registry().chunk_files(files.scan(spark, str(root))).collect()
    assert {(r.path, r.type) for r in made} == {("docs/a.txt", "text_section"), ("bad.md", "section"), ("main.go", "code_group")}
    tagged = registry.with_metadata(registry.default_registry().chunk_files(files.scan(spark, str(root)))).first()
    assert tagged.metadata["source"] == tagged.path
    with pytest.raises(ValueError):
        registry.default_registry().register(registry.Parser("go", (".go",)))
    assert registry.default_registry().for_extension("yml").name == "yaml"


def test_command_output(spark):
    row = files.command_output(spark, ["/anywhere/echo", "hello"]).first()
    assert (row.source, row.text) == ("echo", "hello\n")


def test_evaluation_csv(spark, tmp_path):
    p = tmp_path / "e.csv"
    p.write_text('a,b,c,d,e,f,g,h\n1,q,,ans,,,1,"a passage, quoted"\nx,q,,ans,,,1,p\n2,short\n')
    assert [(r.query_id, r.relevant_passage) for r in files.evaluation_csv(spark, str(p)).collect()] == [(1, "a passage, quoted")]


def test_streaming_ingest(spark, tmp_path):
    from folio.streaming.ingest import ingest

    root, seen = tmp_path / "in", []
    root.mkdir()
    (root / "a.txt").write_text("words of a text that is long enough to stay")
    run = lambda: ingest(spark, str(root), lambda rows, n: seen.extend(r.path for r in rows.collect()), str(tmp_path / "cp")).awaitTermination()
    run()
    (root / "b.txt").write_text("other words of a text that is long enough")
    run()
    assert len(seen) == 2 and seen[1].endswith("b.txt")


def test_windowed_counts(spark):
    from folio.streaming.ingest import windowed_counts

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert windowed_counts(events).agg(F.sum("n")).first()[0] == events.count()


def test_metadata_in_one_schema(spark):
    from folio.operators.metadata import file_metadata
    from folio.schema import FILE_METADATA

    texts = {
        "text": ("README.txt", "INTRO\n\nsome words here. And more!\n- item one of it\n"),
        "csv": ("p.csv", "name,n\nann,10\nbob,20\n"),
        "json": ("x.json", '{"a": [1, 2], "b": {"c": true}}'),
        "markdown": ("g.md", "---\ntitle: Guide\nauthor: me\n---\n# One\n```go\nx\n```\n## Two\n"),
        "yaml": ("k.yaml", "apiVersion: v1\nspec:\n  image: x\n  items:\n    - a\n# c\n"),
        "go": ("m.go", 'package shop\n\nimport "fmt"\n\nfunc Show() {\n\tfmt.Println()\n}\n'),
        "protobuf": ("m.proto", 'syntax = "proto3";\npackage a.b;\nimport "x.proto";\nmessage M {\n  int32 n = 1;\n}\n'),
    }
    got = {}
    for parser, (path, text) in texts.items():
        made = file_metadata(frame(spark, text, path), parser)
        assert made.drop("doc_id").schema.simpleString() == FILE_METADATA.simpleString()
        got[parser] = made.first()
    assert got["text"].properties["document_type"] == "readme" and got["text"].symbols[0].name == "INTRO" and got["text"].properties["list_items"] == "1"
    assert got["csv"].properties["row_count"] == "2" and [d.signature for d in got["csv"].definitions] == ["name: text", "n: integer"]
    assert got["json"].properties["array_count"] == "1" and [s.name for s in got["json"].symbols] == ["a", "b"]
    assert got["markdown"].properties["title"] == "Guide" and [(s.name, s.type) for s in got["markdown"].symbols] == [("One", "h1"), ("Two", "h2")] and got["markdown"].properties["author"] == "me"
    assert got["yaml"].properties["kubernetes_manifest"] == "true" and [s.name for s in got["yaml"].symbols] == ["apiVersion", "spec", "image", "items"] and got["yaml"].properties["item_count"] == "1"
    assert got["go"].imports == ["fmt"] and got["go"].properties["package"] == "shop" and got["go"].properties["total_function"] == "1" and got["go"].definitions[0].visibility == "public"
    assert got["protobuf"].properties["syntax"] == "proto3" and got["protobuf"].imports == ["x.proto"] and got["protobuf"].properties["package"] == "a.b"


def test_declarations_of_any_depth_in_one_pass(spark):
    deep = "".join(f"{'  ' * k}message M{k} {{\n" for k in range(30)) + "int32 x = 1;\n" + "}\n" * 30
    rows = codeblocks.declarations(frame(spark, deep), codeblocks.PROTO).orderBy("depth").collect()
    assert [(r.qualified_name, r.line_start, r.line_end) for r in rows] == [(".".join(f"M{i}" for i in range(k + 1)), k + 1, 61 - k) for k in range(30)]
    long = "package p\n" + "".join(f"// F{i} does it.\nfunc F{i}(\n\ta int,\n) error {{\n\treturn nil\n}}\n" for i in range(4000))
    found = codeblocks.declarations(frame(spark, long), codeblocks.GO)
    got = found.agg(F.count("*"), F.min(F.expr("line_end - line_start")), F.max(F.expr("line_end - line_start")), F.count_if(F.expr("documentation = name || ' does it.'"))).first()
    assert tuple(got) == (4000, 4, 4, 4000)


def test_typescript_members_and_arrow_functions(spark):
    ts = (
        "import { a } from './a';\n\nexport const add = (x: number): number => {\n  return x;\n};\n\n/** A thing. */\nexport class Thing<T> extends Base {\n  private n = 1;\n  items: string[] = [\n    'a(',\n  ];\n"
        "  constructor(\n    readonly a: string,\n  ) {\n    super();\n    if (a) {\n    }\n  }\n  static async load<T>(id: string): Promise<T> {\n    call(id);\n    const inner = 1;\n  }\n  handle = (e: Event) => {\n    run(e);\n  };\n  get size() { return 1; }\n}\n\n"
        "interface Shape {\n  area(): number;\n  name?: string;\n}\nfunction outer() {\n  const local = 1;\n  call();\n}\n"
    )
    rows = [(r.kind, r.qualified_name, r.line_start, r.line_end) for r in codeblocks.declarations(frame(spark, ts), codeblocks.TYPESCRIPT).orderBy("line_start").collect()]
    assert rows == [
        ("constant", "add", 3, 5),
        ("class", "Thing", 8, 28),
        ("property", "Thing.n", 9, 9),
        ("property", "Thing.items", 10, 12),
        ("constructor", "Thing.constructor", 13, 19),
        ("method", "Thing.load", 20, 23),
        ("property", "Thing.handle", 24, 26),
        ("method", "Thing.size", 27, 27),
        ("interface", "Shape", 30, 33),
        ("method", "Shape.area", 31, 31),
        ("property", "Shape.name", 32, 32),
        ("function", "outer", 34, 37),
    ]


def test_proto_annotations(spark):
    text = "// Says.\nmessage M {\n  int32 a = 1;\n  oneof o {\n    string s = 2;\n  }\n  enum E {\n    NONE = 0;\n    ONE = 1;\n  }\n}\nservice S {\n  rpc Get(stream x.M) returns (M) {}\n  rpc Put(M)\n      returns (stream x.M);\n}\n"
    rows = {r["name"]: r.annotations for r in codeblocks.proto_annotations(codeblocks.declarations(frame(spark, text), codeblocks.PROTO)).collect()}
    assert rows["M"] == {"type": "message", "name": "M", "has_doc": "true", "field_count": "1"}
    assert rows["E"]["value_count"] == "2" and rows["o"]["field_count"] == "1" and rows["S"]["rpc_count"] == "2"
    assert rows["Get"]["signature"] == "rpc Get(stream x.M) returns (M)" and rows["Get"]["streams_request"] == "true" and rows["Get"]["request_type"] == "x.M"
    assert rows["Put"]["signature"] == "rpc Put(M) returns (stream x.M)" and rows["Put"]["streams_response"] == "true" and rows["Put"]["response_type"] == "x.M"


def test_json_of_any_depth_in_one_pass(spark):
    deep = "[" * 400 + '{"a":[1,{"b c":"x,[y"}],"q\\"":null}' + "]" * 400
    rows = jsonchunks.paths(spark.createDataFrame([(1, deep), (2, '{"k": {"l": [true, []]}}'), (3, "{")], "doc_id long, text string")).collect()
    assert {(r.path, r.key, r.value_type, r.level) for r in rows if r.doc_id == 2} == {("root", "", "object", 0), ("k", "k", "object", 1), ("k.l", "l", "array", 2), ("k.l[0]", "[0]", "primitive", 3), ("k.l[1]", "[1]", "array", 3)}
    top = "root" + "[0]" * 400
    assert {(r.path, r.level) for r in rows if r.doc_id == 1 and r.level >= 400} == {(top, 400), (f"{top}.a", 401), (f'{top}.q"', 401), (f"{top}.a[0]", 402), (f"{top}.a[1]", 402), (f"{top}.a[1].b c", 403)}


def test_pages_to_chunks(spark):
    from folio.sources.registry import default_registry

    one = "Abstract\nWords of the abstract that are long enough.\n\nsecond, part\fno header, here\fConclusion\nWhat follows from all of the words above."
    two = "a paragraph of the first page, long enough\f \fshort\n\n\na paragraph of the third page, long enough"
    files_ = spark.createDataFrame([("one.pdf", one), ("two.pdf", two)], "path string, text string")
    rows = default_registry().chunk_files(files_).orderBy("path", "chunk_index").collect()
    assert [(r.path, r.type, r.identifier, r.line_start, r.line_end) for r in rows] == [
        ("one.pdf", "document_section", "abstract", 2, 9),
        ("two.pdf", "paragraph", "two_pdf_pg1_para1", 2, 2),
        ("two.pdf", "paragraph", "two_pdf_pg3_para2", 6, 6),
    ]
    assert rows[0].content.startswith("Words of the abstract") and "--- Page 3 ---" in rows[0].content
    cut = pdftext.chunk_document_pages(pdftext.text_pages(files_), most=45, min_bytes=5)
    assert {r.type for r in cut.collect()} >= {"document_section_split", "paragraph"} and cut.where("line_end < line_start or page is null").count() == 0


def test_a_batch_that_is_handed_over_again_is_written_once(spark, tmp_path):
    from folio.streaming.ingest import ingest, table_sink

    root, out = tmp_path / "in", str(tmp_path / "out")
    root.mkdir()
    for i in range(3):
        (root / f"f{i}.txt").write_text(f"plain words of text {i} that is long enough to be kept")
    write, calls = table_sink(out), []

    def failing(chunks, n):
        write(chunks, n)
        calls.append(n)
        if len(calls) == 2:
            raise RuntimeError("lost after writing")

    first = ingest(spark, str(root), failing, str(tmp_path / "cp"), files_per_batch=1)
    with pytest.raises(Exception, match="lost after writing"):
        first.awaitTermination()
    ingest(spark, str(root), failing, str(tmp_path / "cp"), files_per_batch=1).awaitTermination()
    assert calls == [0, 1, 1, 2]
    assert spark.read.parquet(out).groupBy("path").count().where("count = 1").count() == 3


def test_terraform_literals(spark):
    cases = {
        '"plain"': '"plain"', '"a ${b}"': "<expression>", '"50%"': '"50%"', "1.50": "1.5", "-2": "-2", "3.0": "3", "1e3": "1000", "true": "true", "null": "<expression>",
        '[1, "a,]", true,]': '[1, "a,]", true]', "[]": "[]", "[var.x]": "<expression>", "var.x": "<expression>", "{ a = 1 }": "<expression>", "007": "7", "0.0": "0",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "v string").select("v", codeblocks.terraform_literal("v").alias("x")).collect()
    assert {r.v: r.x for r in rows} == cases


def test_signatures_over_several_lines(spark):
    go = "package p\n\nfunc (s *Store[T]) Add(\n\tctx context.Context, // why\n\tvals map[string]interface{},\n) (n int, err error) {\n\treturn\n}\nfunc f(a interface{}, g func(int) error) error {\n\treturn g(1)\n}\nfunc one() { x := T{1} }\n"
    rows = {r["name"]: r.signature for r in codeblocks.declarations(frame(spark, go), codeblocks.GO).collect()}
    assert rows == {"Add": "func (s *Store[T]) Add(ctx context.Context, vals map[string]interface{}) (n int, err error)", "f": "func f(a interface{}, g func(int) error) error", "one": "func one()"}


def test_calls_at_once_are_bounded_and_spaced(spark, tmp_path):
    folder = str(tmp_path)

    def connect():
        import os
        import time
        import uuid

        def call(texts):
            name = f"{folder}/{uuid.uuid4().hex}.open"
            open(name, "w").close()
            time.sleep(0.15)
            at_once = sum(f.endswith(".open") for f in os.listdir(folder))
            os.remove(name)
            return [[float(len(t)), float(at_once)] for t in texts]

        return call

    rows = spark.range(16).selectExpr("id", "repeat('x', cast(id as int)) as t")
    made = models.paced(rows, "t", "v", connect, slots=2, interval=0.2, batch=2).orderBy("id").collect()
    assert [r.v[0] for r in made] == [float(i) for i in range(16)] and max(r.v[1] for r in made) <= 2
    started, call = [], models.spaced(lambda batch: started.append(__import__("time").monotonic()) or batch, 0.1)
    assert [call([k]) for k in range(3)] == [[0], [1], [2]] and all(b - a >= 0.09 for a, b in zip(started, started[1:]))


def test_blocks_give_exact_best_rows_with_ties_and_odd_vectors(spark, monkeypatch):
    import numpy as np

    draw = np.random.default_rng(4)
    vectors = draw.normal(size=(300, 5)).round(1)
    vectors[100:200] = vectors[7]  # ties go to the smaller id
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(None, vectors[7].tolist()), (None, vectors[7].tolist()), (900, None), (901, [0.0] * 5), (902, [float("nan")] * 5), (903, [1.0, None, 1.0, 1.0, 1.0]), (904, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = df.where("vec_id % 9 = 7").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    monkeypatch.setattr(search, "_PRODUCT", 400)  # a few queries at a time
    got = {(r.query_id, r["rank"]): r.vec_id for r in search.top_k(df, asked, 4, skip_self=True).collect()}
    for q in range(7, 300, 9):
        a = vectors[q]
        score = lambda v: float((v * a).sum() / (np.sqrt((v * v).sum()) * np.sqrt((a * a).sum())))
        every = sorted((-score(np.array(v)), i is not None, i or 0, i) for i, v in rows[:302] if i != q and i is not None)
        want = [x[3] for x in every if -x[0] >= 0][:4]
        assert [got.get((q, k)) for k in range(1, len(want) + 1)] == want
    assert search.top_k(df, asked.limit(0), 2).collect() == []
