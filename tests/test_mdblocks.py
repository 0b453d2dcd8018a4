"""Markdown blocks on mixed documents."""

from test_operators import frame

from folio.operators import markdown, mdblocks

MIXED = """---
title: T
---
Top *title*
goes on
===
para | no table
more
# One #
~~~~ python
# no heading
~~~
```
~~~~
> # quoted
lazy
> ```

- item
  - nested
    ```
    # in a list
    ```

  more of it
1. other kind

| a | b |
|---|:-:|
| 1 | 2 |
end
---

***
    indented

    code

2. two
   ### not mine
#5 no heading
```js `no` fence
text
```` go
```
unclosed
"""


def test_elements_of_a_mixed_document(spark):
    rows = mdblocks.elements(frame(spark, MIXED, "a.md")).orderBy("element").collect()
    got = [(r.type, r.level, r.language, r.line_start, r.line_end) for r in rows]
    assert got == [
        ("heading", 1, None, 4, 6),
        ("paragraph", 0, None, 7, 8),
        ("heading", 1, None, 9, 9),
        ("code", 0, "python", 10, 14),
        ("quote", 0, None, 15, 17),
        ("list", 0, None, 19, 26),
        ("table", 0, None, 28, 30),
        ("heading", 2, None, 31, 32),
        ("code", 0, None, 35, 37),
        ("list", 0, None, 39, 43),
        ("code", 0, "go", 44, 47),
    ]
    text = {r.line_start: r.content for r in rows}
    assert text[4] == "Top *title* goes on" and text[9] == "One" and text[10] == "# no heading\n~~~\n```" and text[35] == "indented\n\ncode"
    assert text[28].startswith("| a | b |") and text[44] == "```\nunclosed\n"


def test_sections_by_all_kinds_of_headings(spark):
    text = "Guide\n=====\nintro\n\nPart\n----\n~~~go\n# not one\nfunc main() {}\n~~~\n   ## Deep ##\nx\n"
    rows = markdown.chunk_markdown(frame(spark, text, "a.md")).orderBy("line_start").collect()
    assert [(r.identifier, r.type, r.context_level, r.parent_context) for r in rows if r.type == "section"] == [("Guide", "section", 1, ""), ("Part", "section", 2, "Guide"), ("Deep", "section", 2, "Guide")]
    code = next(r for r in rows if r.type == "code_block")
    assert (code.content, code.language) == ("# not one\nfunc main() {}", "go")


def test_chunks_row_by_row(spark):
    text = "before\n```\nplain\n```\n# A\n### B\n```js\nfunction f() {}\n```\nmore\n```go\nfunc g() {}\n## C\n```\n## D\n# E\n#### F\nend\n### G"
    made = markdown.chunk_markdown(spark.createDataFrame([("1", text, "a.md"), (None, text, "a.md"), ("2", " \n", "b.md"), ("3", None, "c.md")], "doc_id string, text string, path string"))
    assert not any(x in made._jdf.queryExecution().executedPlan().toString() for x in ("Exchange", "Window", "Join"))
    for key in ("1", None):  # sections in order, then blocks
        rows = [(r.type, r.identifier, r.parent_context, r.context_level, r.line_start, r.line_end, r.language) for r in made.where(made.doc_id.eqNullSafe(key)).collect()]
        assert rows == [
            ("document", "A", "", 0, 1, 4, None),
            ("section", "A", "", 1, 5, 5, None),
            ("section", "B", "A", 3, 6, 10, None),
            ("section", "D", "A", 2, 15, 15, None),
            ("section", "E", "", 1, 16, 16, None),
            ("section", "F", "E", 4, 17, 18, None),
            ("section", "G", "E", 3, 19, 19, None),
            ("code_block", "A - code 2", "", 0, 7, 9, "js"),
            ("code_block", "A - code 3", "", 0, 11, 14, "go"),
        ]
    assert made.count() == 18


def test_odd_markdown(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "```"), (4, "---\n---\n"), (5, "a\n\n" * 5000), (6, "- \n" * 3000)], "doc_id long, text string")
    counts = {r.doc_id: r["count"] for r in mdblocks.elements(df).groupBy("doc_id").count().collect()}
    assert counts == {3: 1, 5: 5000, 6: 1}
