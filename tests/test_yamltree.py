"""YAML node trees: against a YAML library where there is one, and on texts that vary by row."""

import random

import pytest
from pyspark.sql import functions as F
from test_operators import frame

from folio.operators import configs, yamltree
from folio.operators.metadata import yaml_metadata

MIXED = """# c
%YAML 1.2
---
name: "x y"   # remark
spec: &here
  image: nginx:1.2
  ports:
  - containerPort: 80
    name: web
  -   - deep
      - er
  empty:
  script: |
    a: b
      # not a comment
    - c

    end
  # comment
  tags: [a, {b: c, d: [e, f]}, "g,h"]
  multi: [
    1,
    2
  ]
list:
- one
- two: 2
  three: 3
last: *here
text: some words
  go on
q: "two
  lines"
fold: >-
  one
  two

  three
...
other: 1
"""


def compared(text):
    """(path, kind, line, children, bytes of scalars) of each node, and the counts, by a YAML library."""
    yaml = pytest.importorskip("yaml")
    root = yaml.compose(text.split("\n...\n")[0])
    out, counts = [], dict.fromkeys(("mappings", "sequences", "scalars", "keys"), 0)

    def walk(node, path, line, flow, depth):
        kind = node.id
        counts[kind + "s"] += 1
        deepest = 1 if kind in ("mapping", "sequence") else 0
        inner = flow or getattr(node, "flow_style", False)
        if not flow:
            size = len(node.value.encode()) if kind == "scalar" else 0
            out.append((path, kind, line, len(node.value) if kind != "scalar" else 0, size))
        below = 0
        if kind == "mapping":
            for k, v in node.value:
                counts["keys"] += 1
                counts["scalars"] += 1
                below = max(below, walk(v, k.value if depth == 0 else f"{path}.{k.value}", k.start_mark.line + 1, inner, depth + 1))
        elif kind == "sequence":
            for i, v in enumerate(node.value):
                below = max(below, walk(v, f"{path}[{i}]", v.start_mark.line + 1, inner, depth + 1))
        return deepest + below

    counts["max_depth"] = 1 + walk(root, "root", None, False, 0)
    return out[1:], counts


def found(spark, text):
    df = frame(spark, text, "a.yaml")
    rows = yamltree.yaml_nodes(df).where("node > 0").orderBy("node").collect()
    told = yamltree.with_nodes(df).select("__broken", *(c.alias(k) for k, c in yamltree.statistics(F.col("__nodes")).items())).first()
    return [(r.path, r.kind, r.line_start, r.n_children, r.value_bytes) for r in rows], told.asDict()


def test_nodes_equal_a_library(spark):
    text = MIXED.replace("last: *here\n", "")
    nodes, told = found(spark, text)
    want, counts = compared(text)
    assert nodes == want
    assert not told["__broken"] and {k: told[k] for k in counts} == counts


def test_ranges_and_aliases(spark):
    rows = {r.path: r for r in yamltree.yaml_nodes(frame(spark, MIXED, "a.yaml")).collect()}
    assert (rows["spec"].line_start, rows["spec"].line_end) == (5, 24)
    assert (rows["spec.script"].line_start, rows["spec.script"].line_end, rows["spec.script"].value_lines) == (13, 18, 6)
    assert (rows["spec.ports[0]"].line_start, rows["spec.ports[0]"].line_end) == (8, 9)
    assert (rows["spec.multi"].line_end, rows["spec.multi"].n_children, rows["last"].kind) == (24, 2, "alias")
    assert rows["root"].line_end == 38 and "other" not in rows


def made_yaml(draw, depth=0, width=2):
    """A random block of YAML lines."""
    pad = " " * width * depth
    if depth > 4 or draw.random() < 0.25:
        return None
    if draw.random() < 0.5:
        out = []
        for k in range(draw.randint(1, 4)):
            inner = made_yaml(draw, depth + 1, width)
            out += [f"{pad}k{k}: {draw.choice(['1', 'a b', 'x:y # c', chr(34) + 'q: r' + chr(34), '[a, b]', '{c: d}', ''])}".rstrip()] if inner is None else [f"{pad}k{k}:", *inner]
            if draw.random() < 0.2:
                out += ["", f"{pad}# remark: no key"]
        return out
    out = []
    for _ in range(draw.randint(1, 4)):
        inner = made_yaml(draw, depth + 1, width)
        out += [f"{pad}- {draw.choice(['1', 'a b', '[a]'])}"] if inner is None else [f"{pad}-{' ' * (width - 1)}{inner[0].lstrip()}", *inner[1:]]
    return out


def test_random_trees(spark):
    pytest.importorskip("yaml")
    draw, texts = random.Random(4), []
    while len(texts) < 60:
        lines = made_yaml(draw, 0, draw.choice([2, 4]))
        if lines:
            texts.append("\n".join(lines) + "\n")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in yamltree.yaml_nodes(df).where("node > 0").orderBy("doc_id", "node").collect():
        got.setdefault(r.doc_id, []).append((r.path, r.kind, r.line_start, r.n_children, r.value_bytes))
    for i, text in enumerate(texts):
        assert got.get(i, []) == compared(text)[0], text


def test_what_matters_in_a_mapping(spark):
    block = "  " + "\n  ".join(["w"] * 6)
    text = f"a: 1\nb:\n  c: 1\nd:\n  e:\n    f: 1\n    g: 2\nh: |\n{block}\ni: |\n  short\nj: {'x' * 201}\nk: [1]\nl: {{a: 1, b: 2}}\nm:\n- 1\n- 2\n# the end\n"
    rows = configs.chunk_yaml(frame(spark, text, "a.yaml")).collect()
    assert [r.identifier for r in rows] == ["d", "h", "j", "l", "m"]
    assert rows[0].content == "d:\n  e:\n    f: 1\n    g: 2" and rows[0].annotations == {"type": "yaml_section", "key": "d", "path": "d", "value_type": "mapping", "indent": "1", "keys_count": "1"}
    assert rows[-1].content == "m:\n- 1\n- 2\n# the end\n" and rows[-1].annotations["items_count"] == "2"
    long = configs.chunk_yaml(frame(spark, "--- # start\n" + "".join(f"- id: {i}\n  v: x\n" for i in range(120)), "a.yaml")).collect()
    assert [(r.identifier, r.line_start, r.line_end) for r in long] == [("items[0-49]", 2, 101), ("items[50-99]", 102, 201), ("items[100-119]", 202, 241)]
    assert long[0].type == "yaml_sequence_slice" and long[0].content.startswith("- id: 0\n  v: x\n- id: 1")


def test_broken_places(spark):
    cases = [("a: [1, 2\nb: 3\n", True), ("a: {b: [1}\n", True), ("a:\n    b: 1\n  c: 2\n", True), ("a:\n  - 1\n  b: 2\n", True), ("a: |\n\tx\n", False), ('a: "x\n  y: z"\nb: 1\n', False), ("x", False), ("[1, 2]\n", False), ("- [a,\n  b]\n- c: {d: e,\n    f: g}\n", False)]
    df = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r["__broken"] for r in yamltree.with_nodes(df).collect()}
    assert got == {i: broken for i, (_, broken) in enumerate(cases)}


def test_metadata_of_yaml(spark):
    made = yaml_metadata(frame(spark, "a:\n  b: |\n    x\n    y\n  c: [1, 2]\nd:\n" + "".join(f"- k{i}: v\n" for i in range(12)), "a.yaml")).first()
    assert [s.name for s in made.symbols] == ["a", "b", "c", "d", *(f"k{i}" for i in range(10))]
    assert [(d.name, d.type, d.signature, d.line_start, d.line_end) for d in made.definitions] == [("a", "mapping", "mapping{2 keys}", 1, 5), ("b", "scalar", "scalar", 2, 4), ("c", "sequence", "sequence[2 items]", 5, 5), ("d", "sequence", "sequence[12 items]", 6, 18)]
    p = made.properties
    assert (p["valid"], p["root_type"], p["keys"], p["mappings"], p["sequences"], p["max_depth"]) == ("true", "mapping", "16", "14", "2", "4")
    assert yaml_metadata(frame(spark, "a: [", "a.yaml")).first().properties["valid"] == "false"


def test_deep_and_long_texts_take_one_pass(spark):
    deep = "".join("  " * i + f"k{i}:\n" for i in range(300))
    wide = "".join(f"key{i}:\n  a: {i}\n  b: [x, y]\n" for i in range(4000))
    df = spark.createDataFrame([(1, deep), (2, wide), (3, None), (4, "")], "doc_id long, text string")
    counts = {r.doc_id: (r.n, r.depth) for r in yamltree.yaml_nodes(df).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("depth").alias("depth")).collect()}
    assert counts == {1: (301, 300), 2: (12_001, 2), 3: (1, 0), 4: (1, 0)}
