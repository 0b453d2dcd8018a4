"""YAML texts: features, patterns, and chunks of the top level by the node tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import col, exploded, lines, title_name, trim_space
from folio.operators import yamltree

#: Words that mark kinds of configuration.
CONFIG_WORDS = ("database", "server", "api", "logging", "auth", "cache", "environment", "deployment")
#: Words that mark continuous integration.
CI_WORDS = ("pipeline", "workflow", "job:", "stage:", "script:", "deploy")


def features(text: str | Column) -> dict[str, Column]:
    """Flags by name, each a plain test of the text."""
    t, low = col(text), F.lower(col(text))
    has = lambda c, w: F.contains(c, F.lit(w))
    out = {
        "has_yaml_directive": has(t, "%YAML"),
        "has_tag_directive": has(t, "%TAG"),
        "has_document_separator": has(t, "---"),
        "has_document_terminator": has(t, "..."),
        "has_multiline_strings": has(t, "|") | has(t, ">"),
        "has_anchors": t.rlike(r"&[0-9A-Za-z_]+"),
        "has_aliases": t.rlike(r"\*[0-9A-Za-z_]+"),
    }
    out |= {f"has_{w}_config": has(low, w) for w in CONFIG_WORDS}
    out["kubernetes_manifest"] = has(low, "apiversion") | has(low, "kind:")
    out["has_docker_config"] = has(low, "docker") | has(low, "image:")
    ci = F.lit(False)
    for w in CI_WORDS:
        ci = ci | has(low, w)
    out["has_ci_config"] = ci
    return out


def chunk_yaml(docs: DataFrame, text: str = "text", path: str = "path") -> DataFrame:
    """Chunks of the first document's top level, with annotations.

    A mapping of up to three keys, a sequence of up to five items, and a scalar
    are one ``yaml_document``; a larger mapping has a ``yaml_section`` for each
    key that matters, from the key to the line before the next one; a larger
    sequence has a ``yaml_sequence_slice`` for every 50 items. A key matters
    that holds a mapping of two keys or one with a collection of two, a sequence
    of two items, or a text of over five lines or 200 bytes. What is no YAML is
    one ``yaml_invalid``.
    """
    rest = [c for c in docs.columns if c != text]
    found = yamltree.with_nodes(docs.where(trim_space(text) != ""), text)
    root = F.get("__nodes", F.lit(0))
    top = F.transform(F.filter(F.transform("__nodes", lambda n, k: F.struct(n.alias("n"), k.alias("k"))), lambda x: x["n"]["parent"] == 0), lambda x: x["n"].withField("at", x["k"]))
    found = found.withColumn("__l", lines(text)).withColumn("__top", top).withColumn("__root", root)
    made = "struct<content:string,line_start:int,line_end:int,type:string,identifier:string,annotations:map<string,string>>"

    def chunk(content: Column, a: Column, b: Column, kind: str, label: Column, **notes: Column) -> Column:
        noted = F.create_map(F.lit("type"), F.lit(kind), *(x for k, v in notes.items() for x in (F.lit(k), v.cast("string"))))
        return F.struct(content, a, b, F.lit(kind), label, F.map_filter(noted, lambda _, v: v.isNotNull())).cast(made)

    held = lambda a, b: F.array_join(F.slice("__l", a, b - a + 1), "\n")
    rich = lambda n: n["kind"].isin("mapping", "sequence") & (n["n_children"] >= 2)

    def matters(n: Column, k: Column) -> Column:
        after = F.coalesce(F.get(F.col("__top"), k + 1)["at"], F.size("__nodes"))
        inside = F.exists(F.slice("__nodes", n["at"] + 2, after - n["at"] - 1), lambda x: (x["parent"] == n["node"]) & rich(x))
        return rich(n) | ((n["kind"] == "mapping") & inside) | ((n["kind"] == "scalar") & ((n["value_lines"] > 5) | (n["value_bytes"] > 200)))

    def section(n: Column) -> Column:
        end = F.coalesce(F.get(F.col("__top"), n["place"] + 1)["line_start"] - 1, F.col("__root.line_end"))
        count = lambda kind: F.when(n["kind"] == kind, n["n_children"])
        return chunk(held(n["line_start"], end), n["line_start"], end, "yaml_section", F.when(n["key"] == "", n["path"]).otherwise(n["key"]), key=n["key"], path=n["path"], value_type=n["kind"], indent=n["depth"], keys_count=count("mapping"), items_count=count("sequence"))

    def group(i: Column) -> Column:
        first, last = F.get(F.col("__top"), i * 50), F.get(F.col("__top"), F.least(i * 50 + 49, F.size("__top") - 1))
        label = F.concat(F.lit("items["), first["place"].cast("string"), F.lit("-"), last["place"].cast("string"), F.lit("]"))
        return chunk(held(first["line_start"], last["line_end"]), first["line_start"], last["line_end"], "yaml_sequence_slice", label, start_index=first["place"], end_index=last["place"], items_count=last["place"] - first["place"] + 1)

    whole = lambda kind: F.array(chunk(F.col(text), F.lit(1), F.size("__l"), kind, title_name(path), yaml_type=F.when(F.lit(kind == "yaml_document"), F.col("__root.kind"))))
    parts = F.transform(F.filter("__top", matters), section)
    groups = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("__top") / 50).cast("int") - 1, F.lit(0))), group)
    many = F.size("__top")
    chunks = F.when(F.col("__broken"), whole("yaml_invalid")).when((F.col("__root.kind") == "mapping") & (many > 3), parts).when((F.col("__root.kind") == "sequence") & (many > 5), groups).otherwise(whole("yaml_document"))
    found = found.withColumn("__chunks", chunks)
    found = found.withColumn("__chunks", F.when(F.size("__chunks") > 0, F.col("__chunks")).otherwise(whole("yaml_document")))
    return exploded(found, rest, F.col("__chunks"), "chunk_index", "c").select(*rest, "chunk_index", "c.*")
