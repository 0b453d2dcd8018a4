"""Records of large CSV files: read by lines in byte ranges, joined where quotes stay open.

A line begins a record where the number of quotes before it is even. That number
is a prefix sum: over the lines of a byte range, and over the ranges of a file,
so that one file spreads over as many tasks as it has ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.storage import drop, written


def csv_records(spark: SparkSession, path: str | list[str], keep_header: bool = False) -> DataFrame:
    """(file, block, number, record): each record as text, without line ends around it; blank lines are none.

    ``block`` is where the byte range begins in which a record begins, and
    ``number`` its place there, so that both give a file's order. A file's first
    record is left out unless ``keep_header``. A quote without a partner joins
    all that follows it to the next one, as readers of CSV do.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    lines = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = written(lines.withColumn("quotes", quotes), "csv_lines")  # ranges and places stay as they were read
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = lines.groupBy("file", "block").agg(F.sum("quotes").alias("n")).withColumn("carry", F.coalesce(F.sum("n").over(earlier), F.lit(0)) % 2).drop("n")
    inside = Window.partitionBy("file", "block").orderBy("at")
    before = F.col("carry") + F.coalesce(F.sum("quotes").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = lines.join(sums, ["file", "block"]).withColumn("before", before).withColumn("starts", F.col("before") % 2 == 0)
    marked = written(marked.withColumn("number", F.sum(F.col("starts").cast("long")).over(inside)).drop("carry"), "csv_marked")
    drop(lines)
    single = F.col("starts") & (F.col("quotes") % 2 == 0)
    # lines before a range's first record belong to the last record of the nearest earlier range that has any
    ranges = marked.groupBy("file", "block").agg(F.max("number").alias("n"))
    owner = F.last(F.when(F.col("n") > 0, F.struct("block", "n")), ignorenulls=True).over(earlier)
    owners = ranges.withColumn("owner", owner).drop("n")
    long = marked.where(~single).join(owners, ["file", "block"])
    continued = F.col("number") == 0
    line = F.struct("block", "at", "value").alias("line")
    long = long.select("file", F.when(continued, F.col("owner.block")).otherwise(F.col("block")).alias("first"), F.when(continued, F.col("owner.n")).otherwise(F.col("number")).alias("number"), line)
    joined = long.groupBy("file", F.col("first").alias("block"), "number").agg(F.array_join(F.transform(F.sort_array(F.collect_list("line")), lambda x: x["value"]), "\n").alias("record"))
    every = marked.where(single).select("file", "block", "number", F.col("value").alias("record")).unionByName(joined)
    every = every.withColumn("record", F.regexp_replace("record", r"\r\z", ""))
    if not keep_header:
        every = every.where("not (block = 0 and number = 1)")
    return every.where("record <> ''")


def csv_fields(records: DataFrame, n: int, record: str = "record") -> DataFrame:
    """``records`` with ``fields``, the first ``n`` cells of each as an array, shorter for records with fewer cells."""
    schema = ", ".join(f"c{i} string" for i in range(n))
    options = {"mode": "PERMISSIVE", "escape": '"', "ignoreLeadingWhiteSpace": "true", "maxCharsPerColumn": "-1"}
    # the reader gives null for missing and for empty cells alike; commas outside of quotes tell how many there are
    parts = F.transform(F.split(F.col(record), '"', -1), lambda p, i: F.when(i % 2 == 0, F.length(p) - F.length(F.replace(p, F.lit(","), F.lit("")))).otherwise(0))
    commas = F.aggregate(parts, F.lit(0), lambda s, k: s + k)
    listed = F.transform(F.array(F.from_csv(F.col(record), schema, options)), lambda c: F.array(*(F.coalesce(c[f"c{i}"], F.lit("")) for i in range(n))))[0]  # parsed once
    return records.withColumn("fields", F.slice(listed, F.lit(1), F.least(F.lit(n), commas + 1)))
