"""Files of a tree as rows, filtered by directory, extension and size before their content is decoded."""

from __future__ import annotations

import contextlib
import re
import shutil
import subprocess
import tempfile
from collections.abc import Iterator, Sequence
from pathlib import Path
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions.text import col, extension, repaired
from folio.sources.csvfiles import csv_fields, csv_records
from folio.storage import written

#: Directories that are never read.
SKIPPED_DIRS = (".git", ".svn", ".hg", "vendor", "node_modules", "__pycache__", "build", "dist", "target", "out", "bin", ".vscode", ".idea", ".vs", ".DS_Store", "Thumbs.db")
#: Extensions of files that hold no text.
BINARY = (
    ".exe", ".dll", ".so", ".dylib", ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tiff", ".svg", ".ico", ".zip", ".tar", ".gz", ".rar", ".7z", ".bz2", ".xz",
    ".mp3", ".mp4", ".avi", ".mov", ".wav", ".flac", ".ogg", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".bin", ".dat", ".db", ".sqlite",
)
MAX_FILE = 10 * 1024 * 1024


def _dotted(names: Sequence[str]) -> list[str]:
    return [("" if n.startswith(".") else ".") + n.lower() for n in names]


def in_skipped_dir(path: str | Column, more: Sequence[str] = ()) -> Column:
    parts = F.split(col(path), "/", -1)
    return F.arrays_overlap(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*(F.lit(d) for d in (*SKIPPED_DIRS, *more))))


def is_wanted(path: str | Column, length: str | Column, include: Sequence[str] = (), exclude: Sequence[str] = (), more_dirs: Sequence[str] = (), max_file: int = MAX_FILE) -> Column:
    """The loader's test of a file; with an include list the exclude list doesn't count."""
    ext = F.lower(extension(path))
    listed = ext.isin(_dotted(include)) if include else ~ext.isin(_dotted(exclude)) if exclude else F.lit(True)
    return ~in_skipped_dir(path, more_dirs) & (col(length) <= max_file) & ~ext.isin(list(BINARY)) & listed


def scan(spark: SparkSession, root: str, include: Sequence[str] = (), exclude: Sequence[str] = (), more_dirs: Sequence[str] = (), max_file: int = MAX_FILE, total_budget: int | None = None) -> DataFrame:
    """(path, text, length, modificationTime) of a tree's text files; path is relative to ``root``.

    The tests of path and length reach the file list, so that only files that
    pass them are opened; those in skipped directories never are.
    ``total_budget`` keeps files, in path order, while their sizes add up to no
    more; it needs the sums of ranges of the file list and is off by default.
    """
    if not root:
        raise ValueError("a path is needed")
    found = _listed(spark, root).where(_passing(root, include, exclude, more_dirs, max_file))
    relative = _relative(F.col("path"), root)
    found = found.withColumn("path", relative).where(is_wanted("path", "length", include, exclude, more_dirs, max_file))
    if total_budget is not None:
        within = names(spark, root, include, exclude, more_dirs, max_file).select("path", "length")
        found = found.join(_within_budget(within, total_budget), "path", "left_semi")
    return found.select("path", repaired("content").alias("text"), "length", "modificationTime")


def names(spark: SparkSession, root: str, include: Sequence[str] = (), exclude: Sequence[str] = (), more_dirs: Sequence[str] = (), max_file: int = MAX_FILE) -> DataFrame:
    """(path, length, modificationTime) of the files that ``scan`` would read; none is opened."""
    found = _listed(spark, root).where(_passing(root, include, exclude, more_dirs, max_file)).withColumn("path", _relative(F.col("path"), root))
    return found.where(is_wanted("path", "length", include, exclude, more_dirs, max_file)).select("path", "length", "modificationTime")


def _listed(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).load(root)


def _relative(path: Column, root: str) -> Column:
    base = re.sub(r"\A[a-z][a-z0-9+.-]*:/*(?=/)", "", root.rstrip("/"))
    return F.regexp_replace(F.element_at(F.split(path, rf"\Q{base}/\E", 2), -1), r"\A/+", "")


def _passing(root: str, *tests) -> Column:
    """The test of a file on what its listing says alone, so that Spark drops files before it opens any."""
    path = _relative(F.col("_metadata.file_path"), quote(root, safe="/:@!$&'()*+,;=~"))
    return is_wanted(path, F.col("_metadata.file_size"), *tests)


def _within_budget(names: DataFrame, total: int) -> DataFrame:
    """Paths, in order, whose sizes add up to ``total`` at most: sums of ranges of paths first, then sums within each range."""
    spark = names.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = names.repartitionByRange(width, "path").withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "file-sizes")
    sums = ranged.groupBy("part").agg(F.sum("length").alias("size"))  # a row for each range
    offsets = sums.withColumn("offset", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.sum("length").over(Window.partitionBy("part").orderBy("path"))
    return ranged.join(F.broadcast(offsets), "part").withColumn("sum", F.col("offset") + within).where(F.col("sum") <= total).select("path")


@contextlib.contextmanager
def cloned(url: str, ref: str | None = None) -> Iterator[str]:
    """A shallow clone in a folder of the driver that goes afterwards; read it out, or copy it to shared storage, inside."""
    folder = tempfile.mkdtemp(prefix="folio-clone-")
    try:
        subprocess.run(["git", "clone", "--depth", "1", *(["--branch", ref] if ref else []), "--", url, folder], check=True, capture_output=True)
        yield folder
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def read_repository(spark: SparkSession, url: str, ref: str | None = None, **filters) -> DataFrame:
    """A remote repository's text files with ``original_source_url``. The clone is read on the driver, as it is local to it."""
    with cloned(url, ref) as folder:
        rows = []
        for p in sorted(Path(folder).rglob("*")):
            if p.is_file() and ".git" not in p.relative_to(folder).parts and p.stat().st_size <= filters.get("max_file", MAX_FILE):
                rows.append((str(p.relative_to(folder)), p.read_bytes(), p.stat().st_size))
        raw = spark.createDataFrame(rows, "path string, content binary, length long")
    wanted = {k: v for k, v in filters.items() if k in ("include", "exclude", "more_dirs", "max_file")}
    return raw.where(is_wanted("path", "length", **wanted)).select("path", repaired("content").alias("text"), "length", F.lit(url).alias("original_source_url"))


def command_output(spark: SparkSession, command: Sequence[str], timeout: float = 600.0) -> DataFrame:
    """One document: what a command prints. Only the base name of the command is run, found by the search path."""
    name = Path(command[0]).name
    done = subprocess.run([name, *command[1:]], capture_output=True, check=True, timeout=timeout)
    return spark.createDataFrame([(name, done.stdout.decode("utf-8", "replace"))], "source string, text string")


def evaluation_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of evaluation files of eight columns or more; those with a bad id or too few columns are left out.

    ``place`` orders the rows as their file does. A file of any size is read by
    as many tasks as it has byte ranges.
    """
    rows = csv_fields(csv_records(spark, path), 8)
    cell = lambda i: F.get(F.col("fields"), F.lit(i))
    query = F.trim(cell(0)).try_cast("int")
    place = F.struct("file", "block", "number").alias("place")
    return rows.where((F.size("fields") >= 8) & query.isNotNull()).select(
        query.alias("query_id"), F.trim(cell(1)).alias("query_text"), F.trim(cell(3)).alias("ground_truth_answer"), F.coalesce(F.trim(cell(6)).try_cast("int"), F.lit(0)).alias("is_selected"), F.trim(cell(7)).alias("relevant_passage"), place
    )
