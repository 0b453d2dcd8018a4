"""Incremental ingest of a file tree: new files are chunked in micro-batches and handed to a sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folio.functions.text import repaired
from folio.sources.files import MAX_FILE, is_wanted
from folio.sources.registry import Registry, default_registry
from folio.storage import drop

_FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, root: str, files_per_batch: int = 256, max_file: int = MAX_FILE, **filters) -> DataFrame:
    """(path, text, length, modificationTime) of text files as they appear under ``root``."""
    raw = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(root)
    return raw.where(is_wanted("path", "length", max_file=max_file, **filters)).select("path", repaired("content").alias("text"), "length", "modificationTime")


def ingest(spark: SparkSession, root: str, sink: Callable[[DataFrame, int], None], checkpoint: str, registry: Registry | None = None, **options) -> StreamingQuery:
    """Chunks files as they appear and calls ``sink(chunks, batch number)``; an error in the sink stops the query.

    The checkpoint remembers which files are done, so that a restart goes on
    where it stopped. A batch may be handed over again after a failure: sinks
    write by key or by batch number.
    """
    parsers = registry or default_registry()

    def batch(files: DataFrame, n: int) -> None:
        dealt = parsers.deal(files)
        chunks = parsers.chunk_dealt(dealt)
        try:
            sink(chunks, n)
        finally:
            drop(chunks)  # the files and their chunks

    return stream_files(spark, root, **options).writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()


def table_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to a part of a Parquet table of its own, named by the batch number.

    A batch that is handed over again, whole or in part, takes the place of its
    first writing, so that each chunk is in the table once.
    """

    def write(chunks: DataFrame, n: int) -> None:
        chunks.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={n}")

    return write


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events by type and time window, closed once the watermark has passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
