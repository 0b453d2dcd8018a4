"""Tables in the folder that a cluster's driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Removes an execution's shuffle files when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    A session on one machine may leave it unset and gets a local folder; a
    cluster may not, as its executors couldn't read each other's tables.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="folio-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again, in a folder for each value of ``by``.

    It cuts lineage: a lost executor costs the tasks of the later stages only,
    and a table that several branches read is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folio/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    try:
        spark.conf.set(_CLEAN, "true")  # the table stands in for the shuffles that led to it
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``written`` made and that nothing reads any more."""
    for df in tables:
        spark, own = df.sparkSession, f"{shared_dir(df.sparkSession)}/folio/"
        for table in {own + f.split(own, 1)[1].split("/", 1)[0] for f in df.inputFiles() if own in f}:  # the folder of the whole table
            path = spark._jvm.org.apache.hadoop.fs.Path(table)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
