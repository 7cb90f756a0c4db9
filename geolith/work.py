"""Work tables in the folder that the cluster shares (``spark.checkpoint.dir``): they cut lineage and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder.  Where none is named and all runs in one process (tests), a temporary one is set and used; on
    a cluster that is an error, as executors do not see one another's disks."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not found.isDefined() and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = found.get() if found.isDefined() else "file://" + tempfile.mkdtemp(prefix="geolith-work-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def file_system(spark: SparkSession, path: str) -> tuple:
    """(Hadoop's file system of ``path``, the path)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


def deleted(spark: SparkSession, path: str) -> None:
    """A table that nothing will read again."""
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``stored``, and where."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = file_system(spark, path)
    fs.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again; the table goes when the driver ends."""
    return stored_at(df, name)[0]
