"""Tables that a job writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def path_of(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made, made.getFileSystem(spark._jsc.hadoopConfiguration())


def folder(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir, removed when the driver ends; a temporary one where that is unset on a local master, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="quillstone-")
        spark.sparkContext.setCheckpointDir(named)
    path = f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    made, fs = path_of(spark, path)
    fs.deleteOnExit(made)
    return path


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """df written to the shared folder and read again: several readers don't compute it again, nor does a lost executor."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
