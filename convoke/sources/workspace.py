"""Folders that the driver and all executors share, for what a query has to write and read again."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; under a temporary folder only where that is unset and the session is local. It goes when the application ends."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is to name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='convoke-')}"
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base}/convoke-{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written and read again: what comes after doesn't compute them anew."""
    path = f"{shared_folder(spark, name)}/rows"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
