"""Intermediate tables in the folder that spark.checkpoint.dir names, which all executors share."""

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's setting; where it is unset, a temporary folder of a local session, and an error on a cluster, whose executors share none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is to name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='convoke-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


class Scratch:
    """Tables of one run of an operator. write() cuts lineage: a lost executor repeats only what was not yet written. They are deleted when the application ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{checkpoint_dir(spark)}/convoke-{name}-{uuid.uuid4().hex}"
        self.marked = False

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        schema = df.schema
        df.write.option("compression", "zstd").parquet(path)
        if not self.marked:
            base = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
            self.marked = base.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(base)
        self.release()
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Lets Spark's cleaner remove the shuffle files of finished jobs, which otherwise stay until the driver happens to collect its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
