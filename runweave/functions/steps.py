"""Tables that a job of many steps keeps on its way, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; only on a local master, where that is unset, a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp"))
    return sc.getCheckpointDir()


class Steps:
    """Stores tables and removes them: a table that is stored under a name takes the place of the one before it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.named = spark, {}

    def kept(self, df: DataFrame, name: str | None = None) -> DataFrame:
        """`df` read again from where it is stored: its lineage ends, and lost executors don't matter."""
        path = f"{shared_folder(self.spark)}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        before = self.named.get(name)
        if name:
            self.named[name] = path
        if before:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(before)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        return self.spark.read.schema(df.schema).parquet(path)

    def freed(self) -> None:
        """What was shuffled for tables stored so far goes now, not when the driver happens to collect its garbage."""
        self.spark.sparkContext._jvm.System.gc()
