"""Written tables between the stages of a plan."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Workspace:
    """A folder of written tables under the one that the cluster names in spark.checkpoint.dir.

    A stage that several later ones read is written once: that survives lost executors, and later plans start from a
    scan, so that they stay small. Only a local session may lack the setting; it then gets a temporary folder.
    """

    def __init__(self, spark: SparkSession):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            root = f"file://{tempfile.mkdtemp(prefix='factloom-')}"
            spark.conf.set("spark.checkpoint.dir", root)
        self.spark, self.path = spark, f"{root.rstrip('/')}/factloom-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def close(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
