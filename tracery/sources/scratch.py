"""Tables that cut lineage, in the folder of spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root_of(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where it is unset, a local session gets a temporary one; on a cluster that is an error, since executors don't share their disks."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tracery-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def folder(spark: SparkSession) -> str:
    return f"{root_of(spark)}/tables-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from a table just written."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
