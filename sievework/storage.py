"""Tables between the steps of an operator, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only where it is unset and driver and executors are one process (tests) is a folder made."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("sievework.scratch", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("sievework.scratch", at)
    return at.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once as Parquet in the shared folder: steps after it neither repeat it nor lose it with an executor."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
