"""Tables that a job writes for its own later steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir where it is set, else a temporary folder in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="lensmill-")


def stored(df: DataFrame, tag: str, *by: str) -> DataFrame:
    """df written to the shared folder and read again; a filter on columns of ``by`` reads their folders alone."""
    path = f"{shared_folder(df.sparkSession)}/lensmill/{tag}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_blocks(df: DataFrame, *order: Column | str, tag: str = "blocks") -> DataFrame:
    """df stored with ``part``: the number of the range of the order that a row is in. Ranges hold about as many rows each."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), tag)
