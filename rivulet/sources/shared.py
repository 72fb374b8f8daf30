"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path below ``spark.checkpoint.dir``. Only where that is unset on a single machine (in tests) a temporary folder takes its place."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="rivulet-")
    return f"{folder}/{purpose}-{uuid.uuid4().hex}"


def kept(df: DataFrame, purpose: str = "table") -> DataFrame:
    """``df`` as a table in the shared folder, read again: computed once however often it is used, independent of executors and without its lineage."""
    spark = df.sparkSession
    df.write.parquet(path := shared_folder(spark, purpose))
    return spark.read.schema(df.schema).parquet(path)
