"""Tables that a plan reads more than once are written once, into the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a session of one machine gets a temporary folder where it is unset, a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="hearthline-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back: its lineage ends here, and a lost executor loses nothing of it."""
    path = f"{shared_folder(df.sparkSession)}/hearthline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by its keys over all cores, twice as many parts: a small file of many rows is read by few tasks, which dear expressions would then stay in."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, *keys)
