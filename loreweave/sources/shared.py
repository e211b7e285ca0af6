"""Tables written to the folder that the cluster shares, where a plan reads one twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir. Only a session on one machine (tests) may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loreweave-"))
        found = spark.sparkContext.getCheckpointDir()
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df in as many partitions as a shuffle has, since a file may come in few parts that take long."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of the shared folder: computed once, and there for any executor after a loss."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
