"""Helpers that the training-data operators share."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The class [\x20\x09-\x0D] as characters.
SPACES = " \t\n\x0b\x0c\r"
#: A maximal run of other characters, as a Java pattern.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a session on one machine (tests) gets a temporary one; a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loreweave-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, and any executor can read it after a loss."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(name: str, columns: list[str]) -> str:
    """name with as many underscores in front as it takes to differ from all columns, whatever their case."""
    while name.lower() in (c.lower() for c in columns):
        name = f"_{name}"
    return name


def row_hash(values: list[Column]) -> Column:
    """128 bits over values and over which of them are null."""
    flagged = [x for v in values for x in (v.isNull(), v)]
    return F.struct(F.xxhash64(F.lit(1), *flagged).alias("a"), F.xxhash64(F.lit(2), *flagged).alias("b"))


def hashed_rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a hash of all columns, the same wherever a row is read again, and that column's name, which docs doesn't have."""
    name = fresh("row", docs.columns)
    nested = {"ignoreNullFields": "false"}
    return docs.withColumn(name, row_hash([F.to_json(quoted(c), nested) if "<" in t else quoted(c) for c, t in docs.dtypes])), name


def distinct_rows(rows: DataFrame) -> DataFrame:
    """rows once each, compared on every column. A table dealt by a hash among its columns is not dealt again."""
    count = fresh("count", rows.columns)
    return rows.groupBy(*map(quoted, rows.columns)).agg(F.count("*").alias(count)).drop(count)


def without_dropped(rows: DataFrame, name: str, verdicts: DataFrame) -> DataFrame:
    """rows (with their hash `name`) without those that verdicts (row: the hash, kept) drop, each once, without the hash.

    A hash goes only if no row of that hash is kept. So rows that share one by chance all stay, and none is lost.
    """
    gone = verdicts.groupBy("row").agg(F.bool_or("kept").alias("kept")).where(~F.col("kept")).select(F.col("row").alias(name))
    return distinct_rows(rows.join(gone, name, "left_anti")).drop(name)


def tick(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def quoted(name: str) -> Column:
    return F.col(tick(name))


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """All rows, or about 96 % of `most` of them chosen by a hash of the key; what reaches one place is bounded whatever the number
    of tasks, and which rows are chosen depends on the keys alone. Rows that share a key come or go together."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 32)) < int(0.96 * most / n * (1 << 32)))


def literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from the driver as one literal, so that no Python worker has to start for it."""
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


_kept: dict = {}


def kept(key, make):
    """What a Python worker keeps between tasks: the thing last asked for, and nothing else."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_of(name: str = "text") -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
