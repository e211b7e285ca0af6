"""Run events as a stream: the current status of every run, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """Parquet event files, a folder of them or a single one, as a stream with ts as a timestamp."""
    batch = spark.read.parquet(path)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", files_per_trigger)
    if batch.inputFiles()[:1] and batch.inputFiles()[0].rstrip("/").endswith(path.rstrip("/").rpartition("/")[2]):  # a single file: its folder, by its name
        folder, _, name = path.rstrip("/").rpartition("/")
        stream, path = stream.option("pathGlobFilter", name), folder
    return stream.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def current(events: DataFrame, key: str, status: str, *order: str) -> DataFrame:
    """Batch or stream: each key's newest status and number of events. State is one small row per key."""
    return events.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias("status"), F.count("*").alias("events"))


def settled(stream: DataFrame, key: str, target: str, checkpoint: str) -> DataFrame:
    """Runs a fold until all that is there is read. Each batch's changed rows are written to target by tasks; a key's last one counts."""
    schema = stream.withColumn("batch", F.lit(0).cast("long")).schema

    def write(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{target}/part={batch}")

    going = stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    going.awaitTermination()
    spark = stream.sparkSession
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{target}/part=-1")  # a stream without files has no batch
    rows = spark.read.schema(schema).parquet(target)
    last = rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*stream.columns), "batch").alias("_last"))
    return last.select("_last.*")


def windowed(events: DataFrame, length: str, late: str, *by: str) -> DataFrame:
    """Events per window and group; in a stream, windows close `late` behind the newest event."""
    marked = events.withWatermark("ts", late)
    counts = marked.groupBy(F.window("ts", length).alias("w"), *by).agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").alias("window_start"), *by, "events", "total")


def retention(source: DataFrame, target: str, checkpoint: str, every: str = "300 seconds") -> StreamingQuery:
    """Appends events to target, as Parquet by day, at every trigger; exactly once by the sink's log."""
    days = source.withColumn("day", F.to_date("ts"))
    return days.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).partitionBy("day").trigger(processingTime=every).start()
