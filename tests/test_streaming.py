"""Run events as a stream give what the batch gives; the sink keeps every event once."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreweave.streaming import runs


def events(spark, folder, n=60):
    rows = [(k, 60.0 * k, k % 5, "click" if k % 3 else "error", float(k)) for k in range(n)]
    df = spark.createDataFrame(rows, "event_id long, s double, user_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.repartition(6).write.parquet(folder)
    return df


def test_status_of_a_folder_of_files(spark, tmp_path):
    batch = events(spark, str(tmp_path / "in"))
    stream = runs.current(runs.read_events(spark, str(tmp_path / "in"), 2), "user_id", "event_type", "ts", "event_id")
    q = stream.writeStream.format("memory").queryName("status").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = {tuple(r) for r in runs.current(batch, "user_id", "event_type", "ts", "event_id").collect()}
    assert {tuple(r) for r in spark.table("status").collect()} == want


def test_windows_close_behind_the_watermark(spark, tmp_path):
    batch = events(spark, str(tmp_path / "in"))
    stream = runs.windowed(runs.read_events(spark, str(tmp_path / "in"), 1), "10 minutes", "1 hour", "event_type")
    q = stream.writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = {tuple(r) for r in runs.windowed(batch, "10 minutes", "1 hour", "event_type").collect()}
    assert {tuple(r) for r in spark.table("windows").collect()} <= want


def test_retention_sink(spark, tmp_path):
    events(spark, str(tmp_path / "in"))
    q = runs.retention(runs.read_events(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"), "1 second")
    q.processAllAvailable()
    q.stop()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.select("event_id").distinct().count() == 60 and "day" in out.columns


def test_settled_status_stays_out_of_the_driver(spark, tmp_path):
    batch = events(spark, str(tmp_path / "in"))
    stream = runs.current(runs.read_events(spark, str(tmp_path / "in"), 2), "user_id", "event_type", "ts", "event_id")
    out = runs.settled(stream, "user_id", str(tmp_path / "out"), str(tmp_path / "c"))
    want = {tuple(r) for r in runs.current(batch, "user_id", "event_type", "ts", "event_id").collect()}
    assert out.columns == stream.columns and sorted(map(tuple, out.collect())) == sorted(want)
    assert len(list((tmp_path / "out").glob("part=*"))) >= 3


def test_the_query_keeps_no_table_in_the_driver(spark, sf):
    from loreweave.queries.runs import run_status_stream

    rows = run_status_stream(spark, sf)
    assert rows.inputFiles() and not [t for t in spark.catalog.listTables() if t.name.startswith("run_status")]
