"""Queries of run events, status folds, retention and control-plane checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.operators import answering, control, uploads
from loreweave.queries import query
from loreweave.sources.shared import shared_path
from loreweave.sources.tables import table
from loreweave.streaming import runs


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT user_id, max_by(event_type, (ts, event_id)) AS status, count(*) AS events FROM events GROUP BY user_id")
def run_status_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.current(events(spark, sf_dir), "user_id", "event_type", "ts", "event_id")


@query("SELECT user_id, event_type, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.latest(events(spark, sf_dir).select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("""WITH i AS (SELECT o_custkey AS plan, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'FAILED' ELSE 'RUNNING' END AS status FROM orders),
    c AS (SELECT plan, count(*) AS items, count_if(status = 'COMPLETED') AS completed, count_if(status = 'FAILED') AS failed FROM i GROUP BY plan)
    SELECT *, CASE WHEN items > completed + failed THEN 'RUNNING' WHEN failed = 0 THEN 'COMPLETED' WHEN completed = 0 THEN 'FAILED' ELSE 'PARTIAL' END AS status FROM c""")
def plan_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return control.status_summary(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("plan"), F.when(s == "F", "COMPLETED").when(s == "O", "FAILED").otherwise("RUNNING").alias("status")), "plan")


@query("SELECT event_id, ts FROM events WHERE ts <= TIMESTAMP '2024-01-15' ORDER BY ts, event_id LIMIT 200")
def retention_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    import datetime

    return uploads.expired(table(spark, sf_dir, "events"), datetime.datetime(2024, 1, 15), 200, "ts", "event_id").select("event_id", "ts")


@query("SELECT event_id FROM events WHERE event_type = 'click' AND event_id % 12 <= 10 ORDER BY ts, event_id LIMIT 100")
def storage_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "click", "PENDING").otherwise("COMPLETED").alias("status"), (F.col("event_id") % 12).alias("attempts"), F.col("ts").alias("created_at"))
    return uploads.pending(rows).select(F.col("id").alias("event_id"))


@query("""SELECT s_suppkey AS schema_id, CASE WHEN bool_or(c_custkey % 4 = 0) THEN 'ACTIVE' ELSE 'INACTIVE' END AS status FROM supplier LEFT JOIN customer ON c_custkey % 97 = s_suppkey GROUP BY s_suppkey""")
def schema_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 97).alias("schema_id"), (F.col("c_custkey") % 4 == 0).alias("active"))
    return control.schema_status(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("schema_id")), links)


@query("SELECT c_nationkey AS kb, count_if(c_acctbal > 5000) AS active_schemas FROM customer GROUP BY kb HAVING active_schemas > 1")
def several_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.several_active(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("kb"), (F.col("c_acctbal") > 5000).alias("active")))


@query("SELECT c_custkey AS kb FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def deletable_knowledge_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.deletable(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("kb")), table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("kb")))


@query("""WITH d AS (SELECT p_brand AS name, CAST(min(p_size) AS VARCHAR) AS def FROM part GROUP BY p_brand), a AS (SELECT p_type AS alias, min(p_brand) AS name FROM part GROUP BY p_type),
    o AS (SELECT p_name AS name, CAST(p_partkey AS VARCHAR) AS value FROM part WHERE false UNION ALL SELECT p_brand, CAST(max(p_partkey) AS VARCHAR) FROM part WHERE p_brand LIKE '%1' GROUP BY p_brand UNION ALL SELECT p_type, CAST(max(p_size) AS VARCHAR) FROM part GROUP BY p_type)
    SELECT d.name, coalesce(own.value, (SELECT min(o.value) FROM a JOIN o ON o.name = a.alias WHERE a.name = d.name), def) AS value FROM d LEFT JOIN o own ON own.name = d.name""")
def effective_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as settings, types as their old names."""
    part = table(spark, sf_dir, "part")
    defaults = part.groupBy(F.col("p_brand").alias("name")).agg(F.min("p_size").cast("string").alias("default"))
    aliases = part.groupBy(F.col("p_type").alias("alias")).agg(F.min("p_brand").alias("name"))
    own = part.where("p_brand like '%1'").groupBy(F.col("p_brand").alias("name")).agg(F.max("p_partkey").cast("string").alias("value"))
    return control.effective_settings(defaults, aliases, own.unionByName(part.groupBy(F.col("p_type").alias("name")).agg(F.max("p_size").cast("string").alias("value"))))


@query("""WITH x AS (SELECT c_custkey AS change_id, CASE c_custkey % 3 WHEN 0 THEN 'CREATE' WHEN 1 THEN 'UPDATE' ELSE 'DELETE' END AS action, c_nationkey + CASE WHEN c_custkey % 7 = 2 THEN 40 ELSE 0 END AS schema_id, 'n' || (c_nationkey + CASE WHEN c_custkey % 7 = 2 THEN 40 ELSE 0 END + (c_custkey % 4 = 1)::INT) AS name, c_custkey % 2 AS version FROM customer),
    s AS (SELECT n_nationkey AS schema_id, 'n' || n_nationkey AS name, n_regionkey % 2 AS version, n_nationkey % 6 = 0 AS used FROM nation)
    SELECT change_id, CASE WHEN action = 'CREATE' THEN CASE WHEN (x.name, x.version) IN (SELECT (name, version) FROM s) THEN 'ALREADY_EXISTS' END WHEN s.name IS NULL THEN 'NOT_FOUND' WHEN used THEN 'ACTIVE' WHEN action = 'UPDATE' AND (s.name <> x.name OR s.version <> x.version) THEN 'IDENTITY_CHANGED' END AS problem
    FROM x LEFT JOIN s USING (schema_id) WHERE problem IS NOT NULL""")
def schema_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey") + F.when(F.col("c_custkey") % 7 == 2, 40).otherwise(0)
    changes = table(spark, sf_dir, "customer").select(k.alias("change_id"), F.when(k % 3 == 0, "CREATE").when(k % 3 == 1, "UPDATE").otherwise("DELETE").alias("action"), n.alias("schema_id"), F.concat(F.lit("n"), (n + (k % 4 == 1).cast("int")).cast("string")).alias("name"), (k % 2).cast("int").alias("version"))
    nation = table(spark, sf_dir, "nation")
    schemas = nation.select(F.col("n_nationkey").alias("schema_id"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("name"), (F.col("n_regionkey") % 2).alias("version"))
    return control.schema_change_violations(changes, schemas, nation.select(F.col("n_nationkey").alias("schema_id"), (F.col("n_nationkey") % 6 == 0).alias("active")))


@query("SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'FAILED' ELSE 'INTERRUPTED' END AS status FROM orders")
def restart_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return control.interrupted(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(s == "F", "FAILED").when(s == "O", "RUNNING").otherwise("QUEUED").alias("status")))


@query("""SELECT doc_id, list_filter([CASE WHEN upper(text) LIKE '%DELETE%' THEN 'DELETE' END, CASE WHEN upper(text) LIKE '%SET%' THEN 'SET' END, CASE WHEN upper(text) LIKE '%CALL%' THEN 'CALL' END], lambda x: x IS NOT NULL) AS keywords FROM documents""")
def forbidden_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", control.forbidden_keywords(F.col("text"), ["DELETE", "SET", "CALL"]).alias("keywords"))


@query("""SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'CANCELLED' WHEN sum(value) < 500 THEN 'NO_CONCRETE_GAP' WHEN count(*) < 60 THEN 'DEADLINE_RESERVE' ELSE 'RUN' END AS follow_up FROM events GROUP BY user_id""")
def follow_up_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = events(spark, sf_dir).groupBy("user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("cancelled"), F.when(F.sum("value") < 500, F.array(F.lit(" "))).otherwise(F.array(F.lit("gap"))).alias("gaps"), F.count("*").alias("remaining_ms"), F.array(F.lit("r")).alias("refinements"))
    return answering.follow_up(own, 60).select("user_id", "follow_up")


@query("""SELECT 'settings' AS code, CAST(p_partkey AS VARCHAR) AS subject FROM part WHERE p_size > 48 UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal < 0""")
def publication_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "part").where("p_size > 48").select(F.col("p_partkey").alias("subject"))
    return control.readiness(settings=big, supplier=table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("subject")))


@query("SELECT CAST(time_bucket(INTERVAL '1 day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS events, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def run_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.windowed(events(spark, sf_dir), "1 day", "1 hour", "event_type")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "events", F.round("total", 6).alias("total"))


@query("SELECT user_id, max_by(event_type, (ts, event_id)) AS status, count(*) AS events FROM events GROUP BY user_id")
def run_status_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fold as a stream over the event files, until all that is there is read; changed rows go to the shared folder."""
    stream = runs.current(runs.read_events(spark, f"{sf_dir.rstrip('/')}/events.parquet"), "user_id", "event_type", "ts", "event_id")
    folder = shared_path(spark, "run_status")
    return runs.settled(stream, "user_id", f"{folder}/rows", f"{folder}/log")
