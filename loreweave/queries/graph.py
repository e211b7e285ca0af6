"""Queries of graph plans, fact writes and their sanitising."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.functions import identity
from loreweave.operators import graph, ranking
from loreweave.plans.graphplan import Aggregate, Compare, GraphPlan, Hop, Junction, Order, Project, match, run, supported
from loreweave.queries import query
from loreweave.sources.tables import SalesGraph, table


@query("""SELECT o_orderkey AS order_key, c_name AS customer, o_totalprice AS total FROM customer JOIN orders ON o_custkey = c_custkey
    WHERE o_totalprice > 300000 AND c_mktsegment = 'BUILDING' ORDER BY total DESC, order_key LIMIT 100""")
def plan_filter_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = GraphPlan(
        "Customer", (Hop("PLACED", "Order"),), (Compare(1, "total", ">", 300000.0), Compare(0, "segment", "=", "BUILDING")),
        (Project("order_key", 1, "orderkey"), Project("customer", 0, "name"), Project("total", 1, "total")), None, (Order("total", True), Order("order_key")), 100,
    )
    return run(plan, SalesGraph(spark, sf_dir))


@query("""SELECT c_name AS customer, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE c_acctbal >= 9000 ORDER BY customer LIMIT 120""")
def plan_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = GraphPlan(
        "Customer", (Hop("CUSTOMER_IN", "Nation"), Hop("IN_REGION", "Region")), (Compare(0, "acctbal", ">=", 9000.0),),
        (Project("customer", 0, "name"), Project("nation", 1, "name"), Project("region", 2, "name")), None, (Order("customer"),), 120,
    )
    return run(plan, SalesGraph(spark, sf_dir))


@query("SELECT n_name AS nation, s_name AS supplier FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name IN ('NATION_9', 'NATION_7') OR n_nationkey <= 3 ORDER BY nation, supplier LIMIT 200")
def plan_incoming_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = Junction(True, (Compare(0, "name", "IN", ["NATION_9", "NATION_7"]), Compare(0, "nationkey", "<=", 3)))
    plan = GraphPlan("Nation", (Hop("SUPPLIER_IN", "Supplier", incoming=True),), (wanted,), (Project("nation", 0, "name"), Project("supplier", 1, "name")), None, (Order("nation"), Order("supplier")), 200)
    return run(plan, SalesGraph(spark, sf_dir))


@query("SELECT p_partkey AS part_key, p_name AS name FROM part WHERE p_size IN (1, 7, 9) AND contains(p_name, 'ring') AND starts_with(p_brand, 'Brand#1') ORDER BY part_key LIMIT 150")
def plan_in_contains_startswith(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = (Compare(0, "size", "IN", [1, 7, 9]), Compare(0, "name", "CONTAINS", "ring"), Compare(0, "brand", "STARTS WITH", "Brand#1"))
    return run(GraphPlan("Part", (), filters, (Project("part_key", 0, "partkey"), Project("name", 0, "name")), None, (Order("part_key"),), 150), SalesGraph(spark, sf_dir))


@query("""SELECT o_orderkey AS order_key, o_orderstatus AS status FROM orders WHERE (o_orderstatus = 'P' OR (o_totalprice < 20000 AND o_orderpriority <> '5-LOW')) AND o_orderkey > 100
    ORDER BY order_key LIMIT 200""")
def plan_or_junction(spark: SparkSession, sf_dir: str) -> DataFrame:
    cheap = Junction(False, (Compare(0, "total", "<", 20000.0), Compare(0, "priority", "<>", "5-LOW")))
    filters = (Junction(True, (Compare(0, "status", "=", "P"), cheap)), Compare(0, "orderkey", ">", 100))
    return run(GraphPlan("Order", (), filters, (Project("order_key", 0, "orderkey"), Project("status", 0, "status")), None, (Order("order_key"),), 200), SalesGraph(spark, sf_dir))


def _aggregated(function: str, name: str | None):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        plan = GraphPlan("Customer", (Hop("CUSTOMER_IN", "Nation"), Hop("IN_REGION", "Region")), (), (Project("region", 2, "name"),), Aggregate(function, "value", 0, name), (Order("region"),), 50)
        out = run(plan, SalesGraph(spark, sf_dir))
        return out.withColumn("value", F.round("value", 6)) if function in ("SUM", "AVERAGE") else out

    return f


for _function, _name, _sql in (
    ("COUNT", None, "count(*)"), ("COUNT_DISTINCT", "segment", "count(DISTINCT c_mktsegment)"), ("SUM", "acctbal", "round(coalesce(sum(c_acctbal), 0), 6)"),
    ("AVERAGE", "acctbal", "round(avg(c_acctbal), 6)"), ("MINIMUM", "acctbal", "min(c_acctbal)"), ("MAXIMUM", "acctbal", "max(c_acctbal)"),
):
    _f = _aggregated(_function, _name)
    _f.__name__ = f"plan_agg_{_function.lower()}"
    query(f"SELECT r_name AS region, {_sql} AS value FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")(_f)


@query("""WITH p AS (SELECT r_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey ORDER BY c_custkey, n_nationkey, r_regionkey LIMIT 200)
    SELECT r_name AS region, count(*) AS value FROM p GROUP BY r_name""")
def plan_agg_scan_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = GraphPlan("Customer", (Hop("CUSTOMER_IN", "Nation"), Hop("IN_REGION", "Region")), (), (Project("region", 2, "name"),), Aggregate("COUNT", "value"), (Order("region"),), 50)
    return run(plan, SalesGraph(spark, sf_dir), scan_limit=200)


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_returnflag = 'R')
    SELECT o_orderkey AS order_key, p_partkey AS part_key FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey
    WHERE p_size <= 10 AND (l_orderkey, l_partkey) IN (SELECT (o, p) FROM e) AND o_orderkey IN (SELECT o FROM e) AND p_partkey IN (SELECT p FROM e)
    ORDER BY order_key, part_key LIMIT 200""")
def plan_evidence_supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = GraphPlan("Order", (Hop("CONTAINS", "Part"),), (Compare(1, "size", "<=", 10),), (Project("order_key", 0, "orderkey"), Project("part_key", 1, "partkey")), None, (Order("order_key"), Order("part_key")), 200)
    sales = SalesGraph(spark, sf_dir)
    seen = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_partkey")
    element = lambda name, key: seen.select(F.lit(name).alias("element"), key.alias("fact_id"))
    evidence = element("n0", F.col("l_orderkey").cast("string")).union(element("n1", F.col("l_partkey").cast("string"))).union(element("r0", F.concat_ws(":", F.lit("CONTAINS"), "l_orderkey", "l_partkey")))
    return run(plan, sales, supported(match(plan, sales), plan, evidence))


@query("""WITH seeds AS (SELECT o_orderkey AS chunk_id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS seed_rank FROM orders QUALIFY seed_rank <= 10),
    edges AS (SELECT o_custkey AS parent, o_orderkey AS child FROM orders WHERE o_orderstatus <> 'O')
    SELECT CAST(seed_rank AS INTEGER) AS seed_rank, s.chunk_id, coalesce(parent, s.chunk_id) AS evidence_chunk, l_orderkey * 10 + l_linenumber AS evidence_id, l_partkey AS fact_id
    FROM seeds s LEFT JOIN edges ON child = s.chunk_id JOIN lineitem ON l_orderkey = coalesce(parent, s.chunk_id) ORDER BY seed_rank, evidence_id, fact_id LIMIT 40""")
def evidence_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loreweave.operators.retrieval import ranked

    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    seeds = ranked(orders.select(F.col("o_orderkey").alias("chunk_id"), "o_totalprice", F.lit("").alias("subquery")), 10, F.desc("o_totalprice"), F.col("chunk_id")).select(F.col("rank").alias("seed_rank"), "chunk_id")
    edges = orders.where("o_orderstatus <> 'O'").select(F.col("o_custkey").alias("parent"), F.col("o_orderkey").alias("child"))
    evidence = items.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("evidence_id"), F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("fact_id"))
    return ranking.evidence_expansion(seeds, edges, evidence, 40).select("seed_rank", "chunk_id", "evidence_chunk", "evidence_id", "fact_id")


@query("""WITH e AS (SELECT l_partkey AS fact_id, l_suppkey AS chunk_id, l_orderkey * 10 + l_linenumber AS evidence_id FROM lineitem),
    f AS (SELECT fact_id, list_sort(list(citation)) AS citations FROM (SELECT fact_id, chunk_id, min(evidence_id) AS citation FROM e GROUP BY ALL) GROUP BY fact_id)
    SELECT fact_id, list_sort(list(DISTINCT evidence_id)) AS evidence_ids, any_value(citations) AS citations FROM e JOIN f USING (fact_id) GROUP BY fact_id""")
def fact_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.merge_facts(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("fact_id"), F.col("l_suppkey").alias("chunk_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("evidence_id")))


NODE_SQL = "'node:' || sha256('sales' || chr(10) || 'Part' || chr(10) || 'key:partkey=' || length(CAST(l_partkey AS VARCHAR)) || ':' || l_partkey)"


@query(f"""WITH n AS (SELECT {NODE_SQL} AS id, l_suppkey AS supplier, l_orderkey * 10 + l_linenumber AS write_seq FROM lineitem)
    SELECT id, min_by(supplier, write_seq) AS supplier, min(write_seq) AS write_seq FROM n GROUP BY id""")
def fact_upsert_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    seq = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    place = F.struct("_metadata.file_path", "_metadata.row_index")  # line numbers repeat: of those the row that stands first was written first
    nodes = items.select(identity.node_id(F.lit("sales"), F.lit("Part"), partkey=F.col("l_partkey")).alias("id"), F.col("l_suppkey").alias("supplier"), seq.alias("write_seq"), place.alias("place"))
    return graph.first_writer(nodes.where("write_seq % 2 = 0"), nodes.where("write_seq % 2 = 1"), place="place")


@query("""WITH r AS (SELECT DISTINCT l_orderkey AS from_id, l_partkey AS to_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus <> 'F' AND p_size <= 25)
    SELECT 'rel:' || sha256('sales' || chr(10) || 'CONTAINS' || chr(10) || from_id || chr(10) || to_id) AS id, from_id, to_id FROM r""")
def relationship_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("from_id"), F.col("l_partkey").alias("to_id"))
    rels = items.withColumn("write_seq", F.lit(1))
    orders, parts = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("id")), table(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("id"))
    kept = graph.upsert_relationships(rels.where("false"), rels, orders, parts, ("from_id", "to_id"))
    return kept.select(identity.relationship_id(F.lit("sales"), F.lit("CONTAINS"), F.col("from_id"), F.col("to_id")).alias("id"), "from_id", "to_id")


@query("""WITH e AS (SELECT l_orderkey * 10 + l_linenumber AS evidence_id, l_orderkey AS document_id, l_partkey AS fact_id FROM lineitem)
    SELECT evidence_id, fact_id FROM e WHERE document_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def evidence_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("evidence_id"), F.col("l_orderkey").alias("document_id"), F.col("l_partkey").alias("fact_id"))
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("document_id"))
    return graph.without(items, gone, "document_id").select("evidence_id", "fact_id")


@query("SELECT p_partkey AS fact_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-06-01')")
def orphan_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp '2001-06-01'").select(F.col("l_partkey").alias("fact_id"))
    return graph.orphans(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("fact_id")), evidence)


EXTRACTED_SQL = """
    nodes AS (SELECT l_orderkey AS chunk_id, CASE WHEN l_linenumber = 4 THEN 'Ghost' WHEN l_linenumber % 2 = 0 THEN 'Supplier' ELSE 'Part' END AS label,
        CASE WHEN l_linenumber = 5 THEN ' ' ELSE CAST(l_partkey AS VARCHAR) END AS part, CASE WHEN l_suppkey % 9 > 0 THEN l_returnflag END AS flag, CAST(l_suppkey AS VARCHAR) AS supplier, CASE WHEN l_partkey % 2 = 0 THEN 'n' || l_partkey END AS name FROM lineitem),
    kept AS (SELECT chunk_id, label, CASE WHEN label = 'Part' THEN [coalesce(nullif(trim(part), ''), name), coalesce(flag, name)] WHEN label = 'Supplier' THEN [supplier] END AS key_values FROM nodes),
    judged AS (SELECT *, CASE WHEN label = 'Ghost' THEN 'unknown_label' WHEN len(list_filter(key_values, lambda v: v IS NULL)) > 0 THEN 'incomplete_node_key' END AS drop_reason FROM kept)"""


def extracted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Line items as extracted nodes, with unknown labels, composite keys and missing ones; and the schema's keys."""
    n, part = F.col("l_linenumber"), F.col("l_partkey").cast("string")
    name = F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("n"), part))
    props = F.create_map(F.lit("part"), F.when(n == 5, " ").otherwise(part), F.lit("flag"), F.when(F.col("l_suppkey") % 9 > 0, F.col("l_returnflag")), F.lit("supplier"), F.col("l_suppkey").cast("string"), F.lit("name"), name)
    nodes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.when(n == 4, "Ghost").when(n % 2 == 0, "Supplier").otherwise("Part").alias("label"), props.alias("props"))
    keys = spark.createDataFrame([("Part", ["part", "flag"]), ("Supplier", ["supplier"])], "label string, keys array<string>")
    return graph.sanitise_nodes(nodes, keys).select("chunk_id", "label", "key_values", "drop_reason"), keys


@query(f"WITH {EXTRACTED_SQL} SELECT chunk_id, label, key_values, drop_reason FROM judged")
def extraction_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark, sf_dir)[0]


@query(f"""WITH {EXTRACTED_SQL}, good AS (SELECT chunk_id, label, key_values FROM judged WHERE drop_reason IS NULL),
    only_ AS (SELECT chunk_id, label, any_value(key_values) AS kv FROM good GROUP BY ALL HAVING count(*) = 1),
    rels AS (SELECT l_orderkey AS chunk_id, l_linenumber, CASE WHEN l_linenumber = 6 THEN 'OWNS' ELSE 'SUPPLIES' END AS kind, CASE WHEN l_linenumber = 7 THEN 'Ghost' ELSE 'Supplier' END AS from_label,
        CASE WHEN l_linenumber = 3 THEN ' ' WHEN l_linenumber <> 1 THEN CAST(l_suppkey AS VARCHAR) END AS fk, l_linenumber = 1 AS no_from, CASE WHEN l_linenumber IN (2, 3) THEN NULL ELSE CAST(l_partkey AS VARCHAR) END AS t1, CASE WHEN l_suppkey % 9 > 0 THEN l_returnflag END AS t2, l_linenumber = 2 AS no_to FROM lineitem),
    v AS (SELECT r.*, coalesce(nullif(trim(fk), ''), f.kv[1]) AS fv, [coalesce(CASE WHEN no_to THEN NULL ELSE t1 END, t.kv[1]), coalesce(CASE WHEN no_to THEN NULL ELSE t2 END, t.kv[2])] AS tv FROM rels r
        LEFT JOIN only_ f ON f.chunk_id = r.chunk_id AND f.label = from_label LEFT JOIN only_ t ON t.chunk_id = r.chunk_id AND t.label = 'Part'),
    o AS (SELECT CASE WHEN from_label = 'Ghost' THEN 'unknown_endpoint_label' WHEN kind = 'OWNS' THEN 'invalid_relationship_triple' WHEN (no_from AND fv IS NULL) OR (no_to AND tv[1] IS NULL AND tv[2] IS NULL) THEN 'empty_endpoint_key'
        WHEN fv IS NULL THEN 'incomplete_from_endpoint_key' WHEN tv[1] IS NULL OR tv[2] IS NULL THEN 'incomplete_to_endpoint_key'
        WHEN NOT EXISTS (SELECT 1 FROM good g WHERE g.chunk_id = v.chunk_id AND g.label = from_label AND g.key_values = [fv]) THEN 'from_endpoint_not_kept'
        WHEN NOT EXISTS (SELECT 1 FROM good g WHERE g.chunk_id = v.chunk_id AND g.label = 'Part' AND g.key_values = tv) THEN 'to_endpoint_not_kept' ELSE 'kept' END AS reason FROM v)
    SELECT reason, count(*) AS n FROM o GROUP BY reason""")
def relationship_drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, none = F.col("l_linenumber"), F.create_map().cast("map<string,string>")
    given = F.create_map(F.lit("part"), F.when(~n.isin(2, 3), F.col("l_partkey").cast("string")), F.lit("flag"), F.when(F.col("l_suppkey") % 9 > 0, F.col("l_returnflag")))
    rels = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("chunk_id"), F.when(n == 6, "OWNS").otherwise("SUPPLIES").alias("kind"), F.when(n == 7, "Ghost").otherwise("Supplier").alias("from_label"),
        F.when(n == 1, none).otherwise(F.create_map(F.lit("supplier"), F.when(n == 3, " ").otherwise(F.col("l_suppkey").cast("string")))).alias("from_key"), F.lit("Part").alias("to_label"), F.when(n == 2, none).otherwise(given).alias("to_key"),
    )
    nodes, keys = extracted(spark, sf_dir)
    triples = spark.createDataFrame([("SUPPLIES", "Supplier", "Part")], "kind string, from_label string, to_label string")
    out = graph.sanitise_relationships(rels, nodes.where("drop_reason is null"), triples, keys)
    return out.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey * 10 + l_linenumber AS evidence_id, CASE WHEN l_returnflag = 'R' AND l_linenumber = 2 THEN 'BLANK_SCHEMA_ID' WHEN o_orderkey IS NULL THEN 'CHUNK_NOT_FOUND' WHEN o_custkey % 7 = 0 OR l_linenumber = 5 THEN 'CHUNK_SCOPE' WHEN o_orderstatus = 'P' THEN 'CHUNK_RUN' END AS problem
    FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 60000) ON o_orderkey = l_orderkey WHERE problem IS NOT NULL""")
def evidence_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, order = F.col("l_linenumber"), F.col("l_orderkey")
    evidence = table(spark, sf_dir, "lineitem").select((order * 10 + n).alias("evidence_id"), F.lit("kb0").alias("kb"), F.lit("r").alias("run"), F.when((F.col("l_returnflag") == "R") & (n == 2), " ").otherwise("s").alias("schema_id"), F.when(n == 5, -1).otherwise(order).alias("document_id"), order.alias("chunk_id"))
    chunks = table(spark, sf_dir, "orders").where("o_totalprice > 60000").select(F.col("o_orderkey").alias("chunk_id"), F.when(F.col("o_custkey") % 7 == 0, "kb1").otherwise("kb0").alias("kb"), F.col("o_orderkey").alias("document_id"), F.when(F.col("o_orderstatus") == "P", "q").otherwise("r").alias("run"))
    return graph.scope_violations(evidence, chunks)


@query("""WITH r AS (SELECT o_orderkey AS run_id, o_custkey AS document_id, CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'COMPLETED' ELSE 'RUNNING' END AS status, o_orderkey AS seq FROM orders),
    l AS (SELECT document_id, max_by(status, seq) AS s, max(seq) AS m FROM r GROUP BY document_id)
    SELECT run_id, document_id FROM r JOIN l USING (document_id) WHERE s = 'COMPLETED' AND seq < m AND status IN ('FAILED', 'COMPLETED')""")
def stale_run_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.stale_runs(order_runs(spark, sf_dir), overwrite=True)


def order_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs of their customer's document."""
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("document_id"), F.when(s == "F", "FAILED").when(s == "O", "COMPLETED").otherwise("RUNNING").alias("status"), F.col("o_orderkey").alias("seq"))


@query("""WITH r AS (SELECT o_orderkey AS run_id, o_custkey AS document_id, o_orderstatus AS s FROM orders)
    SELECT run_id, document_id, coalesce(run_id = max(CASE WHEN s = 'O' THEN run_id END) OVER (PARTITION BY document_id), false) AS active FROM r""")
def single_active_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.single_active(order_runs(spark, sf_dir)).select("run_id", "document_id", "active")


@query("""SELECT p_partkey AS id, list_sort(list_filter(CASE WHEN p_size > 25 THEN ['brand', 'colour', 'name'] ELSE ['brand', 'weight'] END, lambda x: x NOT IN ('brand', 'name'))) AS dropped FROM part""")
def declared_property_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.lit("v")
    props = F.when(F.col("p_size") > 25, F.create_map(F.lit("brand"), v, F.lit("colour"), v, F.lit("name"), v)).otherwise(F.create_map(F.lit("brand"), v, F.lit("weight"), v))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("Part").alias("label"), props.alias("props"))
    return graph.declared_properties(rows, spark.createDataFrame([("Part", ["brand", "name"])], "label string, names array<string>")).select("id", "dropped")


@query("""SELECT chunk_id, n_nodes, n_rels FROM (SELECT l_suppkey AS chunk_id, count(*) AS n_nodes, count_if(l_returnflag = 'R') AS n_rels FROM lineitem GROUP BY ALL) WHERE n_nodes > 600 OR n_rels > 150""")
def payload_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("chunk_id"), "l_returnflag")
    return graph.over_caps(items, items.where("l_returnflag = 'R'"), 600, 150)


