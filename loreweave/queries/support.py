"""Queries of graph plans with evidence: line items as evidence of orders, parts and what joins them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.plans import rounds, support
from loreweave.plans.graphplan import Aggregate, Compare, GraphPlan, Hop, Order, Project
from loreweave.queries import query
from loreweave.sources.tables import SalesGraph, table

EVIDENCE_SQL = """
    chunk AS (SELECT CAST(s_suppkey AS VARCHAR) AS chunk_id, CAST(s_suppkey % 10 AS VARCHAR) AS document_id, CASE WHEN s_suppkey % 7 = 3 THEN 'CHILD' ELSE 'PARENT' END AS kind,
        CASE WHEN s_suppkey % 11 = 0 THEN 'kb2' ELSE 'kb1' END AS kb, CASE WHEN s_suppkey % 13 = 5 THEN 'r0' ELSE 'r1' END AS run, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey * 10 END AS a, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey * 10 + CASE WHEN s_suppkey % 5 = 4 THEN -1 ELSE 5 END END AS b FROM supplier),
    item AS (SELECT l_orderkey AS o, l_partkey AS p, l_suppkey AS s, l_linenumber AS n, o_custkey AS c, l_orderkey * 10 + l_linenumber AS id FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    evidence AS (
      SELECT 'p' || id AS evidence_id, 'Part:' || p AS fact_id, NULL AS from_id, NULL AS to_id, s FROM item WHERE n <> 6
      UNION ALL SELECT 'o' || id, 'Order:' || o, NULL, NULL, s FROM item WHERE n <= 4
      UNION ALL SELECT 'c' || id, 'Customer:' || c, NULL, NULL, s FROM item WHERE n = 1
      UNION ALL SELECT 'h' || id, 'PLACED:' || c || ':' || o, 'Customer:' || c, 'Order:' || o, s FROM item WHERE n <= 2
      UNION ALL SELECT 'i' || id, 'CONTAINS:' || o || ':' || p, 'Order:' || o, 'Part:' || CASE WHEN n = 4 THEN 0 ELSE p END, s FROM item),
    sup AS (SELECT e.*, chunk_id, coalesce(a >= 0 AND b >= a, a IS NULL AND b IS NULL) AS valid FROM evidence e JOIN chunk ON chunk_id = CAST(s AS VARCHAR) WHERE kind = 'PARENT' AND kb = 'kb1' AND run = 'r1'),
    path AS (SELECT DISTINCT c, o, p, p_size AS size, o_totalprice AS total FROM item JOIN part ON p_partkey = p JOIN orders ON o_orderkey = o WHERE p_size <= 20
      AND 'Customer:' || c IN (SELECT fact_id FROM sup) AND 'Order:' || o IN (SELECT fact_id FROM sup) AND 'Part:' || p IN (SELECT fact_id FROM sup)
      AND 'PLACED:' || c || ':' || o IN (SELECT fact_id FROM sup) AND 'CONTAINS:' || o || ':' || p IN (SELECT fact_id FROM sup WHERE to_id = 'Part:' || p)),
    place AS (SELECT *, unnest([0, 1, 2, 3, 4]) AS place, unnest(['Customer:' || c, 'Order:' || o, 'Part:' || p, 'PLACED:' || c || ':' || o, 'CONTAINS:' || o || ':' || p]) AS fact_id FROM cut),
    fact AS (SELECT row, fact_id, min(path_no * 10 + place) AS spot, any_value(p) AS p FROM place GROUP BY row, fact_id),
    listed AS (SELECT row, fact_id, spot, list_sort(list(DISTINCT evidence_id)) AS ids FROM fact JOIN sup USING (fact_id) WHERE valid AND (to_id IS NULL OR to_id NOT LIKE 'Part:%' OR to_id = 'Part:' || p) GROUP BY ALL),
    cited AS (SELECT row, fact_id, list(chunk_id ORDER BY e, chunk_id) AS chunks FROM (SELECT row, fact_id, chunk_id, min(evidence_id) AS e FROM fact JOIN sup USING (fact_id) WHERE valid AND (to_id IS NULL OR to_id NOT LIKE 'Part:%' OR to_id = 'Part:' || p) GROUP BY ALL) GROUP BY row, fact_id),
    facts AS (SELECT row, string_agg(fact_id || '=' || array_to_string(ids, ',') || '@' || array_to_string(chunks, ','), ';' ORDER BY spot) AS facts FROM listed JOIN cited USING (row, fact_id) GROUP BY row)"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supports of the sales graph's facts in base kb1."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c")), "l_orderkey")
    n, o, p, c = F.col("l_linenumber"), F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), F.col("c").cast("string")
    name = lambda *parts: F.concat_ws(":", *(F.lit(x) if isinstance(x, str) else x for x in parts))
    none, number = F.lit(None).cast("string"), (F.col("l_orderkey") * 10 + n).cast("string")
    entry = lambda letter, kind, fact, a, b, when: F.when(when, F.struct(F.concat(F.lit(letter), number).alias("evidence_id"), F.lit(kind).alias("kind"), fact.alias("fact_id"), (fact if kind == "NODE" else none).alias("node_id"), a.alias("from_id"), b.alias("to_id")))
    rows = F.array(
        entry("p", "NODE", name("Part", p), none, none, n != 6), entry("o", "NODE", name("Order", o), none, none, n <= 4), entry("c", "NODE", name("Customer", c), none, none, n == 1),
        entry("h", "RELATIONSHIP", name("PLACED", c, o), name("Customer", c), name("Order", o), n <= 2), entry("i", "RELATIONSHIP", name("CONTAINS", o, p), name("Order", o), name("Part", F.when(n == 4, "0").otherwise(p)), F.lit(True)),
    )
    s = F.col("l_suppkey")
    out = items.select(F.explode(rows).alias("x"), s.cast("string").alias("chunk_id"), (s % 10).cast("string").alias("document_id")).where("x is not null")
    out = out.select("x.*", "chunk_id", "document_id", F.lit("kb1").alias("kb"), F.lit("sales").alias("schema_id"), F.lit("r1").alias("run"))
    return support.supports(out, parents(spark, sf_dir), "kb1", "sales")


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, null = F.col("s_suppkey"), F.lit(None).cast("int")
    start = F.when(s % 3 > 0, s * 10)
    return table(spark, sf_dir, "supplier").select(
        s.cast("string").alias("chunk_id"), (s % 10).cast("string").alias("document_id"), F.when(s % 7 == 3, "CHILD").otherwise("PARENT").alias("kind"), F.when(s % 11 == 0, "kb2").otherwise("kb1").alias("kb"), F.when(s % 13 == 5, "r0").otherwise("r1").alias("run"),
        start.cast("int").alias("source_start"), (start + F.when(s % 5 == 4, -1).otherwise(5)).cast("int").alias("source_end"), null.alias("page_start"), null.alias("page_end"), F.lit("v1").alias("revision"), F.lit(None).cast("string").alias("path"),
    )


def _text(f) -> Column:
    """A fact as text: id=evidence@chunks."""
    return F.concat(f("fact_id"), F.lit("="), F.array_join(f("evidence_ids"), ","), F.lit("@"), F.array_join(F.transform(f("citations"), lambda c: c["chunk_id"]), ","))


def shown(rows: DataFrame) -> DataFrame:
    """Facts as text, in order."""
    return rows.select("row", "values.*", F.array_join(F.transform("facts", lambda f: _text(lambda c: f[c])), ";").alias("facts"))


def joined(facts: DataFrame, most: int = 1 << 14) -> DataFrame:
    """row, facts: each row's facts as text, joined in parts of `most` first, so that only the parts' texts meet by row."""
    in_order = lambda c: F.array_join(F.array_sort(F.collect_list(F.struct(c, "text")))["text"], ";")
    texts = facts.select("row", "no", F.floor((F.col("no") - 1) / most).alias("part"), _text(F.col).alias("text"))
    return texts.groupBy("row", "part").agg(in_order("no").alias("text")).groupBy("row").agg(in_order("part").alias("facts"))


HOPS = (Hop("PLACED", "Order"), Hop("CONTAINS", "Part"))


@query(f"""WITH {EVIDENCE_SQL.replace("place AS", "cut AS (SELECT *, row_number() OVER (ORDER BY total DESC, p, c, o) AS row, row AS path_no FROM path QUALIFY row <= 60), place AS", 1)}
    SELECT CAST(row AS INTEGER) AS row, o AS order_key, p AS part_key, total, facts FROM cut JOIN facts USING (row)""")
def plan_support_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hops whose five facts each carry their evidence and citations."""
    plan = GraphPlan("Customer", HOPS, (Compare(2, "size", "<=", 20),), (Project("order_key", 1, "orderkey"), Project("part_key", 2, "partkey"), Project("total", 1, "total")), None, (Order("total", True), Order("part_key")), 60)
    return shown(support.run_with_facts(plan, SalesGraph(spark, sf_dir), evidence(spark, sf_dir)))


@query(f"""WITH {EVIDENCE_SQL.replace("place AS", '''scan AS (SELECT *, row_number() OVER (ORDER BY c, o, p) AS path_no FROM path),
      grouped AS (SELECT size, count(*) AS n, min(path_no) AS least, row_number() OVER (ORDER BY count(*) DESC, min(path_no)) AS row FROM scan GROUP BY size QUALIFY row <= 15), cut AS (SELECT scan.*, row, n FROM scan JOIN grouped USING (size)), place AS''', 1)}
    SELECT CAST(row AS INTEGER) AS row, size, n, facts FROM grouped JOIN facts USING (row)""")
def plan_fact_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per group of an aggregate, the facts of all its paths, each once."""
    plan = GraphPlan("Customer", HOPS, (Compare(2, "size", "<=", 20),), (Project("size", 2, "size"),), Aggregate("COUNT", "n"), (Order("n", True),), 15)
    values, facts = support.rows_and_facts(plan, SalesGraph(spark, sf_dir), evidence(spark, sf_dir), show=("fact_id", "evidence_ids", "citations"), cited=("chunk_id",))
    return values.join(joined(facts), "row").select("row", "values.*", "facts")


def plans() -> list[GraphPlan]:
    """Unlike plans of one round: rows, a group, one of an unknown property, one without time left."""
    rows = GraphPlan("Customer", HOPS, (Compare(2, "size", "<=", 20),), (Project("order_key", 1, "orderkey"), Project("part_key", 2, "partkey")), None, (Order("order_key", True), Order("part_key")), 40)
    groups = GraphPlan("Customer", HOPS, (Compare(2, "size", "<=", 20),), (Project("size", 2, "size"),), Aggregate("COUNT", "n"), (Order("n", True),), 15)
    bad = GraphPlan("Customer", HOPS, (Compare(2, "weight", "<=", 20),), (Project("size", 2, "size"),), None, (), 10)
    return [rows, bad, groups, rows]


def one_round(spark: SparkSession, sf_dir: str) -> rounds.Round:
    return rounds.round_of(spark, plans(), SalesGraph(spark, sf_dir), evidence(spark, sf_dir), expired=lambda k: k == 4, show=("fact_id", "citations"), cited=("chunk_id", "document_id"))


ROUND_SQL = f"""{EVIDENCE_SQL.split("place AS")[0]} scan AS (SELECT *, row_number() OVER (ORDER BY c, o, p) AS path_no FROM path),
    grouped AS (SELECT size, count(*) AS n, min(path_no) AS least, row_number() OVER (ORDER BY count(*) DESC, min(path_no)) AS row FROM scan GROUP BY size QUALIFY row <= 15),
    firsts AS (SELECT *, row_number() OVER (ORDER BY o DESC, p, c) AS row, row AS path_no FROM path QUALIFY row <= 40),
    cut AS (SELECT 1 AS plan_no, row, path_no, c, o, p FROM firsts UNION ALL SELECT 3, row, path_no, c, o, p FROM scan JOIN grouped USING (size)),
    place AS (SELECT *, unnest(['Customer:' || c, 'Order:' || o, 'Part:' || p, 'PLACED:' || c || ':' || o, 'CONTAINS:' || o || ':' || p]) AS fact_id FROM cut),
    n AS (SELECT plan_no, row, count(DISTINCT fact_id) AS facts, count(DISTINCT (fact_id, chunk_id)) AS citations FROM place JOIN sup USING (fact_id) WHERE valid AND (to_id IS NULL OR to_id NOT LIKE 'Part:%' OR to_id = 'Part:' || p) GROUP BY plan_no, row),
    vals AS (SELECT 1 AS plan_no, row, '{{"order_key":' || o || ',"part_key":' || p || '}}' AS shown FROM firsts UNION ALL SELECT 3, row, '{{"n":' || n || ',"size":' || size || '}}' FROM grouped),
    kept AS (SELECT plan_no, row, shown, facts, citations FROM vals JOIN n USING (plan_no, row))"""


@query(f"""WITH {ROUND_SQL} SELECT CAST(row_number() OVER (ORDER BY plan_no, row) AS INTEGER) AS rank, CAST(plan_no AS INTEGER) AS plan_no, CAST(row AS INTEGER) AS row, shown, CAST(facts AS INTEGER) AS facts, citations FROM kept""")
def graph_round_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of unlike plans in one table, with how many facts and citations each has."""
    own = one_round(spark, sf_dir)
    cited = own.citations().groupBy("rank").agg(F.count("*").alias("citations"))
    facts = own.facts.groupBy("plan_no", "row").agg(F.count("*").cast("int").alias("facts"))
    return own.ranked().join(facts, ["plan_no", "row"]).join(cited, "rank").select("rank", "plan_no", "row", F.to_json("values").alias("shown"), "facts", "citations")


@query(f"""WITH {ROUND_SQL}, a AS (SELECT * FROM (VALUES (1, 'COMPLETED', NULL), (2, 'VALIDATION_FAILED', 'filter.property-unknown'), (3, 'COMPLETED', NULL), (4, 'DEADLINE_EXCEEDED', 'deadline.expired')) v(plan_no, status, category))
    SELECT 'graph-' || plan_no AS attempt, status, (SELECT count(*) FROM kept k WHERE k.plan_no = a.plan_no) AS rows, category FROM a UNION ALL SELECT 'round', 'COMPLETED', (SELECT count(*) FROM kept), 'filter.property-unknown'""")
def graph_round_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = one_round(spark, sf_dir)
    return own.attempts.select("attempt", "status", "rows", "category").unionByName(own.status().withColumn("attempt", F.lit("round")))
