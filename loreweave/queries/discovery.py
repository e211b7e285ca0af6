"""Queries of schema discovery, diffs and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.operators import discovery
from loreweave.queries import query
from loreweave.sources.tables import table

CANDIDATES_SQL = """
    c AS (SELECT 'NODE' AS kind, lang || '.' || (doc_id % 40) AS identity, CASE WHEN doc_id % 40 = 7 AND n_chars % 2 = 0 THEN 'Long' ELSE 'Short' END AS type, source,
        CASE WHEN doc_id % 3 = 0 THEN doc_id // 9 END AS document, CASE WHEN doc_id % 5 = 0 THEN 'GUIDED' ELSE 'OBSERVED' END AS origin, n_chars / 100000.0 AS confidence FROM documents)"""
MERGED_SQL = f"""{CANDIDATES_SQL},
    m AS (SELECT kind, identity, type, max(confidence) AS confidence, list_sort(list(DISTINCT origin)) AS origins, count(DISTINCT coalesce('document:' || document, source)) AS support FROM c GROUP BY ALL)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.lit("NODE").alias("kind"), F.concat_ws(".", "lang", (d % 40).cast("string")).alias("identity"), F.when((d % 40 == 7) & (F.col("n_chars") % 2 == 0), "Long").otherwise("Short").alias("type"), "source",
        F.when(d % 3 == 0, F.floor(d / 9)).alias("document"), F.when(d % 5 == 0, "GUIDED").otherwise("OBSERVED").alias("origin"), (F.col("n_chars") / 100000.0).alias("confidence"),
    )


@query(f"WITH {MERGED_SQL} SELECT * FROM m")
def discovery_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.merge_candidates(candidates(spark, sf_dir))


KEYED_SQL = """
    k AS (SELECT 'NODE_KEY' AS kind, 'Order' || (l_linenumber % 3) AS identity, 'KEY' AS type, CASE WHEN l_partkey % 2 = 0 THEN ['id'] ELSE ['code', 'id'] END AS keys, 's' || (l_suppkey % 5) AS source, CASE WHEN l_orderkey % 4 > 0 THEN l_orderkey % 50 END AS document, l_returnflag AS origin, l_quantity AS confidence FROM lineitem)"""


@query(f"""WITH {KEYED_SQL}, e AS (SELECT kind, identity, type, keys, source, document, list_sort(list(DISTINCT origin)) AS origins FROM k GROUP BY ALL)
    SELECT identity, array_to_string(keys, ',') AS keys, (SELECT max(confidence) FROM k WHERE k.identity = e.identity AND k.keys = e.keys) AS confidence, count(*) AS evidence, max(len(origins)) AS most_origins, count(DISTINCT coalesce('document:' || document, source)) AS support FROM e GROUP BY identity, keys""")
def discovery_merge_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a node in two spellings are two variants, each with its own united evidence."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.lit("NODE_KEY").alias("kind"), F.concat(F.lit("Order"), (F.col("l_linenumber") % 3).cast("string")).alias("identity"), F.lit("KEY").alias("type"), F.when(F.col("l_partkey") % 2 == 0, F.array(F.lit("id"))).otherwise(F.array(F.lit("code"), F.lit("id"))).alias("keys"),
        F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")).alias("source"), F.when(F.col("l_orderkey") % 4 > 0, F.col("l_orderkey") % 50).alias("document"), F.col("l_returnflag").alias("origin"), F.col("l_quantity").alias("confidence"),
    )
    evidence = discovery.united_evidence(rows).groupBy("identity", "keys").agg(F.count("*").alias("evidence"), F.max(F.size("origins")).cast("long").alias("most_origins"))
    return discovery.merge_candidates(rows).join(evidence, ["identity", "keys"]).select("identity", F.array_join("keys", ",").alias("keys"), "confidence", "evidence", "most_origins", "support")


@query(f"WITH {CANDIDATES_SQL} SELECT identity, list_sort(list(DISTINCT type)) AS alternatives FROM c GROUP BY identity HAVING count(DISTINCT type) > 1")
def discovery_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.property_conflicts(candidates(spark, sf_dir))


@query(f"""WITH {MERGED_SQL}, x AS (SELECT identity FROM c GROUP BY identity HAVING count(DISTINCT type) > 1)
    SELECT identity, type, CASE WHEN identity = 'en.3' THEN 'SUPPRESSED' WHEN identity IN (SELECT identity FROM x) THEN 'REVIEW_REQUIRED'
        WHEN list_contains(origins, 'GUIDED') AND NOT list_contains(origins, 'OBSERVED') THEN 'REVIEW_REQUIRED' WHEN support < 2 AND list_contains(origins, 'OBSERVED') THEN 'LOW_SUPPORT' ELSE 'RECOMMENDED' END AS review_state FROM m""")
def discovery_review_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = candidates(spark, sf_dir)
    excluded = spark.createDataFrame([("en.3",)], "identity string")
    return discovery.review_state(discovery.merge_candidates(own), excluded, discovery.property_conflicts(own)).select("identity", "type", "review_state")


@query("""WITH r AS (SELECT l_linestatus AS kind, 'S' || (l_suppkey % 4) AS f, 'S' || (l_partkey % 5) AS t FROM lineitem),
    p AS (SELECT kind, least(f, t) AS a, greatest(f, t) AS b, f <= t AS forward FROM r WHERE f <> t)
    SELECT kind, a, b FROM p GROUP BY kind, a, b HAVING count(DISTINCT forward) > 1""")
def direction_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = lambda c, n: F.concat(F.lit("S"), (F.col(c) % n).cast("string"))
    return discovery.direction_conflicts(table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("kind"), label("l_suppkey", 4).alias("from_label"), label("l_partkey", 5).alias("to_label")))


OLD = [("Asset", "node", "NODE", False), ("Asset.id", "property", "INTEGER", True), ("Asset.name", "property", "STRING", False), ("Asset.cost", "property", "FLOAT", False), ("Part", "node", "NODE", False), ("HAS", "relationship", "Asset>Part", False)]
NEW = [("Asset", "node", "NODE", False), ("Asset.id", "property", "LONG", True), ("Asset.name", "property", "DATE", False), ("Asset.due", "property", "DATE", False), ("Asset.code", "property", "STRING", True), ("Team", "node", "NODE", False), ("HAS", "relationship", "Part>Asset", False), ("Part", "node", "NODE", False)]
_rows = lambda rows: ", ".join(f"('{a}', '{b}', '{c}', {d})" for a, b, c, d in rows)


@query(f"""WITH o AS (SELECT * FROM (VALUES {_rows(OLD)}) AS v(coordinate, k, t, r)), n AS (SELECT * FROM (VALUES {_rows(NEW)}) AS v(coordinate, k, t, r)),
    j AS (SELECT coordinate, o.k AS k0, n.k AS k1, o.t AS t0, n.t AS t1, o.r AS r0, n.r AS r1 FROM o FULL JOIN n USING (coordinate)),
    d AS (SELECT *, CASE WHEN k0 IS NULL THEN 'ADD' WHEN k1 IS NULL THEN 'REMOVE' WHEN t0 <> t1 OR r0 <> r1 THEN 'CHANGE' END AS change FROM j)
    SELECT coordinate, coalesce(k1, k0) AS kind, change, CASE WHEN change = 'ADD' AND k1 IN ('node', 'relationship') THEN 'ADDITIVE' WHEN change = 'ADD' AND NOT r1 THEN 'ADDITIVE' WHEN change = 'ADD' THEN 'REVIEW_REQUIRED'
        WHEN change = 'CHANGE' AND k1 = 'property' AND (t0 = t1 OR (t0 = 'INTEGER' AND t1 IN ('LONG', 'FLOAT', 'DOUBLE')) OR (t0 = 'LONG' AND t1 IN ('FLOAT', 'DOUBLE')) OR (t0 = 'FLOAT' AND t1 = 'DOUBLE')) THEN 'REVIEW_REQUIRED'
        ELSE 'BREAKING' END AS compatibility FROM d WHERE change IS NOT NULL""")
def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "coordinate string, kind string, type string, required boolean"
    return discovery.schema_diff(spark.createDataFrame(OLD, schema), spark.createDataFrame(NEW, schema))


METRICS_SQL = """
    i AS (SELECT source, lang, quality = 1 AS recognised, CASE WHEN toxic = 0 THEN n_chars > 1000 END AS key_present, n_chars % 3 AS conflicts, n_chars % 5 AS missing FROM documents JOIN labels USING (doc_id)),
    a AS (SELECT source, count_if(recognised) AS recognised, count_if(NOT recognised) AS unknown, count_if(recognised AND key_present IS NOT NULL) AS nodes_with_key_definition, count_if(recognised AND key_present) AS nodes_with_key,
        CAST(coalesce(sum(conflicts) FILTER (recognised), 0) AS BIGINT) AS type_conflicts, CAST(coalesce(sum(missing) FILTER (recognised), 0) AS BIGINT) AS missing_required FROM i GROUP BY source),
    r AS (SELECT source, count(*) AS relationships, count_if(lang <> 'en' OR n_chars < 500) AS dropped, count_if(lang = 'de') AS outside FROM documents WHERE source <> 'src3' GROUP BY source),
    c AS (SELECT source, coalesce(recognised, 0) AS recognised, coalesce(unknown, 0) AS unknown, coalesce(nodes_with_key_definition, 0) AS nodes_with_key_definition, coalesce(nodes_with_key, 0) AS nodes_with_key, coalesce(type_conflicts, 0) AS type_conflicts, coalesce(missing_required, 0) AS missing_required,
        coalesce(relationships, 0) AS relationships, coalesce(dropped, 0) AS dropped, coalesce(outside, 0) AS dropped_schema_constraint, coalesce(greatest(0, dropped - outside), 0) AS dropped_invalid_endpoint_or_key FROM a FULL JOIN r USING (source))"""
RATES_SQL = "round(recognised / nullif(recognised + unknown, 0), 9) AS recognition_rate, round(dropped / nullif(relationships, 0), 9) AS drop_rate, round(nodes_with_key / nullif(nodes_with_key_definition, 0), 9) AS key_rate"


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, docs = F.col("n_chars"), table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    nodes = docs.join(table(spark, sf_dir, "labels"), "doc_id").select("source", (F.col("quality") == 1).alias("recognised"), F.when(F.col("toxic") == 0, n > 1000).alias("key_present"), (n % 3).alias("type_conflicts"), (n % 5).alias("missing_required"))
    edges = docs.where("source <> 'src3'").select("source", (F.col("lang") != "de").alias("in_schema"), ((F.col("lang") == "en") & (n >= 500)).alias("kept"))
    return discovery.evaluation_metrics(nodes, edges, "source")


@query(f"WITH {METRICS_SQL} SELECT *, {RATES_SQL} FROM c")
def evaluation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir)


_counters = "recognised unknown nodes_with_key_definition nodes_with_key type_conflicts missing_required relationships dropped dropped_schema_constraint dropped_invalid_endpoint_or_key".split()


@query(f"""WITH {METRICS_SQL}, s AS (SELECT substring(source, 1, 4) AS run, {', '.join(f'CAST(sum({x}) AS BIGINT) AS {x}' for x in _counters)}, max(length(source)) AS low_support FROM c GROUP BY run) SELECT *, {RATES_SQL} FROM s""")
def evaluation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = metrics(spark, sf_dir).withColumn("run", F.substring("source", 1, 4)).withColumn("low_support", F.length("source").cast("long")).drop("source")
    return discovery.roll_up(own, "run", ("low_support",))


CONFLICT_SQL = """
    x AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'NODE_PROPERTY' WHEN 1 THEN 'RELATIONSHIP_PROPERTY' ELSE 'NODE_KEY' END AS kind, lang || '.' || (doc_id % 60) AS identity, 'T' || (n_chars % 2) AS type, CASE WHEN n_chars % 7 = 0 THEN 'id,site' ELSE 'id' END AS key, source FROM documents),
    y AS (SELECT 'R' || (l_linenumber % 3) AS relationship, 'L' || (l_suppkey % 9) AS f, 'L' || (l_partkey % 11) AS t, l_returnflag AS source FROM lineitem),
    e AS (SELECT 'PROPERTY_TYPE' AS category, kind AS apart, identity AS coordinate, type AS alternative, source FROM x WHERE kind <> 'NODE_KEY' UNION ALL SELECT 'IDENTITY_KEY', '', identity, key, source FROM x WHERE kind = 'NODE_KEY'
        UNION ALL SELECT 'RELATIONSHIP_NAME', '', 'relationship-endpoints:' || f || '->' || t, relationship, source FROM y UNION ALL SELECT 'RELATIONSHIP_DIRECTION', '', 'relationship-direction:' || relationship || ':' || least(f, t) || ':' || greatest(f, t), f || '->' || t, source FROM y)"""


@query(f"WITH {CONFLICT_SQL} SELECT category, coordinate, list_sort(list(DISTINCT alternative)) AS alternatives, list_sort(list(DISTINCT source)) AS sources FROM e GROUP BY category, apart, coordinate HAVING count(DISTINCT alternative) > 1")
def conflict_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, null = F.col("doc_id"), F.lit(None).cast("string")
    kind = F.when(d % 3 == 0, "NODE_PROPERTY").when(d % 3 == 1, "RELATIONSHIP_PROPERTY").otherwise("NODE_KEY")
    named = table(spark, sf_dir, "documents").select(
        kind.alias("kind"), F.concat_ws(".", "lang", (d % 60).cast("string")).alias("identity"), F.concat(F.lit("T"), (F.col("n_chars") % 2).cast("string")).alias("type"),
        F.when(F.col("n_chars") % 7 == 0, F.array(F.lit("id"), F.lit("site"))).otherwise(F.array(F.lit("id"))).alias("keys"), null.alias("relationship"), null.alias("from_label"), null.alias("to_label"), "source",
    )
    label = lambda c, n: F.concat(F.lit("L"), (F.col(c) % n).cast("string"))
    joined = table(spark, sf_dir, "lineitem").select(
        F.lit("RELATIONSHIP").alias("kind"), null.alias("identity"), null.alias("type"), F.lit(None).cast("array<string>").alias("keys"), F.concat(F.lit("R"), (F.col("l_linenumber") % 3).cast("string")).alias("relationship"),
        label("l_suppkey", 9).alias("from_label"), label("l_partkey", 11).alias("to_label"), F.col("l_returnflag").alias("source"),
    )
    return discovery.conflicts(named.unionByName(joined))


@query("""WITH a AS (SELECT CAST(c_custkey AS VARCHAR) AS identity, c_mktsegment AS type FROM customer WHERE c_acctbal > 0), b AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS identity, 'ORDERED' AS type FROM orders)
    SELECT identity, coalesce(b.type, a.type) AS type, list_sort(list_filter([CASE WHEN a.type IS NOT NULL THEN 'GUIDED' END, CASE WHEN b.type IS NOT NULL THEN 'OBSERVED' END], lambda x: x IS NOT NULL)) AS origins FROM a FULL JOIN b USING (identity)""")
def observed_over_inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("identity"), F.col("c_mktsegment").alias("type"), F.array(F.lit("GUIDED")).alias("origins"))
    b = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("identity")).distinct().select("identity", F.lit("ORDERED").alias("type"), F.array(F.lit("OBSERVED")).alias("origins"))
    return discovery.observed_over_inherited(a, b)


@query("""WITH d AS (SELECT o_custkey AS identity, max_by(o_orderstatus, o_orderkey) AS s, max_by(o_orderpriority, o_orderkey) AS v FROM orders GROUP BY o_custkey)
    SELECT identity, coalesce(CASE WHEN s = 'O' THEN v END, c_mktsegment) AS value FROM (SELECT c_custkey AS identity, c_mktsegment FROM customer) FULL JOIN d USING (identity) WHERE s IS NULL OR s <> 'F'""")
def apply_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    decisions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("identity"), F.when(s == "F", "REJECT").when(s == "O", "REPLACE").otherwise("KEEP").alias("action"), F.when(s == "O", F.col("o_orderpriority")).alias("value"), F.col("o_orderkey").alias("seq"))
    return discovery.apply_decisions(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("identity"), F.col("c_mktsegment").alias("value")), decisions)


@query("""WITH n AS (SELECT upper(source[1]) || source[2:] AS label, lang, n_chars, doc_id AS seq, CASE WHEN lang = 'de' THEN 'chars' WHEN lang = 'fr' THEN 'lang, b-d' END AS given FROM documents),
    p AS (SELECT label, unnest([{'name': 'chars', 'value': CAST(n_chars AS VARCHAR)}, {'name': 'lang', 'value': lang}, {'name': 'share', 'value': CASE WHEN n_chars % 2 = 0 THEN '0.5' ELSE '2024-01-01' END}], recursive := true), seq FROM n),
    t AS (SELECT label, name, min_by(value, seq) AS first FROM p GROUP BY label, name),
    q AS (SELECT label, list_sort(list(name || ':' || CASE WHEN regexp_matches(first, '^[+-]?[0-9]+$') THEN 'integer' WHEN first = '0.5' THEN 'number' WHEN first LIKE '2024%' THEN 'date' ELSE 'string' END)) AS properties FROM t GROUP BY label),
    k AS (SELECT label, min(seq) FILTER (lang = 'de') AS de, min(seq) FILTER (lang = 'fr') AS fr FROM n GROUP BY label)
    SELECT label, (SELECT min_by(m.lang, m.seq) FROM n m WHERE m.label = q.label AND m.lang <> 'en') AS description, CASE WHEN de IS NULL AND fr IS NULL THEN ['chars', 'lang'] WHEN fr IS NULL THEN ['chars'] WHEN de IS NULL THEN ['lang'] WHEN de < fr THEN ['chars', 'lang'] ELSE ['lang', 'chars'] END AS keys, properties FROM q JOIN k USING (label)""")
def schema_from_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang, n = F.col("lang"), F.col("n_chars")
    props = F.create_map(
        F.lit("chars"), n.cast("string"), F.lit("lang"), lang, F.lit("share"), F.when(n % 2 == 0, "0.5").otherwise("2024-01-01"), F.lit("description"), F.when(lang == "en", " ").otherwise(lang), F.lit("key"), F.when(lang == "de", "chars").when(lang == "fr", "lang, b-d"),
    )
    nodes = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), F.col("source").alias("type"), props.alias("props"), F.col("doc_id").alias("seq"))
    edges = spark.createDataFrame([], "relation string, head string, tail string, props map<string,string>, seq long")
    labels = discovery.schema_from_graph(nodes, edges)[0]
    return labels.select("label", "description", "keys", F.array_sort(F.transform("properties", lambda p: F.concat_ws(":", p["name"], p["type"]))).alias("properties"))


@query("""WITH t AS (SELECT doc_id AS seq, lang AS head, source AS tail, CASE WHEN n_chars % 10 = 0 THEN ' ' ELSE 'spoken in' END AS relation FROM documents) SELECT 'SPOKEN_IN' AS relationship, 'Lang' AS from_label, 'Entity' AS to_label, count(DISTINCT head) * 0 + 1 AS properties FROM t WHERE trim(relation) <> '' GROUP BY ALL""")
def triples_to_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("map<string,string>")
    triples = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"), F.col("lang").alias("head"), F.lit("lang").alias("head_type"), none.alias("head_props"), F.when(F.col("n_chars") % 10 == 0, " ").otherwise("spoken in").alias("relation"),
        F.col("source").alias("tail"), F.lit(None).cast("string").alias("tail_type"), none.alias("tail_props"), none.alias("relation_props"), F.create_map(F.lit("chars"), F.col("n_chars").cast("string")).alias("props"),
    )
    return discovery.schema_from_graph(*discovery.triples_to_graph(triples))[1].select("relationship", "from_label", "to_label", F.size("properties").cast("long").alias("properties"))


@query("""WITH o AS (SELECT o_custkey AS reuse_key, max_by(o_orderkey, o_orderkey) AS outcome_id FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey),
    p AS (SELECT c_custkey AS id, c_nationkey <> 3 AS same FROM customer)
    SELECT id, CASE WHEN NOT same THEN 'STALE_SOURCE' WHEN outcome_id IS NOT NULL THEN 'REUSED' ELSE 'RUN' END AS state, CASE WHEN same THEN outcome_id END AS outcome_id FROM p LEFT JOIN o ON id = reuse_key""")
def evaluation_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("reuse_key"), F.col("o_orderkey").alias("outcome_id"), F.when(F.col("o_orderstatus") == "F", "SUCCEEDED").otherwise("FAILED").alias("status"), F.col("o_orderkey").alias("seq"))
    pending = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("reuse_key"), F.lit("a").alias("source_sha"), F.when(F.col("c_nationkey") == 3, "b").otherwise("a").alias("current_sha"))
    return discovery.reuse(pending, outcomes)
