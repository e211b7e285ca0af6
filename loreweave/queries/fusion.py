"""Queries of fusion over many requests: text branches and graph rows, with nulls, blanks and failed branches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loreweave.operators import ranking
from loreweave.queries import query
from loreweave.sources.tables import table

FOUND_SQL = """
    lines AS (SELECT o_custkey AS request, o_orderkey, l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 3 WHEN 0 THEN 'DENSE' WHEN 1 THEN 'LEXICAL' ELSE 'METADATA' END AS channel,
        CASE WHEN l_linenumber % 3 < 2 THEN 'q' || (o_orderkey % 2) END AS subquery FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    found AS (SELECT request, channel, subquery, CASE WHEN l_suppkey % 19 = 0 THEN NULL WHEN l_suppkey % 17 = 0 THEN ' ' ELSE 'c' || (l_partkey % 300) END AS chunk_id,
        CASE WHEN l_suppkey % 13 = 0 THEN NULL WHEN l_suppkey % 11 = 0 THEN '' ELSE 'd' || (l_partkey % 50) END AS document_id,
        row_number() OVER (PARTITION BY request, channel, subquery ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rank FROM lines WHERE NOT (channel = 'LEXICAL' AND request % 4 = 0)),
    cited AS (SELECT request, dense_rank() OVER (PARTITION BY request ORDER BY o_orderkey) AS rank, l_linenumber AS place, CASE WHEN l_suppkey % 23 = 0 THEN NULL WHEN l_linenumber % 2 = 0 THEN 'c' || (l_partkey % 300) ELSE 'g' || (l_partkey % 700) END AS chunk_id,
        'd' || (l_partkey % 50) AS document_id, l_suppkey AS fact_id FROM lines),
    good AS (SELECT * FROM found WHERE rank <= 5 AND trim(coalesce(chunk_id, '')) <> '' AND trim(coalesce(document_id, '')) <> ''),
    near AS (SELECT *, chunk_id IS NOT NULL AS ok FROM cited WHERE rank <= 5),
    fresh AS (SELECT request, chunk_id, row_number() OVER (PARTITION BY request ORDER BY min(rank * 1000 + place), chunk_id) AS n FROM near WHERE ok AND (request, chunk_id) NOT IN (SELECT (request, chunk_id) FROM good) GROUP BY request, chunk_id),
    taken AS (SELECT near.*, ok AND ((request, chunk_id) IN (SELECT (request, chunk_id) FROM good) OR (request, chunk_id) IN (SELECT (request, chunk_id) FROM fresh WHERE n <= 4)) AS yes FROM near)"""


def found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Line items as what the branches and the graph plans of a customer's request found."""
    n, part, supplier = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("request")), "l_orderkey")
    lines = lines.select("request", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").repartition("request")  # the only shuffle, all else is by request
    lines = lines.withColumn("channel", F.when(n % 3 == 0, "DENSE").when(n % 3 == 1, "LEXICAL").otherwise("METADATA")).withColumn("subquery", F.when(n % 3 < 2, F.concat(F.lit("q"), (F.col("l_orderkey") % 2).cast("string"))))
    name = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    rank = F.row_number().over(Window.partitionBy("request", "channel", "subquery").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    text = lines.select(
        "request", "channel", "subquery", F.when(supplier % 19 == 0, None).when(supplier % 17 == 0, " ").otherwise(name("c", part % 300)).alias("chunk_id"),
        F.when(supplier % 13 == 0, None).when(supplier % 11 == 0, "").otherwise(name("d", part % 50)).alias("document_id"), rank.alias("rank"),
        F.when((F.col("channel") == "LEXICAL") & (F.col("request") % 4 == 0), "FAILED").otherwise("COMPLETED").alias("status"),
    )
    graph = lines.select(
        "request", F.dense_rank().over(Window.partitionBy("request").orderBy("l_orderkey")).alias("rank"), n.alias("place"),
        F.when(supplier % 23 == 0, None).when(n % 2 == 0, name("c", part % 300)).otherwise(name("g", part % 700)).alias("chunk_id"), name("d", part % 50).alias("document_id"), supplier.alias("fact_id"),
    )
    return text, graph


@query(f"""WITH {FOUND_SQL},
    ex AS (SELECT request, channel, count(DISTINCT coalesce(subquery, 'branch')) AS n FROM found GROUP BY request, channel),
    t AS (SELECT request, chunk_id, channel, coalesce(subquery, 'branch') AS sq, min(rank) AS r FROM good GROUP BY ALL),
    terms AS (SELECT request, chunk_id, CASE channel WHEN 'DENSE' THEN 2.0 ELSE 1.0 END / n / (60 + r) AS term FROM t JOIN ex USING (request, channel) UNION ALL SELECT request, chunk_id, 1.0 / (60 + min(rank)) FROM taken WHERE yes GROUP BY request, chunk_id),
    facts AS (SELECT request, chunk_id, list_sort(list(DISTINCT CAST(fact_id AS VARCHAR))) AS facts FROM taken WHERE yes GROUP BY request, chunk_id),
    docs AS (SELECT request, chunk_id, min(document_id) AS document_id FROM (SELECT request, chunk_id, document_id FROM good UNION ALL SELECT request, chunk_id, document_id FROM taken WHERE yes AND (request, chunk_id) NOT IN (SELECT (request, chunk_id) FROM good)) GROUP BY ALL),
    s AS (SELECT request, chunk_id, round(sum(term), 12) AS score FROM terms GROUP BY request, chunk_id)
    SELECT request, chunk_id, document_id, score, coalesce(facts, []) AS facts, CAST(row_number() OVER (PARTITION BY request ORDER BY score DESC, chunk_id) AS INTEGER) AS fused_rank
    FROM s LEFT JOIN facts USING (request, chunk_id) LEFT JOIN docs USING (request, chunk_id) QUALIFY fused_rank <= 10""")
def fusion_with_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, graph = found(spark, sf_dir)
    out = ranking.fuse(text, {"DENSE": 2.0}, pool=10, per_branch=5, graph=graph, derived=4, by=("request",))
    return out.select("request", "chunk_id", "document_id", "score", "facts", "fused_rank")


@query(f"""WITH {FOUND_SQL}
    SELECT request, channel, count_if(rank <= 5 AND trim(coalesce(chunk_id, '')) <> '' AND trim(coalesce(document_id, '')) <> '') AS accepted, count_if(NOT (rank <= 5 AND trim(coalesce(chunk_id, '')) <> '' AND trim(coalesce(document_id, '')) <> '')) AS truncated,
        count(DISTINCT coalesce(subquery, 'branch')) AS executed FROM found GROUP BY request, channel
    UNION ALL SELECT request, 'GRAPH', (SELECT count(*) FROM taken t WHERE t.request = c.request AND yes), (SELECT count(*) FROM taken t WHERE t.request = c.request AND NOT yes) + count(DISTINCT CASE WHEN rank > 5 THEN rank END), 1 FROM cited c GROUP BY request""")
def channel_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, graph = found(spark, sf_dir)
    return ranking.branch_counters(text, 5, graph, 4, by=("request",))


@query("""WITH a AS (SELECT doc_id AS chunk_id, 1 AS round, lang FROM documents WHERE lang = 'en'), b AS (SELECT doc_id, 2, lang FROM documents WHERE n_chars > 500) SELECT round, lang, count(*) AS n, count(DISTINCT chunk_id) AS chunks FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL""")
def union_of_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "lang", "n_chars")
    both = ranking.text_rounds(docs.where("lang = 'en'").drop("n_chars"), docs.where("n_chars > 500").drop("n_chars"))
    return both.groupBy("round", "lang").agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("chunks"))
