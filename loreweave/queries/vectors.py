"""Queries of the vector index: vectors in two bases and two spaces, asked for by every twentieth of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.operators import vector_index
from loreweave.queries import query
from loreweave.sources.shared import shared_path, written
from loreweave.sources.tables import table

SCOPED_SQL = """
    v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, CASE WHEN label < 7 THEN 'kb1' ELSE 'kb2' END AS kb, CASE WHEN vec_id % 10 = 3 THEN 'old' ELSE 'new' END AS space, CASE WHEN vec_id % 33 = 5 THEN 'PARENT' WHEN vec_id % 2 = 0 THEN 'CHILD' END AS kind FROM embeddings),
    q AS (SELECT * FROM v WHERE vec_id % 20 = 0),
    hits AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round((1 + list_cosine_similarity(v.x, q.x)) / 2, 9) AS score FROM q JOIN v ON v.kb = q.kb AND v.space = q.space WHERE v.kind IS NULL OR v.kind = 'CHILD')"""


def scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as chunks of two knowledge bases and embedding spaces, some of them parents."""
    i = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        i.alias("chunk_id"), "embedding", F.when(F.col("label") < 7, "kb1").otherwise("kb2").alias("kb"),
        F.when(i % 10 == 3, "old").otherwise("new").alias("space"), F.when(i % 33 == 5, "PARENT").when(i % 2 == 0, "CHILD").alias("kind"),
    )


def asked(chunks: DataFrame) -> DataFrame:
    return chunks.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "kb", "space", "embedding")


def indexed(spark: SparkSession, sf_dir: str) -> tuple[vector_index.Index, DataFrame]:
    chunks = scoped(spark, sf_dir)
    return vector_index.build(chunks, shared_path(spark, "vectors")), asked(chunks)


@query(f"WITH {SCOPED_SQL} SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM hits QUALIFY rank <= 10")
def vector_index_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lists probed: blocks, scope and ranks as a full scan gives them."""
    index, queries = indexed(spark, sf_dir)
    return vector_index.search(spark, index, queries, 10, exact=True).select("query_id", "chunk_id", "score", "rank")


@query(f"""WITH {SCOPED_SQL} SELECT kb, space, count(*) AS queries, true AS recall_reached, true AS fewer_read FROM q GROUP BY kb, space""")
def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per scope: is the mean recall of the ten nearest at least 0.9, and is less than the whole base read?"""
    index, queries = indexed(spark, sf_dir)
    exact = vector_index.search(spark, index, queries, 10, exact=True)
    recall = vector_index.recalled(vector_index.search(spark, index, queries, 10), exact)
    joined = queries.drop("embedding").join(recall, "query_id").join(vector_index.scan_shares(spark, index, queries), "query_id")
    return joined.groupBy("kb", "space").agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.9).alias("recall_reached"), (F.avg("share") < 1).alias("fewer_read"))


@query()
def vector_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest ten by the probes that the index was tuned to."""
    index, queries = indexed(spark, sf_dir)
    return written(vector_index.search(spark, index, queries, 10).select("query_id", "chunk_id", "score", "rank"), "nearest")
