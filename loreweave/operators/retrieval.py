"""Candidate retrieval: dense, lexical and metadata branches. All give (subquery, chunk_id, rank, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The characters of a term.
TERM = "[a-z0-9à-öø-ÿß]+"


def ranked(hits: DataFrame, most: int, *order: Column, by: tuple[str, ...] = ("subquery",)) -> DataFrame:
    """The first `most` of each group by order, with rank; Spark cuts each task's rows to `most` before the shuffle."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def dense(chunks: DataFrame, queries: list[tuple[str, list[float]]], most: int) -> DataFrame:
    """chunks: chunk_id, embedding. Each row meets the few query vectors of the request as literals; no join is needed."""
    asked = F.array(*(F.struct(F.lit(n).alias("subquery"), F.array(*map(F.lit, v)).alias("vector")) for n, v in queries))
    hits = chunks.where(F.col("embedding").isNotNull()).select("*", F.explode(asked).alias("q")).select("q.subquery", "chunk_id", ((1 + cosine(F.col("embedding"), F.col("q.vector"))) / 2).alias("score"))
    return ranked(hits, most, F.desc("score"), F.col("chunk_id"))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def lexical_all(chunks: DataFrame, query: list[str]) -> DataFrame:
    """chunk_id of the chunks that hold every term. chunks: chunk_id, text."""
    own = terms(F.col("text"))
    return chunks.where(F.size(F.array_except(F.array(*map(F.lit, query)), own)) == 0).select("chunk_id")


def metadata(documents: DataFrame, most: int, **equal: str | None) -> DataFrame:
    """Documents whose columns equal the given values without regard to case (None: any), newest first. documents: document_id."""
    out = documents
    for name, value in equal.items():
        if value is not None:
            out = out.where(F.lower(name) == value.lower())
    return ranked(out.withColumn("subquery", F.lit("")), most, F.desc("document_id"))


def owned_chunks(chunks: DataFrame, documents: DataFrame, kb: str, most: int) -> DataFrame:
    """The first `most` chunks, by id, of the given documents (document_id, by a request's filter) of a knowledge base; each scores 1.
    chunks: chunk_id, document_id, kb, perhaps kind (parents are left out). Documents are joined by their id, however many."""
    own = chunks.where(F.col("kb") == kb)
    own = own.where(F.col("kind").isNull() | (F.col("kind") == "CHILD")) if "kind" in chunks.columns else own
    hits = own.join(documents.select("document_id").distinct(), "document_id", "left_semi").select(F.lit("").alias("subquery"), "chunk_id", "document_id", F.lit(1.0).alias("score"))
    return ranked(hits, most, F.col("chunk_id"))


def metadata_chunks(documents: DataFrame, chunks: DataFrame, kb: str, most_documents: int, most: int, **equal: str | None) -> DataFrame:
    """The metadata branch down to chunks: the newest documents whose columns equal the given values, then their chunks."""
    found = metadata(documents.where(F.col("kb") == kb), most_documents, **equal)
    return owned_chunks(chunks, found, kb, most)


def incompatible(chunks: DataFrame, space: str, tokenizer: str) -> DataFrame:
    """Embedded chunks of another space or tokenizer; compatible if empty."""
    return chunks.where(F.col("embedding").isNotNull() & (~F.col("embedding_space_id").eqNullSafe(F.lit(space)) | ~F.col("tokenizer_id").eqNullSafe(F.lit(tokenizer))))
