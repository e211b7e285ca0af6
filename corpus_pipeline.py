"""The corpus pipeline over documents: quality, exact duplicates, near duplicates, mixing, packing.

Every stage takes what the one before kept and calls one operator of loreweave.llm; all but the last return the columns of
documents. run() writes each stage's result as Parquet to the shared folder and reads it again for the next.

In every stage a null text counts as empty, null ids and sources are values like others, nulls in other columns are kept as they
are, extra columns pass through whatever their names (operators' own columns take other names), and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.llm import exact_dedup, mixing, near_dedup, packing, quality
from loreweave.llm.common import fresh, materialize, table
from loreweave.llm.queries import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold go. Rows with equal texts go or stay together, repeated rows stay repeated, empty
    texts get the score of an empty text; without usable labels all stay."""
    q, name = quality.Quality(), fresh("score", docs.columns)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), q)
    return quality.score(docs, model, name=name).where(F.col(name) >= q.threshold).drop(name)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) the longest stays, then the smallest id; empty texts are one group; of rows equal in all
    columns one stays."""
    return exact_dedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group, over shingles of five words and a similarity of 0.8, the smallest id stays; empty texts all stay, but of rows
    equal in all columns one does."""
    return near_dedup.deduplicated(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's documents: a row for each contiguous stretch of one that a pass takes; n_chars follows the text. Texts without words
    are never taken; repeated rows are taken each for themselves."""
    mixed = mixing.mixed_documents(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else mixed


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens: their sequence and offset, and a checksum of their ids. An empty text is one token; rows that
    repeat an id are packed each for themselves."""
    return packing.pack(docs, tokenizer_path()).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("mixed_sources", mixed_sources),
    ("packed_sequences", packed_sequences),
]

#: Scores, signatures, draws and token ids are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
