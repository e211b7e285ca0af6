"""Uploads: duplicates, replacement, pending storage work, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_existing(uploads: DataFrame, kb: str = "kb", text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, sha256, document_id (the first upload of the same content in the knowledge base), is_new.

    The first upload is a partial minimum per (kb, sha); content itself is not shuffled.
    """
    hashed = uploads.select(key, kb, F.sha2(text, 256).alias("sha256"))
    first = hashed.groupBy(kb, "sha256").agg(F.min(key).alias("document_id"))
    return hashed.join(first, [kb, "sha256"]).select(key, "sha256", "document_id", (F.col(key) == F.col("document_id")).alias("is_new"))


def replaced(documents: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    """documents with the rows of new in place of those with the same key."""
    return documents.join(new.select(key), key, "left_anti").unionByName(new)


def pending(mutations: DataFrame, most: int = 100, retries: int = 10) -> DataFrame:
    """The storage work to claim: oldest first. mutations: id, status, attempts, created_at."""
    return mutations.where((F.col("status") == "PENDING") & (F.col("attempts") <= retries)).orderBy("created_at", "id").limit(most)


def expired(rows: DataFrame, now, most: int, expires: str = "expires_at", key: str = "id") -> DataFrame:
    """A batch to delete: the oldest expired rows."""
    return rows.where(F.col(expires) <= F.lit(now)).orderBy(expires, key).limit(most)
