"""Deterministic identities as column expressions: lower-case hex SHA-256 over UTF-8."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hashed(prefix: str, *parts: Column) -> Column:
    """prefix + SHA-256 of the parts, joined by line feeds."""
    return F.concat(F.lit(prefix), F.sha2(F.concat_ws("\n", *(p.cast("string") for p in parts)), 256))


def chunk_id(doc_sha: Column, revision: Column, kind: str, section: Column, start: Column, end: Column) -> Column:
    return hashed("parent_" if kind == "PARENT" else "chunk_", doc_sha, revision, F.lit(kind), section, start, end)


def node_id(schema: Column, label: Column, **keys: Column) -> Column:
    """Over schema, label and key:name=length:value of every key in name order; knowledge bases share nodes."""
    parts = [F.concat(F.lit(f"key:{k}="), F.length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")) for k, v in sorted(keys.items())]
    return hashed("node:", schema, label, *parts)


def relationship_id(schema: Column, kind: Column, start: Column, end: Column) -> Column:
    return hashed("rel:", schema, kind, start, end)


def evidence_id(kind: Column, run: Column, document: Column, chunk: Column, fact: Column) -> Column:
    return hashed("evidence:", kind, run, document, chunk, fact)


def embedding_space(base_url: Column, model: Column, dimensions: Column) -> Column:
    """The tokenizer is left out: it does not move vectors."""
    return hashed("es_", normal_url(base_url), model, dimensions)


def settings_hash(settings: Column) -> Column:
    """Of a map: sorted length:key=length:value lines."""
    pairs = F.array_sort(F.map_entries(settings))
    size = lambda x: F.length(x).cast("string")
    line = lambda e: F.concat(size(e["key"]), F.lit(":"), e["key"], F.lit("="), size(e["value"]), F.lit(":"), e["value"], F.lit("\n"))
    return F.sha2(F.array_join(F.transform(pairs, line), ""), 256)


def normal_url(url: Column) -> Column:
    """Scheme and host in lower case, without default port and closing slashes."""
    head = F.lower(F.regexp_extract(url, r"^([A-Za-z]+://[^/]*)", 1))
    head = F.regexp_replace(F.regexp_replace(head, r"^(http://[^/]*):80$", "$1"), r"^(https://[^/]*):443$", "$1")
    return F.regexp_replace(F.concat(head, F.regexp_replace(url, r"^[A-Za-z]+://[^/]*", "")), "/+$", "")


def fingerprint(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)
