"""Canonical JSON: keys sorted at every level, no white space, one spelling for each number; and its fingerprint.

The text is parsed to a VARIANT, which keeps an object's keys in order of their bytes. A decimal without a fraction is a whole number
(1.0 as 1). Text that is no JSON, or repeats a key in an object, has no canonical form (null); null and blank text is the empty object.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(text: Column) -> Column:
    return F.when(text.isNull() | text.rlike(r"^\s*$"), F.lit("{}")).otherwise(F.to_json(F.try_parse_json(text)))


def canonical_value(value: Column) -> Column:
    """Of a struct, map or array: its canonical JSON, nulls included."""
    return F.to_json(F.to_variant_object(value))


def fingerprint(canonical_text: Column) -> Column:
    return F.sha2(canonical_text, 256)


def node_value(id_: Column, labels: Column, properties: Column) -> Column:
    return F.struct(F.lit("node").alias("_type"), id_.alias("id"), id_.cast("string").alias("elementId"), labels.alias("labels"), properties.alias("properties"))


def relationship_value(id_: Column, kind: Column, start: Column, end: Column, properties: Column) -> Column:
    return F.struct(
        F.lit("relationship").alias("_type"), id_.alias("id"), id_.cast("string").alias("elementId"), kind.alias("type"),
        start.cast("string").alias("startNodeElementId"), end.cast("string").alias("endNodeElementId"), properties.alias("properties"),
    )


def path_value(nodes: Column, relationships: Column) -> Column:
    """nodes, relationships: arrays of node_value and relationship_value; unlike properties must be VARIANTs."""
    return F.struct(F.lit("path").alias("_type"), F.size(relationships).alias("length"), nodes.alias("nodes"), relationships.alias("relationships"))
