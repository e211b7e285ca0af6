"""Connected components of a table of links by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Of u's smaller neighbours the least one is linked with u, others are linked with that one."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("a"), F.col("m").alias("b"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """links: long columns a, b. Gives (node, root), root the smallest node of the component, for every node but the roots.

    known: what an earlier call gave for other links; they stand for those, so that rounds are spent on what is new alone. Edges
    are written out after every round; the driver sees a count and a checksum. Links of a node to itself are ignored. The first
    round reads links several times, so they should be cheap to read, as a table is.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = edges if known is None else edges.union(known.select("node", "root"))
    seen = None if known is None else _state(edges)
    while True:
        edges = materialize(_small_star(_large_star(edges)).distinct(), "stars")
        now = _state(edges)
        if now == seen or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
