"""A round of several graph plans, whose results have unlike columns, as one table.

Values become VARIANT objects, so rows of all plans stand in one table in the order of the plans. A plan that is not valid, or
whose time is over, gives no rows and an attempt with its status; what the others found stays. The round is COMPLETED if any
plan is, else DEADLINE_EXCEEDED if any is, else FAILED; its failure category is the first of its attempts that has one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loreweave.plans.graphplan import Graph, GraphPlan, validate
from loreweave.plans.support import CITATION, FACT, rows_and_facts, supported_match
from loreweave.sources.shared import written

#: What an attempt may end as, in the order in which one decides for the round; the last stands for all others.
COMPLETED, DEADLINE, FAILED, INVALID = "COMPLETED", "DEADLINE_EXCEEDED", "FAILED", "VALIDATION_FAILED"
EXPIRED = "deadline.expired"


@dataclass(frozen=True)
class Round:
    """rows: plan_no, row (within its plan), values (variant); attempts: plan_no, attempt, status, rows, category; facts: plan_no, row,
    no (within the row) and what is shown of each fact, a row each, since a group may have as many as there are paths."""

    rows: DataFrame | None
    attempts: DataFrame
    facts: DataFrame | None = None

    def status(self) -> DataFrame:
        """One row, or none without plans: status, rows, category."""
        any_of = lambda s: F.bool_or(F.col("status") == s)
        named = F.when(F.trim("category") != "", F.struct("plan_no", "category"))
        out = self.attempts.agg(F.when(any_of(COMPLETED), COMPLETED).when(any_of(DEADLINE), DEADLINE).otherwise(FAILED).alias("status"), F.sum("rows").alias("rows"), F.min(named)["category"].alias("category"), F.count("*").alias("n"))
        return out.where("n > 0").drop("n")

    def ranked(self) -> DataFrame | None:
        """rows with rank: their place in the round. A round has a few plans of at most a few hundred rows."""
        return None if self.rows is None else self.rows.withColumn("rank", F.row_number().over(Window.orderBy("plan_no", "row")))

    def citations(self) -> DataFrame | None:
        """What fusion takes as graph rows: rank, place, chunk_id, document_id, fact_id of every citation of every row."""
        rows = self.ranked()
        if rows is None:
            return None
        facts = self.facts.join(F.broadcast(rows.select("plan_no", "row", "rank")), ["plan_no", "row"])
        cited = facts.select("rank", (F.col("no") - 1).alias("k"), "fact_id", F.posexplode("citations").alias("c", "citation"))
        return cited.select("rank", F.struct("k", "c").alias("place"), F.col("citation.chunk_id").alias("chunk_id"), F.col("citation.document_id").alias("document_id"), "fact_id")


def round_of(spark: SparkSession, plans: list[GraphPlan], graph: Graph, found: DataFrame, scan_limit: int | None = None, expired: Callable[[int], bool] = lambda _: False, show: tuple[str, ...] = FACT, cited: tuple[str, ...] = CITATION) -> Round:
    """Runs the plans over supported paths (found as support.supports gives it). expired(k): is the time of plan k over? show (fact_id
    and citations among them): what is kept of a fact, cited (chunk_id and document_id first): of a citation."""
    parts, attempts = [], []
    pattern = lambda plan: repr((plan.root, plan.hops, plan.filters))
    asked = Counter(pattern(plan) for k, plan in enumerate(plans, 1) if not expired(k))
    known_paths: dict[str, DataFrame] = {}
    for k, plan in enumerate(plans, 1):
        if expired(k):
            attempts.append((k, f"graph-{k}", DEADLINE, EXPIRED))
            continue
        if problems := validate(plan, graph.schema):
            attempts.append((k, f"graph-{k}", INVALID, problems[0]))
            continue
        try:
            if asked[key := pattern(plan)] > 1 and key not in known_paths:  # plans that differ in what they show of the same paths
                known_paths[key] = written(supported_match(plan, graph, found), "paths")
            values, facts = rows_and_facts(plan, graph, found, scan_limit, known_paths.get(key), show, cited)
            parts.append((values.select(F.lit(k).alias("plan_no"), "row", F.to_variant_object("values").alias("values")), facts.withColumn("plan_no", F.lit(k))))
            attempts.append((k, f"graph-{k}", COMPLETED, None))
        except AnalysisException as e:  # a table without the columns that the schema declares
            attempts.append((k, f"graph-{k}", FAILED, type(e).__name__))
    known = spark.createDataFrame(attempts, "plan_no int, attempt string, status string, category string")
    if not parts:
        return Round(None, known.withColumn("rows", F.lit(0).cast("long")))
    facts = written(reduce(DataFrame.unionByName, (f for _, f in parts)), "round-facts")  # asked for by rows, attempts and citations
    rows = written(reduce(DataFrame.unionByName, (v for v, _ in parts)).join(facts.select("plan_no", "row").distinct(), ["plan_no", "row"]), "round")
    counts = rows.groupBy("plan_no").agg(F.count("*").alias("rows"))
    return Round(rows, known.join(counts, "plan_no", "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("long"))), facts)
