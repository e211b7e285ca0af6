"""Schema drafts: candidate pages, projection to a schema, reconciliation, promotion and publication guards."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loreweave.functions import canonical
from loreweave.operators.control import latest


def candidate_page(candidates: DataFrame, decisions: DataFrame, number: int, size: int) -> DataFrame:
    """A page of candidates by identity, with each one's newest decision. Page and size are clamped."""
    newest = latest(decisions.select("identity", "action", "seq"), ["identity"], "seq").select("identity", "action")
    number, size = max(0, number), min(100, max(1, size))
    return candidates.join(newest, "identity", "left").orderBy("identity").offset(number * size).limit(size)


def projected_schema(properties: DataFrame) -> DataFrame:
    """label and its properties as a sorted array of (name, type, required); required iff the property is part of the key.
    properties: label, name, type, is_key."""
    entry = F.struct("name", "type", F.col("is_key").alias("required"))
    return properties.groupBy("label").agg(F.array_sort(F.collect_set(entry)).alias("properties"))


def reconciliation(decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """identity, conflict: COORDINATE where the decided candidate is gone, PINNED_DEFINITION where its value changed.
    decisions: identity, pinned; candidates: identity, value."""
    joined = decisions.join(candidates, "identity", "left")
    kind = F.when(F.col("value").isNull(), "COORDINATE").when(F.col("pinned").isNotNull() & (F.col("pinned") != F.col("value")), "PINNED_DEFINITION")
    return joined.select("identity", kind.alias("conflict")).where("conflict is not null")


def promotable(runs: DataFrame, drafts: DataFrame) -> DataFrame:
    """Finished analysis runs whose draft still has the revision, running run and sources they started from."""
    keys = ["draft_id", "revision", "run_id", "sources"]
    return runs.join(drafts.select("draft_id", F.col("running_run_id").alias("run_id"), "revision", "sources"), keys, "left_semi")


def analysis_outcome(results: DataFrame) -> DataFrame:
    """Per run: FAILED without a success, PARTIAL with any failure, else COMPLETED. results: run_id, succeeded."""
    counted = results.groupBy("run_id").agg(F.count_if("succeeded").alias("succeeded"), F.count_if(~F.col("succeeded")).alias("failed"))
    return counted.withColumn("status", F.when(F.col("succeeded") == 0, "FAILED").when(F.col("failed") > 0, "PARTIAL").otherwise("COMPLETED"))


def next_revision(revisions: DataFrame) -> DataFrame:
    return revisions.groupBy("draft_id").agg((F.max("revision") + 1).alias("next_revision"))


def support_risk(merged: DataFrame) -> DataFrame:
    """One row: candidates with a single support, and guided ones never observed. merged: support, origins."""
    guided = F.array_contains("origins", "GUIDED") & ~F.array_contains("origins", "OBSERVED")
    return merged.agg(F.count_if(F.col("support") == 1).alias("single_support"), F.count_if(guided).alias("guided_only"))


def guidance_overlap(guidance: DataFrame) -> DataFrame:
    """Concepts that a request both wants and excludes, or names twice: request, overlap, repeated. guidance: request, wanted, excluded."""
    low = lambda c: F.transform(c, lambda x: F.lower(F.trim(x)))
    rows = guidance.select("request", low("wanted").alias("w"), low("excluded").alias("x"))
    return rows.select("request", F.array_sort(F.array_intersect("w", "x")).alias("overlap"), (F.size("w") != F.size(F.array_distinct("w"))).alias("repeated")).where((F.size("overlap") > 0) | F.col("repeated"))


def held_out(documents: DataFrame, contributing: DataFrame) -> DataFrame:
    """Documents that gave nothing to a draft, neither by id nor by content. Both: document_id, sha256."""
    return documents.join(contributing.select("document_id"), "document_id", "left_anti").join(contributing.select("sha256"), "sha256", "left_anti")


def contributing_sources(drafts: DataFrame, aggregates: DataFrame, results: DataFrame, revisions: DataFrame) -> DataFrame:
    """draft_id, source_id, sha256 along draft, aggregate, result and source revision, each once. Drafts and revisions are few beside
    results, so a task keeps its share of them and need not sort the results."""
    own = drafts.join(aggregates, "aggregate_id", "left_semi").select("draft_id", "aggregate_id").hint("shuffle_hash")
    named = revisions.select("revision_id", "sha256").hint("shuffle_hash")
    return results.join(own, "aggregate_id").join(named, "revision_id").select("draft_id", "source_id", "sha256").distinct()


def semantic_key(kind: Column, coordinate: Column, alternatives: Column) -> Column:
    """What makes conflicts of different revisions the same: type, coordinate and the set of alternatives, whatever their order or
    spelling. alternatives: JSON texts."""
    own = F.array_sort(F.array_distinct(F.transform(alternatives, canonical.canonical)))
    identity = F.struct(own.alias("alternatives"), coordinate.alias("coordinate"), kind.alias("type"))
    return canonical.fingerprint(canonical.canonical_value(identity))


def valid_resolution(alternatives: Column, selected: Column, custom: Column) -> Column:
    """Exactly one of a selected alternative, which is among them, and a custom one that says something."""
    plain = F.transform(alternatives, lambda a: F.coalesce(F.try_variant_get(F.try_parse_json(a), "$", "string"), a))
    written = canonical.canonical(custom)
    text = F.try_variant_get(F.try_parse_json(custom), "$", "string")
    said = F.coalesce(written.isNotNull() & ~written.isin("null", "{}", "[]") & ~(written.startswith('"') & F.coalesce(text.rlike(r"^\s*$"), F.lit(False))), F.lit(False))
    chosen = F.coalesce(F.array_contains(plain, selected), F.lit(False))
    return F.when(selected.isNotNull() & custom.isNull(), chosen).when(selected.isNull() & custom.isNotNull(), said).otherwise(F.lit(False))


def carried(conflicts: DataFrame) -> DataFrame:
    """Conflicts along the revisions of their drafts, each unresolved one with the resolution that its like had last.

    conflicts: conflict_id, draft_id, revision (a number that grows), type, coordinate, alternatives (array of JSON texts), resolved,
    selected, custom (JSON text), resolved_at, created_at, perhaps semantic_key (blank: derived). Of the resolved conflicts of one key
    the latest revision's counts, in it the one resolved, then created last, then the smallest id; if its resolution does not hold for
    the conflict, nothing is carried. Adds semantic_key, carried; resolved, selected and custom (canonical) are as they are then.

    What is carried on becomes history itself, but never differs from what was resolved by hand before it, so one ordered pass over the
    revisions of each key gives the fold. A revision's conflicts are summed up to one row a key first.
    """
    # conflicts that are alike are named once, since a key parses and writes JSON
    like = ("type", "coordinate", "alternatives")
    named = conflicts.select(*like).distinct().select(*(F.col(c).alias(f"_{c}") for c in like), semantic_key(*map(F.col, like)).alias("_derived"))
    alike = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in like))
    known = F.when(~F.col("semantic_key").rlike(r"^\s*$"), F.col("semantic_key")) if "semantic_key" in conflicts.columns else F.lit(None).cast("string")
    rows = conflicts.join(named, alike, "left").withColumn("semantic_key", F.coalesce(known, F.col("_derived"))).drop("_derived", *(f"_{c}" for c in like))
    keys = ["draft_id", "semantic_key"]
    later = lambda c: F.coalesce(-F.unix_micros(c), F.lit((1 << 63) - 1))
    order = F.when(F.col("resolved"), F.struct(later("resolved_at"), later("created_at"), "conflict_id"))
    per = rows.groupBy(*keys, "revision").agg(F.min_by(F.struct("selected", "custom"), order).alias("own"))
    before = F.last("own", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("revision").rowsBetween(Window.unboundedPreceding, -1))
    past = per.withColumn("past", before).select(*keys, "revision", "past")
    out = rows.join(past, [*keys, "revision"], "left")
    holds = ~F.col("resolved") & F.coalesce(valid_resolution(F.col("alternatives"), F.col("past.selected"), F.col("past.custom")), F.lit(False))
    out = out.withColumn("carried", holds)
    value = lambda c: F.when(F.col("carried"), F.col(f"past.{c}")).otherwise(F.col(c))
    return out.withColumn("selected", value("selected")).withColumn("custom", F.when(F.col("carried") & F.col("past.custom").isNotNull(), canonical.canonical(F.col("past.custom"))).otherwise(value("custom"))).withColumn("resolved", F.col("resolved") | F.col("carried")).drop("past")
