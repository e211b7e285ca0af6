"""Results and payloads: JSON envelopes, tagged values, model answers, planner fallbacks, limits of settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENVELOPE = "version int, answer string, evidence array<struct<citation_id:string,chunk_id:bigint>>"


def result_problem(version: Column, answer: Column, evidence: Column, most: int = 20) -> Column:
    """The code of what makes a result unfit to be stored or read, or null."""
    ids = F.transform(evidence, lambda e: e["citation_id"])
    return (
        F.when(~version.eqNullSafe(F.lit(1)), "result.version.unsupported").when(answer.isNull() | evidence.isNull(), "result.structure.invalid")
        .when(F.size(evidence) > most, "result.evidence.limit").when(F.exists(ids, lambda i: i.isNull()), "result.structure.invalid")
        .when(F.size(F.array_distinct(ids)) < F.size(ids), "result.citation.duplicate")
    )


def encoded(results: DataFrame, most: int = 20) -> DataFrame:
    """request, payload, problem: every result as JSON of version 1; one with a problem is to be refused, not stored."""
    problem = result_problem(F.lit(1), F.col("answer"), F.col("evidence"), most)
    return results.select("request", F.to_json(F.struct(F.lit(1).alias("version"), "answer", "evidence")).alias("payload"), problem.alias("problem"))


def decoded(payloads: DataFrame, most: int = 20) -> DataFrame:
    """request, version, answer, evidence, problem of payloads; none is left out, text that is no JSON object has a problem too."""
    rows = payloads.select("request", F.from_json("payload", ENVELOPE).alias("r")).select("request", "r.*")
    return rows.withColumn("problem", result_problem(F.col("version"), F.col("answer"), F.col("evidence"), most))


def tagged_node(label: Column, id_: Column, **properties: Column) -> Column:
    return F.struct(F.lit("node").alias("_type"), id_.cast("string").alias("_id"), label.alias("_label"), *(c.alias(n) for n, c in properties.items()))


def tagged_relationship(kind: Column, id_: Column, start: Column, end: Column) -> Column:
    return F.struct(F.lit("relationship").alias("_type"), id_.cast("string").alias("_id"), kind.alias("_kind"), start.cast("string").alias("_start"), end.cast("string").alias("_end"))


def model_json(answer: Column) -> Column:
    """The JSON inside a model's answer: without code fences, from the first [ to the last ], where a list stands first, or from the
    first { to the last }."""
    plain = F.regexp_replace(answer, r"```[A-Za-z]*", "")
    return F.nullif(F.regexp_extract(plain, r"(?s)^[^\[{]*(\[.*\]|\{.*\})", 1), F.lit(""))


def tokenizer_of(explicit: Column, model: Column) -> Column:
    """An explicit cl100k_base, else that of the models that use it, else the byte estimator."""
    known = F.lower(model).isin("text-embedding-3-small", "text-embedding-3-large", "text-embedding-ada-002")
    return F.when(explicit == "cl100k_base", explicit).when(known, "cl100k_base").otherwise("utf8-byte-v1")


def chunk_metadata(**columns: Column) -> Column:
    """A map of the given values as strings, without nulls."""
    pairs = F.create_map(*(x for n, c in columns.items() for x in (F.lit(n), c.cast("string"))))
    return F.map_filter(pairs, lambda _, v: v.isNotNull())


@dataclass(frozen=True)
class SubQuery:
    id: str
    text: str


def planned(question: str, proposed: list[tuple[str, str]] | None, most: int = 3, characters: int = 500) -> list[SubQuery]:
    """A planner's subqueries if they are sound (1 to most, ids that differ, texts that are not blank), else one with the question."""
    flat = lambda s: " ".join(s.split())[:characters]
    own = [SubQuery(i.strip(), flat(t)) for i, t in proposed or []]
    if 1 <= len(own) <= most and len({s.id for s in own}) == len(own) and all(s.id and s.text for s in own):
        return own
    return [SubQuery("fallback-1", flat(question))]


@dataclass(frozen=True)
class SearchSettings:
    evidence: int = 10
    candidates: int = 60
    most_candidates: int = 200
    rerank: int = 20
    seeds: int = 10
    facts: int = 20
    subqueries: int = 3
    terms: int = 8
    reserve_ms: int = 5_000
    deadline_ms: int = 60_000

    def __post_init__(self):
        bounds = (
            ("evidence", 1, 20), ("candidates", 1, self.most_candidates), ("most_candidates", 1, 200), ("rerank", 1, 20), ("seeds", 1, 10),
            ("facts", 1, 20), ("subqueries", 1, 3), ("terms", 1, 16), ("reserve_ms", 0, self.deadline_ms - 1),
        )
        wrong = [n for n, low, high in bounds if not low <= getattr(self, n) <= high]
        if wrong:
            raise ValueError("out of bounds: " + ", ".join(wrong))


@dataclass(frozen=True)
class ChunkSettings:
    target: int = 800
    overlap: int = 80
    parent: int = 1600
    pages: int = 2
    header: int = 96

    def __post_init__(self):
        if not (0 <= self.overlap < self.target <= self.parent and 1 <= self.pages <= 2 and 0 <= self.header < self.target):
            raise ValueError("overlap < target <= parent, 1 or 2 pages, header < target")


def assembled(selected: DataFrame, facts: DataFrame, contexts: DataFrame) -> DataFrame:
    """The evidence of an answer: each selected chunk with its facts and context; a fact goes to the best-ranked chunk that has it.

    selected: chunk_id, final_rank; facts: chunk_id, fact_id; contexts: chunk_id, context.
    """
    ranked = facts.join(selected, "chunk_id")
    owner = ranked.groupBy("fact_id").agg(F.min_by("chunk_id", F.struct("final_rank", "chunk_id")).alias("chunk_id"))
    own = owner.groupBy("chunk_id").agg(F.array_sort(F.collect_list("fact_id")).alias("facts"))
    none = F.array().cast(dict(own.dtypes)["facts"])
    return selected.join(own, "chunk_id", "left").join(contexts, "chunk_id", "left").withColumn("facts", F.coalesce("facts", none))
