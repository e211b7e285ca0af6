"""Citations, answer checks and follow-up decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def citation_catalog(selected: DataFrame, by: str = "request") -> DataFrame:
    """Numbers evidence E1.. (text children and graph parents together) and contexts CTX1.. of each request in rank order; a chunk is
    cited once per kind. selected: by, rank, kind (TEXT_CHILD, GRAPH_PARENT or CONTEXT), chunk_id. A request selects a few dozen."""
    first = selected.groupBy(by, "kind", "chunk_id").agg(F.min("rank").alias("rank"))
    context = F.col("kind") == "CONTEXT"
    number = F.row_number().over(Window.partitionBy(by, context).orderBy("rank", "kind", "chunk_id"))
    return first.withColumn("citation_id", F.concat(F.when(context, "CTX").otherwise("E"), number.cast("string")))


def fact_citations(facts: DataFrame, catalog: DataFrame, by: str = "request") -> DataFrame:
    """by, fact_id, citation_ids: those of the fact's own chunks among the graph parents, or of all graph parents if none is cited.

    facts: by, fact_id, chunk_id (a row for each citation; null: none)."""
    parents = catalog.where("kind = 'GRAPH_PARENT'").select(by, "chunk_id", "citation_id")
    every = parents.groupBy(by).agg(F.array_sort(F.collect_set("citation_id")).alias("every"))
    own = facts.join(parents, [by, "chunk_id"], "left").groupBy(by, "fact_id").agg(F.array_sort(F.collect_set("citation_id")).alias("own"))
    none = F.array().cast("array<string>")
    return own.join(every, by, "left").select(by, "fact_id", F.when(F.size("own") > 0, F.col("own")).otherwise(F.coalesce("every", none)).alias("citation_ids"))


#: Limits of an answer, and the codes of what may be wrong with it.
VERSION, MOST_CLAIMS, MOST_LIMITATIONS = 1, 40, 20


def _text(c: Column) -> Column:
    return F.coalesce(~c.rlike(r"^\s*$"), F.lit(False))


def answer_violations(answers: DataFrame, catalog: DataFrame, facts: DataFrame, by: str = "request") -> DataFrame:
    """by, code, n: how often each problem occurs in a request's answer; an answer without rows is sound.

    answers: by, answer, a struct (null: missing) of version, status (ANSWERED or an abstention), text, level, score, limitations
    (array of code, description) and claims (array of id, text, kind TEXT or GRAPH, citation_ids, fact_ids, evidence_ids); catalog:
    by, kind, citation_id; facts: by, fact_id, citation_ids, evidence_ids. What a request may cite is gathered per request and meets
    its answer in one join.
    """
    none = F.array().cast("array<string>")
    citable = catalog.where("kind <> 'CONTEXT'").groupBy(by).agg(F.collect_set("citation_id").alias("citable"))
    known = facts.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct(F.col("fact_id").cast("string"), "citation_ids"))).alias("facts"), F.array_distinct(F.flatten(F.collect_list("evidence_ids"))).alias("evidence"))
    joined = answers.join(citable, by, "left").join(known, by, "left")
    joined = joined.select(by, "answer", F.coalesce("citable", none).alias("citable"), F.coalesce("facts", F.create_map().cast("map<string,array<string>>")).alias("facts"), F.coalesce("evidence", none).alias("evidence"))
    a, listed = F.col("answer"), lambda c: F.coalesce(c, none)
    claims, limits = F.coalesce(a["claims"], F.array().cast(_kind(answers, "claims"))), F.coalesce(a["limitations"], F.array().cast(_kind(answers, "limitations")))
    when = lambda c, code: F.when(c, F.array(F.lit(code))).otherwise(none)
    answered = F.coalesce(a["status"] == "ANSWERED", F.lit(False))
    whole = F.concat(
        when(~a["version"].eqNullSafe(F.lit(VERSION)), "answer.version.unsupported"), when(a["status"].isNull(), "answer.status.missing"),
        when(a["level"].isNull() | a["score"].isNull() | F.isnan("answer.score") | ~a["score"].between(0.0, 1.0), "answer.confidence.invalid"),
        when(F.size(limits) > MOST_LIMITATIONS, "answer.limitations.limit"), when(F.size(claims) > MOST_CLAIMS, "answer.claims.limit"),
        when(answered & ~_text(a["text"]), "answer.text.missing"), when(answered & (F.size(claims) == 0), "answer.claims.missing"), when(~answered & (F.size(claims) > 0), "answer.abstention.claims-not-empty"),
    )
    limitation = F.transform(F.filter(limits, lambda x: x.isNull() | ~_text(x["code"]) | ~_text(x["description"])), lambda _: F.lit("answer.limitation.invalid"))

    def sound(x: Column) -> Column:
        return x.isNotNull() & _text(x["id"]) & _text(x["text"]) & x["kind"].isNotNull()

    def graph_claim(x: Column) -> Column:
        own = listed(x["fact_ids"])
        allowed = F.flatten(F.transform(own, lambda f: F.coalesce(F.element_at("facts", f), none)))
        missing = (F.size(own) == 0) | (F.size(listed(x["evidence_ids"])) == 0)
        rest = F.concat(
            when(F.size(F.array_except(own, F.map_keys("facts"))) > 0, "answer.graph-claim.fact-unknown"), when(F.size(F.array_except(listed(x["evidence_ids"]), F.col("evidence"))) > 0, "answer.graph-claim.evidence-unknown"),
            when(~F.arrays_overlap(listed(x["citation_ids"]), allowed), "answer.graph-claim.citation-type-invalid"),
        )
        return F.when(missing, F.array(F.lit("answer.graph-claim.references-missing"))).otherwise(rest)

    def claim(x: Column) -> Column:
        cited = listed(x["citation_ids"])
        references = (F.size(listed(x["fact_ids"])) > 0) | (F.size(listed(x["evidence_ids"])) > 0)
        own = F.concat(
            when((F.size(cited) == 0) | (F.size(F.array_except(cited, F.col("citable"))) > 0), "answer.claim.citation-unknown"),
            when((x["kind"] == "TEXT") & references, "answer.text-claim.graph-references"), F.when(x["kind"] == "GRAPH", graph_claim(x)).otherwise(none),
        )
        return F.when(sound(x), own).otherwise(F.array(F.lit("answer.claim.invalid")))

    ids = F.transform(F.filter(claims, sound), lambda x: x["id"])
    repeated = F.array_repeat(F.lit("answer.claim.id-duplicate"), F.size(ids) - F.size(F.array_distinct(ids)))
    codes = F.when(a.isNull(), F.array(F.lit("answer.missing"))).otherwise(F.concat(whole, limitation, repeated, F.flatten(F.transform(claims, claim))))
    return joined.select(by, F.explode(codes).alias("code")).groupBy(by, "code").agg(F.count("*").alias("n"))


def _kind(answers: DataFrame, name: str) -> str:
    return answers.schema["answer"].dataType[name].dataType.simpleString()


def follow_up(requests: DataFrame, reserve_ms: int) -> DataFrame:
    """Adds follow_up: RUN, or the first reason against it. requests: cancelled, gaps array, remaining_ms, refinements array."""
    decision = (
        F.when(F.col("cancelled"), "CANCELLED").when(F.size(F.filter("gaps", lambda g: F.trim(g) != "")) == 0, "NO_CONCRETE_GAP")
        .when(F.col("remaining_ms") < reserve_ms, "DEADLINE_RESERVE").when(F.size("refinements") == 0, "NO_REFINEMENTS").otherwise("RUN")
    )
    return requests.withColumn("follow_up", decision)


def owned(rows: DataFrame, ids: DataFrame, kb: str, key: str = "document_id", most: int = 128) -> DataFrame:
    """The rows (key, kb) of one knowledge base among the ids asked for (column key; a request names at most `most`)."""
    asked = ids.select(key).distinct()
    if asked.limit(most + 1).count() > most:
        raise ValueError(f"at most {most} ids")
    return rows.where(F.col("kb") == kb).join(F.broadcast(asked), key, "left_semi")  # checked: at most `most` rows


def enriched(citations: DataFrame, documents: DataFrame, fallback: str = "unknown source") -> DataFrame:
    """citations with the document's label; missing ones get the fallback and a warning."""
    joined = citations.join(documents.select("document_id", F.col("label").alias("found")), "document_id", "left")
    return joined.withColumn("label", F.coalesce("found", F.lit(fallback))).withColumn("missing", F.col("found").isNull()).drop("found")


def sufficiency(evidence_count: int, judged: tuple[str, list[str]] | None) -> tuple[str, list[str]]:
    """(verdict, gaps) of an evidence check. Without evidence: MISSING, a gap for the whole question; a failed model call
    (None) or an unknown verdict: PARTIAL without gaps; blank gaps are left out."""
    if evidence_count == 0:
        return "MISSING", ["no evidence"]
    if judged is None or judged[0] not in ("SUFFICIENT", "PARTIAL", "MISSING"):
        return "PARTIAL", []
    return judged[0], [g.strip() for g in judged[1] if g.strip()]


def synthesise(write, check) -> tuple[list, list[str]]:
    """(claims, codes): what write(None) gives if check finds nothing; else one repair, write(codes); else no claims.

    write takes the codes to repair (None at first) and gives claims, or None on failure; check gives the codes of claims.
    """
    claims, codes = write(None), ["model.failed"]
    if claims is not None:
        codes = check(claims)
        if not codes:
            return claims, []
    claims = write(codes)
    left = ["model.failed"] if claims is None else check(claims)
    return ([], left) if left else (claims, [])
