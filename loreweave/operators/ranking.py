"""Fusion, expansion, context, reranking and diversity of candidates."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed rank offset of reciprocal-rank fusion.
RRF = 60


def has_text(c: Column) -> Column:
    """Neither null nor blank; never null itself. White space is below 33, so most texts are settled by their first character."""
    text = c.cast("string")
    return F.coalesce((F.ascii(text) > 32) | text.rlike(r"\S"), F.lit(False))


def completed(candidates: DataFrame) -> DataFrame:
    """The candidates of branches that completed; without a status column, all."""
    return candidates.where("status = 'COMPLETED'").drop("status") if "status" in candidates.columns else candidates


def _accepted(candidates: DataFrame, per_branch: int) -> Column:
    return (F.col("rank") <= per_branch) & has_text(F.col("chunk_id")) & has_text(F.col("document_id"))


def _cited(rows: DataFrame, derived: int, by: tuple[str, ...]) -> DataFrame:
    """rows (by, chunk_id, known: text branches found it, first: where valid graph rows name it first, null if none do), a row a
    chunk, with accepted: graph rows may name it, since it is known or of the first `derived` others in order of appearance."""
    new = ~F.col("known") & F.col("first").isNotNull()
    order = F.row_number().over(Window.partitionBy(*by, new).orderBy("first", "chunk_id"))
    return rows.withColumn("accepted", F.col("first").isNotNull() & (F.col("known") | (order <= derived)))


def _named(*columns: str) -> Column:
    """Rows without a request (or channel) belong to none."""
    return reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns), F.lit(True))


def fuse(
    candidates: DataFrame, weights: dict[str, float] | None = None, pool: int = 60, per_branch: int = 60, graph: DataFrame | None = None,
    derived: int = 20, executed: dict[str, int] | None = None, by: tuple[str, ...] = (),
) -> DataFrame:
    """Weighted reciprocal-rank fusion of text branches and, as channel GRAPH, of the rows of graph plans.

    candidates: by (the columns that name a request), channel, subquery, chunk_id, document_id, rank, perhaps status; graph: by,
    rank, place, chunk_id, document_id, fact_id. Each channel's term is weight / executed / (60 + rank), executed being the number
    of subqueries among all its completed candidates, or what `executed` says; of a chunk found several times under one (channel,
    subquery) the best rank counts. Candidates without chunk or document and ranks beyond per_branch are left out, as are chunks
    that only graph rows name beyond the first `derived`. Gives by, chunk_id, document_id, score, fused_rank and facts (fact ids)
    of the best `pool` of each request.
    """
    done = completed(candidates).withColumn("subquery", F.coalesce("subquery", F.lit("branch")))
    # a row a subquery with the best candidate of each chunk: one pass over the candidates, no join
    found = F.struct("chunk_id", "rank", "document_id")
    branches = done.groupBy(*by, "channel", "subquery").agg(F.collect_list(F.when(_named(*by, "channel") & _accepted(done, per_branch), found)).alias("found"))
    branches = branches.withColumn("executed", F.count("*").over(Window.partitionBy(*by, "channel")))  # a channel's subqueries are few
    valid = branches.select(*by, "channel", "subquery", "executed", F.inline("found"))
    # of a chunk found several times the best rank counts, then the smallest document
    best = valid.groupBy(*by, "chunk_id", "channel", "subquery", "executed").agg(F.min(F.struct("rank", "document_id")).alias("best"))
    nowhere = "cast(null as struct<rank:{rank},place:{place}>)"
    rows = best.select(*by, "chunk_id", "channel", "subquery", "executed", F.lit(0).alias("kind"), "best.rank", "best.document_id")
    if graph is None:
        rows = rows.withColumn("facts", F.lit(None).cast("array<string>"))
    else:
        kinds = dict(graph.dtypes)
        first, facts = F.min(F.struct("rank", "place", "document_id")), F.array_sort(F.collect_set(F.col("fact_id").cast("string"))).alias("facts")
        own = graph.where(_accepted(graph, per_branch)).groupBy(*by, "chunk_id").agg(F.when(_named(*by), first).alias("first"), facts).where("first is not null")
        own = own.select(*by, "chunk_id", F.lit("GRAPH").alias("channel"), F.lit("branch").alias("subquery"), F.lit(1).cast("long").alias("executed"), F.lit(1).alias("kind"), "first.rank", "first.document_id", "facts", F.struct("first.rank", "first.place").alias("first"))
        rows = rows.withColumn("facts", F.lit(None).cast("array<string>")).withColumn("first", F.expr(nowhere.format(**{c: kinds[c] for c in ("rank", "place")}))).unionByName(own)
    number, weight = F.col("executed"), F.lit(1.0)
    for name, n in (executed or {}).items():
        number = F.when(F.col("channel") == name, max(1, n)).otherwise(number)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("channel") == name, w).otherwise(weight)
    rows = rows.withColumn("term", weight / number / (RRF + F.col("rank")))
    sums = [F.round(F.sum("term"), 12).alias("score"), F.min_by("document_id", F.struct("kind", "channel", "subquery", "rank")).alias("document_id"), F.coalesce(F.first("facts", ignorenulls=True), F.array().cast("array<string>")).alias("facts")]
    if graph is None:
        scored = rows.groupBy(*by, "chunk_id").agg(*sums)
    else:
        scored = rows.groupBy(*by, "chunk_id").agg(*sums, (F.min("kind") == 0).alias("known"), F.min("first").alias("first"))
        scored = _cited(scored, derived, by).where("known or accepted").drop("known", "first", "accepted")
    place = F.row_number().over(Window.partitionBy(*by, F.lit(0)).orderBy(F.desc("score"), "chunk_id"))  # tasks cut their rows to `pool` first
    return scored.withColumn("fused_rank", place).where(F.col("fused_rank") <= pool)


def branch_counters(candidates: DataFrame, per_branch: int, graph: DataFrame | None = None, derived: int = 20, by: tuple[str, ...] = ()) -> DataFrame:
    """Per channel: accepted and truncated candidates, and subqueries executed. Of graph rows, citations count, and a row beyond
    per_branch counts once as truncated."""
    done = completed(candidates)
    good = F.coalesce(_accepted(done, per_branch), F.lit(False))
    out = done.groupBy(*by, "channel").agg(F.count_if(good).alias("accepted"), F.count_if(~good).alias("truncated"), F.count_distinct(F.coalesce("subquery", F.lit("branch"))).alias("executed"))
    if graph is None:
        return out
    inside, valid = F.col("rank") <= per_branch, _named(*by) & _accepted(graph, per_branch)
    # a row a chunk, and one (of no chunk) a graph row beyond per_branch
    cited = graph.where(F.col("rank").isNotNull()).groupBy(*by, F.when(inside, F.col("chunk_id")).alias("chunk_id"), F.when(~inside, F.col("rank")).alias("beyond"))
    cited = cited.agg(F.count_if(inside & valid).alias("valid"), F.count_if(inside & ~valid).alias("lost"), F.min(F.when(inside & valid, F.struct("rank", "place"))).alias("first"))
    text = done.where(good).select(*by, "chunk_id").distinct()
    both = cited.withColumn("text", F.lit(False)).unionByName(text.withColumn("text", F.lit(True)), allowMissingColumns=True)
    chunks = both.groupBy(*by, "chunk_id", "beyond").agg(F.sum("valid").alias("valid"), F.sum("lost").alias("lost"), F.min("first").alias("first"), F.bool_or("text").alias("known"), F.bool_or(~F.col("text")).alias("graph"))
    taken = F.coalesce(F.when(F.col("accepted"), F.col("valid")), F.lit(0)).alias("accepted")
    gone = F.when(F.col("beyond").isNotNull(), 1).otherwise(F.coalesce("lost", F.lit(0)) + F.when(F.col("accepted"), 0).otherwise(F.coalesce("valid", F.lit(0))))
    sums = _cited(chunks, derived, by).where("graph").select(*by, taken, gone.alias("truncated")).groupBy(*by).agg(F.sum("accepted").alias("accepted"), F.sum("truncated").alias("truncated"))
    return out.unionByName(sums.select(*by, F.lit("GRAPH").alias("channel"), "accepted", "truncated", F.lit(1).cast("long").alias("executed")))


def text_rounds(*rounds: DataFrame) -> DataFrame:
    """The candidates of all rounds, with the number of their round; a round with more columns (a status) keeps them."""
    out = None
    for k, own in enumerate(rounds, 1):
        own = own.withColumn("round", F.lit(k))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def diversify(ranking: DataFrame, per_document: int, most: int, rank: str = "fused_rank", comparison: bool = False) -> DataFrame:
    """In rank order, at most per_document rows of a document and `most` in all; a skipped row never affects others. A question that
    compares documents lifts the cap: `most` rows, whatever their documents."""
    if not 1 <= most <= 20 or per_document < 1:
        raise ValueError("1 to 20 rows, at least one of a document")
    per_document = most if comparison else per_document
    place = F.row_number().over(Window.partitionBy("document_id").orderBy(rank))
    return ranking.withColumn("place", place).where(F.col("place") <= per_document).orderBy(rank).limit(most).drop("place")


def rerank(ranking: DataFrame, scores: DataFrame, pool: int) -> DataFrame:
    """The first `pool` rows by the reranker's score (missing last), then fused rank; the tail as it was. scores: chunk_id, rerank_score."""
    joined = ranking.join(scores, "chunk_id", "left")
    inside = F.col("fused_rank") <= pool
    order = [F.desc(inside), F.when(inside, F.col("rerank_score")).desc_nulls_last(), F.col("fused_rank"), F.col("chunk_id")]
    return joined.withColumn("final_rank", F.row_number().over(Window.orderBy(*order)))  # a pool of at most a few hundred rows


def rerank_valid(ranking: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: do the scores cover exactly the ranked chunks, each once and from 0 to 1?"""
    both = ranking.select("chunk_id", F.lit(1).alias("asked")).join(scores.groupBy("chunk_id").agg(F.count("*").alias("n"), F.min("rerank_score").alias("low"), F.max("rerank_score").alias("high")), "chunk_id", "full_outer")
    bad = F.col("asked").isNull() | F.col("n").isNull() | (F.col("n") != 1) | F.col("low").isNull() | (F.col("low") < 0) | (F.col("high") > 1)
    return both.agg((F.count_if(bad) == 0).alias("valid"))


#: The outcomes of a parent lookup; the first that holds.
def parent_outcome(child: str = "child", parent: str = "parent", edge: str = "edge") -> Column:
    c, p, asked = (lambda n: F.col(f"{child}.{n}")), (lambda n: F.col(f"{parent}.{n}")), (lambda n: F.col(f"asked.{n}"))
    or_empty = lambda x: F.coalesce(x, F.lit(""))
    return (
        F.when(c("id").isNull(), "CHILD_NOT_FOUND").when((c("kb") != asked("kb")) | (c("document_id") != asked("document_id")), "CHILD_SCOPE")
        .when(or_empty(c("run")) != or_empty(asked("run")), "CHILD_RUN").when(or_empty(c("revision")) != or_empty(asked("revision")), "CHILD_REVISION")
        .when(c("parent_id").isNull(), "NO_PARENT").when(p("id").isNull(), "PARENT_NOT_FOUND").when(p("kind") != "PARENT", "PARENT_KIND")
        .when((p("kb") != c("kb")) | (p("document_id") != c("document_id")), "PARENT_SCOPE").when(or_empty(p("run")) != or_empty(c("run")), "PARENT_RUN")
        .when(or_empty(p("revision")) != or_empty(c("revision")), "PARENT_REVISION").when(F.col(f"{edge}.child").isNull(), "MEMBERSHIP").otherwise("VALID_PARENT")
    )


def parent_contexts(candidates: DataFrame, chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """The candidates (chunk_id, document_id, kb, run, revision) with outcome and parent_id. chunks: id, document_id, kind, parent_id,
    kb, run, revision; edges: parent, child. A null run or revision equals an empty one."""
    child, parent, edge = chunks.alias("child"), chunks.alias("parent"), edges.alias("edge")
    joined = candidates.alias("asked").join(child, F.col("chunk_id") == F.col("child.id"), "left").join(parent, F.col("child.parent_id") == F.col("parent.id"), "left")
    joined = joined.join(edge, (F.col("edge.parent") == F.col("parent.id")) & (F.col("edge.child") == F.col("child.id")), "left")
    outcome = parent_outcome()
    return joined.select(*(f"asked.{c}" for c in ("chunk_id", "document_id", "kb", "run", "revision")), outcome.alias("outcome"), F.when(outcome == "VALID_PARENT", F.col("parent.id")).alias("parent_id"))


def estimate(text: Column) -> Column:
    """Tokens of a text: a quarter of its characters, rounded up, at least 1."""
    return F.greatest(F.lit(1), F.floor((F.coalesce(F.length(text), F.lit(4)) + 3) / 4)).cast("long")


#: Outcomes of a lookup after which a chunk's neighbours are its context.
BESIDE = ("NO_PARENT", "PARENT_NOT_FOUND")


def adjacent(contexts: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """chunk_id, first_index, last_index, context (the texts of the chunks at most k places away, joined by a blank line in order) and
    tokens, the sum of their estimates.

    contexts: chunk_id, outcome; only children without a parent, or whose parent is missing, have adjacent chunks. chunks: id,
    document_id, kind, kb, run, revision, section, path, parent_id, chunk_index, text. Neighbours are children (or of no kind) of
    the same document, base, run and revision, and of the same section and path, or with the same missing parent. Each place asked
    for joins by document and index, so no document is compared with itself.
    """
    asked = contexts.where(F.col("outcome").isin(*BESIDE)).select("chunk_id")
    asked = asked.distinct()
    child = chunks.drop("text").join(asked, F.col("id") == F.col("chunk_id"), "left_semi").withColumn("place", F.explode(F.sequence(F.col("chunk_index") - k, F.col("chunk_index") + k))).alias("c")
    near = chunks.where(F.col("kind").isNull() | (F.col("kind") == "CHILD")).alias("n")
    c, n = (lambda x: F.col(f"c.{x}")), (lambda x: F.col(f"n.{x}"))
    same = lambda x: F.coalesce(n(x), F.lit("")) == F.coalesce(c(x), F.lit(""))
    beside = c("parent_id").isNull() & (n("section") == c("section")) & same("path") | (n("parent_id") == c("parent_id"))
    joined = child.join(near, (n("document_id") == c("document_id")) & (n("chunk_index") == F.col("place")) & (n("kb") == c("kb")) & same("run") & same("revision") & beside)
    parts = joined.groupBy(c("id").alias("chunk_id")).agg(F.array_sort(F.collect_list(F.struct(n("chunk_index").alias("i"), n("text").alias("text")))).alias("parts"))
    index = F.transform("parts", lambda p: p["i"])
    return parts.select("chunk_id", F.array_min(index).alias("first_index"), F.array_max(index).alias("last_index"), F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n").alias("context"), F.aggregate(F.transform("parts", lambda p: estimate(p["text"])), F.lit(0).cast("long"), lambda a, t: a + t).alias("tokens"))


def expanded(candidates: DataFrame, chunks: DataFrame, edges: DataFrame, k: int = 1, evidence: int = 20, **budget: int) -> DataFrame:
    """Parent expansion of many requests' candidates: the parent lookup, neighbours where there is no parent, then the budgets.

    candidates: request, fused_rank, perhaps citation_kind, and what parent_contexts takes; chunks as in adjacent. Of a request, the
    first `evidence` candidates that cite a text child (all that cite none of another kind, where there is no such column) are looked
    up, each within its own base, document, run and revision: the same chunk may have a parent for one request and none for another.
    Gives request, fused_rank, chunk_id, document_id, lookup, context_id, context, tokens, outcome (of candidates not looked up:
    null); without a context the outcome is the lookup's. A group of neighbours is one context, named by its first child.
    """
    scope = ["chunk_id", "document_id", "kb", "run", "revision"]
    text_child = F.col("citation_kind") == "TEXT_CHILD" if "citation_kind" in candidates.columns else F.lit(True)
    place = F.row_number().over(Window.partitionBy("request", "child").orderBy("fused_rank", "chunk_id"))  # a request has a few hundred
    marked = candidates.withColumn("child", F.coalesce(text_child, F.lit(False))).withColumn("asked", F.col("child") & (place <= evidence))
    asked = marked.where("asked")
    looked = parent_contexts(asked.select(*scope).distinct(), chunks, edges)
    beside = adjacent(looked, chunks, k).select("chunk_id", "context", "tokens")
    text = chunks.select(F.col("id").alias("parent_id"), F.col("text").alias("parent_text"))
    found = looked.join(text, "parent_id", "left").join(beside, "chunk_id", "left")
    alone = F.col("outcome").isin(*BESIDE)
    context = F.when(alone, F.col("context")).otherwise(F.col("parent_text"))
    named = F.when(alone, F.when(F.col("context").isNotNull(), F.concat(F.lit("beside:"), F.col("chunk_id").cast("string")))).otherwise(F.col("parent_id").cast("string"))
    tokens = F.when(alone, F.col("tokens")).when(F.col("parent_id").isNotNull(), estimate(F.col("parent_text")))
    found = found.select(*scope, F.col("outcome").alias("lookup"), named.alias("context_id"), context.alias("context"), F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens"))
    f, a = found.alias("f"), asked.alias("a")
    same = F.col("a.chunk_id") == F.col("f.chunk_id")
    for name in scope[1:]:
        same = same & F.col(f"a.{name}").eqNullSafe(F.col(f"f.{name}"))
    rows = a.join(f, same).select("a.request", "a.fused_rank", "a.chunk_id", "a.document_id", "f.lookup", "f.context_id", "f.context", "f.tokens")
    done = context_budget(rows, **budget).withColumn("outcome", F.when(F.col("outcome") == "NO_CONTEXT", F.col("lookup")).otherwise(F.col("outcome")))
    rest = marked.where(~F.col("asked")).select("request", "fused_rank", "chunk_id", "document_id")
    return done.unionByName(rest, allowMissingColumns=True)


def context_budget(contexts: DataFrame, most: int = 8, per_document: int = 3, tokens: int = 4096, by: str = "request") -> DataFrame:
    """Greedy choice in rank order within budgets; one that doesn't fit is skipped, later smaller ones may fit.

    contexts: by, fused_rank, chunk_id, document_id, context_id (null: none), tokens. Adds outcome. A fold over the few
    candidates of one request, so requests run in parallel.
    """

    def fold(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["fused_rank", "chunk_id"])
        seen: set = set()
        used: dict = {}
        left, taken, out = tokens, 0, []
        for row in own.itertuples():
            if pd.isna(row.context_id):
                out.append("NO_CONTEXT")
            elif row.context_id in seen:
                out.append("DEDUPLICATED")
            elif taken >= most:
                out.append("CONTEXT_BUDGET")
            elif used.get(row.document_id, 0) >= per_document:
                out.append("DOCUMENT_BUDGET")
            elif row.tokens > left:
                out.append("TOKEN_BUDGET")
            else:
                out.append("INCLUDED")
                seen.add(row.context_id)
                used[row.document_id] = used.get(row.document_id, 0) + 1
                left, taken = left - row.tokens, taken + 1
        return own.assign(outcome=out)

    schema = ", ".join([*(f"`{n}` {t}" for n, t in contexts.dtypes), "outcome string"])
    return contexts.groupBy(by).applyInPandas(fold, schema)


def running_budget(rows: DataFrame, text: str, budget: int, by: list[str], *order: str) -> DataFrame:
    """Texts cut so that, in order, they hold `budget` characters in all."""
    before = F.coalesce(F.sum(F.length(text)).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("kept_text", F.substring(F.col(text), F.lit(1), F.greatest(F.lit(0), F.lit(budget) - before).cast("int")))


def evidence_expansion(seeds: DataFrame, edges: DataFrame, evidence: DataFrame, most: int) -> DataFrame:
    """Facts asserted by the chunks the seeds stand for: the parent where there is one, else the seed. Ordered by seed rank,
    evidence and fact; the limit is over all seeds. seeds: seed_rank, chunk_id; edges: parent, child; evidence: evidence_id, chunk_id, fact_id."""
    parent = edges.select("parent", F.col("child").alias("chunk_id"))
    joined = seeds.join(parent, "chunk_id", "left").select("seed_rank", "chunk_id", F.coalesce("parent", "chunk_id").alias("evidence_chunk"))
    found = joined.join(evidence.withColumnRenamed("chunk_id", "evidence_chunk"), "evidence_chunk")
    return found.orderBy("seed_rank", "evidence_id", "fact_id").limit(most)


def merge_facts(facts: DataFrame) -> DataFrame:
    """One row per fact: its evidence ids, and the first citation of each chunk. facts: fact_id, chunk_id, evidence_id."""
    first = facts.groupBy("fact_id", "chunk_id").agg(F.min("evidence_id").alias("citation"), F.collect_set("evidence_id").alias("own"))
    return first.groupBy("fact_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("own")))).alias("evidence_ids"), F.array_sort(F.collect_list("citation")).alias("citations"))


