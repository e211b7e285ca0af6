"""Queries of the retrieval and ranking operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.operators import answering, postings, ranking, retrieval
from loreweave.queries import query
from loreweave.sources.shared import shared_path
from loreweave.sources.tables import table


def vectors(spark: SparkSession, sf_dir: str, ids: list[int]) -> list[tuple[str, list[float]]]:
    """The few vectors a request asks with, in order."""
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isin(ids)).select("vec_id", "embedding").collect()
    return [(f"q{r[0]}", [float(x) for x in r[1]]) for r in sorted(rows)]


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", F.concat(F.lit("L"), "label").alias("document_id"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two branches: the chunks nearest to vector 0, and the newest English documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "lang", "source")
    chunks = embedded(spark, sf_dir)
    near = retrieval.dense(chunks, vectors(spark, sf_dir, [0]), 60).join(chunks.select("chunk_id", "document_id"), "chunk_id").select(F.lit("DENSE").alias("channel"), "subquery", "chunk_id", "document_id", "rank")
    new = retrieval.metadata(docs, 60, lang="EN").select(F.lit("METADATA").alias("channel"), "subquery", F.col("document_id").alias("chunk_id"), F.col("source").alias("document_id"), "rank")
    return near.unionByName(new)


DENSE_SQL = """
    SELECT 'q' || q.vec_id AS subquery, e.vec_id AS chunk_id, e.label,
           (1 + list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) / 2 AS score
    FROM embeddings e, embeddings q WHERE q.vec_id IN ({ids})"""
CANDIDATES_SQL = f"""
    dense AS ({DENSE_SQL.format(ids=0)}),
    cand AS (
      SELECT 'DENSE' AS channel, subquery, chunk_id, 'L' || label AS document_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM dense QUALIFY rank <= 60
      UNION ALL
      SELECT 'METADATA', '', doc_id, source, row_number() OVER (ORDER BY doc_id DESC) AS rank FROM documents WHERE lower(lang) = 'en' QUALIFY rank <= 60)"""
FUSED_SQL = f"""{CANDIDATES_SQL},
    scored AS (SELECT chunk_id, round(sum(1.0 / (60 + rank)), 12) AS score, min_by(document_id, channel) AS document_id FROM cand GROUP BY chunk_id),
    fused AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS fused_rank FROM scored QUALIFY fused_rank <= 60)"""


@query(f"""WITH {FUSED_SQL},
    d AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY fused_rank) AS place FROM fused)
    SELECT chunk_id, document_id, score, CAST(fused_rank AS INTEGER) AS fused_rank FROM d WHERE place <= 2 ORDER BY fused_rank LIMIT 10""")
def rrf_fusion_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = ranking.fuse(candidates(spark, sf_dir))
    return ranking.diversify(fused, 2, 10).select("chunk_id", "document_id", "score", "fused_rank")


@query(f"""WITH d AS ({DENSE_SQL.format(ids="0, 1, 2")})
    SELECT subquery, chunk_id, CAST(row_number() OVER (PARTITION BY subquery ORDER BY score DESC, chunk_id) AS INTEGER) AS rank, round(score, 9) AS score
    FROM d QUALIFY rank <= 10""")
def dense_topk_per_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.dense(embedded(spark, sf_dir), vectors(spark, sf_dir, [0, 1, 2]), 10)
    return hits.select("subquery", "chunk_id", "rank", F.round("score", 9).alias("score"))


@query("""SELECT doc_id AS document_id, source, CAST(row_number() OVER (ORDER BY doc_id DESC) AS INTEGER) AS rank
    FROM documents WHERE lower(lang) = 'de' QUALIFY rank <= 20""")
def metadata_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "lang", "source")
    return retrieval.metadata(docs, 20, lang="De", source=None).select("document_id", "source", "rank")


@query(f"""WITH d AS (SELECT conv_id AS document_id, conv_id % 5 = 0 AS wanted, row_number() OVER (PARTITION BY conv_id % 5 = 0 AND conv_id % 4 > 0 ORDER BY conv_id DESC) AS n FROM (SELECT DISTINCT conv_id FROM conversations)),
    h AS (SELECT conv_id * 1000 + turn AS chunk_id, conv_id AS document_id FROM conversations WHERE conv_id IN (SELECT document_id FROM d WHERE wanted AND document_id % 4 > 0 AND n <= 12) AND turn > 0)
    SELECT chunk_id, document_id, 1.0::DOUBLE AS score, CAST(row_number() OVER (ORDER BY chunk_id) AS INTEGER) AS rank FROM h QUALIFY rank <= 25""")
def metadata_chunk_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered documents of one base, newest first, and then their chunks; first turns are parents."""
    d = F.col("document_id")
    chunks = turns(spark, sf_dir).select(F.col("id").alias("chunk_id"), "document_id", F.when(d % 4 == 0, "kb2").otherwise("kb1").alias("kb"), F.when(F.col("chunk_index") == 0, "PARENT").when(F.col("chunk_index") % 2 == 0, "CHILD").alias("kind"))
    documents = chunks.select("document_id", "kb").distinct().withColumn("format", F.when(d % 5 == 0, "PDF").otherwise("TXT"))
    return retrieval.metadata_chunks(documents, chunks, "kb1", 12, 25, format="pdf").select("chunk_id", "document_id", "score", "rank")


@query("""SELECT o_orderkey AS order_key, '{"id":' || c_custkey || ',"custkey":' || c_custkey || ',"name":"' || c_name || '","segment":"' || c_mktsegment || '"}' AS customer, '{"id":"PLACED:' || c_custkey || ':' || o_orderkey || '","from_id":' || c_custkey || ',"to_id":' || o_orderkey || '}' AS placed
    FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 400000 ORDER BY order_key LIMIT 90""")
def plan_whole_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole nodes and relationships as projections."""
    from loreweave.plans.graphplan import Compare, GraphPlan, Hop, Order, Project, run
    from loreweave.sources.tables import SalesGraph

    plan = GraphPlan("Customer", (Hop("PLACED", "Order"),), (Compare(1, "total", ">", 400000.0),), (Project("order_key", 1, "orderkey"), Project("customer", 0), Project("placed", hop=0)), None, (Order("order_key"),), 90)
    return run(plan, SalesGraph(spark, sf_dir)).select("order_key", F.to_json(F.col("customer").dropFields("acctbal")).alias("customer"), F.to_json("placed").alias("placed"))


@query("""SELECT l_orderkey * 10 + l_linenumber AS citation, coalesce('order ' || o_orderkey, 'unknown source') AS label, o_orderkey IS NULL AS missing FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON o_orderkey = l_orderkey""")
def source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations with the labels of their documents; those of missing ones are marked."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("citation"), F.col("l_orderkey").alias("document_id"))
    documents = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("document_id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("label"))
    return answering.enriched(rows, documents).select("citation", "label", "missing")


ASKED = [("a", "The thing"), ("b", "ontion erth"), ("c", "und  der und"), ("d", "thble"), ("e", "to-of erth"), ("f", "nowhere thble"), ("g", "of the")]
TERMS_SQL = "regexp_extract_all(lower(text), '[a-z0-9à-öø-ÿß]+')"


@query(f"SELECT doc_id AS chunk_id FROM documents WHERE list_has_all({TERMS_SQL}, ['the', 'thing'])")
def lexical_and_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return retrieval.lexical_all(chunks, ["the", "thing"])


def lexical_sql(chunks: str, scope: str, most: int) -> str:
    """Words all there, plus three times the phrase's score, over chunks (doc_id, own, kb, kind); ASKED as rows."""
    rows = ", ".join(f"('{name}', {[w for w in postings.parsed(text)]})" for name, text in ASKED)
    return f"""WITH c AS ({chunks}), s AS (SELECT count(*) AS n, sum(len(own)) / count(*) AS mean FROM c),
    q AS (SELECT *, flatten(words) AS flat FROM (VALUES {rows}) v(subquery, words)),
    p AS (SELECT subquery, unnest(range(1, len(words) + 1)) AS word, unnest(words) AS alternatives FROM q), parts AS (SELECT subquery, word, unnest(alternatives) AS term FROM p),
    tf AS (SELECT doc_id, len(own) AS dl, kb, kind, own, u.term, count(*) AS tf FROM c, unnest(own) AS u(term) WHERE u.term IN (SELECT term FROM parts) GROUP BY ALL),
    df AS (SELECT term, ln(1 + ((SELECT n FROM s) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf GROUP BY term),
    m AS (SELECT subquery, doc_id, dl, own, sum(idf * tf / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS score, count(DISTINCT word) AS words_there FROM tf JOIN df USING (term) JOIN parts USING (term), s WHERE {scope} GROUP BY subquery, doc_id, dl, own),
    f AS (SELECT subquery, doc_id, dl, score, words_there = len(words) AS all_there, CASE WHEN len(words) > 1 THEN len(list_filter(range(1, dl - len(flat) + 2), lambda i: own[i : i + len(flat) - 1] = flat)) ELSE 0 END AS phrases, (SELECT sum(idf) FROM parts JOIN df USING (term) WHERE parts.subquery = m.subquery) AS idf FROM m JOIN q USING (subquery)),
    h AS (SELECT subquery, doc_id AS chunk_id, phrases, round(score + CASE WHEN phrases > 0 THEN 3 * idf * phrases / (phrases + 1.2 * (0.25 + 0.75 * dl / mean)) ELSE 0 END, 9) AS score FROM f, s WHERE all_there)
    SELECT subquery, chunk_id, CAST(phrases AS INTEGER) AS phrases, round(score, 6) AS score FROM h QUALIFY row_number() OVER (PARTITION BY subquery ORDER BY score DESC, chunk_id) <= {most}"""


@query(lexical_sql(f"SELECT doc_id, {TERMS_SQL} AS own, NULL AS kb, NULL AS kind FROM documents", "true", 20))
def lexical_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over the texts for the terms asked for; words all there, phrases boosted, a word of several terms, single words."""
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    hits = postings.search(spark, postings.scan(chunks, ASKED), ASKED, 20)
    return hits.select("subquery", "chunk_id", "phrases", F.round("score", 6).alias("score"))


@query(lexical_sql(f"SELECT doc_id, {TERMS_SQL} AS own, 'kb' || (doc_id % 3) AS kb, CASE WHEN doc_id % 10 = 4 THEN 'PARENT' WHEN doc_id % 2 = 0 THEN 'CHILD' END AS kind FROM documents", "kb = 'kb1' AND coalesce(kind, 'CHILD') = 'CHILD'", 30))
def lexical_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole index, written, then asked within one knowledge base; parents do not come back."""
    i = F.col("doc_id")
    chunks = table(spark, sf_dir, "documents").select(i.alias("chunk_id"), "text", F.concat(F.lit("kb"), (i % 3).cast("string")).alias("kb"), F.when(i % 10 == 4, "PARENT").when(i % 2 == 0, "CHILD").alias("kind"))
    index = postings.build(chunks, shared_path(spark, "postings"), 16)
    return postings.search(spark, index, ASKED, 30, "kb1").select("subquery", "chunk_id", "phrases", F.round("score", 6).alias("score"))


@query(f"""WITH {CANDIDATES_SQL}
    SELECT channel, count_if(rank <= 40) AS accepted, count_if(rank > 40) AS truncated, count(DISTINCT subquery) AS executed FROM cand GROUP BY channel""")
def branch_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.branch_counters(candidates(spark, sf_dir), 40)


RERANK_SQL = f"""WITH {FUSED_SQL},
    s AS (SELECT *, CASE WHEN fused_rank <= 20 THEN (chunk_id % 7) / 7.0 END AS rerank_score FROM fused)"""


def rerank_scores(fused: DataFrame) -> DataFrame:
    """A stand-in for a reranker's answer."""
    return fused.where("fused_rank <= 20").select("chunk_id", ((F.col("chunk_id") % 7) / F.lit(7.0)).alias("rerank_score"))


@query(f"""{RERANK_SQL} SELECT chunk_id, CAST(fused_rank AS INTEGER) AS fused_rank,
    CAST(row_number() OVER (ORDER BY fused_rank <= 20 DESC, rerank_score DESC NULLS LAST, fused_rank, chunk_id) AS INTEGER) AS final_rank FROM s""")
def rerank_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = ranking.fuse(candidates(spark, sf_dir))
    return ranking.rerank(fused, rerank_scores(fused), 20).select("chunk_id", "fused_rank", "final_rank")


@query(f"""{RERANK_SQL} SELECT count(*) = count(rerank_score) AND min(rerank_score) >= 0 AND max(rerank_score) <= 1 AS valid FROM s WHERE fused_rank <= 20""")
def rerank_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = ranking.fuse(candidates(spark, sf_dir))
    return ranking.rerank_valid(fused.where("fused_rank <= 20"), rerank_scores(fused))


TURNS_SQL = "SELECT conv_id AS document_id, turn AS chunk_index, conv_id * 1000 + turn AS id, text FROM conversations"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as chunks of one document."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")


HIERARCHY_SQL = f"""
    chunks AS (SELECT id, document_id, CASE WHEN chunk_index = 0 AND document_id % 11 <> 3 THEN 'PARENT' WHEN id % 6 <> 5 THEN 'CHILD' END AS kind,
                 CASE WHEN chunk_index > 0 AND document_id % 7 > 3 THEN document_id * 1000 WHEN chunk_index > 0 AND document_id % 7 = 3 THEN -5 END AS parent_id,
                 CASE WHEN document_id % 13 = 5 THEN 'kb2' ELSE 'kb1' END AS kb, CASE WHEN chunk_index = 3 THEN 'run0' WHEN document_id % 5 = 1 AND chunk_index = 1 THEN NULL ELSE 'run1' END AS run,
                 CASE WHEN document_id % 17 = 4 THEN 'v0' WHEN document_id % 3 = 0 THEN NULL ELSE 'v1' END AS revision, chunk_index // 3 AS section, CASE WHEN document_id % 2 = 0 THEN 'a > b' END AS path, chunk_index, text FROM ({TURNS_SQL})),
    edges AS (SELECT parent_id AS parent, id AS child FROM chunks WHERE parent_id IS NOT NULL AND id % 5 <> 4),
    q AS (SELECT id AS chunk_id, document_id + (id % 31 = 0)::INT AS document_id, 'kb1' AS kb, CASE WHEN document_id % 5 = 1 THEN '' ELSE 'run1' END AS run, CASE WHEN document_id % 3 = 0 THEN NULL ELSE 'v1' END AS revision FROM chunks WHERE chunk_index > 0
          UNION ALL SELECT -1, 0, 'kb1', 'run1', 'v1'),
    o AS (SELECT q.chunk_id, p.id AS pid, CASE WHEN c.id IS NULL THEN 'CHILD_NOT_FOUND' WHEN c.kb <> q.kb OR c.document_id <> q.document_id THEN 'CHILD_SCOPE' WHEN coalesce(c.run, '') <> coalesce(q.run, '') THEN 'CHILD_RUN'
        WHEN coalesce(c.revision, '') <> coalesce(q.revision, '') THEN 'CHILD_REVISION' WHEN c.parent_id IS NULL THEN 'NO_PARENT' WHEN p.id IS NULL THEN 'PARENT_NOT_FOUND'
        WHEN p.kind <> 'PARENT' THEN 'PARENT_KIND' WHEN p.kb <> c.kb OR p.document_id <> c.document_id THEN 'PARENT_SCOPE' WHEN coalesce(p.run, '') <> coalesce(c.run, '') THEN 'PARENT_RUN'
        WHEN coalesce(p.revision, '') <> coalesce(c.revision, '') THEN 'PARENT_REVISION' WHEN e.child IS NULL THEN 'MEMBERSHIP' ELSE 'VALID_PARENT' END AS outcome
      FROM q LEFT JOIN chunks c ON q.chunk_id = c.id LEFT JOIN chunks p ON c.parent_id = p.id LEFT JOIN edges e ON e.parent = p.id AND e.child = c.id),
    beside AS (SELECT c.id AS chunk_id, min(n.chunk_index) AS first_index, max(n.chunk_index) AS last_index, string_agg(n.text, chr(10) || chr(10) ORDER BY n.chunk_index, n.text) AS context, CAST(sum(greatest(1, (coalesce(length(n.text), 4) + 3) // 4)) AS BIGINT) AS tokens
      FROM o JOIN chunks c ON c.id = o.chunk_id JOIN chunks n ON n.document_id = c.document_id AND abs(n.chunk_index - c.chunk_index) <= 1 AND n.kb = c.kb AND coalesce(n.run, '') = coalesce(c.run, '') AND coalesce(n.revision, '') = coalesce(c.revision, '')
        AND (n.kind IS NULL OR n.kind = 'CHILD') AND ((c.parent_id IS NULL AND n.section = c.section AND coalesce(n.path, '') = coalesce(c.path, '')) OR n.parent_id = c.parent_id)
      WHERE o.outcome IN ('NO_PARENT', 'PARENT_NOT_FOUND') GROUP BY c.id)"""


def hierarchy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turns as children of their conversation's first turn, with faults of every kind and nulls; membership edges; and what is asked for."""
    d, i = F.col("document_id"), F.col("chunk_index")
    chunks = turns(spark, sf_dir).select(
        "id", "document_id",
        F.when((i == 0) & (d % 11 != 3), "PARENT").when(F.col("id") % 6 != 5, "CHILD").alias("kind"),
        F.when((i > 0) & (d % 7 > 3), d * 1000).when((i > 0) & (d % 7 == 3), -5).alias("parent_id"),
        F.when(d % 13 == 5, "kb2").otherwise("kb1").alias("kb"),
        F.when(i == 3, "run0").when((d % 5 == 1) & (i == 1), None).otherwise("run1").alias("run"),
        F.when(d % 17 == 4, "v0").when(d % 3 == 0, None).otherwise("v1").alias("revision"),
        F.floor(i / 3).alias("section"), F.when(d % 2 == 0, "a > b").alias("path"), "chunk_index", "text",
    )
    edges = chunks.where("parent_id is not null and id % 5 <> 4").select(F.col("parent_id").alias("parent"), F.col("id").alias("child"))
    asked = chunks.where("chunk_index > 0").select(
        F.col("id").alias("chunk_id"), (d + (F.col("id") % 31 == 0).cast("long")).alias("document_id"), F.lit("kb1").alias("kb"),
        F.when(d % 5 == 1, "").otherwise("run1").alias("run"), F.when(d % 3 == 0, None).otherwise("v1").alias("revision"),
    )
    absent = spark.range(1).select(F.lit(-1).cast("long"), F.lit(0).cast("long"), F.lit("kb1"), F.lit("run1"), F.lit("v1"))
    return chunks, edges, asked.union(absent)


@query(f"WITH {HIERARCHY_SQL} SELECT chunk_id, outcome, CASE WHEN outcome = 'VALID_PARENT' THEN pid END AS parent_id FROM o")
def parent_context_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, edges, asked = hierarchy(spark, sf_dir)
    return ranking.parent_contexts(asked, chunks, edges).select("chunk_id", "outcome", "parent_id")


@query(f"WITH {HIERARCHY_SQL} SELECT * FROM beside")
def adjacency_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, edges, asked = hierarchy(spark, sf_dir)
    return ranking.adjacent(ranking.parent_contexts(asked, chunks, edges), chunks, 1)


BUDGET_SQL = """
    r AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY fused_rank, chunk_id) AS n FROM c),
    f AS (SELECT request, 0 AS n, CAST(NULL AS BIGINT) AS chunk_id, [] :: VARCHAR[] AS seen, [] :: BIGINT[] AS docs, CAST({tokens} AS BIGINT) AS remain, '' AS outcome FROM (SELECT DISTINCT request FROM r)
      UNION ALL
      SELECT request, n, chunk_id, CASE WHEN o = 'INCLUDED' THEN list_append(seen, context_id) ELSE seen END, CASE WHEN o = 'INCLUDED' THEN list_append(docs, document_id) ELSE docs END, CASE WHEN o = 'INCLUDED' THEN remain - tokens ELSE remain END, o
      FROM (SELECT r.request, r.n, r.chunk_id, r.context_id, r.document_id, r.tokens, f.seen, f.docs, f.remain, CASE WHEN r.context_id IS NULL THEN 'NO_CONTEXT' WHEN list_contains(f.seen, r.context_id) THEN 'DEDUPLICATED' WHEN len(f.seen) >= 8 THEN 'CONTEXT_BUDGET'
          WHEN len(list_filter(f.docs, lambda d: d = r.document_id)) >= 3 THEN 'DOCUMENT_BUDGET' WHEN r.tokens > f.remain THEN 'TOKEN_BUDGET' ELSE 'INCLUDED' END AS o
        FROM f JOIN r ON r.request = f.request AND r.n = f.n + 1))"""


EXPANSION_SQL = f"""{HIERARCHY_SQL.replace(" q AS (", " q0 AS (", 1).replace("o AS (SELECT q.chunk_id, p.id AS pid,", """
    turns2 AS (SELECT 2 * (document_id // 4) AS request, * FROM q0 UNION ALL SELECT 2 * (document_id // 4) + 1, chunk_id, document_id, CASE WHEN chunk_id % 3 = 0 THEN 'kb2' ELSE kb END, CASE WHEN chunk_id % 2 = 0 THEN 'run0' ELSE run END, CASE WHEN chunk_id % 5 = 0 THEN 'v0' ELSE revision END FROM q0 WHERE chunk_id % 4 > 0),
    kinds AS (SELECT *, CASE WHEN chunk_id % 6 = 1 THEN 'GRAPH_PARENT' ELSE 'TEXT_CHILD' END AS citation_kind FROM turns2),
    numbered AS (SELECT *, citation_kind = 'TEXT_CHILD' AND row_number() OVER (PARTITION BY request, citation_kind ORDER BY chunk_id) <= 12 AS asked FROM kinds),
    q AS (SELECT DISTINCT chunk_id, document_id, kb, run, revision FROM numbered WHERE asked),
    o AS (SELECT q.chunk_id, q.document_id, q.kb, q.run, q.revision, p.id AS pid,""", 1)},
    c AS (SELECT n.request, n.chunk_id AS fused_rank, n.chunk_id, n.document_id, o.outcome AS lookup, CASE WHEN outcome = 'VALID_PARENT' THEN CAST(p.id AS VARCHAR) WHEN outcome IN ('NO_PARENT', 'PARENT_NOT_FOUND') AND context IS NOT NULL THEN 'beside:' || n.chunk_id END AS context_id,
            CAST(coalesce(CASE WHEN outcome = 'VALID_PARENT' THEN greatest(1, (length(p.text) + 3) // 4) WHEN outcome IN ('NO_PARENT', 'PARENT_NOT_FOUND') THEN beside.tokens END, 0) AS BIGINT) AS tokens
          FROM numbered n JOIN o ON n.asked AND o.chunk_id = n.chunk_id AND o.document_id IS NOT DISTINCT FROM n.document_id AND o.kb IS NOT DISTINCT FROM n.kb AND o.run IS NOT DISTINCT FROM n.run AND o.revision IS NOT DISTINCT FROM n.revision
          LEFT JOIN chunks p ON p.id = CASE WHEN outcome = 'VALID_PARENT' THEN pid END LEFT JOIN beside ON beside.chunk_id = n.chunk_id)"""


@query(f"""WITH RECURSIVE {EXPANSION_SQL},
    {BUDGET_SQL.format(tokens=120)}
    SELECT f.request, f.chunk_id, c.lookup, c.context_id, c.tokens, CASE WHEN f.outcome = 'NO_CONTEXT' THEN c.lookup ELSE f.outcome END AS outcome FROM f JOIN c USING (request, chunk_id) WHERE f.n > 0
    UNION ALL SELECT request, chunk_id, NULL, NULL, NULL, NULL FROM numbered WHERE NOT asked""")
def parent_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent lookup, neighbours and budgets in one plan. Two requests ask for the same chunks, the second in other bases, runs and
    revisions, so the outcomes differ; some candidates cite no text child, and some lie beyond the first twelve."""
    chunks, edges, asked = hierarchy(spark, sf_dir)
    first = asked.withColumn("request", 2 * F.floor(F.col("document_id") / 4))
    i = F.col("chunk_id")
    second = asked.where(i % 4 > 0).select(
        "chunk_id", "document_id", F.when(i % 3 == 0, "kb2").otherwise(F.col("kb")).alias("kb"), F.when(i % 2 == 0, "run0").otherwise(F.col("run")).alias("run"),
        F.when(i % 5 == 0, "v0").otherwise(F.col("revision")).alias("revision"), (2 * F.floor(F.col("document_id") / 4) + 1).alias("request"),
    )
    rows = first.unionByName(second).withColumn("fused_rank", i).withColumn("citation_kind", F.when(i % 6 == 1, "GRAPH_PARENT").otherwise("TEXT_CHILD"))
    return ranking.expanded(rows, chunks, edges, evidence=12, tokens=120).select("request", "chunk_id", "lookup", "context_id", "tokens", "outcome")


@query(f"""WITH RECURSIVE c AS (SELECT document_id AS request, id AS fused_rank, id AS chunk_id, chunk_index % 2 AS document_id, CAST(id // 2 AS VARCHAR) AS context_id, length(text) AS tokens FROM ({TURNS_SQL})),
    {BUDGET_SQL.format(tokens=4096)} SELECT request, chunk_id, outcome FROM f WHERE n > 0""")
def parent_context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).select(F.col("document_id").alias("request"), F.col("id").alias("fused_rank"), F.col("id").alias("chunk_id"), (F.col("chunk_index") % 2).alias("document_id"), F.floor(F.col("id") / 2).cast("string").alias("context_id"), F.length("text").cast("long").alias("tokens"))
    return ranking.context_budget(rows).select("request", "chunk_id", "outcome")


@query(f"""WITH t AS ({TURNS_SQL}) SELECT id, substring(text, 1, CAST(greatest(0, 400 - coalesce(sum(length(text)) OVER (PARTITION BY document_id ORDER BY chunk_index, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS INTEGER)) AS kept_text FROM t""")
def running_text_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.running_budget(turns(spark, sf_dir), "text", 400, ["document_id"], "chunk_index", "id").select("id", "kept_text")


@query("""SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL AND (CASE WHEN label % 5 = 3 THEN 'es_old' ELSE 'es_new' END <> 'es_new' OR CASE WHEN vec_id % 50 = 7 THEN 'cl100k_base' ELSE 'utf8-byte-v1' END <> 'utf8-byte-v1')""")
def embedding_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("label") % 5 == 3, "es_old").otherwise("es_new").alias("embedding_space_id"), F.when(F.col("vec_id") % 50 == 7, "cl100k_base").otherwise("utf8-byte-v1").alias("tokenizer_id"))
    return retrieval.incompatible(chunks, "es_new", "utf8-byte-v1").select("vec_id")


CATALOG_SQL = f"""
    sel AS (SELECT document_id AS request, chunk_index AS rank, CASE chunk_index % 3 WHEN 2 THEN 'CONTEXT' WHEN 1 THEN 'GRAPH_PARENT' ELSE 'TEXT_CHILD' END AS kind, id // 2 AS chunk_id FROM ({TURNS_SQL})),
    cat AS (SELECT request, kind, chunk_id, min(rank) AS rank FROM sel GROUP BY ALL),
    num AS (SELECT *, CASE WHEN kind = 'CONTEXT' THEN 'CTX' ELSE 'E' END || row_number() OVER (PARTITION BY request, kind = 'CONTEXT' ORDER BY rank, kind, chunk_id) AS citation_id FROM cat),
    fc AS (SELECT document_id AS request, 'f' || (chunk_index % 2) AS fact_id, (document_id * 1000 + chunk_index // 2) // 2 AS chunk_id FROM ({TURNS_SQL})),
    facts AS (SELECT request, fact_id, CASE WHEN len(own) > 0 THEN own ELSE coalesce((SELECT list_sort(list(DISTINCT citation_id)) FROM num WHERE kind = 'GRAPH_PARENT' AND num.request = o.request), []) END AS citation_ids
      FROM (SELECT fc.request, fact_id, list_sort(list_filter(list(DISTINCT citation_id), lambda c: c IS NOT NULL)) AS own FROM fc LEFT JOIN num ON kind = 'GRAPH_PARENT' AND num.request = fc.request AND num.chunk_id = fc.chunk_id GROUP BY ALL) o)"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("chunk_index")
    rows = turns(spark, sf_dir).select(F.col("document_id").alias("request"), i.alias("rank"), F.when(i % 3 == 2, "CONTEXT").when(i % 3 == 1, "GRAPH_PARENT").otherwise("TEXT_CHILD").alias("kind"), F.floor(F.col("id") / 2).alias("chunk_id"))
    return answering.citation_catalog(rows)


def cited_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = F.col("document_id"), F.col("chunk_index")
    rows = turns(spark, sf_dir).select(d.alias("request"), F.concat(F.lit("f"), (i % 2).cast("string")).alias("fact_id"), F.floor((d * 1000 + F.floor(i / 2)) / 2).alias("chunk_id"))
    return answering.fact_citations(rows, catalog(spark, sf_dir))


@query(f"WITH {CATALOG_SQL} SELECT * FROM num")
def citation_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir)


@query(f"WITH {CATALOG_SQL} SELECT * FROM facts")
def fact_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cited_facts(spark, sf_dir)


@query(f"""WITH {CATALOG_SQL},
    claim AS (SELECT document_id AS request, chunk_index AS k, CASE WHEN chunk_index = 3 THEN ' ' ELSE 'c' || (chunk_index % 4) END AS id, CASE WHEN chunk_index % 2 = 1 THEN 'GRAPH' ELSE 'TEXT' END AS kind,
                CASE WHEN chunk_index = 2 THEN [] WHEN document_id % 3 = 0 THEN ['E1', 'E9'] ELSE ['E1'] END AS cited, CASE WHEN chunk_index IN (0, 5) THEN [] WHEN document_id % 5 = 0 THEN ['f9'] ELSE ['f1'] END AS fids FROM ({TURNS_SQL})),
    known AS (SELECT request, list(citation_id) AS ok FROM num WHERE kind <> 'CONTEXT' GROUP BY request), has AS (SELECT request, list(fact_id) AS fs FROM facts GROUP BY request),
    j AS (SELECT claim.*, coalesce(ok, []) AS ok, coalesce(fs, []) AS fs, coalesce((SELECT f.citation_ids FROM facts f WHERE f.request = claim.request AND f.fact_id = fids[1]), []) AS allowed FROM claim LEFT JOIN known USING (request) LEFT JOIN has USING (request)),
    s AS (SELECT * FROM j WHERE trim(id) <> ''),
    codes AS (SELECT request, 'answer.claim.invalid' AS code FROM j WHERE trim(id) = '' UNION ALL SELECT request, 'answer.claim.citation-unknown' FROM s WHERE len(cited) = 0 OR NOT list_has_all(ok, cited)
      UNION ALL SELECT request, 'answer.text-claim.graph-references' FROM s WHERE kind = 'TEXT' AND len(fids) > 0 UNION ALL SELECT request, 'answer.graph-claim.references-missing' FROM s WHERE kind = 'GRAPH' AND len(fids) = 0
      UNION ALL SELECT request, 'answer.graph-claim.fact-unknown' FROM s WHERE kind = 'GRAPH' AND len(fids) > 0 AND NOT list_has_all(fs, fids) UNION ALL SELECT request, 'answer.graph-claim.citation-type-invalid' FROM s WHERE kind = 'GRAPH' AND len(fids) > 0 AND NOT list_has_any(allowed, cited)
      UNION ALL SELECT request, 'answer.claim.id-duplicate' FROM (SELECT request, id, count(*) - 1 AS extra FROM s GROUP BY ALL), range(extra) r(x)
      UNION ALL SELECT DISTINCT request, 'answer.version.unsupported' FROM claim WHERE request % 7 = 0 UNION ALL SELECT DISTINCT request, 'answer.abstention.claims-not-empty' FROM claim WHERE request % 11 = 0
      UNION ALL SELECT DISTINCT request, 'answer.confidence.invalid' FROM claim WHERE request % 13 = 0)
    SELECT request, code, count(*) AS n FROM codes GROUP BY ALL""")
def answer_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    d, i = F.col("document_id"), F.col("chunk_index")
    fids = F.when(i.isin(0, 5), ids()).when(d % 5 == 0, ids("f9")).otherwise(ids("f1"))
    claim = F.struct(
        F.when(i == 3, " ").otherwise(F.concat(F.lit("c"), (i % 4).cast("string"))).alias("id"), F.lit("x").alias("text"), F.when(i % 2 == 1, "GRAPH").otherwise("TEXT").alias("kind"),
        F.when(i == 2, ids()).when(d % 3 == 0, ids("E1", "E9")).otherwise(ids("E1")).alias("citation_ids"), fids.alias("fact_ids"), F.transform(fids, lambda _: F.lit("v")).alias("evidence_ids"),
    )
    claims = turns(spark, sf_dir).groupBy(d.alias("request")).agg(F.collect_list(claim).alias("claims"))
    r, none = F.col("request"), F.array().cast("array<struct<code:string,description:string>>")
    answer = F.struct(F.when(r % 7 == 0, 2).otherwise(1).alias("version"), F.when(r % 11 == 0, "INSUFFICIENT").otherwise("ANSWERED").alias("status"), F.lit("t").alias("text"), F.lit("HIGH").alias("level"), F.when(r % 13 == 0, 1.5).otherwise(0.5).alias("score"), none.alias("limitations"), "claims")
    facts = cited_facts(spark, sf_dir).withColumn("evidence_ids", ids("v"))
    return answering.answer_violations(claims.select("request", answer.alias("answer")), catalog(spark, sf_dir), facts)
