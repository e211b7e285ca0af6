"""Queries of drafts, results and small checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.functions import canonical
from loreweave.operators import control, drafts, graph, ranking, results
from loreweave.queries import query
from loreweave.queries.discovery import MERGED_SQL, candidates
from loreweave.queries.retrieval import FUSED_SQL, TURNS_SQL, turns
from loreweave.queries.retrieval import candidates as hits
from loreweave.sources.tables import table


@query("""WITH d AS (SELECT o_custkey, max_by(o_orderstatus, o_orderkey) AS action FROM orders GROUP BY o_custkey)
    SELECT c_custkey AS identity, c_name AS value, action FROM customer LEFT JOIN d ON o_custkey = c_custkey ORDER BY identity LIMIT 100 OFFSET 100""")
def candidate_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("identity"), F.col("o_orderstatus").alias("action"), F.col("o_orderkey").alias("seq"))
    return drafts.candidate_page(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("identity"), F.col("c_name").alias("value")), decisions, 1, 500)


@query("""SELECT p_brand AS label, array_to_string(list_sort(list(DISTINCT p_type || ':' || p_size % 3 || ':' || (p_size % 3 = 0))), ';') AS properties FROM part GROUP BY p_brand""")
def draft_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "part").select(F.col("p_brand").alias("label"), F.col("p_type").alias("name"), (F.col("p_size") % 3).cast("string").alias("type"), (F.col("p_size") % 3 == 0).alias("is_key"))
    flat = F.array_sort(F.transform("properties", lambda p: F.concat_ws(":", p["name"], p["type"], p["required"].cast("string"))))
    return drafts.projected_schema(own).select("label", F.array_join(flat, ";").alias("properties"))


@query("""WITH c AS (SELECT s_suppkey AS identity, CAST(s_nationkey AS VARCHAR) AS value FROM supplier), d AS (SELECT c_custkey AS identity, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS VARCHAR) END AS pinned FROM customer)
    SELECT identity, CASE WHEN value IS NULL THEN 'COORDINATE' WHEN pinned <> value THEN 'PINNED_DEFINITION' END AS conflict FROM d LEFT JOIN c USING (identity) WHERE conflict IS NOT NULL""")
def draft_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("identity"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey").cast("string")).alias("pinned"))
    return drafts.reconciliation(decisions, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("identity"), F.col("s_nationkey").cast("string").alias("value")))


@query("""SELECT o_orderkey AS run_id, o_custkey AS draft_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 5 = c_custkey % 5 AND c_nationkey % 3 = o_orderkey % 3""")
def promotion_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("draft_id"), F.col("o_orderkey").alias("run_id"), (F.col("o_orderkey") % 5).alias("revision"), (F.col("o_orderkey") % 3).cast("string").alias("sources"))
    own = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), F.col("c_custkey") == F.col("o_custkey"))
    held = own.select(F.col("c_custkey").alias("draft_id"), F.col("o_orderkey").alias("running_run_id"), (F.col("c_custkey") % 5).alias("revision"), (F.col("c_nationkey") % 3).cast("string").alias("sources"))
    return drafts.promotable(runs, held).select("run_id", "draft_id")


@query("""WITH c AS (SELECT o_custkey AS run_id, count_if(o_orderstatus <> 'F') AS succeeded, count_if(o_orderstatus = 'F') AS failed FROM orders GROUP BY o_custkey)
    SELECT *, CASE WHEN succeeded = 0 THEN 'FAILED' WHEN failed > 0 THEN 'PARTIAL' ELSE 'COMPLETED' END AS status FROM c""")
def analysis_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drafts.analysis_outcome(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), (F.col("o_orderstatus") != "F").alias("succeeded")))


@query("SELECT o_custkey AS draft_id, max(o_orderkey) + 1 AS next_revision FROM orders GROUP BY o_custkey")
def next_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drafts.next_revision(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("draft_id"), F.col("o_orderkey").alias("revision")))


@query(f"WITH {MERGED_SQL} SELECT count_if(support = 1) AS single_support, count_if(list_contains(origins, 'GUIDED') AND NOT list_contains(origins, 'OBSERVED')) AS guided_only FROM m")
def support_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loreweave.operators.discovery import merge_candidates

    return drafts.support_risk(merge_candidates(candidates(spark, sf_dir)))


@query("""SELECT o_orderkey AS request, CASE WHEN o_orderstatus = 'F' THEN ['a'] WHEN o_orderstatus = 'P' THEN [] END AS overlap, o_orderstatus = 'P' AS repeated FROM orders WHERE o_orderstatus <> 'O'""")
def guidance_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    s = F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"), F.when(s == "P", words("b", "B ")).otherwise(words("A", "c")).alias("wanted"), F.when(s == "F", words("a ")).otherwise(words("z")).alias("excluded"))
    return drafts.guidance_overlap(rows)


@query("""WITH c AS (SELECT doc_id, sha256(text) AS sha FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
    SELECT doc_id AS document_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM c) AND sha256(text) NOT IN (SELECT sha FROM c)""")
def held_out_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.sha2("text", 256).alias("sha256"))
    used = docs.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id")), "document_id", "left_semi")
    return drafts.held_out(docs, used).select("document_id")


@query("""SELECT DISTINCT c_custkey AS draft_id, l_suppkey AS source_id, CAST(p_size AS VARCHAR) AS sha256 FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey""")
def contributing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("draft_id"), F.col("o_orderkey").alias("aggregate_id"))
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("aggregate_id"), F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("revision_id"))
    return drafts.contributing_sources(own.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("draft_id")), "draft_id", "left_semi"), own.select("aggregate_id").distinct(), found, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("revision_id"), F.col("p_size").cast("string").alias("sha256")))


@query("""WITH e AS (SELECT l_suppkey || ':' || (l_orderkey // 64) AS request, count(*) AS n, count(DISTINCT l_linenumber * 100 + l_partkey % 100) AS ids FROM lineitem GROUP BY l_suppkey, l_orderkey // 64)
    SELECT request, n AS n_evidence, CASE WHEN n > 20 THEN 'result.evidence.limit' WHEN ids < n THEN 'result.citation.duplicate' END AS problem FROM e""")
def result_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written and read again; what breaks the envelope's rules keeps its code."""
    entry = F.struct(F.concat(F.lit("E"), (F.col("l_linenumber") * 100 + F.col("l_partkey") % 100).cast("string")).alias("citation_id"), F.col("l_orderkey").alias("chunk_id"))
    own = table(spark, sf_dir, "lineitem").groupBy(F.concat_ws(":", "l_suppkey", F.floor(F.col("l_orderkey") / 64)).alias("request")).agg(F.lit("x").alias("answer"), F.array_sort(F.collect_list(entry)).alias("evidence"))
    return results.decoded(results.encoded(own)).select("request", F.size("evidence").cast("long").alias("n_evidence"), "problem")


@query("""SELECT o_orderkey AS id, 'node' AS node_type, 'Order' AS label, 'relationship' AS rel_type, CAST(o_custkey AS VARCHAR) AS start FROM orders""")
def value_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(key.alias("id"), results.tagged_node(F.lit("Order"), key, status=F.col("o_orderstatus")).alias("n"), results.tagged_relationship(F.lit("PLACED"), key, F.col("o_custkey"), key).alias("r"))
    return rows.select("id", F.col("n._type").alias("node_type"), F.col("n._label").alias("label"), F.col("r._type").alias("rel_type"), F.col("r._start").alias("start"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n``` done"))
    return table(spark, sf_dir, "events").select("event_id", F.from_json(results.model_json(fenced), "k long")["k"].alias("k"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN 'cl100k_base' WHEN p_size % 4 = 1 THEN 'cl100k_base' ELSE 'utf8-byte-v1' END AS tokenizer FROM part""")
def tokenizer_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 4
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), results.tokenizer_of(F.when(k == 0, "cl100k_base").when(k == 2, "other"), F.when(k == 1, "Text-Embedding-3-small").otherwise("local")).alias("tokenizer"))


@query("""SELECT doc_id, CAST(2 + (n_chars % 2 = 0)::INT AS INTEGER) AS n_keys, source FROM documents""")
def chunk_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = results.chunk_metadata(source=F.col("source"), length=F.col("n_chars"), page=F.when(F.col("n_chars") % 2 == 0, F.lit(1)))
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("m")).select("doc_id", F.size("m").alias("n_keys"), F.col("m")["source"].alias("source"))


@query("""SELECT l_orderkey AS document_id, l_linenumber AS chunk FROM (SELECT *, max((l_linenumber = 1)::INT) OVER (PARTITION BY l_orderkey) AS has FROM lineitem) WHERE has = 0 OR l_linenumber = 1""")
def extraction_chunk_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("chunk"), F.when(F.col("l_linenumber") == 1, "PARENT").otherwise("CHILD").alias("kind"))
    return graph.extraction_chunks(chunks).select("document_id", "chunk")


@query("""SELECT l_orderkey * 10 + l_linenumber AS evidence_id, CASE WHEN o_orderkey IS NULL THEN 'own' ELSE o_orderpriority END AS page, l_returnflag AS flag FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'O') ON o_orderkey = l_orderkey""")
def evidence_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("evidence_id"), F.col("l_orderkey").alias("chunk_id"), "l_returnflag")
    chunks = table(spark, sf_dir, "orders").where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("chunk_id"), "o_orderpriority")
    props = F.create_map(F.lit("page"), F.lit("own"), F.lit("flag"), F.col("l_returnflag"))
    return graph.with_provenance(evidence, chunks, props, F.create_map(F.lit("page"), F.col("o_orderpriority"))).select("evidence_id", F.col("props")["page"].alias("page"), F.col("props")["flag"].alias("flag"))


PIPELINE_SQL = f"""WITH {FUSED_SQL},
    s AS (SELECT *, CASE WHEN fused_rank <= 20 THEN (chunk_id % 7) / 7.0 END AS rr FROM fused),
    r AS (SELECT *, row_number() OVER (ORDER BY fused_rank <= 20 DESC, rr DESC NULLS LAST, fused_rank, chunk_id) AS final_rank FROM s),
    d AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY final_rank) AS place FROM r),
    sel AS (SELECT chunk_id, document_id, final_rank FROM d WHERE place <= 2 ORDER BY final_rank LIMIT 10),
    f AS (SELECT DISTINCT l_suppkey AS chunk_id, l_partkey AS fact_id FROM lineitem),
    o AS (SELECT fact_id, min_by(chunk_id, (final_rank, chunk_id)) AS chunk_id FROM f JOIN sel USING (chunk_id) GROUP BY fact_id),
    g AS (SELECT chunk_id, list_sort(list(fact_id)) AS facts FROM o GROUP BY chunk_id)
    SELECT chunk_id, document_id, CAST(final_rank AS INTEGER) AS final_rank, coalesce(facts, []) AS facts, lang AS context FROM sel LEFT JOIN g USING (chunk_id) LEFT JOIN documents ON doc_id = chunk_id"""


@query(PIPELINE_SQL)
def ranking_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion, reranking, diversity and assembly of evidence in one plan."""
    from loreweave.queries.retrieval import rerank_scores

    fused = ranking.fuse(hits(spark, sf_dir))
    ranked = ranking.rerank(fused, rerank_scores(fused), 20).select("chunk_id", "document_id", "final_rank")
    selected = ranking.diversify(ranked, 2, 10, "final_rank")
    facts = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("chunk_id"), F.col("l_partkey").alias("fact_id"))
    contexts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("context"))
    return results.assembled(selected, facts, contexts)


@query("""WITH f AS (SELECT event_id, event_type, CASE WHEN event_id % 5 = 0 THEN 400 + user_id WHEN event_id % 5 = 1 THEN 500 + user_id END AS status, event_id % 5 AS k FROM events)
    SELECT event_id, CASE WHEN event_type = 'error' THEN 'TIMEOUT' WHEN status = 408 THEN 'TIMEOUT' WHEN status IN (429, 409) THEN 'OVERLOADED' WHEN status IS NOT NULL THEN 'PROVIDER_ERROR' WHEN k = 2 THEN 'PROVIDER_ERROR' WHEN k = 3 THEN 'CONVERSION_ERROR' ELSE 'PROVIDER_ERROR' END AS category,
        CASE WHEN event_type = 'error' OR status = 408 THEN 'TRANSPORT_TIMEOUT' WHEN status = 429 THEN 'RATE_LIMIT' WHEN status >= 500 THEN 'PROVIDER_5XX' WHEN status = 409 THEN 'PROVIDER_RETRYABLE_STATUS' WHEN status IN (401, 403) THEN 'PROVIDER_AUTH' WHEN status IS NOT NULL THEN 'PROVIDER_INVALID_REQUEST' WHEN k = 2 THEN 'TRANSPORT_IO'
            WHEN k = 3 THEN 'MALFORMED_MODEL_RESPONSE' ELSE 'PROVIDER_ERROR' END AS code,
        CASE WHEN event_type = 'error' THEN true WHEN status IN (408, 429, 409) OR status >= 500 THEN true WHEN status IS NOT NULL THEN false ELSE k IN (2, 3) END AS retryable FROM f""")
def failure_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    types = F.array(F.lit("RuntimeException"), F.when(F.col("event_type") == "error", "SocketTimeoutException").when(k == 2, "ConnectException").otherwise("IllegalStateException"))
    status = F.when(k == 0, 400 + F.col("user_id")).when(k == 1, 500 + F.col("user_id"))
    out = control.failure_class(types, F.array(F.when(k == 3, "Could not parse the answer").otherwise("boom")), status, F.lit(None).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", out.alias("f")).select("event_id", "f.*")


@query("""SELECT source AS kb, count(*) AS documents, count(DISTINCT lang) AS types FROM documents GROUP BY source""")
def counts_by_knowledge_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("kb")).agg(F.count("*").alias("documents"), F.count_distinct("lang").alias("types"))


@query("""SELECT event_type AS retriever, user_id % 3 AS status, count(*) AS attempts, round(sum(value), 6) AS total_ms, max(value) AS slowest_ms FROM events GROUP BY ALL""")
def attempt_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("retriever"), (F.col("user_id") % 3).alias("status"))
    return own.agg(F.count("*").alias("attempts"), F.round(F.sum("value"), 6).alias("total_ms"), F.max("value").alias("slowest_ms"))


@query("""SELECT o_custkey AS draft_id, max_by(o_orderkey, (o_orderstatus = 'O', o_orderkey)) AS run_id FROM orders GROUP BY o_custkey""")
def current_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draft's running run, else its newest."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("draft_id"), F.col("o_orderkey").alias("run_id"), (F.col("o_orderstatus") == "O").alias("running"))
    return control.latest(rows, ["draft_id"], "running", "run_id").select("draft_id", "run_id")


CONFLICT_SQL = """
    c AS (SELECT 'c' || l_orderkey || '-' || l_linenumber || '-' || l_partkey AS conflict_id, CAST(l_suppkey AS VARCHAR) AS draft_id, l_orderkey % 40 AS revision, CASE WHEN l_linenumber % 2 = 0 THEN 'PROPERTY_TYPE' ELSE 'IDENTITY_KEY' END AS type,
        CASE WHEN l_linenumber = 7 THEN NULL ELSE 'node:' || l_linenumber END AS coordinate, l_returnflag = 'R' AS resolved, l_shipdate AS resolved_at, l_shipdate - INTERVAL 1 DAY AS created_at,
        CASE WHEN l_returnflag = 'R' AND l_partkey % 3 > 0 THEN CASE WHEN l_partkey % 7 = 0 THEN 'other' ELSE 'a' END END AS selected, CASE WHEN l_returnflag = 'R' AND l_partkey % 3 = 0 THEN CASE WHEN l_partkey % 2 = 0 THEN '{"y": 1, "x": ' || l_partkey || '}' ELSE '" "' END END AS custom FROM lineitem)"""


@query(f"""WITH RECURSIVE {CONFLICT_SQL},
    k AS (SELECT *, dense_rank() OVER (ORDER BY draft_id, type, coordinate) AS key FROM c),
    per AS (SELECT key, revision, first(struct_pack(selected := selected, custom := custom) ORDER BY resolved_at DESC, created_at DESC, conflict_id) FILTER (resolved) AS own FROM k GROUP BY key, revision),
    n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY revision) AS n FROM per),
    fold AS (SELECT key, n, revision, CAST(NULL AS STRUCT(selected VARCHAR, custom VARCHAR)) AS past, own AS state FROM n WHERE n = 1
      UNION ALL SELECT n.key, n.n, n.revision, state, coalesce(n.own, state) FROM fold JOIN n ON n.key = fold.key AND n.n = fold.n + 1),
    j AS (SELECT k.*, past, NOT resolved AND coalesce(CASE WHEN past.custom IS NULL THEN past.selected IN ('a', 'b') ELSE past.custom <> '" "' END, false) AS carried FROM k JOIN fold USING (key, revision))
    SELECT conflict_id, resolved OR carried AS resolved, carried, CASE WHEN carried THEN past.selected ELSE selected END AS selected,
        CASE WHEN carried THEN regexp_replace(past.custom, '\\{{"y": 1, "x": (.*)\\}}', '{{"x":\\1,"y":1}}') ELSE custom END AS custom FROM j""")
def carried_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolutions carried along the revisions of a draft; alternatives in either order are the same conflict."""
    n, part, order, back = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_orderkey"), F.col("l_returnflag") == "R"
    custom = F.when(part % 2 == 0, F.concat(F.lit('{"y": 1, "x": '), part.cast("string"), F.lit("}"))).otherwise('" "')
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("c"), F.concat_ws("-", order, n, part)).alias("conflict_id"), F.col("l_suppkey").cast("string").alias("draft_id"), (order % 40).alias("revision"), F.when(n % 2 == 0, "PROPERTY_TYPE").otherwise("IDENTITY_KEY").alias("type"),
        F.when(n != 7, F.concat(F.lit("node:"), n.cast("string"))).alias("coordinate"), F.when(part % 2 == 0, F.array(F.lit('"a"'), F.lit('"b"'))).otherwise(F.array(F.lit(' "b"'), F.lit('"\\u0061"'))).alias("alternatives"), back.alias("resolved"),
        F.col("l_shipdate").cast("timestamp").alias("resolved_at"), (F.col("l_shipdate").cast("timestamp") - F.expr("interval 1 day")).alias("created_at"),
        F.when(back & (part % 3 > 0), F.when(part % 7 == 0, "other").otherwise("a")).alias("selected"), F.when(back & (part % 3 == 0), custom).alias("custom"),
    )
    return drafts.carried(rows).select("conflict_id", "resolved", "carried", "selected", "custom")


@query(r"""SELECT event_id, '{"k":{"Z":[1,{"b":null,"y":"v' || event_id || '"}],"a":{"n":' || user_id || '}},"type":"' || event_type || '"}' AS canonical,
    sha256('{"k":{"Z":[1,{"b":null,"y":"v' || event_id || '"}],"a":{"n":' || user_id || '}},"type":"' || event_type || '"}') AS fingerprint FROM events""")
def canonical_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three levels, keys in any order, white space and escapes: one text, one fingerprint."""
    e, u, t = F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.col("event_type")
    one = F.concat(F.lit('{"type": "'), t, F.lit('", "k": {"a": {"n": '), u, F.lit('}, "Z": [1.0, {"y": "v'), e, F.lit('", "b": null}]}}'))
    two = F.concat(F.lit('{"k":{"Z":[1,{"b":null,"y":"\u0076'), e, F.lit('"}],"a":{"n":'), u, F.lit('}},\n"type":"'), t, F.lit('"}'))
    text = canonical.canonical(F.when(F.col("event_id") % 2 == 0, one).otherwise(two))
    return table(spark, sf_dir, "events").select("event_id", text.alias("canonical"), canonical.fingerprint(text).alias("fingerprint"))


@query("""WITH o AS (SELECT o_orderkey AS o, o_custkey AS c, o_orderstatus AS s, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey),
    n AS (SELECT *, '{"_type":"node","elementId":"' || c || '","id":' || c || ',"labels":["Customer"],"properties":{"name":"' || name || '"}}' AS customer, '{"_type":"node","elementId":"' || o || '","id":' || o || ',"labels":["Order","Paid"],"properties":{"note":null,"status":"' || s || '"}}' AS placed,
        '{"_type":"relationship","elementId":"' || o || '","endNodeElementId":"' || o || '","id":' || o || ',"properties":{},"startNodeElementId":"' || c || '","type":"PLACED"}' AS rel FROM o)
    SELECT o AS id, '{"found":[' || customer || ',' || placed || '],"named":{"first":{"_type":"path","length":1,"nodes":[' || customer || ',' || placed || '],"relationships":[' || rel || ']}},"none":null}' AS value FROM n""")
def nested_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, relationships and paths inside lists and maps, tagged at every level, as one VARIANT."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    properties = lambda *c: F.to_variant_object(F.struct(*c))
    customer = canonical.node_value(F.col("o_custkey"), F.array(F.lit("Customer")), properties(F.col("c_name").alias("name")))
    placed = canonical.node_value(F.col("o_orderkey"), F.array(F.lit("Order"), F.lit("Paid")), properties(F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("note")))
    rel = canonical.relationship_value(F.col("o_orderkey"), F.lit("PLACED"), F.col("o_custkey"), F.col("o_orderkey"), F.parse_json(F.lit("{}")))
    path = canonical.path_value(F.array(customer, placed), F.array(rel))
    value = F.struct(F.create_map(F.lit("first"), path).alias("named"), F.array(customer, placed).alias("found"), F.lit(None).cast("string").alias("none"))
    return orders.select(F.col("o_orderkey").alias("id"), canonical.canonical_value(value).alias("value"))
