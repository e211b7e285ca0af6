"""Queries of uploads, chunking and chunk audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.functions import text
from loreweave.operators import chunking, uploads
from loreweave.queries import query
from loreweave.queries.retrieval import turns
from loreweave.sources import options, xhtml
from loreweave.sources.tables import table


@query("""SELECT doc_id, sha256(text) AS sha256, min(doc_id) OVER (PARTITION BY source, sha256(text)) AS document_id, doc_id = min(doc_id) OVER (PARTITION BY source, sha256(text)) AS is_new FROM documents""")
def upload_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uploads.with_existing(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), kb="source")


FIXED_SQL = r"""
    b AS (SELECT doc_id, sha256(text) AS sha, length(regexp_extract(text, '^\s*')) AS lead, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM documents),
    s AS (SELECT doc_id, sha, lead, body, unnest(range(0, greatest(length(body), 1), 900)) AS pos FROM b WHERE length(body) > 0),
    w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS chunk_index, substring(body, pos + 1, 1000) AS chunk_text FROM s WHERE pos = 0 OR pos - 900 + 1000 < length(body))"""


@query(f"""WITH {FIXED_SQL} SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(lead + pos AS INTEGER) AS source_start, CAST(lead + pos + length(chunk_text) AS INTEGER) AS source_end, chunk_text,
    'chunk_' || sha256(sha || chr(10) || 'fixed-1000-100' || chr(10) || 'CHILD' || chr(10) || '0' || chr(10) || (lead + pos) || chr(10) || (lead + pos + length(chunk_text))) AS chunk_id FROM w""")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), 1000, 100, revision="fixed-1000-100")


@query("""WITH s AS (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 12000)) AS pos FROM documents WHERE length(text) > 0)
    SELECT doc_id, CAST(pos // 12000 AS INTEGER) AS ordinal, substring(text, pos + 1, 12000) AS window_text FROM s""")
def discovery_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.plain_windows(table(spark, sf_dir, "documents"), 12000)


@query()
def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.recursive_chunks(table(spark, sf_dir, "documents")).where("kind = 'CHILD'").select("doc_id", "parent_index", "child_index", "source_start", "source_end", "tier", "chunk_text")


@query()
def parent_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.recursive_chunks(table(spark, sf_dir, "documents"))
    return rows.groupBy("doc_id", "parent_index").agg(F.min("source_start").alias("source_start"), F.max("source_end").alias("source_end"), F.count_if(F.col("kind") == "CHILD").alias("child_count"), F.min("chunk_index").alias("chunk_index"))


@query()
def xhtml_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xhtml.sections(table(spark, sf_dir, "pages"))


AUDIT_SQL = """
    c AS (SELECT conv_id AS document_id, conv_id * 1000 + turn AS id, turn, CASE WHEN turn = 0 AND conv_id % 11 <> 0 THEN 'PARENT' WHEN conv_id % 19 = 0 THEN 'SIBLING' WHEN conv_id % 23 <> 0 THEN 'CHILD' END AS kind,
        CASE WHEN turn > 0 AND conv_id % 7 <> 0 AND conv_id % 11 <> 0 THEN conv_id * 1000 WHEN turn = 2 AND conv_id % 11 = 0 THEN -1 END AS parent_id, CASE WHEN turn > 0 THEN turn - 1 WHEN conv_id % 29 = 0 THEN 0 END AS child_index,
        CASE WHEN conv_id % 13 = 0 AND turn = 1 THEN NULL ELSE 'r1' END AS run, CASE WHEN conv_id % 17 = 0 AND turn = 2 THEN 'v0' ELSE 'v1' END AS revision FROM conversations),
    e AS (SELECT parent_id AS parent, id AS child FROM c WHERE parent_id IS NOT NULL AND document_id % 5 <> 1)"""


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = F.col("document_id"), F.col("chunk_index")
    return turns(spark, sf_dir).select(
        "document_id", "id", F.when((i == 0) & (d % 11 != 0), "PARENT").when(d % 19 == 0, "SIBLING").when(d % 23 != 0, "CHILD").alias("kind"),
        F.when((i > 0) & (d % 7 != 0) & (d % 11 != 0), d * 1000).when((i == 2) & (d % 11 == 0), -1).alias("parent_id"), F.when(i > 0, i - 1).when(d % 29 == 0, 0).alias("child_index"),
        F.lit("kb").alias("kb"), F.when(~((d % 13 == 0) & (i == 1)), "r1").alias("run"), F.when((d % 17 == 0) & (i == 2), "v0").otherwise("v1").alias("revision"),
    )


@query(f"""WITH {AUDIT_SQL}, j AS (SELECT c.*, p.id AS pid, coalesce(p.run = c.run AND p.revision = c.revision, false) AS same, (c.parent_id, c.id) IN (SELECT (parent, child) FROM e) AS linked FROM c LEFT JOIN c p ON p.kind = 'PARENT' AND p.document_id = c.document_id AND p.id = c.parent_id),
    n AS (SELECT document_id, count(*) AS n_chunks, count_if(kind = 'PARENT') AS n_parents, count_if(kind = 'CHILD' AND parent_id IS NOT NULL) AS n_parented, count_if(kind = 'CHILD' AND parent_id IS NULL) AS n_unparented,
        count_if(kind = 'CHILD' AND parent_id IS NOT NULL AND pid IS NULL) AS n_orphans, count_if(kind = 'CHILD' AND pid IS NOT NULL AND NOT same) AS n_cross_scope, count_if(kind IS NULL OR kind NOT IN ('PARENT', 'CHILD')) AS n_unsupported,
        count_if(kind = 'PARENT' AND (parent_id IS NOT NULL OR child_index IS NOT NULL)) AS n_malformed, count_if(kind = 'CHILD' AND pid IS NOT NULL AND same AND NOT linked) AS n_missing_edges FROM j GROUP BY document_id),
    a AS (SELECT doc_id AS document_id, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_parents, 0) AS n_parents, coalesce(n_parented, 0) AS n_parented, coalesce(n_unparented, 0) AS n_unparented, coalesce(n_orphans, 0) AS n_orphans, coalesce(n_cross_scope, 0) AS n_cross_scope,
        coalesce(n_unsupported, 0) AS n_unsupported, coalesce(n_malformed, 0) AS n_malformed, coalesce(n_missing_edges, 0) AS n_missing_edges FROM (SELECT doc_id FROM documents UNION SELECT conv_id FROM conversations) LEFT JOIN n ON document_id = doc_id)
    SELECT *, CASE WHEN n_chunks = 0 THEN 'EMPTY' WHEN n_orphans + n_cross_scope + n_unsupported + n_malformed + n_missing_edges > 0 THEN 'INVALID' WHEN n_parents = 0 AND n_parented = 0 AND n_unparented = n_chunks THEN 'FLAT' WHEN n_parents > 0 AND n_unparented = 0 THEN 'HIERARCHICAL' ELSE 'INVALID' END AS topology FROM a""")
def chunk_topology_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = audited(spark, sf_dir)
    edges = chunks.where("parent_id is not null and document_id % 5 <> 1").select(F.col("parent_id").alias("parent"), F.col("id").alias("child"))
    return chunking.topology(chunks, edges, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id")))


@query("""WITH p AS (SELECT conv_id AS document_id, conv_id * 1000 AS parent_id, max(turn) + (conv_id % 3 = 0)::INT AS child_count FROM conversations GROUP BY conv_id),
    k AS (SELECT conv_id AS document_id, count(*) AS n, max(turn - 1) AS last, min(turn * 10) AS a, max(turn * 10 + 10) AS b FROM conversations WHERE turn > 0 GROUP BY conv_id)
    SELECT document_id, parent_id AS id, CASE WHEN coalesce(n, 0) <> child_count THEN 'CHILD_COUNT' WHEN last + 1 <> n THEN 'CHILD_INDEX' END AS problem
    FROM p LEFT JOIN k USING (document_id) WHERE problem IS NOT NULL
    UNION ALL SELECT conv_id, conv_id * 1000 + turn, 'CONTAINMENT' FROM conversations WHERE turn > 0 AND (turn * 10 < 10 OR turn * 10 + 10 > 50)""")
def hierarchy_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = turns(spark, sf_dir)
    last = own.groupBy("document_id").agg(F.max("chunk_index").alias("last"))
    parents = last.select("document_id", (F.col("document_id") * 1000).alias("id"), F.lit("PARENT").alias("kind"), F.lit(None).cast("long").alias("parent_id"), F.lit(None).cast("long").alias("child_index"), (F.col("last") + (F.col("document_id") % 3 == 0).cast("long")).alias("child_count"), F.lit(10).cast("long").alias("source_start"), F.lit(50).cast("long").alias("source_end"))
    i = F.col("chunk_index")
    children = own.where("chunk_index > 0").select("document_id", "id", F.lit("CHILD").alias("kind"), (F.col("document_id") * 1000).alias("parent_id"), (i - 1).alias("child_index"), F.lit(None).cast("long").alias("child_count"), (i * 10).alias("source_start"), (i * 10 + 10).alias("source_end"))
    return chunking.hierarchy_violations(parents.unionByName(children))


@query("SELECT conv_id AS document_id, turn AS chunk_index, conv_id * 1000 + turn AS id, text FROM conversations WHERE turn > 0 ORDER BY chunk_index, id LIMIT 50 OFFSET 100")
def chunk_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.page(turns(spark, sf_dir).where("chunk_index > 0"), 2, 50, "chunk_index", "id")


@query(f"WITH {AUDIT_SQL} SELECT document_id, id FROM c WHERE kind = 'CHILD' AND parent_id IS NULL ORDER BY id LIMIT 25 OFFSET 25")
def flat_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.page(audited(spark, sf_dir).where("kind = 'CHILD' and parent_id is null").select("document_id", "id"), 1, 25, "id")


@query(f"""WITH {AUDIT_SQL}, p AS (SELECT * FROM c WHERE kind = 'PARENT' ORDER BY document_id, id LIMIT 8 OFFSET 8)
    SELECT document_id, id, (SELECT count(*) FROM c x WHERE x.kind = 'CHILD' AND x.parent_id = p.id) AS children FROM p""")
def parent_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.parent_page(audited(spark, sf_dir).withColumn("chunk_index", F.col("id")), 1, 8).select("document_id", "id", "children")


@query(f"""WITH {AUDIT_SQL} SELECT document_id, count_if(parent_id IS NULL AND coalesce(kind, 'CHILD') = 'CHILD') AS flat, count(*) AS chunks, count_if(parent_id IS NULL AND coalesce(kind, 'CHILD') = 'CHILD') = count(*) AS is_flat FROM c GROUP BY document_id""")
def flat_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.flat_counts(audited(spark, sf_dir))


@query("""WITH c AS (SELECT doc_id, count(*) AS n, count_if(quality = 0) AS old FROM labels GROUP BY doc_id),
    s AS (SELECT doc_id, CASE WHEN n IS NULL THEN 'NO_CHUNKS' WHEN old > 0 THEN 'OUTDATED' ELSE 'CURRENT' END AS state FROM documents LEFT JOIN c USING (doc_id)),
    w AS (SELECT DISTINCT item_id * 7 AS doc_id FROM benchmark UNION SELECT DISTINCT -item_id - 1 FROM benchmark),
    r AS (SELECT doc_id FROM documents WHERE doc_id % 5 = 0),
    m AS (SELECT 'ALL' AS mode, doc_id, state FROM s WHERE state <> 'NO_CHUNKS' UNION ALL SELECT 'OUTDATED_STRATEGY', doc_id, state FROM s WHERE state = 'OUTDATED' UNION ALL SELECT 'DOCUMENT_IDS', doc_id, state FROM w LEFT JOIN s USING (doc_id))
    SELECT mode, doc_id, state, CASE WHEN state IS NULL THEN 'NOT_FOUND' WHEN state = 'NO_CHUNKS' THEN 'NO_CHUNKS' WHEN doc_id IN (SELECT doc_id FROM r) THEN 'RUNNING' END AS blocker FROM m""")
def migration_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each mode of a migration takes, and what keeps it from starting."""
    states, item = migration_classification(spark, sf_dir), F.col("item_id")
    benchmark = table(spark, sf_dir, "benchmark")
    wanted = benchmark.select((item * 7).alias("doc_id")).union(benchmark.select(-item - 1))
    running = table(spark, sf_dir, "documents").where("doc_id % 5 = 0").select("doc_id")
    parts = [chunking.migration_selection(states, mode, wanted, running).select(F.lit(mode).alias("mode"), "doc_id", "state", "blocker") for mode in ("ALL", "OUTDATED_STRATEGY", "DOCUMENT_IDS")]
    return parts[0].union(parts[1]).union(parts[2])


@query("""WITH c AS (SELECT doc_id, count(*) AS n, count_if(quality = 0) AS old FROM labels GROUP BY doc_id)
    SELECT doc_id, CASE WHEN n IS NULL THEN 'NO_CHUNKS' WHEN old > 0 THEN 'OUTDATED' ELSE 'CURRENT' END AS state FROM documents LEFT JOIN c USING (doc_id)""")
def migration_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 0, "v0").otherwise("v1").alias("revision"))
    return chunking.migration_state(table(spark, sf_dir, "documents").select("doc_id"), chunks, "v1")


@query(r"""SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS collapsed, substring(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 160) AS preview, CAST(greatest(1, floor((length(text) + 3) / 4)) AS BIGINT) AS tokens,
    substring(sha256(text), 1, 16) AS fingerprint, CASE WHEN doc_id % 4 = 0 THEN 'TXT' WHEN doc_id % 4 = 1 THEN 'PDF' WHEN doc_id % 4 = 2 THEN 'DOCX' END AS format FROM documents""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loreweave.functions.identity import fingerprint

    k = F.col("doc_id") % 4
    name = F.when(k == 0, F.concat("source", F.lit(".TXT"))).when(k == 2, "a.docx").otherwise("noname")
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.collapsed(F.col("text")).alias("collapsed"), text.preview(F.col("text")).alias("preview"), text.token_estimate(F.col("text")).alias("tokens"), fingerprint(F.col("text")).alias("fingerprint"),
        text.document_format(name, F.when(k == 1, "application/pdf")).alias("format"),
    )


@query(r"""SELECT p_partkey AS id, CASE WHEN lower(v) IN ('true', 'false') THEN 'boolean' WHEN regexp_matches(v, '^[+-]?\d+$') THEN 'integer' WHEN regexp_matches(v, '^[+-]?\d*\.\d+$') THEN 'number'
    WHEN regexp_matches(v, '^\d{4}-\d{2}-\d{2}$') THEN 'date' WHEN regexp_matches(v, '^\d{4}-\d{2}-\d{2}[Tt ][0-2]\d:[0-5]\d:[0-5]\d(\.\d{1,9})?([Zz]|[+-][0-2]\d:[0-5]\d)?$') THEN 'datetime' ELSE 'string' END AS type
    FROM (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'true' WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN p_size || '.5' WHEN 3 THEN '2024-01-02' WHEN 4 THEN '2024-01-02T10:00:00' ELSE p_name END AS v FROM part)""")
def property_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    v = F.when(k == 0, "true").when(k == 1, size).when(k == 2, F.concat(size, F.lit(".5"))).when(k == 3, "2024-01-02").when(k == 4, "2024-01-02T10:00:00").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.inferred_type(v).alias("type"))


@query(r"""SELECT p_type, array_to_string(list_transform(w, lambda x: upper(x[1]) || lower(x[2:])), '') AS label, upper(array_to_string(w, '_')) AS relationship
    FROM (SELECT DISTINCT p_brand || '-' || lower(p_type) || ' line' AS p_type, list_filter(regexp_split_to_array(regexp_replace(p_brand || '-' || lower(p_type) || ' line', '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^A-Za-z0-9]+'), lambda x: x <> '') AS w FROM part)""")
def label_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("-"), F.lower("p_type"), F.lit(" line")).alias("p_type")).distinct()
    return names.select("p_type", text.normal_label(F.col("p_type")).alias("label"), text.normal_relationship(F.col("p_type")).alias("relationship"))


@query("""WITH r AS (SELECT doc_id AS document_id, CASE WHEN lang = 'en' THEN 'PDF' WHEN lang = 'de' THEN 'DOCX' ELSE 'TXT' END AS format,
        CASE doc_id % 4 WHEN 0 THEN 'pdf.ocr-dpi' WHEN 1 THEN 'docxRevisionMode' WHEN 2 THEN 'preserveLineBreaks' ELSE 'nope' END AS name, CASE doc_id % 4 WHEN 0 THEN CAST(n_chars AS VARCHAR) WHEN 1 THEN source ELSE 'maybe' END AS value FROM documents)
    SELECT document_id, name, CASE WHEN name = 'nope' THEN 'UNKNOWN' WHEN (name = 'pdf.ocr-dpi' AND format <> 'PDF') OR (name = 'docxRevisionMode' AND format <> 'DOCX') THEN 'NOT_APPLICABLE' WHEN name = 'preserveLineBreaks' THEN 'TYPE'
        WHEN name = 'pdf.ocr-dpi' AND CAST(value AS BIGINT) NOT BETWEEN 72 AND 600 THEN 'RANGE' WHEN name = 'docxRevisionMode' THEN 'VALUE' END AS problem FROM r WHERE problem IS NOT NULL""")
def option_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id") % 4
    requests = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("document_id"), F.when(F.col("lang") == "en", "PDF").when(F.col("lang") == "de", "DOCX").otherwise("TXT").alias("format"),
        F.when(d == 0, "pdf.ocr-dpi").when(d == 1, "docxRevisionMode").when(d == 2, "preserveLineBreaks").otherwise("nope").alias("name"),
        F.when(d == 0, F.col("n_chars").cast("string")).when(d == 1, F.col("source")).otherwise("maybe").alias("value"),
    )
    return options.violations(requests)
