"""Queries of document structure: paged texts and web pages into sections, blocks and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.operators import chunking
from loreweave.operators.splitting import Limits
from loreweave.queries import query
from loreweave.sources import structure
from loreweave.sources.shared import dealt
from loreweave.sources.tables import table


def paged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, xhtml: each document as paged XHTML, three lines a paragraph, four paragraphs a page; characters that XML forbids go."""
    legal = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    escaped = F.replace(F.replace(F.replace(legal, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.split(escaped, "\n", -1).alias("lines"))
    last = (F.size("lines") - 1).cast("int")
    tag = lambda name, inside, close: F.concat(F.lit(f"<{name}>"), inside, F.lit(f"</{close}>"))
    paragraph = lambda k: tag("p", F.array_join(F.transform(F.sequence(k * 3, F.least(k * 3 + 2, last)), lambda i: F.get("lines", i)), "\n"), "p")
    whole = lambda n, d: F.floor(n / F.lit(d)).cast("int")
    page = lambda p: tag('div class="page"', F.array_join(F.transform(F.sequence(p * 4, F.least(p * 4 + 3, whole(last, 3))), paragraph), ""), "div")
    body = F.array_join(F.transform(F.sequence(F.lit(0), whole(last, 12)), page), "")
    return docs.select("doc_id", tag("html", tag("body", body, "body"), "html").alias("xhtml"))


@query(r"""WITH t AS (SELECT doc_id, string_split(replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), chr(160), ' '), chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
    l AS (SELECT doc_id, len(lines) AS n, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM t),
    p AS (SELECT doc_id, (n - 1) // 12 + 1 AS page_count, i // 12 AS page, i // 3 AS para, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^[\x09-\x0D\x1C-\x20]+|[\x09-\x0D\x1C-\x20]+$', '', 'g') AS body FROM l GROUP BY ALL),
    q AS (SELECT *, sum(length(body) + 1) OVER (PARTITION BY doc_id, page ORDER BY para) - length(body) - 1 AS s FROM p WHERE body <> ''),
    u AS (SELECT doc_id, page, page_count, para, s, unnest(string_split(body, chr(10))) AS line, unnest(range(len(string_split(body, chr(10))))) AS j FROM q),
    v AS (SELECT *, s + sum(length(line) + 1) OVER w - length(line) - 1 AS a, count(*) FILTER (WHERE line <> '') OVER w AS number FROM u WINDOW w AS (PARTITION BY doc_id, page, para ORDER BY j)),
    b AS (SELECT doc_id, page, page_count, 'PARAGRAPH' AS kind, '/paragraph' AS inner_path, 'HINT' AS confidence, s AS a, body AS block_text FROM q
        UNION ALL SELECT doc_id, page, page_count, 'LINE', '/line[' || number || ']', 'HINT', a, line FROM v WHERE line <> ''
        UNION ALL SELECT doc_id, page, page_count, 'PAGE', '', 'AUTHORITATIVE', 0, string_agg(body, chr(10) ORDER BY para) FROM q GROUP BY doc_id, page, page_count)
    SELECT doc_id, CAST(page AS INTEGER) AS section, CAST(page + 1 AS INTEGER) AS page, CAST(page_count AS INTEGER) AS page_count, kind, 'page[' || (page + 1) || ']' || inner_path AS path, confidence,
        CAST(a AS INTEGER) AS block_start, CAST(a + length(block_text) AS INTEGER) AS block_end, block_text FROM b""")
def pdf_page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.blocks(structure.sections(paged_documents(spark, sf_dir), "PDF")).drop("metadata")


@query()
def pdf_page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural units, parents over sections and pages, and each chunk's context header."""
    limits = Limits(tokens=700, overlap=60, characters=700, parent_tokens=2100, parent_characters=2100, header_tokens=90, header_characters=90)
    chunks = chunking.parsed_chunks(paged_documents(spark, sf_dir), "PDF", limits)
    none = F.lit(None).cast("int")
    header = chunking.context_header(F.lit("v1"), F.col("doc_id").cast("string"), F.lit("PDF"), F.col("path"), F.col("page_start"), F.col("page_end"), none, F.lit(90), F.lit(90))
    return chunks.withColumn("header", header)


@query()
def page_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as flowing documents: headings, paragraphs, tables with rows and cells, list markers."""
    found = structure.sections(table(spark, sf_dir, "pages"), "DOCX", "page_id", "html", strict=False)
    return structure.blocks(found, "page_id").withColumn("list_marker", F.col("metadata")["listMarker"]).drop("metadata")
