"""Splitting documents into chunks, their hierarchy, checks of it, and the chunk table as a sink.

Fixed windows are built-in expressions. The recursive splitter (splitting.py) works on one document's text inside a task; offsets
are code points (utf16_offsets turns them into UTF-16 units).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.functions.identity import chunk_id
from loreweave.operators.splitting import Block, Limits, Section, parents, split
from loreweave.sources import structure


def fixed_windows(docs: DataFrame, most: int, overlap: int, id_col: str = "doc_id", text_col: str = "text", revision: str | None = None) -> DataFrame:
    """id_col, chunk_index, source_start, source_end, chunk_text, and with a revision chunk_id: windows of `most` characters of the
    stripped text, each overlap (at most half a window) before the last one's end; the first that reaches the end is the last.
    The document's hash is taken before its text is cut, so nothing is shuffled."""
    step = max(1, most - min(overlap, most // 2))
    lead = F.length(F.regexp_extract(F.col(text_col), r"^\s*", 0))
    sha = F.sha2(F.col(text_col), 256) if revision is not None else F.lit(None).cast("string")
    body = docs.select(id_col, lead.alias("lead"), F.regexp_replace(F.col(text_col), r"^\s+|\s+$", "").alias("body"), sha.alias("sha"))
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.length("body") - 1, F.lit(0)), F.lit(step)), lambda s: (s == 0) | (s - step + most < F.length("body")))
    rows = body.where(F.length("body") > 0).select(id_col, "lead", "body", "sha", F.posexplode(starts).alias("chunk_index", "at"))
    text = F.substring("body", F.col("at") + 1, F.lit(most))
    cut = rows.select(id_col, "sha", "chunk_index", (F.col("lead") + F.col("at")).alias("source_start"), (F.col("lead") + F.col("at") + F.length(text)).alias("source_end"), text.alias("chunk_text"))
    if revision is None:
        return cut.drop("sha")
    return cut.withColumn("chunk_id", chunk_id(F.col("sha"), F.lit(revision), "CHILD", F.lit(0), F.col("source_start"), F.col("source_end"))).drop("sha")


def plain_windows(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Windows that do not overlap: id_col, ordinal, window_text."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text_col) - 1, F.lit(0)), F.lit(size))
    rows = docs.where(F.length(text_col) > 0).select(id_col, text_col, F.posexplode(starts).alias("ordinal", "at"))
    return rows.select(id_col, "ordinal", F.substring(text_col, F.col("at") + 1, F.lit(size)).alias("window_text"))


CHUNKS = "kind string, chunk_index int, parent_index int, child_index int, source_start int, source_end int, tier string, chunk_text string"


def _numbered(sections: list[Section], limits: Limits, merge_pages: bool = False) -> Iterator[tuple]:
    """The rows of a document: each parent before its children, numbered in that order; what a row is, and what it comes from."""
    chunks = [c for s in sections for c in split(s, limits)]
    number = 0
    for p, parent in enumerate(parents(chunks, limits, merge_pages=merge_pages)):
        yield ("PARENT", number, p, None, parent.start, parent.end, None, parent.text), parent, chunks[parent.first].section
        number += 1
        for c in range(parent.first, parent.last + 1):
            x = chunks[c]
            yield ("CHILD", number, p, c - parent.first, x.start, x.end, x.tier, x.section.text[x.start : x.end]), x, x.section
            number += 1


def recursive_chunks(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", step: int = 4096) -> DataFrame:
    """id_col and CHUNKS of documents that are one section each; rows leave a task in batches of about `step`."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, *(x.split()[0] for x in CHUNKS.split(", "))]
    source = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = [batch.schema.field(0).type, pa.string(), *[pa.int32()] * 5, pa.string(), pa.string()]
            rows: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows += [(key, *row) for row, _, _ in _numbered([Section(text.as_py())], limits)]
                if len(rows) >= step:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return source.mapInArrow(run, f"`{id_col}` {kind}, {CHUNKS}")


PLACED = f"{CHUNKS}, section int, page_start int, page_end int, path array<string>, confidence string"


def section_chunks(sections: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id") -> DataFrame:
    """id_col and PLACED of documents in sections: id_col, section, text, page, format, language, blocks (array of kind, start, end,
    path, confidence). Structural blocks bound the pieces, parents stay within a section and a path, and those of a PDF may join
    two pages. A document is one group: its sections are what its parents are folded over. parsed_chunks reads and chunks
    without a shuffle."""
    fields = ("section", "text", "page", "format", "language")
    blocks = F.transform("blocks", lambda b: F.struct(*(b[c].alias(c) for c in ("kind", "start", "end", "path", "confidence"))))
    own = sections.groupBy(id_col).agg(F.collect_list(F.struct(*fields, blocks.alias("blocks"))).alias("sections"))

    def parts(rows: list[dict]) -> tuple[list[Section], bool]:
        rows = sorted(rows, key=lambda r: r["section"])
        found = [tuple(Block(b["kind"], b["start"], b["end"], tuple(b["path"] or ()), b["confidence"]) for b in r["blocks"] or ()) for r in rows]
        return [Section(r["text"] or "", r["section"], r["page"], b, (r["language"] or "").lower().startswith("en")) for r, b in zip(rows, found, strict=True)], (rows[0]["format"] or "").upper() == "PDF"

    return _placed_rows(own, id_col, parts, limits)


def parsed_chunks(docs: DataFrame, kind: str, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "xhtml", strict: bool = True, split_pages: bool = True, max_pages: int | None = None) -> DataFrame:
    """As section_chunks of structure.sections, without those that have an error: each row of docs is a document, read and chunked
    where it is."""
    if kind not in ("PDF", "DOCX"):
        raise ValueError(f"unknown kind {kind}")

    def parts(text: str | None) -> tuple[list[Section], bool]:
        found = (r for r in structure.parsed(text, kind, strict, split_pages, max_pages) if r[7] is None)
        return [Section(r[1], r[0], r[2], tuple(Block(*b[:5]) for b in r[6])) for r in found], kind == "PDF"

    return _placed_rows(docs.select(id_col, text_col), id_col, parts, limits)


def _placed_rows(docs: DataFrame, id_col: str, parts: Callable, limits: Limits, step: int = 4096) -> DataFrame:
    """id_col and PLACED of rows of an id and a document, which parts turns into its sections and whether they are pages; rows leave
    a task in batches of about `step`."""
    key = docs.schema[id_col].dataType.simpleString()
    names = [id_col, *(x.split()[0] for x in PLACED.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            types = [batch.schema.field(0).type, pa.string(), *[pa.int32()] * 5, pa.string(), pa.string(), *[pa.int32()] * 3, pa.list_(pa.string()), pa.string()]
            for own, document in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sections, merge = parts(document.as_py())
                for row, source, section in _numbered(sections, limits, merge):
                    pages = source.pages if row[0] == "PARENT" else (section.page, section.page)
                    rows.append((own, *row, section.index, *pages, list(source.path), source.confidence))
                if len(rows) >= step:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return docs.mapInArrow(run, f"`{id_col}` {key}, {PLACED}")


def utf16_offsets(text: str, start: int, end: int) -> tuple[int, int]:
    """Code-point offsets as UTF-16 units."""
    units = lambda s: len(s.encode("utf-16-le")) // 2
    return units(text[:start]), units(text[:end])


def context_header(revision: Column, source: Column, kind: Column, path: Column, page: Column, last_page: Column, pages: Column, tokens: Column, characters: Column) -> Column:
    """The header before a chunk's text: source, format, path and page are taken in order, 160 characters of each at most, while the
    header keeps to the UTF-8 bytes and characters left for it; empty if no field fits."""
    number = F.concat(F.when(page == last_page, page.cast("string")).otherwise(F.concat_ws("-", page.cast("string"), last_page.cast("string"))), F.coalesce(F.concat(F.lit("/"), pages.cast("string")), F.lit("")))
    whole = lambda lines: F.concat(F.lit("["), revision, F.lit("]\n"), lines, F.lit("\n\n"))
    out = F.lit("")
    for name, value in (("source", source), ("format", kind), ("path", F.array_join(path, " > ")), ("page", number)):
        flat = F.substring(F.btrim(F.regexp_replace(value, r"\s+", " ")), 1, 160)
        line = F.concat(F.lit(f"{name}: "), flat)
        longer = F.when(out == "", line).otherwise(F.concat(out, F.lit("\n"), line))
        fits = (F.length(whole(longer)) <= characters) & (F.octet_length(whole(longer)) <= tokens)
        out = F.when(value.isNotNull() & (flat != "") & fits, longer).otherwise(out)
    return F.when(out == "", "").otherwise(whole(out))


def topology(chunks: DataFrame, edges: DataFrame, documents: DataFrame | None = None, document: str = "document_id") -> DataFrame:
    """Per document: counts of its chunks and EMPTY, FLAT, HIERARCHICAL or INVALID. chunks: document, id, kind, parent_id, child_index,
    kb, run, revision; edges: parent, child; documents: document, for those without chunks.

    A child's parent is looked up by document and id: one co-partitioned self join, and one with the edges."""
    scope = ("kb", "run", "revision")
    own = chunks.where("kind = 'PARENT'").select(F.col(document).alias("p_document"), F.col("id").alias("p_id"), *(F.col(c).alias(f"p_{c}") for c in scope))
    joined = chunks.join(own, (F.col(document) == F.col("p_document")) & (F.col("parent_id") == F.col("p_id")), "left")
    links = edges.select(F.col("parent").alias("e_parent"), F.col("child").alias("e_child")).distinct()
    joined = joined.join(links, (F.col("parent_id") == F.col("e_parent")) & (F.col("id") == F.col("e_child")), "left")
    is_parent, is_child = F.col("kind") == "PARENT", F.col("kind") == "CHILD"
    parented = is_child & F.col("parent_id").isNotNull()
    same = F.lit(True)
    for c in scope:
        same = same & F.coalesce(F.col(c) == F.col(f"p_{c}"), F.lit(False))
    found = parented & F.col("p_id").isNotNull()
    counted = joined.groupBy(document).agg(
        F.count("*").alias("n_chunks"), F.count_if(is_parent).alias("n_parents"), F.count_if(parented).alias("n_parented"), F.count_if(is_child & F.col("parent_id").isNull()).alias("n_unparented"),
        F.count_if(parented & F.col("p_id").isNull()).alias("n_orphans"), F.count_if(found & ~same).alias("n_cross_scope"), F.count_if(F.coalesce(~(is_parent | is_child), F.lit(True))).alias("n_unsupported"),
        F.count_if(is_parent & (F.col("parent_id").isNotNull() | F.col("child_index").isNotNull())).alias("n_malformed"), F.count_if(found & same & F.col("e_child").isNull()).alias("n_missing_edges"),
    )
    if documents is not None:
        counted = documents.select(document).distinct().join(counted, document, "full_outer").fillna(0)
    broken = F.col("n_orphans") + F.col("n_cross_scope") + F.col("n_unsupported") + F.col("n_malformed") + F.col("n_missing_edges") > 0
    state = (
        F.when(F.col("n_chunks") == 0, "EMPTY").when(broken, "INVALID").when((F.col("n_parents") == 0) & (F.col("n_unparented") == F.col("n_chunks")), "FLAT")
        .when((F.col("n_parents") > 0) & (F.col("n_unparented") == 0), "HIERARCHICAL").otherwise("INVALID")
    )
    return counted.withColumn("topology", state)


def hierarchy_violations(chunks: DataFrame, document: str = "document_id") -> DataFrame:
    """What may not be stored: document, id, problem. chunks: document, id, kind, parent_id, child_index, child_count, source_start,
    source_end, and where they are known text, source_hash, embedding, kb, run, revision, page_start, page_end.

    Ids are there and once; a parent refers to nothing, holds no embedding, and its hash is that of its text; in a document with
    parents every child has one of its scope, inside whose range it lies; children are as many as the parent says, numbered from 0.
    """
    have = set(chunks.columns)
    for name, kind in (("text", "string"), ("source_hash", "string"), ("embedding", "array<double>"), ("kb", "string"), ("run", "string"), ("revision", "string"), ("page_start", "int"), ("page_end", "int")):
        chunks = chunks if name in have else chunks.withColumn(name, F.lit(None).cast(kind))
    is_parent = F.col("kind") == "PARENT"
    p = chunks.where(is_parent).select(F.col(document).alias("p_document"), F.col("id").alias("p_id"), *(F.col(c).alias(f"p_{c}") for c in ("kb", "run", "revision", "source_start", "source_end", "page_start", "page_end")))
    parented = p.select(F.col("p_document").alias(document)).distinct().withColumn("has_parents", F.lit(True))
    joined = chunks.join(p, (F.col(document) == F.col("p_document")) & (F.col("parent_id") == F.col("p_id")), "left").join(parented, document, "left")
    apart = F.lit(False)
    for c in ("kb", "run", "revision"):
        apart = apart | ~F.col(c).eqNullSafe(F.col(f"p_{c}"))
    pages = F.col("p_page_start").isNotNull() & (F.col("page_start").isNull() | (F.col("page_start") < F.col("p_page_start")) | (F.col("page_end") > F.col("p_page_end")) | ~F.col("page_start").eqNullSafe(F.col("page_end")))
    first = (F.col("p_page_start").isNull() | (F.col("p_page_start") == F.col("page_start"))) & (F.col("source_start") < F.col("p_source_start"))
    last = (F.col("p_page_end").isNull() | (F.col("p_page_end") == F.col("page_end"))) & (F.col("source_end") > F.col("p_source_end"))
    child = (F.col("kind") == "CHILD") & F.col("has_parents").isNotNull()
    own = (
        F.when(F.col("id").isNull(), "ID_MISSING").when(is_parent & (F.col("parent_id").isNotNull() | F.col("child_index").isNotNull()), "PARENT_REFERENCE").when(is_parent & F.col("embedding").isNotNull(), "PARENT_EMBEDDING")
        .when(is_parent & F.col("text").isNotNull() & ~F.sha2("text", 256).eqNullSafe(F.col("source_hash")), "PARENT_HASH").when(child & F.col("p_id").isNull(), "PARENT_NOT_FOUND")
        .when(child & apart, "CHILD_SCOPE").when(child & (pages | first | last), "CONTAINMENT")
    )
    single = joined.select(document, F.col("id"), own.alias("problem"))
    repeated = chunks.where("id is not null").groupBy(document, "id").agg(F.count("*").alias("n")).where("n > 1").select(document, "id", F.lit("ID_REPEATED").alias("problem"))
    counts = chunks.where("kind = 'CHILD' and parent_id is not null").groupBy(document, F.col("parent_id").alias("id")).agg(
        F.count("*").alias("n"), F.count_distinct("child_index").alias("numbers"), F.min("child_index").alias("low"), F.max("child_index").alias("high")
    )
    n = F.coalesce("n", F.lit(0))
    numbered = (n == 0) | ((F.col("numbers") == n) & (F.col("low") == 0) & (F.col("high") == n - 1))
    family = chunks.where(is_parent).select(document, "id", "child_count").join(counts, [document, "id"], "left")
    family = family.select(document, "id", F.when(~n.eqNullSafe(F.col("child_count").cast("long")), "CHILD_COUNT").when(~F.coalesce(numbered, F.lit(False)), "CHILD_INDEX").alias("problem"))
    return single.unionByName(repeated).unionByName(family).where("problem is not null")


def replace_chunks(existing: DataFrame, new: DataFrame, document: str = "document_id") -> DataFrame:
    """The chunk table with the documents of `new` replaced, copy-on-write. Raises if new breaks the hierarchy's rules."""
    problems = hierarchy_violations(new, document).limit(20).collect()
    if problems:
        raise ValueError("chunks break the hierarchy: " + ", ".join(f"{r[document]}/{r['id']}: {r['problem']}" for r in problems))
    kept = existing.join(new.select(document).distinct(), document, "left_anti")
    return kept.unionByName(new.select(*existing.columns))


def write_chunks(new: DataFrame, path: str, document: str = "document_id", buckets: int = 256) -> None:
    """The same as a sink: Parquet partitioned by a hash of the document; only the partitions that new touches are written again.
    Rows of theirs that new doesn't replace are read first and kept."""
    spark = new.sparkSession
    part = F.pmod(F.xxhash64(F.col(document)), F.lit(buckets)).cast("int")
    try:
        existing = spark.read.parquet(path)
    except Exception as e:  # the first write
        if "PATH_NOT_FOUND" not in str(e):
            raise
        existing = None
    rows = new.withColumn("part", part)
    if existing is not None:
        from loreweave.sources.shared import written

        touched = rows.select("part").distinct()
        rows = written(replace_chunks(existing.join(touched, "part", "left_semi"), rows, document), "chunk-parts")
    elif problems := hierarchy_violations(new, document).limit(20).collect():
        raise ValueError("chunks break the hierarchy: " + ", ".join(f"{r[document]}/{r['id']}: {r['problem']}" for r in problems))
    rows.repartition("part").write.option("partitionOverwriteMode", "dynamic").partitionBy("part").mode("overwrite").parquet(path)


def page_with_total(df: DataFrame, number: int, size: int, *order: str) -> tuple[DataFrame, int]:
    """A page and how many rows there are in all."""
    return page(df, number, size, *order), df.count()


def page(df: DataFrame, number: int, size: int, *order: str) -> DataFrame:
    if number < 0 or not 1 <= size <= 100:
        raise ValueError("pages start at 0 and hold 1 to 100 rows")
    return df.orderBy(*order).offset(number * size).limit(size)


def document_chunks(chunks: DataFrame, document_id, document: str = "document_id") -> DataFrame:
    """A document's chunks in their order; the filter reaches the scan."""
    return chunks.where(F.col(document) == document_id).orderBy("chunk_index", "id")


def flat_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks outside any hierarchy: of no kind, or children without a parent."""
    return chunks.where(F.col("parent_id").isNull() & (F.col("kind").isNull() | (F.col("kind") == "CHILD")))


def parent_page(chunks: DataFrame, number: int, size: int, document: str = "document_id") -> DataFrame:
    """A page of parents by document and place, each with the number of its children. Children are counted for the page's parents alone."""
    own = page(chunks.where("kind = 'PARENT'"), number, size, document, "chunk_index", "id")
    counts = chunks.where("kind = 'CHILD'").join(F.broadcast(own.select(F.col("id").alias("parent_id"))), "parent_id", "left_semi").groupBy("parent_id").agg(F.count("*").alias("children"))
    return own.join(counts.withColumnRenamed("parent_id", "id"), "id", "left").withColumn("children", F.coalesce("children", F.lit(0).cast("long")))


def flat_counts(chunks: DataFrame, document: str = "document_id") -> DataFrame:
    """Per document: flat chunks, those of all kinds, and whether the document is flat."""
    flat = F.col("parent_id").isNull() & (F.col("kind").isNull() | (F.col("kind") == "CHILD"))
    return chunks.groupBy(document).agg(F.count_if(flat).alias("flat"), F.count("*").alias("chunks")).withColumn("is_flat", F.col("flat") == F.col("chunks"))


def migration_state(documents: DataFrame, chunks: DataFrame, revision: str, document: str = "doc_id") -> DataFrame:
    """Per document: NO_CHUNKS, OUTDATED or CURRENT by its chunks' revisions."""
    seen = chunks.groupBy(document).agg(F.count("*").alias("n"), F.count_if(~F.col("revision").eqNullSafe(F.lit(revision))).alias("old"))
    state = F.when(F.col("n").isNull(), "NO_CHUNKS").when(F.col("old") > 0, "OUTDATED").otherwise("CURRENT")
    return documents.join(seen, document, "left").select(document, state.alias("state"))


def migration_selection(states: DataFrame, mode: str, wanted: DataFrame | None = None, running: DataFrame | None = None, document: str = "doc_id") -> DataFrame:
    """document, state, blocker of what a migration takes: ALL documents with chunks, those OUTDATED_STRATEGY, or DOCUMENT_IDS (wanted).

    A blocker is NOT_FOUND for a wanted id without a document, NO_CHUNKS where there is nothing to split again, and RUNNING while a run
    of the document is open (running: document)."""
    none = states.select(document).limit(0)
    busy = (none if running is None else running.select(document).distinct()).withColumn("busy", F.lit(True))
    if mode == "DOCUMENT_IDS":
        chosen = (none if wanted is None else wanted.select(document).distinct()).join(states, document, "left")
    elif mode in ("ALL", "OUTDATED_STRATEGY"):
        chosen = states.where("state = 'OUTDATED'" if mode == "OUTDATED_STRATEGY" else "state <> 'NO_CHUNKS'")
    else:
        raise ValueError(f"unknown selection {mode}")
    blocker = F.when(F.col("state").isNull(), "NOT_FOUND").when(F.col("state") == "NO_CHUNKS", "NO_CHUNKS").when(F.col("busy"), "RUNNING")
    return chosen.join(busy, document, "left").select(document, "state", blocker.alias("blocker"))
