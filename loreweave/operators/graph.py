"""Writing graph facts copy-on-write, sanitising extractions, and collecting facts without evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_writer(existing: DataFrame, new: DataFrame, key: str | tuple[str, ...] = "id", sequence: str = "write_seq", place: str | None = None) -> DataFrame:
    """Both tables with one row per key, the one written first: later properties are ignored. Partial aggregation, no window.
    Of rows of one sequence the first by `place` counts (a column that says where a row stands; it is dropped), then the smallest."""
    both, keys = existing.unionByName(new), (key,) if isinstance(key, str) else key
    rest = [c for c in both.columns if c not in (*keys, place)]
    if rest == [sequence]:
        return both.groupBy(*keys).agg(F.min(sequence).alias(sequence))
    order = [sequence, *([place] if place else []), *(c for c in rest if c != sequence and not dict(both.dtypes)[c].startswith("map"))]
    first = both.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return first.select(*keys, "row.*")


def upsert_relationships(existing: DataFrame, new: DataFrame, starts: DataFrame, ends: DataFrame, key: str | tuple[str, ...] = "id") -> DataFrame:
    """As first_writer; new relationships need both ends. starts, ends: id. Relationships of one type may be told apart by their ends
    (key), so that their ids, which are long, need not be shuffled but can be made of the result."""
    valid = new.join(starts.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(ends.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    return first_writer(existing, valid.select(*existing.columns), key)


def with_provenance(evidence: DataFrame, chunks: DataFrame, props: Column | None = None, chunk_props: Column | None = None) -> DataFrame:
    """Evidence with its chunk's properties over its own. chunks: chunk_id, chunk_props map; evidence: chunk_id, props map. Instead of
    maps both may have the columns that they are made of: then props and chunk_props are made after the join, of narrow rows. Chunks
    have a row each and are fewer than evidence, so a task keeps its share of them and need not sort the evidence."""
    none = F.create_map().cast("map<string,string>")
    joined = evidence.join(chunks.withColumn("_found", F.lit(True)).hint("shuffle_hash"), "chunk_id", "left")
    joined = joined.withColumn("props", F.col("props") if props is None else props)
    joined = joined.withColumn("chunk_props", F.coalesce(F.when(F.col("_found"), F.col("chunk_props") if chunk_props is None else chunk_props), none)).drop("_found")
    own = F.map_filter("props", lambda k, _: ~F.array_contains(F.map_keys("chunk_props"), k))
    return joined.withColumn("props", F.map_concat(own, "chunk_props")).drop("chunk_props")


def without(rows: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """Copy-on-write deletion."""
    return rows.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def orphans(facts: DataFrame, evidence: DataFrame, key: str = "fact_id") -> DataFrame:
    """Facts that no evidence supports any more."""
    return facts.join(evidence.select(key), key, "left_anti")


def stale_runs(runs: DataFrame, overwrite: bool) -> DataFrame:
    """Runs whose artifacts a newly completed run of the document replaces: failed ones, with overwrite completed ones too.
    runs: run_id, document_id, status, seq."""
    newest = runs.groupBy("document_id").agg(F.max_by("status", "seq").alias("last_status"), F.max("seq").alias("last_seq"))
    old = runs.join(newest, "document_id").where((F.col("last_status") == "COMPLETED") & (F.col("seq") < F.col("last_seq")))
    return old.where(F.col("status").isin("FAILED", "COMPLETED") if overwrite else F.col("status") == "FAILED").select("run_id", "document_id")


def single_active(runs: DataFrame) -> DataFrame:
    """runs with active: the newest completed run of each document. One aggregate joined back, no sort of a document's runs."""
    last = runs.where("status = 'COMPLETED'").groupBy("document_id").agg(F.max("seq").alias("active_seq"))
    return runs.join(last, "document_id", "left").withColumn("active", F.coalesce(F.col("seq") == F.col("active_seq"), F.lit(False))).drop("active_seq")


def extraction_chunks(chunks: DataFrame) -> DataFrame:
    """A document's parents, or all its chunks where it has none."""
    has = F.max((F.col("kind") == "PARENT").cast("int")).over(Window.partitionBy("document_id"))
    return chunks.withColumn("has", has).where((F.col("has") == 0) | (F.col("kind") == "PARENT")).drop("has")


#: Fixed order: the properties a missing key is repaired from.
REPAIRS = ("id", "name", "code", "number", "title")


def blank_to_null(c: Column) -> Column:
    return F.when(~c.rlike(r"^\s*$"), c)


def schema_keys(keys: DataFrame) -> DataFrame:
    """keys (label, keys: array of names) with trimmed names, each once, none blank; a null array is empty."""
    names = F.array_distinct(F.transform(F.filter("keys", lambda k: blank_to_null(k).isNotNull()), lambda k: F.trim(k)))
    return keys.select("label", F.coalesce(names, F.array().cast("array<string>")).alias("keys"))


def sanitise_nodes(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """Adds keys, key_values (a value for each key of the label, repaired where blank; null where nothing repairs it) and drop_reason
    (null: kept). nodes: label, props map; keys: label, keys. A label without keys is complete."""
    joined = nodes.join(F.broadcast(schema_keys(keys)), "label", "left")  # a row per label of a schema
    repaired = F.coalesce(*(blank_to_null(F.element_at("props", F.lit(r))) for r in REPAIRS))
    values = F.transform("keys", lambda k: F.coalesce(blank_to_null(F.element_at(F.col("props"), k)), repaired))
    reason = F.when(F.col("keys").isNull(), "unknown_label").when(F.exists("key_values", lambda v: v.isNull()), "incomplete_node_key")
    return joined.withColumn("key_values", values).withColumn("drop_reason", reason)


def _filled(key: Column, only: Column):
    """The value of the k-th key: the given one, else that of the only node."""
    return lambda k, i: F.coalesce(blank_to_null(F.element_at(key, k)), F.get(only, i))


def sanitise_relationships(rels: DataFrame, nodes: DataFrame, triples: DataFrame, keys: DataFrame) -> DataFrame:
    """Adds from_values, to_values and drop_reason, the first that holds. Blank keys of an end are filled from the chunk's kept node of
    its label where there is exactly one.

    rels: chunk_id, kind, from_label, from_key map, to_label, to_key map; nodes: kept ones as chunk_id, label, key_values; triples:
    kind, from_label, to_label; keys: label, keys. A chunk's kept nodes (a payload has a hundred at most) are gathered once, and one
    join on the chunk serves both ends.
    """
    own = nodes.groupBy("chunk_id", "label").agg(F.count("*").alias("n"), F.collect_set("key_values").alias("sets"))
    kept = own.groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("label", F.struct("n", "sets")))).alias("kept"))
    out = rels.join(kept, "chunk_id", "left")
    defs = schema_keys(keys)
    for end in ("from", "to"):
        out = out.join(F.broadcast(defs.select(F.col("label").alias(f"{end}_label"), F.col("keys").alias(f"{end}_keys"))), f"{end}_label", "left")
        of_label = F.element_at("kept", F.col(f"{end}_label"))
        out = out.withColumn(f"{end}_nodes", of_label["sets"]).withColumn(f"{end}_only", F.when(of_label["n"] == 1, F.get(of_label["sets"], F.lit(0))))
        key, only = F.col(f"{end}_key"), F.col(f"{end}_only")
        out = out.withColumn(f"{end}_values", F.transform(f"{end}_keys", _filled(key, only)))
    out = out.join(F.broadcast(triples.withColumn("declared", F.lit(True))), ["kind", "from_label", "to_label"], "left")
    entries = lambda end: F.coalesce(F.size(F.map_keys(f"{end}_key")), F.lit(0))
    empty = lambda end: (entries(end) <= 0) & ~F.exists(f"{end}_values", lambda v: v.isNotNull())
    missing = lambda end: F.exists(f"{end}_values", lambda v: v.isNull())
    absent = lambda end: F.when(F.size(f"{end}_keys") == 0, F.col(f"{end}_nodes").isNull()).otherwise(~F.coalesce(F.array_contains(F.col(f"{end}_nodes"), F.col(f"{end}_values")), F.lit(False)))
    reason = (
        F.when(F.col("from_keys").isNull() | F.col("to_keys").isNull(), "unknown_endpoint_label").when(F.col("declared").isNull(), "invalid_relationship_triple")
        .when(empty("from") | empty("to"), "empty_endpoint_key").when(missing("from"), "incomplete_from_endpoint_key")
        .when(missing("to"), "incomplete_to_endpoint_key").when(absent("from"), "from_endpoint_not_kept").when(absent("to"), "to_endpoint_not_kept")
    )
    return out.withColumn("drop_reason", reason).drop("kept", "declared", *(f"{end}_{x}" for end in ("from", "to") for x in ("keys", "nodes", "only")))


def scope_violations(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """Evidence that may not be written: evidence_id, problem. evidence: evidence_id, kb, run, schema_id, document_id, chunk_id;
    chunks: chunk_id, kb, document_id, run."""
    blank = lambda c: F.coalesce(F.col(c).cast("string").rlike(r"^\s*$"), F.lit(True))
    c = chunks.select(F.col("chunk_id").alias("own"), F.col("kb").alias("own_kb"), F.col("document_id").alias("own_document"), F.col("run").alias("own_run"))
    joined = evidence.join(c, F.col("chunk_id") == F.col("own"), "left")
    problem = F.lit(None).cast("string")
    for name in ("chunk_id", "document_id", "schema_id", "run", "kb"):
        problem = F.when(blank(name), f"BLANK_{name.upper()}").otherwise(problem)
    other = F.when(F.col("own").isNull(), "CHUNK_NOT_FOUND").when(~F.col("own_kb").eqNullSafe(F.col("kb")) | ~F.col("own_document").eqNullSafe(F.col("document_id")), "CHUNK_SCOPE").when(~F.col("own_run").eqNullSafe(F.col("run")), "CHUNK_RUN")
    return joined.select("evidence_id", F.coalesce(problem, other).alias("problem")).where("problem is not null")


def declared_properties(rows: DataFrame, allowed: DataFrame) -> DataFrame:
    """props cut to the label's declared names, and dropped: the other names. allowed: label, names."""
    joined = rows.join(F.broadcast(allowed), "label", "left")
    names = F.coalesce("names", F.array().cast("array<string>"))
    dropped = F.array_sort(F.array_except(F.map_keys("props"), names))
    return joined.withColumn("dropped", dropped).withColumn("props", F.map_filter("props", lambda k, _: F.array_contains(names, k))).drop("names")


def over_caps(nodes: DataFrame, rels: DataFrame, most_nodes: int = 100, most_rels: int = 200) -> DataFrame:
    """Chunks whose payload holds too many nodes or relationships."""
    a = nodes.groupBy("chunk_id").agg(F.count("*").alias("n_nodes"))
    b = rels.groupBy("chunk_id").agg(F.count("*").alias("n_rels"))
    return a.join(b, "chunk_id", "full_outer").fillna(0, ["n_nodes", "n_rels"]).where((F.col("n_nodes") > most_nodes) | (F.col("n_rels") > most_rels))
