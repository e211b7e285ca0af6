"""Schema discovery: merging candidates, conflicts, review state, diffs, evaluation metrics and their roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: What makes candidates one variant; columns that a table lacks are the same for all its rows.
VARIANT = ("kind", "identity", "type", "keys", "relationship", "from_label", "to_label")


def _variant(candidates: DataFrame) -> list[str]:
    return [c for c in VARIANT if c in candidates.columns]


def merge_candidates(candidates: DataFrame) -> DataFrame:
    """One row per variant. candidates: kind, identity, type, source, document (nullable), origin, confidence, perhaps keys (array),
    relationship, from_label and to_label: nodes with other keys and relationships with other ends are other variants.

    support counts independent sources: a document once, however many sources quote it.
    """
    independent = F.coalesce(F.concat(F.lit("document:"), F.col("document").cast("string")), F.col("source"))
    return candidates.groupBy(*_variant(candidates)).agg(
        F.max("confidence").alias("confidence"),
        F.array_sort(F.collect_set("origin")).alias("origins"),
        F.count_distinct(independent).alias("support"),
    )


def united_evidence(candidates: DataFrame) -> DataFrame:
    """A row per variant and piece of evidence (source, chunk, document; columns that are there), with all its origins in order. Rows
    instead of lists, since a variant may be seen everywhere."""
    own = [c for c in ("source", "chunk", "document") if c in candidates.columns]
    return candidates.groupBy(*_variant(candidates), *own).agg(F.array_sort(F.collect_set("origin")).alias("origins"))


def review_state(merged: DataFrame, excluded: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Adds review_state; excluded: identity; conflicts: identity. Both are short lists of a schema draft."""
    marked = merged.join(F.broadcast(excluded.select("identity", F.lit(True).alias("gone"))), "identity", "left").join(F.broadcast(conflicts.select("identity", F.lit(True).alias("split")).distinct()), "identity", "left")
    observed = F.array_contains("origins", "OBSERVED")
    state = (
        F.when(F.col("gone"), "SUPPRESSED").when(F.col("split"), "REVIEW_REQUIRED").when(F.array_contains("origins", "GUIDED") & ~observed, "REVIEW_REQUIRED")
        .when((F.col("support") < 2) & observed, "LOW_SUPPORT").otherwise("RECOMMENDED")
    )
    return marked.withColumn("review_state", state).drop("gone", "split")


def conflicts(candidates: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """category, coordinate, alternatives, sources of all that discovery cannot decide.

    candidates: kind (NODE_PROPERTY, RELATIONSHIP_PROPERTY, NODE_KEY, RELATIONSHIP, ...), identity, type, keys (array), relationship,
    from_label, to_label, source; aliases: first, second, source. Groups with more than one alternative conflict: types of a property,
    keys of a node, names of relationships between the same ends, directions of a relationship between the same pair. One pass:
    every candidate names its coordinates and alternatives, and one aggregate finds the groups.
    """
    arrow = lambda a, b: F.concat(a, F.lit("->"), b)
    a, b = F.col("from_label"), F.col("to_label")
    entry = lambda on, category, coordinate, alternative: F.when(on, F.struct(F.lit(category).alias("category"), coordinate.alias("coordinate"), alternative.alias("alternative")))
    kind, related = F.col("kind"), F.col("kind") == "RELATIONSHIP"
    entries = F.array(
        entry(kind.isin("NODE_PROPERTY", "RELATIONSHIP_PROPERTY"), "PROPERTY_TYPE", F.col("identity"), F.col("type")),
        entry(kind == "NODE_KEY", "IDENTITY_KEY", F.col("identity"), F.array_join("keys", ",")),
        entry(related, "RELATIONSHIP_NAME", F.concat(F.lit("relationship-endpoints:"), arrow(a, b)), F.col("relationship")),
        entry(related, "RELATIONSHIP_DIRECTION", F.concat(F.lit("relationship-direction:"), F.col("relationship"), F.lit(":"), F.least(a, b), F.lit(":"), F.greatest(a, b)), arrow(a, b)),
    )
    rows = candidates.select("kind", "source", F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e")).select("kind", "source", "e.*")
    # properties of nodes and of relationships are apart, whatever their identities
    found = rows.groupBy("category", "coordinate", F.when(F.col("category") == "PROPERTY_TYPE", F.col("kind")).alias("apart")).agg(F.array_sort(F.collect_set("alternative")).alias("alternatives"), F.array_sort(F.collect_set("source")).alias("sources"))
    found = found.where(F.size("alternatives") > 1).drop("apart")
    if aliases is None:
        return found
    from loreweave.functions.text import normal_label

    pair = F.concat(normal_label(F.col("first")), F.lit("~"), normal_label(F.col("second")))
    return found.unionByName(aliases.select(F.lit("ALIAS_SUGGESTION").alias("category"), pair.alias("coordinate"), F.array("first", "second").alias("alternatives"), F.array("source").alias("sources")))


def property_conflicts(candidates: DataFrame) -> DataFrame:
    """Identities of one kind seen with more than one type: identity, alternatives."""
    return candidates.groupBy("kind", "identity").agg(F.array_sort(F.collect_set("type")).alias("alternatives")).where(F.size("alternatives") > 1).drop("kind")


def direction_conflicts(relationships: DataFrame) -> DataFrame:
    """Pairs of labels that a relationship joins in both directions: kind, a, b."""
    rows = relationships.select("kind", F.least("from_label", "to_label").alias("a"), F.greatest("from_label", "to_label").alias("b"), (F.col("from_label") <= F.col("to_label")).alias("forward"))
    return rows.where("a <> b").groupBy("kind", "a", "b").agg(F.count_distinct("forward").alias("n")).where("n > 1").drop("n")


def in_order(candidates: DataFrame, *order: str) -> DataFrame:
    """Rows in the order that reports use: by the given columns, a null as an empty string."""
    return candidates.orderBy(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order))


def observed_over_inherited(inherited: DataFrame, observed: DataFrame) -> DataFrame:
    """identity, type, origins: observed values win, origins are united."""
    a = inherited.select("identity", F.col("type").alias("t0"), F.col("origins").alias("o0"))
    b = observed.select("identity", F.col("type").alias("t1"), F.col("origins").alias("o1"))
    none = F.array().cast("array<string>")
    return a.join(b, "identity", "full_outer").select("identity", F.coalesce("t1", "t0").alias("type"), F.array_sort(F.array_union(F.coalesce("o0", none), F.coalesce("o1", none))).alias("origins"))


def apply_decisions(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """candidates: identity, value; decisions: identity, action, value, seq. The newest decision counts: REJECT removes, a value replaces."""
    latest = decisions.groupBy("identity").agg(F.max_by(F.struct("action", F.col("value").alias("new")), "seq").alias("d")).select("identity", "d.*")
    both = candidates.join(latest, "identity", "full_outer")
    return both.where(~F.col("action").eqNullSafe(F.lit("REJECT"))).select("identity", F.coalesce("new", "value").alias("value"))


#: Numeric types, and what each may be widened to.
WIDER = {"INTEGER": ("LONG", "FLOAT", "DOUBLE"), "LONG": ("FLOAT", "DOUBLE"), "FLOAT": ("DOUBLE",)}


def compatibility(change: Column, kind: Column, old: Column, new: Column, required: Column) -> Column:
    """ADDITIVE, REVIEW_REQUIRED or BREAKING for one difference of two schemas."""
    wider = F.lit(False)
    for a, own in WIDER.items():
        wider = wider | ((old == a) & new.isin(*own))
    return (
        F.when((change == "ADD") & kind.isin("node", "relationship"), "ADDITIVE").when((change == "ADD") & (kind == "property") & ~required, "ADDITIVE")
        .when(change == "ADD", "REVIEW_REQUIRED").when((change == "CHANGE") & (kind == "property") & (wider | (old == new)), "REVIEW_REQUIRED").otherwise("BREAKING")
    )


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """coordinate, kind, change, compatibility of two flattened schemas: coordinate, kind, type, required."""
    a = old.select("coordinate", F.col("kind").alias("k0"), F.col("type").alias("t0"), F.col("required").alias("r0"))
    b = new.select("coordinate", F.col("kind").alias("k1"), F.col("type").alias("t1"), F.col("required").alias("r1"))
    both = a.join(b, "coordinate", "full_outer")
    change = F.when(F.col("k0").isNull(), "ADD").when(F.col("k1").isNull(), "REMOVE").when(~F.col("t0").eqNullSafe(F.col("t1")) | ~F.col("r0").eqNullSafe(F.col("r1")), "CHANGE")
    kind = F.coalesce("k1", "k0")
    out = both.select("coordinate", kind.alias("kind"), change.alias("change"), compatibility(change, kind, F.col("t0"), F.col("t1"), F.coalesce("r1", F.lit(False))).alias("compatibility"))
    return out.where("change is not null")


def evaluation_metrics(nodes: DataFrame, relationships: DataFrame, by: str) -> DataFrame:
    """Per run: counts over extracted nodes and relationships, and the rates that follow (null: not applicable).

    nodes: by, recognised, key_present (null: no keys asked for), type_conflicts, missing_required (numbers of properties);
    relationships: by, in_schema, kept. Only recognised nodes count for keys and properties. What is dropped beyond the relationships
    outside the schema has an invalid end or key.
    """
    seen = F.col("recognised")
    own = nodes.groupBy(by).agg(
        F.count_if(seen).alias("recognised"), F.count_if(~seen).alias("unknown"),
        F.count_if(seen & F.col("key_present").isNotNull()).alias("nodes_with_key_definition"), F.count_if(seen & F.col("key_present")).alias("nodes_with_key"),
        F.coalesce(F.sum(F.when(seen, F.col("type_conflicts"))), F.lit(0)).alias("type_conflicts"), F.coalesce(F.sum(F.when(seen, F.col("missing_required"))), F.lit(0)).alias("missing_required"),
    )
    dropped = F.count_if(~F.col("kept"))
    outside = F.count_if(~F.col("in_schema"))
    edges = relationships.groupBy(by).agg(F.count("*").alias("relationships"), dropped.alias("dropped"), outside.alias("dropped_schema_constraint"), F.greatest(F.lit(0), dropped - outside).alias("dropped_invalid_endpoint_or_key"))
    return with_rates(own.join(edges, by, "full_outer").fillna(0))


def with_rates(counts: DataFrame) -> DataFrame:
    """The rates of evaluation_metrics from its counts."""
    rate = lambda a, b: F.round(F.try_divide(F.col(a), F.nullif(b, F.lit(0))), 9)
    out = counts.withColumn("recognition_rate", rate("recognised", F.col("recognised") + F.col("unknown")))
    return out.withColumn("drop_rate", rate("dropped", F.col("relationships"))).withColumn("key_rate", rate("nodes_with_key", F.col("nodes_with_key_definition")))


def roll_up(metrics: DataFrame, by: str, maxima: tuple[str, ...] = ()) -> DataFrame:
    """Runs' metrics combined: counters add up, numbers that describe the draft (maxima) don't, rates follow from the sums."""
    sums = [c for c in metrics.columns if c != by and c not in maxima and not c.endswith("_rate") and dict(metrics.dtypes)[c] in ("bigint", "int")]
    return with_rates(metrics.groupBy(by).agg(*(F.sum(c).alias(c) for c in sums), *(F.max(c).alias(c) for c in maxima)))


def triples_to_graph(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (name, type, props, seq) and edges (relation, head, head_type, tail, tail_type, props, seq) of a model's list of triples.

    triples: seq, head, head_type, head_props, relation, tail, tail_type, tail_props, relation_props, props (maps). Triples with a blank
    head, tail or relation are left out; a blank type is Entity; of a node's properties the last value given counts; an edge without
    relation_props takes props."""
    blank = lambda c: F.coalesce(F.col(c).rlike(r"^\s*$"), F.lit(True))
    kind = lambda c: F.when(blank(c), "Entity").otherwise(F.col(c))
    none = F.create_map().cast("map<string,string>")
    sound = triples.where(~blank("head") & ~blank("tail") & ~blank("relation")).withColumn("head_type", kind("head_type")).withColumn("tail_type", kind("tail_type"))
    ends = [sound.select(F.col(end).alias("name"), F.col(f"{end}_type").alias("type"), F.coalesce(f"{end}_props", none).alias("props"), (F.col("seq") * 2 + k).alias("seq")) for k, end in enumerate(("head", "tail"))]
    both = ends[0].unionByName(ends[1])
    last = both.select("name", "type", "seq", F.explode_outer("props").alias("k", "v")).groupBy("name", "type", "k").agg(F.max_by("v", "seq").alias("v"), F.min("seq").alias("seq"))
    nodes = last.groupBy("name", "type").agg(F.map_from_entries(F.filter(F.collect_list(F.struct("k", "v")), lambda e: e["k"].isNotNull())).alias("props"), F.min("seq").alias("seq"))
    own = F.coalesce("relation_props", none)
    edges = sound.select("relation", "head", "head_type", "tail", "tail_type", F.when(F.size(F.map_keys(own)) > 0, own).otherwise(F.coalesce("props", none)).alias("props"), "seq")
    return nodes, edges


def _properties(rows: DataFrame, keys: list[str], hidden: tuple[str, ...]) -> DataFrame:
    """keys and properties: name and type of each, by name; the type is that of the first value given."""
    from loreweave.functions.text import inferred_type

    each = rows.select(*keys, "seq", F.explode("props").alias("name", "value")).where(~F.lower("name").isin(*hidden) & ~F.col("name").rlike(r"^\s*$"))
    first = each.groupBy(*keys, "name").agg(F.min_by(F.struct(inferred_type(F.coalesce("value", F.lit(""))).alias("type")), "seq").alias("t"))
    return first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("name", F.col("t.type").alias("type")))).alias("properties"))


def schema_from_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The schema that a graph's nodes (name, type, props, seq) and edges (as triples_to_graph) imply: labels with description, keys
    and properties; relationships with type, ends, description and properties.

    The first description that is not blank counts. Keys are those that props name under "key" and the label has, else what the
    properties' names suggest. Ends are labelled by the node of that name that comes last, or Entity.
    """
    from loreweave.functions.text import key_properties, safe_name, sanitised_label, sanitised_relation

    labelled = nodes.withColumn("label", sanitised_label(F.col("type")))
    described = lambda: F.min_by(F.element_at("props", F.lit("description")), F.when(~F.element_at("props", F.lit("description")).rlike(r"^\s*$"), F.col("seq"))).alias("description")
    listed = F.filter(F.transform(F.split(F.element_at("props", F.lit("key")), ","), F.trim), lambda k: (k != "") & safe_name(k))
    given = labelled.select("label", "seq", F.posexplode(listed).alias("at", "key")).groupBy("label", "key").agg(F.min(F.struct("seq", "at")).alias("first"))
    given = given.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "key"))), lambda x: x["key"]).alias("given"))
    own = labelled.groupBy("label").agg(described()).join(_properties(labelled, ["label"], ("description", "key")), "label", "left").join(given, "label", "left")
    none = F.array().cast("array<struct<name:string,type:string>>")
    names = F.transform(F.coalesce("properties", none), lambda p: p["name"])
    declared = F.filter(F.coalesce("given", F.array().cast("array<string>")), lambda k: F.array_contains(names, k))
    labels = own.select("label", "description", F.when(F.size(declared) > 0, declared).otherwise(key_properties(names)).alias("keys"), F.coalesce("properties", none).alias("properties"))
    ends = labelled.groupBy("name").agg(F.max_by("label", "seq").alias("label"))
    side = lambda end: ends.select(F.col("name").alias(end), F.col("label").alias(f"{end}_label"))
    placed = edges.join(side("head"), "head", "left").join(side("tail"), "tail", "left")
    keys = ["relationship", "from_label", "to_label"]
    placed = placed.select(sanitised_relation(F.col("relation")).alias("relationship"), F.coalesce("head_label", F.lit("Entity")).alias("from_label"), F.coalesce("tail_label", F.lit("Entity")).alias("to_label"), "props", "seq")
    kinds = placed.groupBy(*keys).agg(described()).join(_properties(placed, keys, ("description",)), keys, "left")
    return labels, kinds.withColumn("properties", F.coalesce("properties", none))


def reuse(pending: DataFrame, outcomes: DataFrame) -> DataFrame:
    """pending: id, reuse_key, source_sha, current_sha; outcomes: reuse_key, outcome_id, status, seq. Adds state and the outcome reused."""
    newest = outcomes.where("status = 'SUCCEEDED'").groupBy("reuse_key").agg(F.max_by("outcome_id", "seq").alias("outcome_id"))
    state = F.when(F.col("source_sha") != F.col("current_sha"), "STALE_SOURCE").when(F.col("outcome_id").isNotNull(), "REUSED").otherwise("RUN")
    joined = pending.join(newest, "reuse_key", "left").withColumn("state", state)
    return joined.select("id", "state", F.when(F.col("state") == "REUSED", F.col("outcome_id")).alias("outcome_id"))
