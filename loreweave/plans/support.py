"""Graph plans with their evidence: which chunks support every node and relationship of a path, and the facts of each result row.

A path counts only if each of its elements has a support: evidence of the fact, within base and schema, from a parent chunk of
the same base, document and run, that asserts the node, or both ends of the relationship as they stand in the path. That is one
semi join per element with the supports of its label, of the nodes and relationships before they meet in paths. Lists are fetched
late: rows are ordered and cut to the plan's `limit` first. An aggregate sees all paths (unless it is given a `scan_limit`), and a
group has the facts of all its paths; these are rows of a table of their own (rows_and_facts), which run_with_facts puts into lists.

Paths are ordered by the plan's ordering and then by the ids along them, so results repeat. Per row a fact (told by kind and id)
comes once, at its first place, with its distinct evidence ids and the first citation of each chunk (both in order of evidence ids). Supports with a
blank id or an impossible range are left out of the lists, then facts without supports, then rows without facts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loreweave.operators.ranking import has_text
from loreweave.plans.graphplan import Graph, GraphPlan, _aggregate, _projection, match, validate
from loreweave.sources.shared import written

CITATION = ("chunk_id", "document_id", "source_start", "source_end", "page_start", "page_end", "run", "revision", "path")
FACT = ("fact_id", "kind", "type", "from_label", "to_label", "properties", "evidence_ids", "citations")


def fact_id(label: str, node: str) -> Column:
    """The id that evidence names a node by: its label and its key."""
    return F.concat_ws(":", F.lit(label), F.col(f"{node}.id").cast("string"))


def supports(evidence: DataFrame, chunks: DataFrame, kb: str, schema_id: str) -> DataFrame:
    """Evidence that its chunk bears out: kind, fact_id, from_id, to_id, evidence_id and the citation's columns.

    evidence: evidence_id, kind (NODE, RELATIONSHIP), fact_id, node_id, from_id, to_id, kb, schema_id, chunk_id, document_id, run;
    chunks: chunk_id, kb, document_id, kind, run, source_start, source_end, page_start, page_end, revision, path. Written out, since
    every element of every path asks for it.
    """
    own = evidence.where((F.col("kb") == kb) & (F.col("schema_id") == schema_id) & ((F.col("kind") == "RELATIONSHIP") | (F.col("node_id") == F.col("fact_id"))))
    own = own.select("evidence_id", "kind", "fact_id", "from_id", "to_id", "chunk_id", "document_id", "run")
    parents = chunks.where((F.col("kind") == "PARENT") & (F.col("kb") == kb)).select("chunk_id", "document_id", "run", "source_start", "source_end", "page_start", "page_end", "revision", "path")
    return written(own.join(parents, ["chunk_id", "document_id", "run"]), "supports")


def in_range(start: Column, end: Column) -> Column:
    """Neither bound is given, or both are, in order and not negative."""
    return (start.isNull() & end.isNull()) | F.coalesce((start >= 0) & (end >= start), F.lit(False))


def valid_supports(rows: DataFrame) -> DataFrame:
    """Supports that can be cited."""
    named = reduce(lambda a, b: a & b, (has_text(F.col(c)) for c in ("evidence_id", "chunk_id", "document_id", "run")))
    return rows.where(named & in_range(F.col("source_start"), F.col("source_end")) & in_range(F.col("page_start"), F.col("page_end")))


def _labels(plan: GraphPlan) -> list[str]:
    return [plan.root, *(h.target for h in plan.hops)]


def _ends(plan: GraphPlan, k: int) -> tuple[int, int]:
    """The nodes that relationship k goes from and to."""
    return (k + 1, k) if plan.hops[k].incoming else (k, k + 1)


def supported_paths(paths: DataFrame, plan: GraphPlan, found: DataFrame) -> DataFrame:
    """Paths whose elements all have a support in found (as supports gives it)."""
    labels = _labels(plan)
    nodes, rels = found.where("kind = 'NODE'").select("fact_id"), found.where("kind = 'RELATIONSHIP'").select("fact_id", "from_id", "to_id")
    for k, label in enumerate(labels):
        paths = paths.join(nodes, fact_id(label, f"n{k}") == F.col("fact_id"), "left_semi")
    for k in range(len(plan.hops)):
        a, b = _ends(plan, k)
        same = (F.col(f"r{k}.id") == F.col("fact_id")) & (fact_id(labels[a], f"n{a}") == F.col("from_id")) & (fact_id(labels[b], f"n{b}") == F.col("to_id"))
        paths = paths.join(rels, same, "left_semi")
    return paths


def _with_support(df: DataFrame, own: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The rows of df whose keys stand in own. A hash is the first key, since ids of one label begin alike and are slow to sort by."""
    own = own.select(F.xxhash64(*keys).alias("_hash"), *(F.col(c).alias(f"_{c}") for c in keys))
    same = reduce(lambda a, b: a & b, (c == F.col(f"_{name}") for name, c in keys.items()))
    return df.join(own, (F.xxhash64(*(c.cast("string") for c in keys.values())) == F.col("_hash")) & same, "left_semi")


def supported_match(plan: GraphPlan, graph: Graph, found: DataFrame) -> DataFrame:
    """The plan's paths whose elements all have a support: match whose nodes and relationships are cut to supported ones first."""
    labels = _labels(plan)
    types = {label: dict(graph.nodes(label).dtypes)["id"] for label in labels}
    named = lambda label, id_: F.concat_ws(":", F.lit(label), id_.cast("string"))

    def keep(name: str, df: DataFrame) -> DataFrame:
        k = int(name[1:])
        if name[0] == "n":
            own = found.where((F.col("kind") == "NODE") & F.col("fact_id").startswith(labels[k])).select("fact_id")
            return _with_support(df, own, {"fact_id": named(labels[k], df["id"])})
        a, b = (labels[x] for x in _ends(plan, k))
        own = found.where((F.col("kind") == "RELATIONSHIP") & F.col("from_id").startswith(a) & F.col("to_id").startswith(b)).select("fact_id", "from_id", "to_id")
        return _with_support(df, own, {"fact_id": df["id"], "from_id": named(a, df["from_id"].cast(types[a])), "to_id": named(b, df["to_id"].cast(types[b]))})

    return match(plan, graph, keep)


def _elements(plan: GraphPlan, paths: DataFrame, shown: bool = True) -> Column:
    """The facts of a path: nodes first, then relationships; properties only if they are shown."""
    labels, none = _labels(plan), F.lit(None).cast("string")
    kinds = dict(paths.dtypes)

    def properties(name: str) -> Column:
        if not shown:
            return F.lit(None).cast("map<string,string>")
        fields = paths.schema[name].dataType.fieldNames()
        return F.map_filter(F.create_map(*(x for f in fields if f != "id" for x in (F.lit(f), F.col(f"{name}.{f}").cast("string")))), lambda _, v: v.isNotNull())

    def element(place: int, kind: str, fact: Column, schema_type: str, ends: tuple[Column, Column], of: tuple[str | None, str | None], name: str) -> Column:
        return F.struct(F.lit(place).alias("place"), F.lit(kind).alias("kind"), fact.alias("fact_id"), F.lit(schema_type).alias("type"), F.lit(of[0]).cast("string").alias("from_label"), F.lit(of[1]).cast("string").alias("to_label"), ends[0].alias("from_id"), ends[1].alias("to_id"), properties(name).alias("properties"))

    assert all(f"n{k}" in kinds for k in range(len(labels)))
    out = [element(k, "NODE", fact_id(label, f"n{k}"), label, (none, none), (None, None), f"n{k}") for k, label in enumerate(labels)]
    for k, hop in enumerate(plan.hops):
        a, b = _ends(plan, k)
        out.append(element(len(labels) + k, "RELATIONSHIP", F.col(f"r{k}.id"), hop.kind, (fact_id(labels[a], f"n{a}"), fact_id(labels[b], f"n{b}")), (labels[a], labels[b]), f"r{k}"))
    return F.array(*out)


def merged_facts(elements: DataFrame, found: DataFrame, cited: tuple[str, ...] = CITATION) -> DataFrame:
    """row, spot (where it comes first) and FACT, a row for each fact of a row, of elements (row, path, place, kind, fact_id, type,
    ends, properties) and the valid supports among found, whose columns `cited` (chunk_id first) make a citation."""
    about = ("type", "from_label", "to_label", "properties")
    earliest = lambda: (F.min("spot").alias("spot"), *(F.min_by(c, "spot").alias(c) for c in about))
    e = elements.withColumn("spot", F.struct("path", "place")).groupBy("row", "kind", "fact_id", "from_id", "to_id").agg(*earliest()).alias("e")
    s = valid_supports(found).alias("s")
    same = (F.col("e.kind") == F.col("s.kind")) & (F.col("e.fact_id") == F.col("s.fact_id"))
    ends = (F.col("e.kind") == "NODE") | ((F.col("e.from_id") == F.col("s.from_id")) & (F.col("e.to_id") == F.col("s.to_id")))
    citation = F.struct(*(F.col(f"s.{c}").alias(c) for c in cited)).alias("citation")
    rows = e.join(s, same & ends).select("e.row", "e.kind", "e.fact_id", "e.spot", *(f"e.{c}" for c in about), F.col("s.evidence_id").alias("evidence_id"), citation)
    by_chunk = rows.groupBy("row", "kind", "fact_id", F.col("citation.chunk_id").alias("chunk")).agg(*earliest(), F.min_by(F.struct("evidence_id", "citation"), "evidence_id").alias("c"), F.collect_set("evidence_id").alias("ids"))
    ids, citations = F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), F.transform(F.array_sort(F.collect_list("c")), lambda c: c["citation"])
    return by_chunk.groupBy("row", "kind", "fact_id").agg(*earliest(), ids.alias("evidence_ids"), citations.alias("citations")).select("row", "spot", *FACT)


def _sort_keys(plan: GraphPlan, ids: list[str]) -> list[Column]:
    keys = [F.desc_nulls_first(f"v.{o.alias}") if o.descending else F.asc_nulls_last(f"v.{o.alias}") for o in plan.ordering]
    return [*keys, *map(F.col, ids)]


def rows_and_facts(plan: GraphPlan, graph: Graph, found: DataFrame, scan_limit: int | None = None, paths: DataFrame | None = None, show: tuple[str, ...] = FACT, cited: tuple[str, ...] = CITATION) -> tuple[DataFrame, DataFrame]:
    """Two tables. The plan's rows over supported paths (paths, if they are known and written): row (1, 2, ...), values (a struct of
    the projections and the aggregate). Their facts, a row each: row, no (1, 2, ... within the row), show."""
    if problems := validate(plan, graph.schema):
        raise ValueError(", ".join(problems))
    known = paths is not None
    paths = paths if known else supported_match(plan, graph, found)
    along = [f"n{k}.id" for k in range(len(plan.hops) + 1)] + [f"r{k}.id" for k in range(len(plan.hops))]
    path = F.struct(*(F.col(c).alias(f"id{k}") for k, c in enumerate(along)))
    number = lambda *keys: F.row_number().over(Window.orderBy(*keys))  # noqa: E731  of rows that are cut to a limit already
    if plan.aggregation is None:
        rows = paths.withColumn("v", F.struct(*map(_projection, plan.projections)))
        cut = rows.orderBy(*_sort_keys(plan, along)).limit(plan.limit).withColumn("row", number(*_sort_keys(plan, along)))
        cut = written(cut, "cut").withColumn("path", path)  # a few rows that stand for all paths: both their values and their facts ask for them
        own = cut
    else:
        if scan_limit is not None:
            paths, known = paths.orderBy(*along).limit(scan_limit), False
        keys = F.struct(*map(_projection, plan.projections)) if plan.projections else F.lit(True)
        scanned = (paths if known else written(paths, "scanned")).withColumn("path", path).withColumn("key", keys)
        grouped = scanned.groupBy("key").agg(_aggregate(plan.aggregation).alias("value"), F.min("path").alias("least"))
        shown = [F.col(f"key.{p.alias}").alias(p.alias) for p in plan.projections]
        grouped = grouped.withColumn("v", F.struct(*shown, F.col("value").alias(plan.aggregation.alias)))
        cut = written(grouped.orderBy(*_sort_keys(plan, ["least"])).limit(plan.limit).withColumn("row", number(*_sort_keys(plan, ["least"]))), "cut")
        own = scanned.join(F.broadcast(cut.select("row", "key")), "key")  # as many rows as the plan's limit
    elements = own.select("row", "path", F.explode(_elements(plan, own, "properties" in show)).alias("x")).select("row", "path", "x.*")
    facts = merged_facts(elements, found, cited).withColumn("no", F.row_number().over(Window.partitionBy("row").orderBy("spot")))
    return cut.select("row", F.col("v").alias("values")), facts.select("row", "no", *show)


def run_with_facts(plan: GraphPlan, graph: Graph, found: DataFrame, scan_limit: int | None = None, paths: DataFrame | None = None) -> DataFrame:
    """The plan's rows in order, each with all its facts as a list: row, values, facts."""
    values, facts = rows_and_facts(plan, graph, found, scan_limit, paths)
    ordered = F.array_sort(F.collect_list(F.struct("no", *FACT)), lambda a, b: F.when(a["no"] < b["no"], -1).otherwise(1))
    lists = facts.groupBy("row").agg(F.transform(ordered, lambda f: F.struct(*(f[c].alias(c) for c in FACT))).alias("facts"))
    return values.join(lists, "row").orderBy("row")
