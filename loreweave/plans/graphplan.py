"""Typed graph plans: filters, up to two typed hops, projections, aggregation, ordering and limits, as joins of DataFrames.

A plan is validated against a schema on the driver, which lists every violation by its code, and then becomes one lazy
DataFrame: Catalyst pushes the filters into the node scans and prunes their columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_HOPS = 2
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
#: Comparison operators, aggregate functions, and the type names that take a literal kind.
OPERATORS = ("=", "<>", ">", ">=", "<", "<=", "IN", "CONTAINS", "STARTS WITH")
AGGREGATES = ("COUNT", "COUNT_DISTINCT", "SUM", "AVERAGE", "MINIMUM", "MAXIMUM")
STRINGS = ("string", "date", "datetime", "localdatetime", "time")
INTEGERS = ("integer", "long")
FLOATS = ("float", "double", "number")


@dataclass(frozen=True)
class NodeType:
    label: str
    key: tuple[str, ...]
    properties: dict[str, str]


@dataclass(frozen=True)
class RelationshipType:
    kind: str
    start: str
    end: str


@dataclass(frozen=True)
class Schema:
    name: str
    nodes: tuple[NodeType, ...]
    relationships: tuple[RelationshipType, ...]

    def node(self, label: str) -> NodeType | None:
        return next((n for n in self.nodes if n.label == label), None)

    def relationship(self, kind: str) -> RelationshipType | None:
        return next((r for r in self.relationships if r.kind == kind), None)


@dataclass(frozen=True)
class Hop:
    kind: str
    target: str
    incoming: bool = False


@dataclass(frozen=True)
class Compare:
    node: int
    name: str
    operator: str
    value: Any


@dataclass(frozen=True)
class Junction:
    any: bool
    parts: tuple["Compare | Junction", ...]


@dataclass(frozen=True)
class Project:
    """A property of node number `node`; without a name, the whole node as a map; with hop set, a relationship as a map."""

    alias: str
    node: int = 0
    name: str | None = None
    hop: int | None = None


@dataclass(frozen=True)
class Aggregate:
    function: str
    alias: str
    node: int = 0
    name: str | None = None


@dataclass(frozen=True)
class Order:
    alias: str
    descending: bool = False


@dataclass(frozen=True)
class GraphPlan:
    root: str
    hops: tuple[Hop, ...] = ()
    filters: tuple[Compare | Junction, ...] = ()
    projections: tuple[Project, ...] = ()
    aggregation: Aggregate | None = None
    ordering: tuple[Order, ...] = ()
    limit: int = 50


class Graph(Protocol):
    schema: Schema

    def nodes(self, label: str) -> DataFrame: ...

    def relationships(self, kind: str) -> DataFrame: ...


def _takes(kind: str, value: Any) -> bool:
    kind = kind.lower()
    if isinstance(value, list | tuple):
        return bool(value) and all(_takes(kind, v) for v in value)
    if isinstance(value, bool):
        return kind == "boolean"
    if isinstance(value, int):
        return kind in INTEGERS + FLOATS
    if isinstance(value, float):
        return kind in FLOATS
    return isinstance(value, str) and kind in STRINGS


def validate(plan: GraphPlan, schema: Schema | None, most: int = 200) -> list[str]:
    """The codes of all violations, in the order they are met. A bad hop adds no node, so later numbers shift."""
    if schema is None:
        return ["scope.active-schema-unavailable"]
    root = schema.node(plan.root)
    if root is None:
        return ["root-label.unknown"]
    out, path = [], [root]
    if len(plan.hops) > MAX_HOPS:
        out.append("hops.limit-exceeded")
    for hop in plan.hops[:MAX_HOPS]:
        if not all(isinstance(x, str) and IDENTIFIER.fullmatch(x) for x in (hop.kind, hop.target)) or not isinstance(hop.incoming, bool):
            out.append("hop.invalid")
            continue
        rel, target = schema.relationship(hop.kind), schema.node(hop.target)
        if rel is None or target is None:
            out.append("hop.schema-mismatch")
        elif (rel.end, rel.start) != (path[-1].label, hop.target) if hop.incoming else (rel.start, rel.end) != (path[-1].label, hop.target):
            out.append("hop.endpoints-mismatch")
        else:
            path.append(target)

    def property_type(node: int, name: str) -> str | None:
        return path[node].properties.get(name) if 0 <= node < len(path) else None

    def check(part: Compare | Junction) -> None:
        if isinstance(part, Junction):
            if len(part.parts) < 2:
                out.append("filter.junction-invalid")
                return
            for x in part.parts:
                check(x)
            return
        if not isinstance(part, Compare):
            out.append("filter.variant-unsupported")
            return
        kind = property_type(part.node, part.name)
        if kind is None:
            out.append("filter.property-unknown")
        elif part.operator not in OPERATORS:
            out.append("filter.operation-invalid")
        elif not _takes(kind, part.value) or isinstance(part.value, list | tuple) != (part.operator == "IN"):
            out.append("filter.literal-type-mismatch")
        elif part.operator in ("CONTAINS", "STARTS WITH") and kind.lower() not in STRINGS or part.operator in (">", ">=", "<", "<=") and kind.lower() == "boolean":
            out.append("filter.operator-type-mismatch")

    for part in plan.filters:
        check(part)
    if not plan.projections and plan.aggregation is None:
        out.append("projection.required")
    aliases: list[str] = []
    for p in plan.projections:
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", p.alias) or p.alias in aliases:
            out.append("projection.alias-invalid")
        aliases.append(p.alias)
        if p.hop is not None:
            if not 0 <= p.hop < len(path) - 1:
                out.append("projection.hop-index-invalid")
        elif not 0 <= p.node < len(path):
            out.append("projection.node-index-invalid")
        elif p.name is not None and property_type(p.node, p.name) is None:
            out.append("projection.property-unknown")
    if (a := plan.aggregation) is not None:
        if a.function not in AGGREGATES or a.name is None and a.function != "COUNT":
            out.append("aggregation.invalid")
        elif a.name is not None and (kind := property_type(a.node, a.name)) is None:
            out.append("aggregation.property-unknown")
        elif a.name is not None and a.function in ("SUM", "AVERAGE") and kind.lower() not in INTEGERS + FLOATS:
            out.append("aggregation.property-type-mismatch")
        if a.alias in aliases:
            out.append("aggregation.alias-conflict")
        aliases.append(a.alias)
    out += ["ordering.projection-unknown" for o in plan.ordering if o.alias not in aliases]
    if not 1 <= plan.limit <= most:
        out.append("limit.out-of-range")
    return out


def _condition(part: Compare | Junction) -> Column:
    if isinstance(part, Junction):
        return reduce(or_ if part.any else and_, map(_condition, part.parts))
    c, v = F.col(f"n{part.node}.{part.name}"), part.value
    return {
        "=": lambda: c == v, "<>": lambda: c != v, ">": lambda: c > v, ">=": lambda: c >= v, "<": lambda: c < v, "<=": lambda: c <= v,
        "IN": lambda: c.isin(*v), "CONTAINS": lambda: c.contains(v), "STARTS WITH": lambda: c.startswith(v),
    }[part.operator]()


def match(plan: GraphPlan, graph: Graph, keep: Callable[[str, DataFrame], DataFrame] = lambda _, df: df) -> DataFrame:
    """The paths of the plan that pass its filters: structs n0, r0, n1, ...; a relationship occurs once in a path. keep(name, df)
    gives those of an element's nodes or relationships that may be in a path."""

    def whole(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.struct(*df.columns).alias(name))

    out = whole(keep("n0", graph.nodes(plan.root)), "n0")
    for k, hop in enumerate(plan.hops):
        a, b = ("to_id", "from_id") if hop.incoming else ("from_id", "to_id")
        rel, node = whole(keep(f"r{k}", graph.relationships(hop.kind)), f"r{k}"), whole(keep(f"n{k + 1}", graph.nodes(hop.target)), f"n{k + 1}")
        out = out.join(rel, F.col(f"n{k}.id") == F.col(f"r{k}.{a}")).join(node, F.col(f"r{k}.{b}") == F.col(f"n{k + 1}.id"))
        if k and plan.hops[k - 1].kind == hop.kind:
            out = out.where(F.col(f"r{k - 1}.id") != F.col(f"r{k}.id"))
    return out.where(reduce(and_, map(_condition, plan.filters))) if plan.filters else out


def _projection(p: Project) -> Column:
    if p.hop is not None:
        return F.col(f"r{p.hop}").alias(p.alias)
    return F.col(f"n{p.node}" + (f".{p.name}" if p.name else "")).alias(p.alias)


def _aggregate(a: Aggregate) -> Column:
    c = F.col(f"n{a.node}.{a.name}") if a.name else F.lit(1)
    out = {
        "COUNT": lambda: F.count(c), "COUNT_DISTINCT": lambda: F.count_distinct(c), "SUM": lambda: F.coalesce(F.sum(c), F.lit(0)),
        "AVERAGE": lambda: F.avg(c), "MINIMUM": lambda: F.min(c), "MAXIMUM": lambda: F.max(c),
    }[a.function]()
    return out.alias(a.alias)


def ordered(df: DataFrame, ordering: tuple[Order, ...], limit: int) -> DataFrame:
    """Ascending with nulls last, descending with nulls first."""
    keys = [F.desc_nulls_first(o.alias) if o.descending else F.asc_nulls_last(o.alias) for o in ordering]
    return (df.orderBy(*keys) if keys else df).limit(limit)


def run(plan: GraphPlan, graph: Graph, paths: DataFrame | None = None, scan_limit: int | None = None) -> DataFrame:
    """The plan's result. With scan_limit, aggregates see that many paths only, the first by the ids along the path."""
    if problems := validate(plan, graph.schema):
        raise ValueError(", ".join(problems))
    paths = match(plan, graph) if paths is None else paths
    if plan.aggregation is None:
        out = paths.select(*map(_projection, plan.projections))
    else:
        if scan_limit is not None:
            paths = paths.orderBy(*(f"n{k}.id" for k in range(len(plan.hops) + 1))).limit(scan_limit)
        out = paths.groupBy(*map(_projection, plan.projections)).agg(_aggregate(plan.aggregation))
    return ordered(out, plan.ordering, plan.limit)


def supported(paths: DataFrame, plan: GraphPlan, evidence: DataFrame) -> DataFrame:
    """Paths whose nodes and relationships all have evidence. evidence: fact_id, filtered to the scope; one semi join per element."""
    for name in [*(f"n{k}" for k in range(len(plan.hops) + 1)), *(f"r{k}" for k in range(len(plan.hops)))]:
        facts = evidence.where(F.col("element") == name).select("fact_id")
        paths = paths.join(facts, F.col(f"{name}.id").cast("string") == F.col("fact_id"), "left_semi")
    return paths
