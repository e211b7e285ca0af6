"""Evidence along paths: both ends asserted, scopes, ranges, shared facts, and rounds of plans."""

from __future__ import annotations

from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from loreweave.plans import rounds, support
from loreweave.plans.graphplan import Aggregate, Compare, GraphPlan, Hop, NodeType, Order, Project, RelationshipType, Schema

SCHEMA = Schema("s", (NodeType("A", ("id",), {"name": "string"}), NodeType("B", ("id",), {"name": "string", "gone": "string"})), (RelationshipType("R", "A", "B"),))


@dataclass
class Tiny:
    spark: object
    schema: Schema = SCHEMA

    def nodes(self, label):
        rows = [(1, "a1"), (2, "a2")] if label == "A" else [(1, "b1"), (2, "b2"), (3, None)]
        return self.spark.createDataFrame(rows, "id long, name string")

    def relationships(self, kind):
        return self.spark.createDataFrame([("R:1:1", 1, 1), ("R:1:2", 1, 2), ("R:2:2", 2, 2), ("R:2:3", 2, 3)], "id string, from_id long, to_id long")


CHUNKS = [("c1", "d1", 0, 5, "kb", "PARENT", "r"), ("c2", "d1", 5, 2, "kb", "PARENT", "r"), ("c3", "d2", None, None, "kb", "PARENT", "r"), ("c4", "d2", 0, 1, "kb", "CHILD", "r"), ("c5", "d2", 0, 1, "other", "PARENT", "r"), ("c6", "d2", 0, None, "kb", "PARENT", "r")]
NODES = [("A:1", "c1"), ("A:2", "c1"), ("B:1", "c1"), ("B:1", "c3"), ("B:2", "c3"), ("B:3", "c4")]


@pytest.fixture(scope="module")
def found(spark):
    chunks = spark.createDataFrame([(*c, None, None, "v", None) for c in CHUNKS], "chunk_id string, document_id string, source_start int, source_end int, kb string, kind string, run string, page_start int, page_end int, revision string, path string")
    docs = {c[0]: c[1] for c in CHUNKS}
    rows = [(f"n{k}", "NODE", f, f, None, None, c) for k, (f, c) in enumerate(NODES)]
    rows += [("x1", "NODE", "A:1", "A:9", None, None, "c3")]  # asserts another node
    rels = [("r1", "R:1:1", "A:1", "B:1", "c1"), ("r0", "R:1:1", "A:1", "B:1", "c1"), ("r2", "R:1:1", "A:1", "B:1", "c2"), ("r3", "R:1:2", "A:1", "B:9", "c1"), ("r4", "R:2:2", "A:2", "B:2", "c3"), ("r5", "R:2:2", "A:2", "B:2", "c6"), ("r6", "R:2:3", "A:2", "B:3", "c5")]
    rows += [(e, "RELATIONSHIP", f, None, a, b, c) for e, f, a, b, c in rels]
    evidence = spark.createDataFrame([(*r, docs[r[6]], "kb", "s", "r") for r in rows], "evidence_id string, kind string, fact_id string, node_id string, from_id string, to_id string, chunk_id string, document_id string, kb string, schema_id string, run string")
    other = evidence.limit(1).withColumn("kb", F.lit("kb2")).withColumn("fact_id", F.lit("B:3"))
    return support.supports(evidence.unionByName(other), chunks, "kb", "s")


PLAN = GraphPlan("A", (Hop("R", "B"),), (), (Project("a", 0, "name"), Project("b", 1, "name")), None, (Order("a", True),), 10)


def test_paths_need_every_support(spark, found):
    rows = support.run_with_facts(PLAN, Tiny(spark), found).collect()
    assert [(r["values"].a, r["values"].b) for r in rows] == [("a2", "b2"), ("a1", "b1")]
    facts = {f.fact_id: f for f in rows[1].facts}
    assert [f.fact_id for f in rows[1].facts] == ["A:1", "B:1", "R:1:1"]
    assert facts["R:1:1"].evidence_ids == ["r0", "r1"]  # r2's range is impossible
    assert [c.chunk_id for c in facts["R:1:1"].citations] == ["c1"] and [c.chunk_id for c in facts["B:1"].citations] == ["c1", "c3"]
    assert facts["A:1"].evidence_ids == ["n0"] and facts["A:1"].properties == {"name": "a1"}
    assert (facts["R:1:1"].from_label, facts["R:1:1"].to_label, facts["R:1:1"].type) == ("A", "B", "R")
    assert {f.fact_id: f.evidence_ids for f in rows[0].facts}["R:2:2"] == ["r4"]  # r5 has one bound only


def test_supports_cut_elements_before_they_meet(spark, found):
    plan = GraphPlan("B", (Hop("R", "A", incoming=True),), (), PLAN.projections, None, (), 10)
    for p in (PLAN, plan):
        ids = lambda df: sorted((r.n0.id, r.r0.id, r.n1.id) for r in df.collect())
        cut = support.supported_match(p, Tiny(spark), found)
        assert ids(cut) == ids(support.supported_paths(support.match(p, Tiny(spark)), p, found)) and len(ids(cut)) == 2
        text = cut._jdf.queryExecution().optimizedPlan().toString()
        assert "Inner" not in text[text.rindex("LeftSemi") :]  # under the last semi join there is no other join


def test_plans_of_one_pattern_share_their_paths(spark, found, monkeypatch):
    made, match = [], support.supported_match
    monkeypatch.setattr(rounds, "supported_match", lambda *x: made.append(x) or match(*x))
    monkeypatch.setattr(support, "supported_match", lambda *_: pytest.fail("paths are made again"))
    groups = GraphPlan("A", (Hop("R", "B"),), (), (), Aggregate("COUNT", "n"), (), 5)
    own = rounds.round_of(spark, [PLAN, groups], Tiny(spark), found)
    assert [r.plan_no for r in own.ranked().collect()] == [1, 1, 2] and len(made) == 1


def test_incoming_hops_swap_the_ends(spark, found):
    plan = GraphPlan("B", (Hop("R", "A", incoming=True),), (), (Project("a", 1, "name"), Project("b", 0, "name")), None, (Order("a"),), 10)
    rows = support.run_with_facts(plan, Tiny(spark), found).collect()
    assert [(r["values"].a, r["values"].b) for r in rows] == [("a1", "b1"), ("a2", "b2")]
    assert {(f.from_label, f.to_label) for r in rows for f in r.facts if f.kind == "RELATIONSHIP"} == {("A", "B")}


def test_groups_collect_the_facts_of_their_paths(spark, found):
    plan = GraphPlan("A", (Hop("R", "B"),), (), (), Aggregate("COUNT", "n"), (), 5)
    (row,) = support.run_with_facts(plan, Tiny(spark), found).collect()
    assert row["values"].n == 2 and [f.fact_id for f in row.facts] == ["A:1", "B:1", "R:1:1", "A:2", "B:2", "R:2:2"]
    (row,) = support.run_with_facts(plan, Tiny(spark), found, scan_limit=1).collect()
    assert row["values"].n == 1 and [f.fact_id for f in row.facts] == ["A:1", "B:1", "R:1:1"]


def test_rows_without_facts_go(spark, found):
    """The path is matched by evidence that cannot be cited, so nothing is left of its row."""
    blank = found.withColumn("run", F.lit(" "))
    assert support.supported_paths(rounds_paths(spark), PLAN, blank).count() == 2
    assert support.run_with_facts(PLAN, Tiny(spark), blank).count() == 0


def rounds_paths(spark):
    from loreweave.plans.graphplan import match

    return match(PLAN, Tiny(spark))


@pytest.mark.parametrize(
    ("expired", "plans", "status", "category"),
    [
        ((), "good bad", "COMPLETED", "filter.property-unknown"), ((2,), "bad good", "DEADLINE_EXCEEDED", "filter.property-unknown"),
        ((), "bad bad", "FAILED", "filter.property-unknown"), ((1,), "good", "DEADLINE_EXCEEDED", "deadline.expired"), ((), "broken good", "COMPLETED", "AnalysisException"),
    ],
)
def test_rounds(spark, found, expired, plans, status, category):
    known = {
        "good": PLAN, "bad": GraphPlan("A", (), (Compare(0, "nothing", "=", 1),), (Project("a", 0, "name"),)),
        "broken": GraphPlan("B", (), (), (Project("x", 0, "gone"),)),
    }
    own = rounds.round_of(spark, [known[p] for p in plans.split()], Tiny(spark), found, expired=lambda k: k in expired)
    got = own.status().first()
    assert (got.status, got.category) == (status, category)
    if "good" in plans and not expired:
        assert got.rows == 2 and own.ranked().count() == 2
        assert own.citations().where("rank = 2").count() == 4
    else:
        assert got.rows == 0 and own.citations() is None


def test_no_plans(spark, found):
    own = rounds.round_of(spark, [], Tiny(spark), found)
    assert own.rows is None and own.status().count() == 0


@dataclass
class Many(Tiny):
    """One node A that is related to 250 nodes B, whose names are x or none."""

    def nodes(self, label):
        rows = self.spark.range(1, 2 if label == "A" else 251)
        return rows.select("id", F.when(F.col("id") % 5 > 0, "x").alias("name"))

    def relationships(self, kind):
        return self.spark.range(1, 251).select(F.format_string("R:1:%d", "id").alias("id"), F.lit(1).cast("long").alias("from_id"), F.col("id").alias("to_id"))


@pytest.fixture(scope="module")
def many(spark):
    chunks = spark.createDataFrame([("c1", "d1", 0, 5, "kb", "PARENT", "r", None, None, "v", None)], "chunk_id string, document_id string, source_start int, source_end int, kb string, kind string, run string, page_start int, page_end int, revision string, path string")
    rows = [("A:1", None, None)] + [(f"B:{k}", None, None) for k in range(1, 251)] + [(f"R:1:{k}", "A:1", f"B:{k}") for k in range(1, 251)]
    rows = [(f"e{k}", "RELATIONSHIP" if a else "NODE", f, None if a else f, a, b, "c1", "d1", "kb", "s", "r") for k, (f, a, b) in enumerate(rows)]
    return support.supports(spark.createDataFrame(rows, "evidence_id string, kind string, fact_id string, node_id string, from_id string, to_id string, chunk_id string, document_id string, kb string, schema_id string, run string"), chunks, "kb", "s")


GROUPS = GraphPlan("A", (Hop("R", "B"),), (), (Project("b", 1, "name"),), Aggregate("COUNT", "n"), (Order("n", True),), 5)


def test_aggregates_see_all_paths(spark, many):
    """More paths than any cut of a scan: all are counted, and all their facts are there; a group may have no name."""
    rows = support.run_with_facts(GROUPS, Many(spark), many).collect()
    assert [(r["values"].b, r["values"].n, len(r.facts)) for r in rows] == [("x", 200, 401), (None, 50, 101)]
    first = sorted({k for k in range(1, 251) if k % 5})
    assert [f.fact_id for f in rows[0].facts] == ["A:1", "B:1", "R:1:1", *(x for k in first[1:] for x in (f"B:{k}", f"R:1:{k}"))]
    assert all(f.evidence_ids and f.citations for r in rows for f in r.facts)
    (row,) = support.run_with_facts(GROUPS, Many(spark), many, scan_limit=4).collect()
    assert (row["values"].b, row["values"].n, len(row.facts)) == ("x", 4, 9)


def test_rounds_see_all_paths(spark, many):
    own = rounds.round_of(spark, [GROUPS, PLAN], Many(spark), many)
    assert [(r.plan_no, r.row) for r in own.ranked().orderBy("rank").collect()] == [(1, 1), (1, 2), *((2, k) for k in range(1, 11))]
    assert {(r.plan_no, r.row): r["count"] for r in own.facts.groupBy("plan_no", "row").count().collect()} == {(1, 1): 401, (1, 2): 101} | {(2, k): 3 for k in range(1, 11)}
    cited = own.citations().where("rank = 1").orderBy("place").collect()
    assert [r.place.k for r in cited] == list(range(401)) and [r.fact_id for r in cited[:3]] == ["A:1", "B:1", "R:1:1"]


@pytest.mark.parametrize("most", [1, 7, 1 << 14])
def test_facts_are_joined_in_parts(spark, many, most):
    from loreweave.queries.support import joined

    _, facts = support.rows_and_facts(GROUPS, Many(spark), many)
    got = {r.row: r.facts.split(";") for r in joined(facts, most).collect()}
    assert [len(got[k]) for k in (1, 2)] == [401, 101] and got[1][:3] == ["A:1=e0@c1", "B:1=e1@c1", "R:1:1=e251@c1"]
    assert [int(x.split("=")[0].split(":")[-1]) for x in got[1][1:]] == [k for k in range(1, 251) if k % 5 for _ in "BR"]
