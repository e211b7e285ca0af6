"""Carried resolutions, canonical JSON, and parent expansion where requests share chunks."""

from __future__ import annotations

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from loreweave.functions import canonical
from loreweave.operators import discovery, drafts, ranking
from loreweave.operators.splitting import Limits, Section, parents, split

KIND = "conflict_id string, draft_id string, revision int, type string, coordinate string, alternatives array<string>, resolved boolean, selected string, custom string, resolved_at timestamp, created_at timestamp, semantic_key string"
AT = dt.datetime(2026, 1, 1)


def conflict(i, revision, resolved=False, selected=None, custom=None, alternatives=('"a"', '"b"'), draft="d", minutes=0, key=None, coordinate="c"):
    at = AT + dt.timedelta(minutes=minutes)
    return (i, draft, revision, "T", coordinate, list(alternatives), resolved, selected, custom, at if resolved else None, AT, key)


def carried(spark, rows):
    return {r.conflict_id: r for r in drafts.carried(spark.createDataFrame(rows, KIND)).collect()}


def test_the_latest_revision_counts(spark):
    got = carried(spark, [
        conflict("1", 1, True, "a", minutes=90), conflict("2", 2, True, "b", minutes=1), conflict("3", 3), conflict("4", 4, alternatives=(' "b"', '"\\u0061"')),
        conflict("5", 5, True, "a"), conflict("6", 6), conflict("o", 6, draft="other"), conflict("n", 6, coordinate=None), conflict("z", 0),
    ])
    assert {i: (r.selected, r.carried) for i, r in got.items()} == {
        "1": ("a", False), "2": ("b", False), "3": ("b", True), "4": ("b", True), "5": ("a", False), "6": ("a", True), "o": (None, False), "n": (None, False), "z": (None, False),
    }
    assert got["3"].semantic_key == got["4"].semantic_key != got["n"].semantic_key


def test_ties_inside_a_revision(spark):
    got = carried(spark, [conflict("x", 1, True, "a", minutes=1), conflict("y", 1, True, "b", minutes=2), conflict("w", 1, True, "a", minutes=2), conflict("q", 2)])
    assert got["q"].selected == "a"  # of the two resolved last, the smaller id


@pytest.mark.parametrize(
    ("selected", "custom", "expected"),
    [("gone", None, None), (None, '{"k":  1}', '{"k":1}'), (None, "{}", None), (None, '" "', None), (None, "null", None), (None, "no json", None), ("a", '{"k":1}', None), (None, "7", "7"), (None, '"x"', '"x"')],
)
def test_what_does_not_hold_is_not_carried(spark, selected, custom, expected):
    got = carried(spark, [conflict("1", 1, True, "b"), conflict("2", 2, True, selected, custom), conflict("3", 3)])
    assert (got["3"].custom, got["3"].resolved, got["3"].selected) == (expected, expected is not None, None)


def test_stored_keys_are_kept(spark):
    got = carried(spark, [conflict("1", 1, True, "a", key="k"), conflict("2", 2, key="k", alternatives=('"a"', '"z"')), conflict("3", 2, key=" ")])
    assert got["2"].carried and not got["3"].carried


def test_no_conflicts(spark):
    assert carried(spark, []) == {}


def test_canonical_json(spark):
    texts = ['{"b":{"z":[1,{"y":null,"x":"\\u00e9"}],"Z":1},"a":1.50}', ' {"a" : 1.5, "b": {"Z":1, "z":[1.0,{"x":"é","y":null}]} }', None, "  ", "oops", '{"a":1,"a":2}', "[]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(canonical.canonical(F.col("t")).alias("c"), canonical.fingerprint(canonical.canonical(F.col("t"))).alias("f"))
    got = df.collect()
    assert [r.c for r in got] == ['{"a":1.5,"b":{"Z":1,"z":[1,{"x":"é","y":null}]}}'] * 2 + ["{}", "{}", None, None, "[]"]
    assert got[0].f == got[1].f != got[2].f and got[4].f is None


def test_variants_by_keys(spark):
    rows = [("NODE_KEY", "A", None, ["id"], "s1", "c1", 1, "OBSERVED", 0.5), ("NODE_KEY", "A", None, ["code"], "s2", "c1", 1, "OBSERVED", 0.9), ("NODE_KEY", "A", None, ["id"], "s1", "c1", 1, "GUIDED", 0.7)]
    df = spark.createDataFrame(rows, "kind string, identity string, type string, keys array<string>, source string, chunk string, document long, origin string, confidence double")
    assert {(r["keys"][0], r.confidence, r.support) for r in discovery.merge_candidates(df).collect()} == {("id", 0.7, 1), ("code", 0.9, 1)}
    assert {(r["keys"][0], tuple(r.origins)) for r in discovery.united_evidence(df).collect()} == {("id", ("GUIDED", "OBSERVED")), ("code", ("OBSERVED",))}


def test_requests_that_share_a_chunk(spark):
    """One chunk, three candidates of two requests, each with one outcome of its own."""
    kind = "id long, document_id long, kind string, parent_id long, kb string, run string, revision string, section int, path string, chunk_index int, text string"
    chunks = spark.createDataFrame([(1, 1, "PARENT", None, "kb", "r1", "v", 0, None, 0, "parent"), (11, 1, "CHILD", 1, "kb", "r1", "v", 0, None, 1, "child")], kind)
    edges = spark.createDataFrame([(1, 11)], "parent long, child long")
    asked = [(1, 1, 11, 1, "kb", "r1", "v", "TEXT_CHILD"), (1, 2, 11, 2, "kb", "r1", "v", "TEXT_CHILD"), (2, 1, 11, 1, "kb", "r2", "v", "TEXT_CHILD"), (2, 2, 11, 1, "kb", "r1", "v", "GRAPH_PARENT"), (2, 3, 12, 1, "kb", "r1", None, "TEXT_CHILD")]
    rows = spark.createDataFrame(asked, "request int, fused_rank int, chunk_id long, document_id long, kb string, run string, revision string, citation_kind string")
    got = {(r.request, r.fused_rank): (r.lookup, r.outcome, r.context) for r in ranking.expanded(rows, chunks, edges).collect()}
    assert got == {
        (1, 1): ("VALID_PARENT", "INCLUDED", "parent"), (1, 2): ("CHILD_SCOPE", "CHILD_SCOPE", None), (2, 1): ("CHILD_RUN", "CHILD_RUN", None),
        (2, 2): (None, None, None), (2, 3): ("CHILD_NOT_FOUND", "CHILD_NOT_FOUND", None),
    }
    capped = {(r.request, r.fused_rank): r.lookup for r in ranking.expanded(rows, chunks, edges, evidence=1).collect()}
    assert capped[(1, 2)] is None and capped[(1, 1)] == "VALID_PARENT"


def test_parents_of_a_long_section_take_time_in_proportion():
    def took(words):
        section = Section("word and more. " * words)
        chunks = split(section, limits)
        start = time.perf_counter()
        assert parents(chunks, limits)
        return time.perf_counter() - start

    limits = Limits()
    took(500)
    assert took(16_000) < 12 * max(took(4_000), 0.002)


def test_alike_conflicts_are_named_once(spark):
    fields = "conflict_id string, draft_id string, revision int, type string, coordinate string, alternatives array<string>, resolved boolean, selected string, custom string, resolved_at timestamp, created_at timestamp"
    rows = [("c1", "d", 1, "t", None, ['"a"', None], True, "a", None, None, None), ("c2", "d", 2, "t", None, ['"a"', None], False, None, None, None, None), ("c3", "d", 2, "t", "x", None, False, None, None, None, None)]
    out = drafts.carried(spark.createDataFrame(rows, fields))
    assert "Aggregate [type" in out._jdf.queryExecution().optimizedPlan().toString()
    found = {r.conflict_id: r for r in out.collect()}
    assert set(found) == {"c1", "c2", "c3"} and [found[c].carried for c in ("c1", "c2", "c3")] == [False, True, False]
    assert found["c1"].semantic_key == found["c2"].semantic_key != found["c3"].semantic_key
