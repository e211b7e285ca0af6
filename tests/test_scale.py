"""What must not grow with the tables: sorts and shuffles that a plan does without, and memory of a batch."""

from __future__ import annotations

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from loreweave.operators import chunking, drafts, graph, postings, vector_index
from loreweave.operators.splitting import Limits
from loreweave.sources import structure


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parsed_chunks_as_in_two_steps(spark):
    """no shuffle and no group; odd documents as before."""
    page = lambda *texts: '<div class="page">' + "".join(f"<p>{t}</p>" for t in texts) + "</div>"
    rows = [(1, f"<html><body>{page('red fox ' * 30, 'a b')}{page('x y z')}</body></html>"), (2, None), (3, "<p>no end"), (4, f"<html>{page()}</html>"), (5, f"<html>{page('é' * 300)}</html>")]
    docs, limits = spark.createDataFrame(rows, "doc_id long, xhtml string"), Limits(tokens=90, overlap=20, characters=90)
    got = chunking.parsed_chunks(docs, "PDF", limits)
    want = chunking.section_chunks(structure.sections(docs, "PDF").where("error is null"), limits)
    assert got.count() > 5 and got.schema == want.schema and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "Exchange" not in plan(got) and "FlatMapGroups" not in plan(got)


def test_postings_without_a_shuffle(spark):
    """a chunk's postings are made where it is."""
    texts = {1: "b a b", 2: None, 3: "", 4: "a " * 300 + "c", 5: "c"}
    rows = postings._postings(postings._placed(spark.createDataFrame(list(texts.items()), "chunk_id long, text string"), None))
    assert "Exchange" not in plan(rows) and "Aggregate" not in plan(rows)
    want = {(i, t): [k for k, x in enumerate((text or "").split()) if x == t] for i, text in texts.items() for t in (text or "").split()}
    assert {(r.chunk_id, r.term): r.positions for r in rows.collect()} == want and rows.count() == len(want)


def test_relationships_by_their_ends(spark):
    """without an id to shuffle, the ends are the key; the first writer's sequence stays."""
    ends = spark.createDataFrame([(1,), (2,)], "id long")
    new = spark.createDataFrame([(1, 2, 5), (1, 2, 3), (2, 9, 1), (2, 1, 4)], "from_id long, to_id long, write_seq long")
    old = spark.createDataFrame([(2, 1, 2), (7, 7, 7)], "from_id long, to_id long, write_seq long")
    out = graph.upsert_relationships(old, new, ends, ends, ("from_id", "to_id"))
    assert sorted(map(tuple, out.collect())) == [(1, 2, 3), (2, 1, 2), (7, 7, 7)]
    assert "SortAggregate" not in plan(out)


def test_provenance_from_columns(spark):
    """evidence is not sorted, maps are made after the join."""
    evidence = spark.createDataFrame([(1, 10, "x"), (2, 11, "y"), (3, 12, None), (4, None, "z")], "evidence_id long, chunk_id long, flag string")
    chunks = spark.createDataFrame([(10, "p"), (12, None)], "chunk_id long, number string")
    out = graph.with_provenance(evidence, chunks, F.create_map(F.lit("page"), F.lit("own"), F.lit("flag"), F.col("flag")), F.create_map(F.lit("page"), F.col("number")))
    assert "SortMergeJoin" not in plan(out)
    assert {r.evidence_id: (r.props["page"], r.props["flag"]) for r in out.collect()} == {1: ("p", "x"), 2: ("own", "y"), 3: (None, None), 4: ("own", "z")}


def test_contributing_sources_without_sorts(spark):
    """results are neither sorted nor multiplied by aggregates that repeat."""
    own = spark.createDataFrame([(1, 10), (2, 11)], "draft_id long, aggregate_id long")
    aggregates = spark.createDataFrame([(10,), (10,)], "aggregate_id long")
    results = spark.createDataFrame([(10, 5, 7), (10, 5, 8), (10, 5, 7), (11, 6, 7), (10, 9, 99)], "aggregate_id long, source_id long, revision_id long")
    out = drafts.contributing_sources(own, aggregates, results, spark.createDataFrame([(7, "a"), (8, "a")], "revision_id long, sha256 string"))
    assert plan(out).count("ShuffledHashJoin") == 2
    assert [tuple(r) for r in out.collect()] == [(1, 5, "a")]


def test_nearest_in_bounded_memory():
    """a batch of rows doesn't meet all centroids at once."""
    rng = np.random.default_rng(1)
    x, c = rng.normal(size=(10_000, 4)), rng.normal(size=(2_000, 4))
    want = np.concatenate([(x[k : k + 10] @ c.T).argmax(1) for k in range(0, 100, 10)])
    tracemalloc.start()
    got = vector_index._nearest(x, c)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got[:100] == want).all() and peak < 30e6
