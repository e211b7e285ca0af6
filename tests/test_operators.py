"""Operators against the fixed cases and against plain versions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loreweave.functions import identity, text
from loreweave.operators import answering, chunking, control, discovery, graph, ranking, retrieval, uploads
from loreweave.operators.splitting import Block, Limits, Section, header, parents, split, structural_bounds, utf8_tokens
from loreweave.plans.graphplan import Aggregate, Compare, GraphPlan, Hop, Junction, Order, Project, validate
from loreweave.sources import xhtml
from loreweave.sources.tables import SALES

#: name, text, limit, overlap, chunks, starts
BASELINE = [
    ("repeated", "same same same", 6, 2, ["same s", " same ", "e same"], [0, 4, 8]),
    ("boundaries", "one.\n\ntwo.", 5, 0, ["one.\n", "\ntwo."], [0, 5]),
    ("identifier", "abcdefghijklmnop", 7, 1, ["abcdefg", "ghijklm", "mnop"], [0, 6, 12]),
    ("overlap", "0123456789", 4, 2, ["0123", "2345", "4567", "6789"], [0, 2, 4, 6]),
    ("several scripts", "Привіт🌍", 5, 1, ["Приві", "іт🌍"], [0, 4]),
]


@pytest.mark.parametrize(("name", "source", "most", "overlap", "chunks", "starts"), BASELINE)
def test_fixed_windows(spark, name, source, most, overlap, chunks, starts):
    df = spark.createDataFrame([(1, source), (2, "  "), (3, None)], "doc_id long, text string")
    rows = chunking.fixed_windows(df, most, overlap).orderBy("chunk_index").collect()
    assert [r.chunk_text for r in rows] == chunks
    assert [r.source_start for r in rows] == starts


def test_utf16_offsets():
    assert chunking.utf16_offsets("Привіт🌍!", 6, 7) == (6, 8)


def texts(t, limits, **more):
    return [t[c.start : c.end] for c in split(Section(t, **more), limits)]


def test_recursive_split_bounds_and_cover():
    cases = ["A sentence here. Another one follows it, longer than the first.\n\nA new paragraph.", "line one\nline two\nline two\nline two", "Слова різними мовами — und mehr davon 🌍🌍", "https://example.org/" + "x" * 120]
    limits = Limits(tokens=24, overlap=6, characters=48)
    for t in cases:
        for count in (utf8_tokens, lambda s: len(s.encode())):  # by running sums, and by calls
            out = split(Section(t), limits, count)
            assert out[0].start == 0 and out[-1].end == len(t)
            assert all(c.end - c.start <= 48 and len(t[c.start : c.end].encode()) <= 24 for c in out)
            assert all(x.end >= y.start for x, y in zip(out, out[1:], strict=False))
            assert out == split(Section(t), limits)
    assert split(Section(" \n "), limits) == []


def test_recursive_split_cases():
    """Repeated text, unknown language, hostile strings, overlaps of whole pieces, structural provenance."""
    assert texts("same same same", Limits(5, 0, 20), english=True) == ["same ", "same ", "same"]
    assert all(c.tier != "SENTENCE" for c in split(Section("Привіт світе. Ще речення."), Limits(12, 0, 40)))
    hostile = split(Section("abcdefghij😀klmnopqrst"), Limits(6, 0, 6))
    assert all(c.tier == "CHARACTER" for c in hostile) and max(len("abcdefghij😀klmnopqrst"[c.start : c.end].encode()) for c in hostile) <= 6
    out = split(Section("one two three four"), Limits(11, 6, 20))
    assert [("one two three four"[c.start : c.end], c.overlap) for c in out] == [("one two ", 0), ("two three ", 4), ("three four", 6)]
    t = "Heading\nParagraph content"
    blocks = (Block("PAGE", 0, len(t)), Block("PARAGRAPH", 8, len(t), ("Heading",), "AUTHORITATIVE"))
    (only,) = split(Section(t, 2, 3, blocks), Limits(50, 0, 100))
    assert (only.start, only.end, only.path, only.confidence) == (0, len(t), ("Heading",), "AUTHORITATIVE")
    assert [(p.start, p.end, p.path) for p in structural_bounds(20, (Block("P", 5, 9, ("a",)), Block("P", 7, 12), Block("P", 12, 18, ("b",))))] == [(0, 5, ()), (5, 9, ("a",)), (9, 12, ()), (12, 18, ("b",)), (18, 20, ())]


def test_parents_hold_their_children():
    t = " ".join(f"word{i}" for i in range(200))
    limits = Limits(tokens=60, overlap=0, characters=60, parent_tokens=200, parent_characters=200)
    children = split(Section(t), limits)
    out = parents(children, limits)
    assert [k for p in out for k in range(p.first, p.last + 1)] == list(range(len(children)))
    assert all(p.end - p.start <= 200 and p.text == t[p.start : p.end] for p in out)


def test_parents_keep_to_paths_and_pages():
    mark = lambda path: (Block("PARAGRAPH", 0, 10, path, "AUTHORITATIVE"),)
    pages = [Section("abcdefghi.", k, k + 1, mark(path)) for k, path in enumerate([("p",), ("p",), ("p",), ("q",)])]
    chunks = [c for s in pages for c in split(s, Limits())]
    assert [p.text for p in parents(chunks, Limits())] == ["abcdefghi."] * 4
    out = parents(chunks, Limits(), merge_pages=True)
    assert [(p.pages, p.merged) for p in out] == [((1, 2), True), ((3, 3), False), ((4, 4), False)]
    assert not any(p.merged for p in parents(chunks, Limits(parent_characters=12), merge_pages=True))
    both = Section("abcde fghij", 0, None, (Block("P", 0, 6, ("a",)), Block("P", 6, 11, ("b",))))
    assert [p.path for p in parents(split(both, Limits(tokens=6)), Limits())] == [("a",), ("b",)]


def test_section_chunks(spark):
    kind = "doc_id long, section int, text string, page int, format string, language string, blocks array<struct<kind:string,start:int,end:int,path:array<string>,confidence:string>>"
    rows = [(1, k, f"Text of page {k}.", k + 1, "PDF", "en", [("PARAGRAPH", 0, 15, ["p"], "AUTHORITATIVE")]) for k in range(3)] + [(2, 0, None, None, None, None, None), (3, 0, "one two", None, "TXT", None, None)]
    out = chunking.section_chunks(spark.createDataFrame(rows, kind)).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.kind, r.parent_index, r.child_index, r.section, r.page_start, r.page_end) for r in out] == [
        (1, "PARENT", 0, None, 0, 1, 2), (1, "CHILD", 0, 0, 0, 1, 1), (1, "CHILD", 0, 1, 1, 2, 2), (1, "PARENT", 1, None, 2, 3, 3), (1, "CHILD", 1, 0, 2, 3, 3), (3, "PARENT", 0, None, 0, None, None), (3, "CHILD", 0, 0, 0, None, None)
    ]
    assert out[0].chunk_text == "Text of page 0.\nText of page 1." and out[0].path == ["p"]


def test_chunk_sink(spark, tmp_path):
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    kind = "document_id long, id string, kind string, parent_id string, child_index int, child_count int, source_start int, source_end int, text string, source_hash string"
    family = lambda d, n: [(d, f"{d}p", "PARENT", None, None, n, 0, 10 * n, "x", sha("x")), *[(d, f"{d}c{k}", "CHILD", f"{d}p", k, None, 10 * k, 10 * k + 10, "c", None) for k in range(n)]]
    df = lambda rows: spark.createDataFrame(rows, kind)
    path = f"file://{tmp_path}/chunks"
    chunking.write_chunks(df(family(1, 2) + family(2, 1)), path, buckets=4)
    chunking.write_chunks(df(family(1, 3)), path, buckets=4)
    got = spark.read.parquet(path).collect()
    assert sorted(r.id for r in got) == ["1c0", "1c1", "1c2", "1p", "2c0", "2p"]
    base = family(1, 2)
    broken = {
        "CHILD_COUNT": base[:2], "CHILD_INDEX": [base[0], base[1], (*base[2][:4], 5, *base[2][5:])], "CONTAINMENT": [base[0], base[1], (*base[2][:7], 99, *base[2][8:])], "PARENT_HASH": [(*base[0][:9], "no"), *base[1:]],
        "PARENT_REFERENCE": [(*base[0][:4], 1, *base[0][5:]), *base[1:]], "ID_REPEATED": [*base, base[2]], "PARENT_NOT_FOUND": [*base, (1, "z", "CHILD", "gone", 0, None, 0, 1, "c", None)], "ID_MISSING": [*base, (1, None, "CHILD", "1p", 2, None, 0, 1, "c", None)],
    }
    for problem, rows in broken.items():
        assert problem in {r.problem for r in chunking.hierarchy_violations(df(rows)).collect()}, problem
        with pytest.raises(ValueError, match=problem if problem in ("PARENT_HASH", "CONTAINMENT") else "break"):
            chunking.write_chunks(df(rows), path, buckets=4)


def test_fusion_recall(spark):
    """A mixed case: 12 dense hits, one relevant at rank 12, and a relevant hit of each other branch."""
    rows = [("DENSE", "q", f"d{i:02d}", "x", i) for i in range(1, 13)] + [("LEXICAL", "q", "l1", "y", 1), ("METADATA", None, "m1", "z", 1)]
    df = spark.createDataFrame(rows, "channel string, subquery string, chunk_id string, document_id string, rank int")
    top = [r.chunk_id for r in ranking.fuse(df).orderBy("fused_rank").limit(10).collect()]
    assert {"l1", "m1", "d01"} <= set(top)
    again = ranking.fuse(df.orderBy(F.rand(3))).orderBy("fused_rank").collect()
    assert [r.chunk_id for r in again][:10] == top


def test_fusion_counts_a_branch_once(spark):
    rows = [("D", "a", "1", "x", 3), ("D", "a", "1", "x", 1), ("D", "b", "2", "x", 1), ("D", "b", " ", "x", 2)]
    df = spark.createDataFrame(rows, "channel string, subquery string, chunk_id string, document_id string, rank int")
    assert [(r.chunk_id, r.score) for r in ranking.fuse(df, {"D": 2.0}).collect()] == [("1", round(1 / 61, 12)), ("2", round(1 / 61, 12))]


def test_fusion_counts_subqueries_without_valid_candidates(spark):
    rows = [("D", "a", "1", "x", 1, "COMPLETED"), ("D", "b", " ", "x", 1, "COMPLETED"), ("D", "c", "2", None, 1, "COMPLETED"), ("D", "d", "3", "x", 1, "FAILED"), ("D", "a", None, "x", 2, "COMPLETED")]
    df = spark.createDataFrame(rows, "channel string, subquery string, chunk_id string, document_id string, rank int, status string")
    assert [(r.chunk_id, r.score) for r in ranking.fuse(df).collect()] == [("1", round(1 / 3 / 61, 12))]
    assert [(r.chunk_id, r.score) for r in ranking.fuse(df, executed={"D": 5}).collect()] == [("1", round(1 / 5 / 61, 12))]
    assert [tuple(r) for r in ranking.branch_counters(df, 60).collect()] == [("D", 1, 3, 3)]


def test_fusion_adds_graph_rows(spark):
    text = spark.createDataFrame([("D", "a", "1", "x", 1)], "channel string, subquery string, chunk_id string, document_id string, rank int")
    rows = [(1, 0, "g1", "y", "f1"), (1, 1, "1", "x", "f1"), (2, 0, "g2", "y", "f2"), (2, 1, "g1", "y", "f3"), (3, 0, "g3", "y", "f4"), (3, 1, None, "y", "f4"), (4, 0, "1", "x", "f5"), (4, 1, "g1", "y", "f5")]
    graph_rows = spark.createDataFrame(rows, "rank int, place int, chunk_id string, document_id string, fact_id string")
    got = {r.chunk_id: (r.score, r.facts) for r in ranking.fuse(text, graph=graph_rows, derived=2, per_branch=3).collect()}
    assert got == {"1": (round(2 / 61, 12), ["f1"]), "g1": (round(1 / 61, 12), ["f1", "f3"]), "g2": (round(1 / 62, 12), ["f2"])}
    assert {tuple(r) for r in ranking.branch_counters(text, 3, graph_rows, 2).collect()} == {("D", 1, 0, 1), ("GRAPH", 4, 3, 1)}


def test_diversify_as_a_walk(spark):
    rng = random.Random(4)
    rows = [(k, f"d{rng.randrange(4)}") for k in range(1, 60)]
    df = spark.createDataFrame(rows, "fused_rank int, document_id string")
    seen, out = {}, []
    for k, d in rows:
        if len(out) < 7 and seen.get(d, 0) < 2:
            seen[d] = seen.get(d, 0) + 1
            out.append(k)
    assert [r.fused_rank for r in ranking.diversify(df, 2, 7).collect()] == out


def test_context_budget_skips_what_does_not_fit(spark):
    rows = [(1, 1, "a", "d1", "p1", 50), (1, 2, "b", "d1", "p1", 50), (1, 3, "c", "d1", "p2", 60), (1, 4, "e", "d2", "p3", 40), (1, 5, "f", "d2", None, 1), (1, 6, "g", "d1", "p4", 5), (1, 7, "h", "d1", "p5", 1)]
    df = spark.createDataFrame(rows, "request int, fused_rank int, chunk_id string, document_id string, context_id string, tokens long")
    out = {r.chunk_id: r.outcome for r in ranking.context_budget(df, most=8, per_document=2, tokens=100).collect()}
    assert out == {"a": "INCLUDED", "b": "DEDUPLICATED", "c": "TOKEN_BUDGET", "e": "INCLUDED", "f": "NO_CONTEXT", "g": "INCLUDED", "h": "DOCUMENT_BUDGET"}


def test_rerank_validity(spark):
    ranked = spark.createDataFrame([("a", 1), ("b", 2)], "chunk_id string, fused_rank int")
    good = spark.createDataFrame([("a", 0.1), ("b", 0.9)], "chunk_id string, rerank_score double")
    assert ranking.rerank_valid(ranked, good).first().valid
    assert not ranking.rerank_valid(ranked, good.limit(1)).first().valid
    assert not ranking.rerank_valid(ranked, good.withColumn("rerank_score", F.lit(1.5))).first().valid
    assert [r.chunk_id for r in ranking.rerank(ranked, good, 20).orderBy("final_rank").collect()] == ["b", "a"]


def codes(**changes):
    base = {"root": "Customer", "hops": (Hop("PLACED", "Order"),), "projections": (Project("a", 0, "name"),), "limit": 10}
    return validate(GraphPlan(**(base | changes)), SALES)


def test_plan_validation():
    assert codes() == []
    assert validate(GraphPlan("Customer"), None) == ["scope.active-schema-unavailable"]
    assert codes(root="Ghost") == ["root-label.unknown"]
    assert codes(hops=(Hop("PLACED", "Order"),) * 3)[0] == "hops.limit-exceeded"
    assert codes(hops=(Hop("PLACED", "Part"),)) == ["hop.endpoints-mismatch"]
    assert codes(hops=(Hop("NOPE", "Part"),)) == ["hop.schema-mismatch"]
    assert codes(filters=(Compare(0, "ghost", "=", 1),)) == ["filter.property-unknown"]
    assert codes(filters=(Compare(0, "name", "~", "x"),)) == ["filter.operation-invalid"]
    assert codes(filters=(Compare(0, "name", "=", 1),)) == ["filter.literal-type-mismatch"]
    assert codes(filters=(Compare(0, "acctbal", "CONTAINS", 1.0),)) == ["filter.operator-type-mismatch"]
    assert codes(filters=(Junction(True, (Compare(0, "name", "=", "x"),)),)) == ["filter.junction-invalid"]
    assert codes(projections=()) == ["projection.required"]
    assert codes(projections=(Project("1x", 0, "name"),)) == ["projection.alias-invalid"]
    assert codes(projections=(Project("a", 5, "name"),)) == ["projection.node-index-invalid"]
    assert codes(projections=(Project("a", hop=3),)) == ["projection.hop-index-invalid"]
    assert codes(aggregation=Aggregate("SUM", "v", 0, "name")) == ["aggregation.property-type-mismatch"]
    assert codes(aggregation=Aggregate("COUNT", "a")) == ["aggregation.alias-conflict"]
    assert codes(ordering=(Order("zz"),)) == ["ordering.projection-unknown"]
    assert codes(limit=0) == ["limit.out-of-range"]


def test_upsert_keeps_the_first_writer(spark):
    a = spark.createDataFrame([("n1", "old", 1)], "id string, name string, write_seq long")
    b = spark.createDataFrame([("n1", "new", 2), ("n2", "x", 4), ("n2", "y", 3)], "id string, name string, write_seq long")
    assert {(r.id, r.name) for r in graph.first_writer(a, b).collect()} == {("n1", "old"), ("n2", "y")}


def test_upsert_of_equal_sequences_keeps_the_row_that_stands_first(spark, tmp_path):
    from loreweave.queries import load
    from tests.compare import connect, same

    rows = [(7, 3, 9, 1), (7, 3, 2, 1), (7, 4, 5, 2), (7, 4, 1, 2), (7, 4, 8, 2)]
    frame = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").coalesce(1)
    frame.write.parquet(f"{tmp_path}/parts")
    next((tmp_path / "parts").glob("*.parquet")).rename(tmp_path / "lineitem.parquet")
    queries, sql = load()
    got = queries["fact_upsert_first_wins"](spark, str(tmp_path))
    assert {r.supplier for r in got.collect()} == {9, 5}
    same(got, connect(str(tmp_path)), sql["fact_upsert_first_wins"])


def test_shared_facts_survive_one_document(spark):
    evidence = spark.createDataFrame([("f1", "d1"), ("f1", "d2"), ("f2", "d1")], "fact_id string, document_id string")
    left = graph.without(evidence, spark.createDataFrame([("d1",)], "document_id string"), "document_id")
    facts = spark.createDataFrame([("f1",), ("f2",)], "fact_id string")
    assert [r.fact_id for r in graph.orphans(facts, left).collect()] == ["f2"]


def test_stale_runs(spark):
    runs = spark.createDataFrame([("r1", "d", "FAILED", 1), ("r2", "d", "COMPLETED", 2), ("r3", "d", "COMPLETED", 3), ("r4", "e", "COMPLETED", 1), ("r5", "e", "FAILED", 2)], "run_id string, document_id string, status string, seq long")
    assert {r.run_id for r in graph.stale_runs(runs, False).collect()} == {"r1"}
    assert {r.run_id for r in graph.stale_runs(runs, True).collect()} == {"r1", "r2"}


def test_provenance_overrides(spark):
    evidence = spark.createDataFrame([("c", {"a": "1", "page": "9"})], "chunk_id string, props map<string,string>")
    chunks = spark.createDataFrame([("c", {"page": "2"})], "chunk_id string, chunk_props map<string,string>")
    assert graph.with_provenance(evidence, chunks).first().props == {"a": "1", "page": "2"}


def test_identities(spark):
    import hashlib

    row = spark.range(1).select(identity.node_id(F.lit("s"), F.lit("L"), k=F.lit("v")).alias("n"), identity.normal_url(F.lit("HTTPS://Api.Example.org:443/v1//")).alias("u"), identity.settings_hash(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))).alias("s")).first()
    assert row.n == "node:" + hashlib.sha256(b"s\nL\nkey:k=1:v").hexdigest()
    assert row.u == "https://api.example.org/v1"
    assert row.s == hashlib.sha256(b"1:a=1:1\n1:b=1:2\n").hexdigest()


def test_text_functions(spark):
    row = spark.createDataFrame([("workOrder due-date",)], "t string").select(text.normal_label(F.col("t")).alias("a"), text.normal_property(F.col("t")).alias("b"), text.normal_relationship(F.col("t")).alias("c"), text.key_properties(F.array(F.lit("name"), F.lit("orderId"), F.lit("zipCode"))).alias("k")).first()
    assert (row.a, row.b, row.c, row.k) == ("WorkOrderDueDate", "workOrderDueDate", "WORK_ORDER_DUE_DATE", ["orderId", "zipCode"])
    assert text.lexical_query("one") == "one"
    assert text.lexical_query("a+b c") == '("a\\+b c")^3 OR (a\\+b AND c)'


def test_types_keys_and_names(spark):
    one = lambda c: spark.range(1).select(c.alias("c")).first().c
    kinds = {"TRUE": "boolean", "-3": "integer", ".5": "number", "2024-01-02": "date", "2024-01-02T10:00:00Z": "datetime", "2024-01-02 10:00:00.25+02:00": "datetime", "2024-01-02T10:00": "string", "2024-01-02T10:00:00 x": "string", " ": "string", "1.": "string"}
    assert {k: one(text.inferred_type(F.lit(k))) for k in kinds} == kinds and one(text.inferred_type(F.lit(None).cast("string"))) == "string"
    keys = lambda *names: one(text.key_properties(F.array(*map(F.lit, names)).cast("array<string>")))
    assert keys("name", "partNumber", "id", "orderId") == ["partNumber", "id"] and keys("a", "b", "c") == ["a", "b"] and keys("a") == ["a"] and keys() == []
    assert one(text.sanitised_label(F.lit("work order!"))) == "Work_order_" and one(text.sanitised_label(F.lit(" "))) == "Entity"
    assert one(text.sanitised_relation(F.lit(" part-of! "))) == "PART_OF" and one(text.sanitised_relation(F.lit("--"))) == "RELATED_TO" == one(text.sanitised_relation(F.lit(None).cast("string")))
    assert text.lexical_query("a&b c&&d") == '("a&b c\\&\\&d")^3 OR (a&b AND c\\&\\&d)'
    assert [one(text.safe_name(F.lit(x))) for x in ("a_1", "1a", None)] == [True, False, False]


def test_cleaned(spark):
    assert spark.createDataFrame([(" a\r\nb\rc ",)], "t string").select(text.cleaned(F.col("t")).alias("t")).first().t == "a\nb\nc"


def test_keyword_modes(spark):
    df = spark.createDataFrame([("MATCH (a:Asset) RETURN a",), ("match (n) set n.x = 1",)], "q string")
    assert [r[0] for r in df.select(control.forbidden_keywords(F.col("q"), ["SET", "RETURN"])).collect()] == [["SET", "RETURN"], ["SET"]]
    assert [r[0] for r in df.select(control.forbidden_keywords(F.col("q"), ["SET"], True)).collect()] == [[], ["SET"]]


def test_transitions(spark):
    df = spark.createDataFrame([(None, "QUEUED"), ("QUEUED", "RUNNING"), ("COMPLETED", "RUNNING"), ("RUNNING", "FAILED")], "a string, b string")
    assert [bool(r[0]) for r in df.select(control.allowed(F.col("a"), F.col("b"))).collect()] == [True, True, False, True]


def test_activation_is_single(spark):
    links = spark.createDataFrame([("k", "s1", True), ("k", "s2", False), ("j", "s1", True)], "kb string, schema_id string, active boolean")
    out = control.activate(links, "k", "s2")
    assert {(r.kb, r.schema_id) for r in out.where("active").collect()} == {("k", "s2"), ("j", "s1")}
    assert control.several_active(out).count() == 0


def test_support_is_independent(spark):
    rows = [("NODE", "A", "t", "s1", 1, "OBSERVED", 0.5), ("NODE", "A", "t", "s2", 1, "OBSERVED", 0.9), ("NODE", "A", "t", "s3", None, "GUIDED", 0.1)]
    df = spark.createDataFrame(rows, "kind string, identity string, type string, source string, document long, origin string, confidence double")
    row = discovery.merge_candidates(df).first()
    assert (row.support, row.confidence, row.origins) == (2, 0.9, ["GUIDED", "OBSERVED"])


def test_replace_and_dedup(spark):
    docs = spark.createDataFrame([("a", "k", "x"), ("b", "k", "x"), ("c", "j", "x")], "doc_id string, kb string, text string")
    assert {r.doc_id for r in uploads.with_existing(docs).where("is_new").collect()} == {"a", "c"}
    new = spark.createDataFrame([("a", "k", "y")], docs.schema)
    assert {(r.doc_id, r.text) for r in uploads.replaced(docs, new, "doc_id").collect()} == {("a", "y"), ("b", "x"), ("c", "x")}


ANSWER = "request int, answer struct<version:int,status:string,text:string,level:string,score:double,limitations:array<struct<code:string,description:string>>,claims:array<struct<id:string,text:string,kind:string,citation_ids:array<string>,fact_ids:array<string>,evidence_ids:array<string>>>>"


def test_answer_checks(spark):
    claim = lambda i, kind="TEXT", cites=("E1",), facts=(), evidence=(), t="x": (i, t, kind, list(cites), list(facts), list(evidence))
    answer = lambda *claims, status="ANSWERED", version=1, text="t", level="HIGH", score=0.5, limits=(): (version, status, text, level, score, list(limits), list(claims))
    cases = {
        1: (answer(claim("a"), claim("b", "GRAPH", ["E2"], ["f1"], ["v1"])), {}), 2: (None, {"answer.missing": 1}),
        3: (answer(version=2, status=None, level=None), {"answer.version.unsupported": 1, "answer.status.missing": 1, "answer.confidence.invalid": 1}), 4: (answer(text=" "), {"answer.text.missing": 1, "answer.claims.missing": 1}),
        5: (answer(claim("a"), status="ABSTAINED", score=1.5), {"answer.abstention.claims-not-empty": 1, "answer.confidence.invalid": 1}),
        6: (answer(claim("a"), claim("a", cites=()), claim(" "), claim("c", cites=["CTX1"])), {"answer.claim.id-duplicate": 1, "answer.claim.citation-unknown": 2, "answer.claim.invalid": 1}),
        7: (answer(claim("a", facts=["f1"]), claim("b", "GRAPH"), claim("c", "GRAPH", ["E1"], ["f1"], ["v9"]), claim("d", "GRAPH", ["E1"], ["f9"], ["v1"])), {"answer.text-claim.graph-references": 1, "answer.graph-claim.references-missing": 1, "answer.graph-claim.evidence-unknown": 1, "answer.graph-claim.fact-unknown": 1, "answer.graph-claim.citation-type-invalid": 2}),
        8: (answer(*(claim(f"c{k}") for k in range(41)), limits=[("a", "b")] * 20 + [("a", " ")]), {"answer.claims.limit": 1, "answer.limitations.limit": 1, "answer.limitation.invalid": 1}), 9: (answer(claim("a"), score=float("nan")), {"answer.confidence.invalid": 1}),
    }
    answers = spark.createDataFrame([(k, a) for k, (a, _) in cases.items()], ANSWER)
    catalog = spark.createDataFrame([(k, kind, c) for k in cases for kind, c in (("TEXT_CHILD", "E1"), ("GRAPH_PARENT", "E2"), ("CONTEXT", "CTX1"))], "request int, kind string, citation_id string")
    facts = spark.createDataFrame([(k, "f1", ["E2"], ["v1"]) for k in cases], "request int, fact_id string, citation_ids array<string>, evidence_ids array<string>")
    got = {}
    for r in answering.answer_violations(answers, catalog, facts).collect():
        got.setdefault(r.request, {})[r.code] = r.n
    assert got == {k: want for k, (_, want) in cases.items() if want}


def test_facts_without_cited_chunks_take_all_graph_parents(spark):
    catalog = spark.createDataFrame([(1, "GRAPH_PARENT", "a", "E1"), (1, "GRAPH_PARENT", "b", "E2"), (1, "TEXT_CHILD", "c", "E3"), (2, "TEXT_CHILD", "c", "E1")], "request int, kind string, chunk_id string, citation_id string")
    facts = spark.createDataFrame([(1, "f1", "b"), (1, "f1", "z"), (1, "f2", "c"), (2, "f3", "c")], "request int, fact_id string, chunk_id string")
    assert {(r.request, r.fact_id): r.citation_ids for r in answering.fact_citations(facts, catalog).collect()} == {(1, "f1"): ["E2"], (1, "f2"): ["E1", "E2"], (2, "f3"): []}


def test_failure_classes(spark):
    cases = [
        (["DiscoveryDeadlineExceededException"], ["x"], 500, "SOURCE_DEADLINE_EXCEEDED", ("TIMEOUT", "SOURCE_DEADLINE_EXCEEDED", True)), (["A", "ModelOutputException"], [None], None, "MALFORMED_MODEL_RESPONSE", ("CONVERSION_ERROR", "MALFORMED_MODEL_RESPONSE", True)),
        (["ModelOutputException"], [], None, "EMPTY_MODEL_RESPONSE", ("VALIDATION_ERROR", "EMPTY_MODEL_RESPONSE", True)), (["SourceStateException"], [], 429, "SOURCE_STALE", ("VALIDATION_ERROR", "SOURCE_STALE", False)),
        (["X", "SocketTimeoutException"], [], 401, None, ("TIMEOUT", "TRANSPORT_TIMEOUT", True)), (["X"], [], 408, None, ("TIMEOUT", "TRANSPORT_TIMEOUT", True)), (["X"], [], 429, None, ("OVERLOADED", "RATE_LIMIT", True)), (["X"], [], 503, None, ("PROVIDER_ERROR", "PROVIDER_5XX", True)),
        (["X"], [], 409, None, ("OVERLOADED", "PROVIDER_RETRYABLE_STATUS", True)), (["X"], [], 403, None, ("PROVIDER_ERROR", "PROVIDER_AUTH", False)), (["X"], [], 404, None, ("PROVIDER_ERROR", "PROVIDER_INVALID_REQUEST", False)),
        (["ConnectException"], ["timeout"], None, None, ("PROVIDER_ERROR", "TRANSPORT_IO", True)), (["X"], ["no API key"], None, None, ("PROVIDER_ERROR", "CONFIGURATION_ERROR", False)), (["X"], ["Timeout of the JSON call"], None, None, ("TIMEOUT", "TRANSPORT_TIMEOUT", True)),
        (["X"], ["pool overloaded"], None, None, ("OVERLOADED", "RATE_LIMIT", True)), (["X"], ["cannot parse"], None, None, ("CONVERSION_ERROR", "MALFORMED_MODEL_RESPONSE", True)), (["X"], ["stale"], None, None, ("VALIDATION_ERROR", "SOURCE_STALE", False)),
        (["X"], ["unavailable"], None, None, ("VALIDATION_ERROR", "SOURCE_UNAVAILABLE", False)), (["X"], ["invalid"], None, None, ("VALIDATION_ERROR", "INVALID_MODEL_CANDIDATE", True)), (["X", "RejectedExecutionException"], ["boom"], None, None, ("PROVIDER_ERROR", "PROVIDER_ERROR", True)),
        (["X"], ["boom"], None, None, ("PROVIDER_ERROR", "PROVIDER_ERROR", False)), (["X"] * 12 + ["ConnectException"], [], None, None, ("PROVIDER_ERROR", "PROVIDER_ERROR", False)), (None, None, None, None, ("PROVIDER_ERROR", "PROVIDER_ERROR", False)),
    ]
    df = spark.createDataFrame([(k, *c[:4]) for k, c in enumerate(cases)], "k int, types array<string>, messages array<string>, status int, code string")
    got = {r.k: tuple(r.f) for r in df.select("k", control.failure_class(F.col("types"), F.col("messages"), F.col("status"), F.col("code")).alias("f")).collect()}
    assert got == {k: c[4] for k, c in enumerate(cases)}


def test_composite_keys_and_relationship_drops(spark):
    keys = spark.createDataFrame([("Part", ["id", " site "]), ("Tag", None), ("Team", ["id"])], "label string, keys array<string>")
    nodes = spark.createDataFrame(
        [("c", "Part", {"id": "1", "site": "x"}), ("c", "Part", {"id": " ", "name": "n"}), ("c", "Part", {"site": "x"}), ("c", "Tag", {}), ("c", "Ghost", {"id": "1"}), ("c", "Team", {"code": "t"}), ("d", "Team", {"id": "1"}), ("d", "Team", {"id": "1"})],
        "chunk_id string, label string, props map<string,string>",
    )
    clean = graph.sanitise_nodes(nodes, keys)
    assert [(r.key_values, r.drop_reason) for r in clean.orderBy("label", "chunk_id", "key_values").collect()] == [(None, "unknown_label"), ([None, "x"], "incomplete_node_key"), (["1", "x"], None), (["n", "n"], None), ([], None), (["t"], None), (["1"], None), (["1"], None)]
    rel = lambda k, c, a, ak, b, bk: (k, c, "R", a, ak, b, bk)
    rows = [
        rel(0, "c", "Team", {}, "Part", {"id": "1", "site": "x"}), rel(1, "c", "Team", None, "Part", None), rel(2, "c", "Team", {"id": "t"}, "Part", {"id": "1"}), rel(3, "c", "Ghost", {}, "Part", {}), rel(4, "c", "Part", {"id": "1", "site": "x"}, "Team", {"id": "t"}),
        rel(5, "c", "Team", {"id": "z"}, "Part", {"id": "1", "site": "x"}), rel(6, "c", "Team", {"id": "t"}, "Part", {"id": "9", "site": "x"}), rel(7, "d", "Team", {"id": " "}, "Part", {"id": "1", "site": "x"}), rel(8, "d", "Team", {}, "Part", {"id": "1", "site": "x"}), rel(9, "c", "Team", {"id": "t"}, "Tag", {"a": "b"}),
    ]
    rels = spark.createDataFrame(rows, "k int, chunk_id string, kind string, from_label string, from_key map<string,string>, to_label string, to_key map<string,string>")
    triples = spark.createDataFrame([("R", "Team", "Part"), ("R", "Team", "Tag")], "kind string, from_label string, to_label string")
    out = graph.sanitise_relationships(rels, clean.where("drop_reason is null"), triples, keys)
    assert {r.k: r.drop_reason for r in out.collect()} == {
        0: None, 1: "empty_endpoint_key", 2: "incomplete_to_endpoint_key", 3: "unknown_endpoint_label", 4: "invalid_relationship_triple", 5: "from_endpoint_not_kept", 6: "to_endpoint_not_kept", 7: "incomplete_from_endpoint_key", 8: "empty_endpoint_key", 9: None
    }


def test_triples_become_a_schema(spark):
    kind = "seq int, head string, head_type string, head_props map<string,string>, relation string, tail string, tail_type string, tail_props map<string,string>, relation_props map<string,string>, props map<string,string>"
    rows = [
        (1, "Ann", "person", {"age": "41", "description": " "}, "works at", "Acme", "org unit", {"orgCode": "A1", "description": "A firm"}, None, {"since": "2020-01-01"}),
        (2, "Ann", "person", {"age": "42", "mail": "x"}, "works at", "Acme", "org unit", {"key": "orgCode, bad-name", "name": "Acme"}, {"since": "later", "level": "3"}, None),
        (3, " ", "person", {"lost": "1"}, "knows", "Bob", None, None, None, None), (4, "Bob", None, None, "knows", "Ann", "person", None, None, None),
    ]
    nodes, edges = discovery.triples_to_graph(spark.createDataFrame(rows, kind))
    assert {(r.name, r.type): r.props for r in nodes.collect()} == {("Ann", "person"): {"age": "42", "description": " ", "mail": "x"}, ("Acme", "org unit"): {"orgCode": "A1", "description": "A firm", "key": "orgCode, bad-name", "name": "Acme"}, ("Bob", "Entity"): {}}
    labels, kinds = discovery.schema_from_graph(nodes, edges)
    got = {r.label: (r.description, r["keys"], [tuple(p) for p in r.properties]) for r in labels.collect()}
    assert got == {"Person": (None, ["age", "mail"], [("age", "integer"), ("mail", "string")]), "Org_unit": ("A firm", ["orgCode"], [("name", "string"), ("orgCode", "string")]), "Entity": (None, [], [])}
    assert {(r.relationship, r.from_label, r.to_label): [tuple(p) for p in r.properties] for r in kinds.collect()} == {("WORKS_AT", "Person", "Org_unit"): [("level", "integer"), ("since", "date")], ("KNOWS", "Entity", "Person"): []}


def test_conflicts(spark):
    kind = "kind string, identity string, type string, keys array<string>, relationship string, from_label string, to_label string, source string"
    rows = [
        ("NODE_PROPERTY", "A.x", "int", None, None, None, None, "s1"), ("NODE_PROPERTY", "A.x", "string", None, None, None, None, "s2"), ("RELATIONSHIP_PROPERTY", "A.y", "int", None, None, None, None, "s1"), ("NODE_PROPERTY", "A.y", "string", None, None, None, None, "s1"),
        ("NODE_KEY", "A", None, ["id"], None, None, None, "s1"), ("NODE_KEY", "A", None, ["id", "site"], None, None, None, "s1"), ("RELATIONSHIP", "r", None, None, "OWNS", "A", "B", "s1"), ("RELATIONSHIP", "r", None, None, "HAS", "A", "B", "s2"), ("RELATIONSHIP", "r", None, None, "OWNS", "B", "A", "s3"),
    ]
    aliases = spark.createDataFrame([("work order", "task", "s9")], "first string, second string, source string")
    got = {(r.category, r.coordinate): (r.alternatives, r.sources) for r in discovery.conflicts(spark.createDataFrame(rows, kind), aliases).collect()}
    assert got == {
        ("PROPERTY_TYPE", "A.x"): (["int", "string"], ["s1", "s2"]), ("IDENTITY_KEY", "A"): (["id", "id,site"], ["s1"]), ("RELATIONSHIP_NAME", "relationship-endpoints:A->B"): (["HAS", "OWNS"], ["s1", "s2"]),
        ("RELATIONSHIP_DIRECTION", "relationship-direction:OWNS:A:B"): (["A->B", "B->A"], ["s1", "s3"]), ("ALIAS_SUGGESTION", "WorkOrder~Task"): (["work order", "task"], ["s9"]),
    }


def test_schema_changes_and_restart(spark):
    schemas = spark.createDataFrame([("s1", "a", 1), ("s2", "b", 1)], "schema_id string, name string, version int")
    links = spark.createDataFrame([("s1", True), ("s2", False)], "schema_id string, active boolean")
    rows = [(1, "CREATE", None, "a", 1), (2, "CREATE", None, "a", 2), (3, "UPDATE", "s1", "a", 1), (4, "UPDATE", "s2", "b", 2), (5, "UPDATE", "s2", "b", 1), (6, "DELETE", "s1", "a", 1), (7, "DELETE", "s2", "b", 1), (8, "DELETE", "s9", "z", 1)]
    out = control.schema_change_violations(spark.createDataFrame(rows, "change_id int, action string, schema_id string, name string, version int"), schemas, links)
    assert {r.change_id: r.problem for r in out.collect()} == {1: "ALREADY_EXISTS", 3: "ACTIVE", 4: "IDENTITY_CHANGED", 6: "ACTIVE", 8: "NOT_FOUND"}
    runs = spark.createDataFrame([("QUEUED",), ("RUNNING",), ("FAILED",)], "status string")
    assert [r.status for r in control.interrupted(runs).collect()] == ["INTERRUPTED", "INTERRUPTED", "FAILED"]


def test_dense_plan_has_no_join(spark):
    chunks = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "chunk_id long, embedding array<float>")
    out = retrieval.dense(chunks, [("a", [1.0, 0.0]), ("b", [1.0, 1.0])], 1)
    assert [(r.subquery, r.chunk_id) for r in out.orderBy("subquery").collect()] == [("a", 1), ("b", 1)]
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_xhtml_sections():
    rows = xhtml.blocks("<html><head><title>t</title></head><body><h1>A</h1><p>x &amp; y</p><h2>B</h2><ul><li>i</li></ul><h1>C</h1><table><tr><td>c</td></tr></table></body></html>")
    assert [(r[0], r[2], r[3], r[4]) for r in rows] == [(0, "HEADING", "A", "A"), (0, "PARAGRAPH", "A", "x & y"), (1, "HEADING", "A > B", "B"), (1, "LIST_ITEM", "A > B", "i"), (2, "HEADING", "C", "C"), (2, "TABLE_CELL", "C", "c")]


def test_page_bounds(spark):
    with pytest.raises(ValueError, match="pages start"):
        chunking.page(spark.range(3).toDF("id"), 0, 101, "id")


def test_context_header(spark):
    def column(tokens, characters, pages=(1, 1)):
        path = F.array(F.lit("x"), F.lit("y"))
        return spark.range(1).select(chunking.context_header(F.lit("v1"), F.lit(" a\n b.txt"), F.lit("TXT"), path, F.lit(pages[0]), F.lit(pages[1]), F.lit(2), F.lit(tokens), F.lit(characters)).alias("h")).first().h

    def plain(tokens, characters, pages=(1, 1)):
        return header("", Limits(header_tokens=tokens, header_characters=characters), "v1", source=" a\n b.txt", kind="TXT", path=("x", "y"), pages=pages, page_count=2)

    assert column(99, 99) == "[v1]\nsource: a b.txt\nformat: TXT\npath: x > y\npage: 1/2\n\n"
    for budget in ((99, 99), (99, 40), (30, 99), (5, 5), (24, 99), (99, 99, (1, 2))):
        assert column(*budget) == plain(*budget), budget
    assert header("x" * 3990, Limits(header_tokens=96, header_characters=512), "v1", source="a") == ""  # the text leaves no room


def test_planner_fallback():
    from loreweave.operators.results import planned

    assert [(s.id, s.text) for s in planned("a  question\n", None)] == [("fallback-1", "a question")]
    assert [(s.id, s.text) for s in planned("q", [("1", "x  y"), ("2", "z")])] == [("1", "x y"), ("2", "z")]
    for bad in ([("1", " ")], [("1", "x"), ("1", "y")], [(str(k), "x") for k in range(4)]):
        assert planned("q", bad)[0].id == "fallback-1"


def test_settings_bounds():
    from loreweave.operators.results import ChunkSettings, SearchSettings

    SearchSettings(), ChunkSettings()
    for more in ({"evidence": 21}, {"candidates": 201}, {"subqueries": 4}, {"reserve_ms": 60_000}):
        with pytest.raises(ValueError, match="out of bounds"):
            SearchSettings(**more)
    with pytest.raises(ValueError, match="overlap"):
        ChunkSettings(overlap=800)


def test_model_json(spark):
    from loreweave.operators.results import model_json

    df = spark.createDataFrame([('```json\n{"a": {"b": 1}}\n```',), ("none",)], "t string")
    assert [r[0] for r in df.select(model_json(F.col("t"))).collect()] == ['{"a": {"b": 1}}', None]


def test_filters_reach_the_scan(spark, sf):
    from loreweave.queries.graph import plan_or_junction, plan_two_hop

    plan = plan_two_hop(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(c_acctbal,9000.0)" in plan and "c_mktsegment" not in plan
    assert "PushedFilters" in plan_or_junction(spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_sufficiency_and_synthesis():
    assert answering.sufficiency(0, ("SUFFICIENT", [])) == ("MISSING", ["no evidence"])
    assert answering.sufficiency(3, None) == ("PARTIAL", [])
    assert answering.sufficiency(3, ("PARTIAL", [" a ", " "])) == ("PARTIAL", ["a"])
    check = lambda claims: [] if claims == ["good"] else ["claim.uncited"]
    assert answering.synthesise(lambda codes: ["good"], check) == (["good"], [])
    assert answering.synthesise(lambda codes: ["good"] if codes else ["bad"], check) == (["good"], [])
    assert answering.synthesise(lambda codes: ["bad"], check) == ([], ["claim.uncited"])
    assert answering.synthesise(lambda codes: None, check) == ([], ["model.failed"])


def test_effective_options(spark):
    from loreweave.sources import options

    docs = spark.createDataFrame([("a", "TXT"), ("b", "DOCX")], "document_id string, format string")
    asked = spark.createDataFrame([("b", "docxRevisionMode", "original")], "document_id string, name string, value string")
    out = {r.document_id: r.options for r in options.effective(docs, asked).collect()}
    assert out["a"] == {"preserveLineBreaks": "true"}
    assert out["b"] == {"preserveLineBreaks": "true", "includeMetadata": "false", "tika.write-limit": "-1", "docxRevisionMode": "original"}


def test_fusion_by_request_shuffles_only_what_it_is_given(spark):
    """Dealt by request, candidates and graph rows meet without a join or another shuffle; rows of no request are in no ranking."""
    text = [(1, "D", "q", "a", "d", 1), (1, "D", "q", "b", "d", 2), (1, "D", "p", " ", "d", 1), (2, "L", None, "a", "d", 1), (None, "D", "q", "a", "d", 1)]
    cited = [(1, 1, 1, "a", "d", 7), (1, 1, 2, "n", "d", 8), (1, 2, 1, "m", "d", 9), (1, 2, 2, "o", "d", 9), (1, 9, 1, "a", "d", 9), (2, 1, 1, "b", "d", 7), (None, 1, 1, "a", "d", 7)]
    text = spark.createDataFrame(text, "request int, channel string, subquery string, chunk_id string, document_id string, rank int").repartition("request")
    cited = spark.createDataFrame(cited, "request int, rank int, place int, chunk_id string, document_id string, fact_id int").repartition("request")
    fused = ranking.fuse(text, graph=cited, derived=2, per_branch=5, by=("request",))
    counted = ranking.branch_counters(text, 5, cited, 2, by=("request",))
    for out in (fused, counted):
        plan = out._jdf.queryExecution().executedPlan().toString().split("\n")
        assert not [x for x in plan if "Join" in x or ("Exchange" in x and "REPARTITION_BY_COL" not in x)]
    assert {(r.request, r.chunk_id): (r.score, r.facts) for r in fused.collect()} == {
        (1, "a"): (round(1 / 2 / 61 + 1 / 61, 12), ["7"]), (1, "b"): (round(1 / 2 / 62, 12), []), (1, "n"): (round(1 / 61, 12), ["8"]), (1, "m"): (round(1 / 62, 12), ["9"]),
        (2, "a"): (round(1 / 61, 12), []), (2, "b"): (round(1 / 61, 12), ["7"]),
    }
    assert {tuple(r) for r in counted.collect()} == {(1, "D", 2, 1, 2), (2, "L", 1, 0, 1), (None, "D", 1, 0, 1), (1, "GRAPH", 3, 2, 1), (2, "GRAPH", 1, 0, 1), (None, "GRAPH", 0, 1, 1)}
