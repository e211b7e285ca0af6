"""Small helpers: lookups, labels, pages, times, order, failure categories, plan codes, the comparison policy."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loreweave.functions import text
from loreweave.operators import answering, chunking, control, discovery, ranking, retrieval
from loreweave.plans.graphplan import Compare, GraphPlan, Hop, Junction, Project, validate
from loreweave.sources.tables import SALES


def test_owned_rows(spark):
    rows = spark.createDataFrame([("a", "k"), ("b", "k"), ("a", "other")], "document_id string, kb string")
    ids = spark.createDataFrame([("a",), ("a",), ("z",)], "document_id string")
    assert [tuple(r) for r in answering.owned(rows, ids, "k").collect()] == [("a", "k")]
    with pytest.raises(ValueError, match="at most 1"):
        answering.owned(rows, ids, "k", most=1)


def test_labels_of_missing_documents(spark):
    citations = spark.createDataFrame([("E1", "a"), ("E2", "z"), ("E3", None)], "citation_id string, document_id string")
    documents = spark.createDataFrame([("a", "Report")], "document_id string, label string")
    got = {r.citation_id: (r.label, r.missing) for r in answering.enriched(citations, documents).collect()}
    assert got == {"E1": ("Report", False), "E2": ("unknown source", True), "E3": ("unknown source", True)}


def test_page_with_total(spark):
    rows, total = chunking.page_with_total(spark.range(25), 2, 10, "id")
    assert ([r.id for r in rows.collect()], total) == ([20, 21, 22, 23, 24], 25)
    with pytest.raises(ValueError, match="pages start at 0"):
        chunking.page_with_total(spark.range(3), -1, 10, "id")


def test_document_chunks_and_flat_ones(spark):
    rows = [("d", "2", 1, "CHILD", None), ("d", "1", 0, None, None), ("d", "3", 2, "PARENT", None), ("d", "4", 3, "CHILD", "3"), ("e", "5", 0, "CHILD", None)]
    df = spark.createDataFrame(rows, "document_id string, id string, chunk_index int, kind string, parent_id string")
    assert [r.id for r in chunking.document_chunks(df, "d").collect()] == ["1", "2", "3", "4"]
    assert {r.id for r in chunking.flat_chunks(df).collect()} == {"1", "2", "5"}
    assert {r.document_id: (r.flat, r.chunks, r.is_flat) for r in chunking.flat_counts(df).collect()} == {"d": (2, 4, False), "e": (1, 1, True)}
    assert [(r.id, r.children) for r in chunking.parent_page(df, 0, 5).collect()] == [("3", 1)]


def test_deadlines_and_retention(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 1, 31, 12), dt.datetime(2026, 1, 31, 11, 59, 58)), (dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 2)), (None, dt.datetime(2026, 1, 2))], "a timestamp, b timestamp")
    got = df.select(control.expires_at(F.col("a"), "30 days").alias("e"), control.remaining_ms(F.col("a"), F.col("b")).alias("ms")).collect()
    assert [r.e for r in got] == [dt.datetime(2026, 3, 2, 12), dt.datetime(2026, 1, 31), None]
    assert [r.ms for r in got] == [2000, 0, 0]


def test_order_of_reports(spark):
    df = spark.createDataFrame([("b", None), ("a", "2"), (None, "z"), ("a", None)], "x string, y string")
    assert [tuple(r) for r in discovery.in_order(df, "x", "y").collect()] == [(None, "z"), ("a", None), ("a", "2"), ("b", None)]


def test_failure_category(spark):
    df = spark.createDataFrame([("a b/c",), ("x" * 99,), (None,), ("Ok_1.2-3",)], "t string")
    assert [r.c for r in df.select(text.failure_category(F.col("t")).alias("c")).collect()] == ["a_b_c", "x" * 80, None, "Ok_1.2-3"]


def test_owned_chunks(spark):
    chunks = spark.createDataFrame([(3, "d", "k", None), (1, "d", "k", "CHILD"), (2, "d", "k", "PARENT"), (4, "e", "k", None), (5, "d", "j", None)], "chunk_id long, document_id string, kb string, kind string")
    wanted = spark.createDataFrame([("d",), ("d",)], "document_id string")
    assert [(r.chunk_id, r["rank"], r.score) for r in retrieval.owned_chunks(chunks, wanted, "k", 5).orderBy("rank").collect()] == [(1, 1, 1.0), (3, 2, 1.0)]
    assert retrieval.owned_chunks(chunks, wanted.limit(0), "k", 5).count() == 0


@pytest.mark.parametrize(("comparison", "expected"), [(False, [1, 3, 4]), (True, [1, 2, 3])])
def test_comparisons_lift_the_cap(spark, comparison, expected):
    df = spark.createDataFrame([(1, "d", 1), (2, "d", 2), (3, "e", 3), (4, "f", 4)], "chunk_id int, document_id string, fused_rank int")
    assert [r.chunk_id for r in ranking.diversify(df, 1, 3, comparison=comparison).collect()] == expected
    with pytest.raises(ValueError, match="1 to 20"):
        ranking.diversify(df, 1, 21)


def test_plan_codes():
    show = (Project("x", 0, "name"),)
    plan = lambda hops=(), filters=(): GraphPlan("Customer", hops, filters, show)
    assert validate(plan((Hop("PLACED BY", "Order"), Hop("PLACED", "Order"))), SALES) == ["hop.invalid"]
    assert validate(plan((Hop("PLACED", None),)), SALES) == ["hop.invalid"]
    assert validate(plan(filters=("name = 1",)), SALES) == ["filter.variant-unsupported"]
    assert validate(plan(filters=(Junction(True, (Compare(0, "gone", "=", 1),)),)), SALES) == ["filter.junction-invalid"]
