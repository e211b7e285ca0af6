"""The vector index: exact where all lists are probed, scoped, odd rows, recall on clustered and on shapeless vectors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loreweave.operators import vector_index as vi
from loreweave.sources.shared import shared_path


def table_of(spark, x, kb=lambda i: "a", space=lambda i: "s", kind=lambda i: None):
    rows = [(i, kb(i), space(i), kind(i), None if v is None else [float(c) for c in v]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "chunk_id long, kb string, space string, kind string, embedding array<float>")


def plain(rows, most):
    """The nearest chunks of each twentieth row, by brute force."""
    rows = [r for r in rows if r.embedding is not None]
    out = set()
    for q in (r for r in rows if r.chunk_id % 20 == 0):
        x = np.array(q.embedding, float)
        hits = []
        for r in rows:
            v = np.array(r.embedding, float)
            if (r.kb, r.space) == (q.kb, q.space) and r.kind in (None, "CHILD") and len(v) == len(x) and v.any() and x.any():
                hits.append((-round((1 + float(v @ x) / np.linalg.norm(v) / np.linalg.norm(x)) / 2, 9), r.chunk_id))
        out |= {(q.chunk_id, i, k) for k, (_, i) in enumerate(sorted(hits)[:most], 1)}
    return out


def queries(df):
    return df.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "kb", "space", "embedding")


def test_exact_with_odd_rows(spark):
    rng = np.random.default_rng(1)
    x = list(rng.normal(size=(300, 6)))
    x[3], x[5], x[7] = None, np.zeros(6), np.ones(4)
    x[40] = x[41] = x[42] = x[60]
    df = table_of(spark, x, lambda i: "ab"[i % 3 == 0], lambda i: "st"[i % 7 == 0], lambda i: ["CHILD", None, "PARENT"][i % 5 % 3])
    index = vi.build(df, shared_path(spark, "vi"), vi.Settings(lists=9, block_rows=4, block_queries=2))
    got = vi.search(spark, index, queries(df), 7, exact=True, settings=vi.Settings(block_queries=2)).collect()
    assert {(r.query_id, r.chunk_id, r.rank) for r in got} == plain(df.collect(), 7)
    again = vi.load(spark, index.path)
    assert again.probes == index.probes and all(np.allclose(again.centroids[k], index.centroids[k]) for k in index.centroids)


@pytest.mark.parametrize("clusters", [12, 0])
def test_recall_and_share(spark, clusters):
    """Clustered vectors need a small share of the lists; shapeless ones get as many probes as it takes."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 24))
    if clusters:
        x = 0.25 * x + rng.normal(size=(clusters, 24))[rng.integers(0, clusters, 3000)]
    df = table_of(spark, x).repartition(4)
    index = vi.build(df, shared_path(spark, "vi"))
    asked = queries(df)
    exact = vi.search(spark, index, asked, 10, exact=True)
    assert vi.recalled(vi.search(spark, index, asked, 10), exact).agg(F.avg("recall")).first()[0] >= 0.9
    share = vi.scan_shares(spark, index, asked).agg(F.avg("share")).first()[0]
    assert share < (0.35 if clusters else 1)


def test_request_reads_probed_folders_only(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 8))
    df = table_of(spark, 0.05 * rng.normal(size=(2000, 8)) + centres[rng.integers(0, 20, 2000)], lambda i: "ab"[i % 2])
    index = vi.build(df, shared_path(spark, "vi"))
    vector = [float(c) for c in df.where("chunk_id = 8").first().embedding]
    out = vi.request(spark, index, "a", "s", [("one", vector), ("two", [-c for c in vector])], 5)
    got = out.collect()
    assert [r.chunk_id for r in got if r.subquery == "one" and r.rank == 1] == [8] and len(got) == 10
    assert all(r.chunk_id % 2 == 0 for r in got)
    plan = out._jdf.queryExecution().explainString(out.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(space" in plan and "list#" in plan.split("PartitionFilters")[1][:200]
    assert vi.request(spark, index, "a", "none", [("one", vector)], 5).count() == 0


def test_one_crowded_list_is_dealt(spark):
    """A list that holds nearly all vectors is written by several tasks and searched whole."""
    x = np.ones((900, 3)) + 1e-3 * np.random.default_rng(4).normal(size=(900, 3))
    df = table_of(spark, x)
    s = vi.Settings(lists=1, block_rows=2)
    index = vi.build(df, shared_path(spark, "vi"), s)
    assert spark.read.parquet(f"{index.path}/blocks").agg(F.sum(F.size("ids"))).first()[0] == 900
    got = vi.search(spark, index, queries(df), 5).collect()
    assert {(r.query_id, r.chunk_id, r.rank) for r in got} == plain(df.collect(), 5)


def test_no_vectors(spark):
    df = table_of(spark, [None, None])
    index = vi.build(df, shared_path(spark, "vi"))
    assert index.centroids == {}
