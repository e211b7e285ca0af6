"""The quality classifier: held-out accuracy, determinism, odd rows."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from loreweave.llm import quality, queries


def test_held_out_accuracy(spark, sf):
    folder = sf.replace("sf0.001", "sf0.01")
    got = queries.op2_quality_classifier(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == r.quality for r in held]) > 0.92
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_index_vectors_are_sparse_and_fixed():
    q = quality.Quality()
    a = quality.index_vectors(q)
    assert (np.abs(a).sum(1) == q.nonzero).all() and (a == quality.index_vectors(q)).all()


def test_contexts_as_counted_by_hand():
    q = quality.Quality(window=2)
    index = quality.index_vectors(q)
    own = quality.Reader(q)
    rows, sizes = own.read(["a b c", None, "", "d"])
    total = np.zeros((q.words + q.shapes, q.dims), np.int64)
    quality.add_contexts(total, rows, sizes, index, q)
    want = np.zeros_like(total)
    for at, size in ((0, 3), (3, 1)):
        for i in range(at, at + size):
            for j in range(max(at, i - 2), min(at + size, i + 3)):
                if i != j:
                    for side in (0, 1):
                        want[rows[i, side]] += index[rows[j, 0]].astype(int) + index[rows[j, 1]]
    assert (total == want).all()


def test_contexts_do_not_depend_on_partitions(spark, documents):
    q = quality.Quality(words=256, shapes=64)
    docs = documents([(k, f"one two w{k % 7} three") for k in range(60)])
    a = quality.context_vectors(F.col("text"), docs.coalesce(1), q)
    assert (a == quality.context_vectors(F.col("text"), docs.repartition(5), q)).all()


def test_odd_rows(spark, documents):
    docs = documents([(1, None), (2, ""), (3, "x"), (None, "a b"), (5, "long " * 30_000), (5, "long " * 30_000)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs, none)
    out = quality.score(docs, model).collect()
    assert [r.score for r in out] == [0.5] * 6
    some = spark.createDataFrame([(k, k % 2) for k in range(1, 40)], "doc_id long, quality int")
    more = documents([(k, "good words here, then more." if k % 2 else "bad### bad###") for k in range(1, 40)] + [(None, None)])
    out = {r.doc_id: r.score for r in quality.score(more, quality.fit(more, some)).collect()}
    assert out[1] > 0.5 > out[2] and 0 <= out[None] <= 1
    assert quality.score(documents([]), model).collect() == []


def test_temperature_is_fitted_on_its_own_fold():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 6))
    y = (rng.random(600) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    net = quality.fit_network(x, y, np.arange(600) % 4 == 0, quality.Quality(epochs=200))
    assert net.temperature > 1  # fitted too sharply without it


def test_sample_is_bounded_and_repeats(spark):
    from loreweave.llm.common import bounded_sample

    rows = spark.range(30_000).withColumnRenamed("id", "k")
    a = {r.k for r in bounded_sample(rows, "k", 2000).collect()}
    assert 1500 < len(a) <= 2000 and a == {r.k for r in bounded_sample(rows.repartition(7), "k", 2000).collect()}
    assert bounded_sample(rows, "k", 30_000).count() == 30_000
    assert bounded_sample(rows.withColumn("k", F.lit(7)), "k", 10).count() <= 10
