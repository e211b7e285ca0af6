"""The pipeline's stages, one by one on what the stage before kept, and the registered queries against SQL."""

from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loreweave.llm import queries
from loreweave.llm.common import materialize
from tests.compare import connect, same
from tests.llm.test_exact_dedup import plain as exact
from tests.llm.test_near_dedup import plain as near


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_as_sql(spark, sf, name):
    same(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLES[name])


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(materialize(stage(spark, seen[-1], sf), name))
    kept = [{r.doc_id: r.text for r in d.select("doc_id", "text").collect()} for d in seen[:-1]]
    assert all(d.columns == docs.columns for d in seen[:-1])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    gone = set(kept[0]) - set(kept[1])
    assert gone and sum(labels.get(i) == 1 for i in gone) <= 1
    assert set(kept[2]) == {k for _, k, _, _ in exact([*kept[1].items()])}
    assert set(kept[3]) == {c for _, _, c in near([*kept[2].items()], 5)}
    words = lambda t: t.encode().split()
    for r in seen[4].collect():
        assert set(words(r.text)) <= set(words(kept[3][r.doc_id])) and r.n_chars == len(r.text)
    used = defaultdict(int)
    for r in seen[5].collect():
        used[r.sequence_id] += r.length
    assert all(n <= 2048 and (n == 2048 or n & (n - 1) == 0) for n in used.values())


CASES = [
    (1, "one text of a few words that stands here", None, "a", 5), (2, None, "en", None, None), (None, "", None, "a", 0), (3, "x " * 30_000, "de", "b", 1), (4, "one text of  a few words that stands here", "en", "a", 5),
    (5, "tie tie tie", "en", "b", 3), (5, "tie tie tie", "en", "b", 3), (5, "tie tie tie", None, "b", 3), (None, "lonely words", None, None, None), (6, " \n ", "en", "a", 3),
]


@pytest.mark.parametrize("stage", range(5))
def test_every_stage_handles_odd_rows(spark, sf, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(CASES, schema)
    for clash in ("Score", "row", "digest", "name", "count", "words", "Kept", "key", "pass", "doc", "label"):
        docs = docs.withColumn(clash, F.lit("clash"))
    name, f = corpus_pipeline.STAGES[stage]
    out = f(spark, docs, sf)
    rows = out.collect()
    assert f(spark, docs.limit(0), sf).collect() == []
    if stage < 4:
        assert out.columns == docs.columns and all(r.Score == r.key == "clash" for r in rows)
    ids = sorted((r.doc_id for r in rows), key=repr)
    if name == "exact_duplicates":
        assert ids == [3, 4, 5, 6, None]  # the empty text is the one with white space
    elif name == "near_duplicates":
        assert {r.text for r in rows} >= {None, "", " \n ", "x " * 30_000, "lonely words"} and ids.count(5) == 1
    elif name == "mixed_sources":
        assert all(r.n_chars == len(r.text) for r in rows) and set(ids) <= {1, 3, 4, 5, None}
    elif name == "packed_sequences":
        assert {r.doc_id for r in rows} == {r[0] for r in CASES}


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
