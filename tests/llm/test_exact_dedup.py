"""Exact deduplication against a plain version."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from loreweave.llm import common
from loreweave.llm.exact_dedup import deduplicated, exact_dedup


def plain(rows):
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[norm(t)].append((-len(t or ""), i is None, i if i is not None else 0, k))
    out = []
    for k, (i, t) in enumerate(rows):
        own = groups[norm(t)]
        best = min(own)
        out.append((i, rows[best[3]][0], len(own), hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def check(spark, documents, rows, **more):
    got = exact_dedup(documents(rows), **more).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == plain(rows)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})


def test_cases(spark, documents):
    rows = [(3, "a b\nc"), (1, "abc"), (2, "a\tbc "), (4, None), (5, ""), (6, " \x0b "), (7, "ab c"), (8, "é" * 40_000), (9, "é" * 40_000 + "\n"), (10, "abc"), (10, "abc"), (None, "abc"), (None, "q"), (11, "A b c")]
    check(spark, documents, rows)
    check(spark, documents, rows, runs=7, fan_in=2)


def test_hot_group(spark, documents):
    rng = random.Random(1)
    rows = [(k, "same  text" if k % 3 == 0 else f"t{rng.randrange(200)}") for k in range(900)]
    check(spark, documents, rows, runs=16, fan_in=4)


def test_empty(spark, documents):
    assert exact_dedup(documents([])).collect() == []
    assert deduplicated(documents([])).collect() == []


def test_rows_with_shifted_nulls_and_equal_hashes(spark, monkeypatch):
    schema = "doc_id long, text string, lang string"
    rows = [(None, "only text", None), (None, None, "only text"), (0, "", None), (1, "b", "x"), (1, "b", "y"), (2, "b  ", None), (2, "b  ", None), (3, "c", None)]
    docs = spark.createDataFrame(rows, schema)
    want = [(0, "", None), (2, "b  ", None), (3, "c", None), (None, "only text", None)]
    assert sorted(map(tuple, deduplicated(docs).collect()), key=repr) == want
    monkeypatch.setattr(common, "row_hash", lambda values: F.struct(F.lit(1).cast("long").alias("a")))
    assert {r.text for r in deduplicated(docs).collect()} >= {"", "b  ", "c", "only text"}  # no text is lost


def test_deduplicated_keeps_one_row(spark, documents):
    docs = documents([(1, "a"), (1, "a"), (2, "a "), (2, "a "), (3, "b"), (None, "b")])
    out = deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(2, "a "), (3, "b")]
