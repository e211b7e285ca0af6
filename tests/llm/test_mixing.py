"""Mixing: targets, permutations, and sums near the targets."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loreweave.llm import common
from loreweave.llm.mixing import Mix, mixed_documents, mixed_sizes, output_slots, permute, targets

SCHEMA = "doc_id long, text string, source string, size long, bucket string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, -1, "clash") for r in rows], SCHEMA)


def test_targets_cap_and_share_the_excess():
    t = targets({"b": 100, "a": 1000, None: 400, "c": 50}, Mix())
    assert t["b"] == 200 and t["c"] == 100  # capped
    assert t["a"] + t[None] == pytest.approx(1.5 * 1550 - 300)
    assert t["a"] / t[None] == pytest.approx(5 / 5) or t["a"] <= 2000
    assert targets({}, Mix()) == {}
    assert targets({"a": 0}, Mix()) == {"a": 0.0}


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1000, 65_537])
def test_permutation(n):
    out = permute(np.arange(n), n, 99)
    assert sorted(out.tolist()) == list(range(n))
    assert n < 100 or out.tolist() != list(range(n))


def test_sums(spark):
    rows = [(k, " ".join(f"w{j}" for j in range(20 + k % 60)), ["x", "y", "z", None, "v"][k % 5] if k % 3 else "hot") for k in range(1500)]
    rows += [(9000, None, "x"), (9001, " \n", None), (9002, "one two", "tiny"), (9003, "one", "y"), (9003, "one", "y")]
    df = docs(spark, rows)
    got = mixed_sizes(df).collect()
    assert len(got) == len(rows)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixed_sizes(df.repartition(7)).collect()), key=repr)
    source, by = {i: x for i, _, x in rows}, {}
    for r in got:
        assert r.taken <= 2 * r.size
        by.setdefault((source[r.doc_id], r.target, r.source_size), []).append(r.taken)
    assert len(by) == len({x for _, _, x in rows})
    for (name, target, size), own in by.items():
        assert size == sum(r.size for r in got if source[r.doc_id] == name)
        assert sum(own) == round(target)


def test_small_sources_at_their_cap_are_taken_whole(spark):
    rows = [(k, " ".join(f"w{j}" for j in range(50)), "b") for k in range(100)]
    rows += [(500, "one two three", "a"), (501, " ".join(f"v{j}" for j in range(37)), "c"), (502, "last", None)]
    got = {r.doc_id: r for r in mixed_sizes(docs(spark, rows)).collect()}
    for k in (500, 501, 502):
        assert got[k].taken == got[k].target == 2 * got[k].size


def test_every_source_takes_its_target_over_many_shards(spark):
    plan = [(48_000.5, 40_000), (33.0, 16), (64.0, 32), (159.6, 80), (320.0, 160), (14.0, 7), (0.0, 0), (5.0, 100), (101.0, 100), (0.4, 9)]
    plan = [(min(t, 2.0 * n), n) for t, n in plan]
    mix = Mix(block=16, shard_slots=32)
    rows = output_slots(spark, plan, mix).collect()
    assert len({(r.sid, r.block, r["pass"]) for r in rows}) == len(rows)
    shards = [r.shard for r in rows]
    assert max(shards) > 80 and all(shards.count(k) == mix.shard_slots for k in range(max(shards)))
    words = lambda r: min(r.upto, plan[r.sid][1] - 16 * r.block)
    for sid, (target, _) in enumerate(plan):
        assert sum(words(r) for r in rows if r.sid == sid) == round(target), sid


def test_inverse_permutation():
    for n in (1, 2, 5, 1000, 4099):
        assert permute(permute(np.arange(n), n, 7), n, 7, inverse=True).tolist() == list(range(n))


def test_small_sources_in_a_mix_of_many_shards(spark):
    rows = [(k, " ".join(f"w{j}" for j in range(50)), "b") for k in range(100)]
    rows += [(500, "one two three", "a"), (501, " ".join(f"v{j}" for j in range(37)), "c"), (502, "last", None)]
    got = {r.doc_id: r for r in mixed_sizes(docs(spark, rows), Mix(block=16, shard_slots=16)).collect()}
    assert all(got[k].taken == got[k].target == 2 * got[k].size for k in (500, 501, 502))


def plain_text(text, first, n):
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text.encode())]
    return text.encode()[spans[first][0] : spans[first + n - 1][1]].decode()


@pytest.mark.parametrize("block", [16, 64, 1024])
def test_documents_hold_the_words_taken(spark, block):
    rows = [(k, "\n".join(f"d{k}w{j}" for j in range(5 + 7 * (k % 40))), "ab"[k % 2]) for k in range(200)]
    df, mix = docs(spark, rows), Mix(block=block, shard_slots=64)
    out = mixed_documents(df, mix)
    assert out.columns == df.columns
    taken = {r.doc_id: r.taken for r in mixed_sizes(df, mix).collect()}
    words, whole = {}, dict((k, t) for k, t, _ in rows)
    for r in out.collect():
        own = r.text.split()
        words[r.doc_id] = words.get(r.doc_id, 0) + len(own)
        at = [int(w.split("w")[1]) for w in own]
        assert at == list(range(at[0], at[0] + len(at)))  # no gap
        assert r.text == (whole[r.doc_id] if len(at) == len(whole[r.doc_id].split()) else plain_text(whole[r.doc_id], at[0], len(at)))
    assert words == {k: v for k, v in taken.items() if v}


def test_rows_with_nulls_in_other_columns(spark, monkeypatch):
    schema = "doc_id long, text string, lang string, source string"
    rows = [(1, "one text here", None, "a"), (1, "one text here", "a", None), (2, "other words", "de", "a"), (2, "other words", "de", "a"), (None, "lonely", None, None)]
    df = spark.createDataFrame(rows, schema)
    for constant in (False, True):
        if constant:
            monkeypatch.setattr(common, "row_hash", lambda values: F.struct(F.lit(1).cast("long").alias("a")))
        out = mixed_documents(df, Mix(total=9)).collect()
        assert set(map(tuple, out)) == set(rows)
        assert sum(len(r.text.split()) for r in out) == 2 * sum(len(t.split()) for _, t, *_ in rows)


def test_empty(spark):
    assert mixed_sizes(docs(spark, [])).collect() == []
    assert mixed_documents(docs(spark, [])).collect() == []
    assert [r.taken for r in mixed_sizes(docs(spark, [(1, None, None)])).collect()] == [0]
