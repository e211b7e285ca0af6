"""Importance resampling: against a plain version, and the merge against a sort."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loreweave.llm import importance
from loreweave.llm.importance import Draw, resample
from loreweave.llm.queries import ORACLES, op13_importance_resample
from tests.compare import connect, same


def plain(rows, target, draw):
    """Rows of (id, n_features, weight, score, rank), by counting and sorting."""

    def features(text):
        w = importance.words_of(text or "")
        return [" ".join(w[k : k + n]) for n in range(1, draw.n + 1) for k in range(len(w) - n + 1)], len(w)

    bucket = lambda f: zlib.crc32(f.encode()) % draw.buckets
    own = [features(t) for _, t in rows]
    s = Counter(map(bucket, chain.from_iterable(f for f, _ in own)))
    t = Counter(map(bucket, chain.from_iterable(features(x)[0] for x in target)))
    n, m = sum(s.values()) + draw.buckets, sum(t.values()) + draw.buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * n / ((s[b] + 1.0) * m)))
    out = []
    for (i, _), (f, words) in zip(rows, own, strict=True):
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{draw.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= draw.least_words])
    eligible = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    rank = {id(r): k for k, r in enumerate(eligible, 1) if k <= draw.percent * len(eligible) // 100}
    return sorted((tuple([*r[:4], rank.get(id(r))]) for r in out), key=repr)


def texts(rng, n):
    return [" ".join(rng.choice(["Red", "blue", "green7", "ÉTÉ", "sun-set", "x_y"], int(rng.integers(0, 9)))) for _ in range(n)]


@pytest.mark.parametrize("draw", [Draw(least_words=3, percent=40), Draw(least_words=0, percent=100, run_rows=7, range_rows=5, block_rows=2), Draw(n=3, least_words=2, percent=30, range_rows=3, block_rows=1), Draw(percent=10, least_words=50)])
def test_as_plain(spark, documents, draw):
    rng = np.random.default_rng(1)
    rows = [*enumerate(texts(rng, 150)), (900, None), (901, ""), (902, "word " * 30_000), *[(7, "red blue green7")] * 30, *[(None, "sun-set blue")] * 40, (None, "other")]
    target = ["blue blue ÉTÉ", "green7", None, ""]
    got = resample(documents(rows), spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string"), draw)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows, target, draw)


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_tiny(spark, documents, rows):
    target = spark.createDataFrame([], "text string")
    assert [tuple(r)[:3] + (r.rank,) for r in resample(documents(rows), target).collect()] == [(i, 0, 0, None) for i, _ in rows]


def test_one_score_of_many_ids_is_cut():
    """Ranges inside one score follow the ids, null ids last."""
    low = np.iinfo(np.int64).min
    ranges = importance.Ranges(np.array([-9, -5, -5, -5, -2]), np.array([low, low, 10, 20, low]))
    rows = np.zeros(8, importance._ROW)
    rows["down"], rows["id"] = [-9, -5, -5, -5, -5, -5, -4, -2], [3, 9, 10, 19, 20, 0, 1, 1]
    rows["null"][5] = 1
    assert ranges.of(rows).tolist() == [0, 1, 2, 2, 3, 3, 3, 4]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(-3, 3), st.integers(0, 4)), max_size=12), max_size=7), st.integers(1, 4))
def test_tournament_sorts(runs, block):
    made = []
    for own in runs:
        rows = np.zeros(len(own), importance._ROW)
        rows["n"] = 1
        if own:
            rows["down"], rows["id"] = zip(*own, strict=True)
        rows = importance.collapsed(rows)
        made.append(iter([rows[k : k + block] for k in range(0, len(rows), block)]))
    got = [(int(r["down"]), int(r["id"])) for part in importance.tournament(made) for r in part for _ in range(int(r["n"]))]
    assert got == sorted(chain.from_iterable(runs))


def test_as_sql(spark, sf):
    same(op13_importance_resample(spark, sf), connect(sf), ORACLES["op13_importance_resample"])
