"""Near duplicates against a plain version over all pairs."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loreweave.llm import common
from loreweave.llm.common import materialize
from loreweave.llm.components import components
from loreweave.llm.near_dedup import Near, NearDuplicates, bucket_keys, deduplicated, near_components, shingles, signatures


def plain(rows, words, percent=80):
    def own(t):
        w = (t or "").encode().lower().split()
        return frozenset([tuple(w)] if 0 < len(w) < words else [tuple(w[k : k + words]) for k in range(len(w) - words + 1)])

    sets = [own(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)].append(i)
    return sorted(((i, len(s), min(least[find(k)], default=None) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def same(documents, rows, words=4):
    got = near_components(documents(rows), Near(words=words)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == plain(rows, words)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        k = rng.randrange(len(out))
        out[k : k + 1] = rng.choice([[], [f"e{rng.randrange(10**6)}"], [out[k], f"i{rng.randrange(10**6)}"]])
    return " ".join(out)


def test_groups_and_cases(spark, documents):
    rng = random.Random(5)
    base = [f"b{k}" for k in range(120)]
    shared = [f"p{k}" for k in range(30)]
    rows = [(k, edited(rng, base, rng.randrange(9))) for k in range(90)]
    rows += [(200 + k, " ".join(shared + [f"r{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 40))])) for k in range(60)]
    rows += [(400, None), (401, ""), (402, " \n"), (403, "a b c"), (404, "A  B c"), (405, "a b"), (406, "É b c d e"), (407, "é b c d e"), (408, "x"), (408, "x"), (None, "a b c"), (None, "lonely words here now ok")]
    same(documents, rows)


def families(n, own, template=300, members=20, seed=9):
    """Documents of one template, in families with `own` words of theirs, one word apart inside a family."""
    rng, out = random.Random(seed), []
    head = [f"t{k}" for k in range(template)]
    for k in range(n):
        mine = [f"f{k // members}w{j}" for j in range(own)]
        mine[rng.randrange(own)] = f"x{k}"
        out.append((k, " ".join([*head, *mine])))
    return out


def test_families_of_one_template(spark, documents):
    """Families too far apart to be linked don't meet: over all pairs across families there would be 600 * 580 / 2."""
    dup = NearDuplicates(documents(families(600, 80)), Near(words=4)).run()
    assert dup.cross.count() <= 600


def test_families_near_the_limit(spark, documents):
    """Templates with families of several sizes around the similarity asked for, some linked over others only."""
    sizes = [(20, 50), (30, 34, 38, 42), (10, 70)]
    rows = [(10000 * t + 1000 * j + i, text.replace("t", f"t{t}_")) for t, own in enumerate(sizes) for j, o in enumerate(own) for i, text in families(60, o, seed=j)]
    same(documents, rows)


def test_long_and_repeating(spark, documents):
    long = " ".join(f"v{k}" for k in range(9000))
    same(documents, [(1, long), (2, long + " tail"), (3, "ha " * 4000), (4, "ha ha ha ha"), (5, "ha " * 3)])


def test_no_word_case_and_empty(spark, documents):
    assert near_components(documents([])).collect() == []
    assert deduplicated(documents([])).collect() == []


def test_deduplicated(spark, documents):
    text = " ".join(f"t{k}" for k in range(60))
    docs = documents([(5, text), (2, text + " more"), (2, text + " more"), (7, "other words stand here alone"), (8, None), (9, None)])
    out = deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [2, 7, 8, 9]


def test_rows_with_shifted_nulls_and_equal_hashes(spark, monkeypatch):
    text = " ".join(f"t{k}" for k in range(60))
    rows = [(None, text, None), (None, None, text), (1, text, "x"), (1, text, "y"), (2, "other words stand here alone", None), (2, "other words stand here alone", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = sorted(map(tuple, deduplicated(docs).collect()), key=repr)
    assert len(out) == 3 and {(r[0], r[1]) for r in out} == {(1, text), (2, rows[4][1]), (None, None)}
    monkeypatch.setattr(common, "row_hash", lambda values: F.struct(F.lit(1).cast("long").alias("a")))
    assert {r.text for r in deduplicated(docs).collect()} == {text, None, rows[4][1]}  # no text is lost
    monkeypatch.undo()
    monkeypatch.setattr(F, "xxhash64", lambda *_: F.lit(5).cast("long"))
    same(lambda x: docs, [(r[0], r[1]) for r in rows], 4)  # sets are found by verified keys


def test_pigeonhole():
    """Signatures that differ in at most `distance` symbols share a key, wherever they differ."""
    near, rng = Near(), np.random.default_rng(2)
    a = rng.integers(0, 1 << 16, (1, near.symbols), np.uint16)
    for _ in range(300):
        b = a.copy()
        at = rng.choice(near.symbols, near.distance, replace=False)
        b[0, at] ^= 1
        assert set(bucket_keys(a, near)[0]) & set(bucket_keys(b, near)[0])
    assert len(set(bucket_keys(a, near)[0])) == near.chunks * near.size


def test_signature_estimates_similarity():
    rng = random.Random(7)
    near = Near(chunks=40)
    words = [f"w{k}" for k in range(2000)]
    a, b = shingles(" ".join(words), 1), shingles(" ".join(rng.sample(words, 1600)), 1)
    sig = signatures([a, b], near)
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.1


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 50)] + [(100, 101), (101, 102), (103, 102)]])
def test_components(spark, edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    want = {(x, find(x)) for x in up if find(x) != x}
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {(r.node, r.root) for r in got.collect()} == want
    assert got.groupBy("node").count().where(F.col("count") > 1).count() == 0


def test_components_without_new_links_take_no_rounds(spark, documents, monkeypatch):
    """Equal to one leader, no group is split: only the first links take rounds, each in one plan that reads its edges four times."""
    from loreweave.llm import components as own

    plans = []
    monkeypatch.setattr(own, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or materialize(df, name))
    words = [f"w{k}" for k in range(100)]
    rows = [(k, " ".join(words[:60] + [f"x{k}"] + words[61:])) for k in range(20)]
    same(documents, rows)
    assert 1 <= len(plans) <= 2
    assert all(p.count("Relation") <= 8 for p in plans)


def test_components_of_known_ones(spark, monkeypatch):
    """What is known already takes no rounds of its own, whatever its size; new links join it."""
    from loreweave.llm import components as own

    known = own.components(spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long"))
    rounds = []
    monkeypatch.setattr(own, "materialize", lambda df, name: rounds.append(name) or materialize(df, name))
    none = spark.createDataFrame([], "a long, b long")
    assert {tuple(r) for r in own.components(none, known).collect()} == {(k, 0) for k in range(1, 41)} | {(101, 100)}
    assert rounds.count("stars") == 1
    joined = own.components(spark.createDataFrame([(101, 7), (50, 50)], "a long, b long"), known)
    assert {tuple(r) for r in joined.collect()} == {(k, 0) for k in (*range(1, 41), 100, 101)}
