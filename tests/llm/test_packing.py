"""Packing: every id in one piece, sequences without gaps or padding."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loreweave.llm.packing import Encoder, Plan, locate, pack
from loreweave.llm.queries import tokenizer_path


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=12))
def test_plan_fills_every_sequence(counts):
    plan = Plan(dict(counts), 64)
    length = np.repeat(np.array(list(counts), np.int64), list(counts.values())) if counts else np.empty(0, np.int64)
    number = np.concatenate([np.arange(n) for n in counts.values()]) if counts else np.empty(0, np.int64)
    row = np.arange(len(length))
    used = defaultdict(list)
    for r, s, n, q, o in locate(plan.arrays(), length, number, row, np.zeros(len(length), np.int64)):
        for k in range(len(r)):
            used[int(q[k])].append((int(o[k]), int(n[k])))
            assert 0 <= s[k] and s[k] + n[k] <= length[r[k]]
    assert sum(n for own in used.values() for _, n in own) == int(length.sum())
    for own in used.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at == 64 or at & (at - 1) == 0


def test_words_encode_as_whole_texts():
    path = tokenizer_path()
    whole, own = Tokenizer.from_file(path), Encoder(path, "H", 1)
    texts = ["", " \n", "Hello, world's 123!", "it's don't!!'s _a_", "a <|endoftext|> b<|startoftext|>c", "Ünïcode ß Ω ΣΑΣ 日本語 ﬁ é", " x　y\u0085z", "²³ ×÷ ª\x00b \x1cq", "x" * 3000, "tab\tand\x0bmore\x0c"] * 2
    ids, ends = own.encode(texts)
    at = 0
    for text, end, e in zip(texts, ends.tolist(), whole.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids[at:end].tolist() == [*e.ids, 1], text
        at = end


def test_pieces(spark, documents):
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 999, int(rng.integers(1, 60))))) for k in range(120)]
    rows += [(500, None), (501, ""), (502, "word " * 900), (503, "same"), (503, "same"), (None, "null id")]
    got = pack(documents(rows), tokenizer_path(), window=128, buckets=8).collect()
    whole = Tokenizer.from_file(tokenizer_path())
    ids = [[*whole.encode(t or "", add_special_tokens=False).ids, 1] for _, t in rows]
    assert sum(r.length for r in got) == sum(map(len, ids))
    by, seq = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append((r.offset, r.length))
    for (i, _), own in zip(rows, ids, strict=True):
        if i == 503:
            continue
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(own)
            assert np.frombuffer(bytes(r.ids), "<u4").tolist() == own[at : at + r.length]
            at += r.length
        assert at == len(own)
    for own in seq.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at == 128 or at & (at - 1) == 0


def test_equal_lengths_are_cut(spark, documents):
    got = pack(documents([(k, "word " * 29) for k in range(40)]), tokenizer_path(), window=64).collect()
    total = defaultdict(int)
    for r in got:
        total[r.sequence_id] += r.length
    assert sum(total.values()) == 40 * 30 and all(n == 64 or n & (n - 1) == 0 for n in total.values())


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_tiny(spark, documents, rows):
    assert len(pack(documents(rows), tokenizer_path()).collect()) == len(rows)
