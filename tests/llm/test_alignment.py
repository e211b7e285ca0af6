"""Alignment of two tokenizers against one that walks the bytes of whole texts."""

from __future__ import annotations

import hashlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from loreweave.llm import alignment
from loreweave.llm.alignment import Aligner, Pair, align, blocks_of, overlaps, token_overlaps
from loreweave.llm.queries import op11_align_tokenizers, tokenizer_path
from loreweave.sources.tables import table

PAIR = Pair(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
ODD = [
    None, "", " ", "  ", "\n", "a", " a ", "a  b", "a \n  b\t c ", "x=  1;\n\n\treturn", "it's  we'll", "</s><s>[INST]", "<|endoftext|> x <unk>", "▁ mark", "Ωμέγα Ά ﬁ", "日本語 の 文 です。 次", "🙂🙃 👩‍👩‍👧 x", "é è à",
    "a b c  d", "​ ﻿ x", "tab\t  end  ", "\x00 a \x1c b\x1c c", "!!! ... ??? --", "word " * 700, "y" * 4000, "Ａ　Ｂ　c", "a\r\n b \r c", "½ ² Ⅷ ½", "́ x", "é e", "  a", "12345 67 8",
]


def plain(rows):
    a, b = Tokenizer.from_file(PAIR.a), sentencepiece.SentencePieceProcessor(model_file=PAIR.b)
    a.encode_special_tokens = True
    shown = Aligner(PAIR)  # for the bytes of ids
    out, held = [], Counter()
    for i, text in rows:
        groups = []
        if text:
            s = f" {text}".encode()
            ta, tb = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
            if b"".join(shown.bytes_a[x] for x in ta) == s == b"".join(shown.bytes_b[x] for x in tb):
                p = q = x = y = 0
                own = ([], [])
                while p < len(ta) or q < len(tb):
                    if x <= y and p < len(ta):
                        own[0].append(ta[p])
                        x += len(shown.bytes_a[ta[p]])
                        p += 1
                    else:
                        own[1].append(tb[q])
                        y += len(shown.bytes_b[tb[q]])
                        q += 1
                    if x == y:
                        groups.append(own)
                        own = ([], [])
        links = Counter((x, y) for xs, ys in groups for x in xs for y in ys)
        held.update(links.keys())
        out.append((i, groups, links))
    best = Counter()
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    done = []
    for i, groups, links in out:
        written = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        digest = hashlib.sha256(written.encode()).hexdigest() if groups else ""
        done.append((i, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()), sum(n for k, n in links.items() if held[k] == best[k[0]]), sum(n * held[k] for k, n in links.items()), digest))
    return sorted(done, key=repr)


def collected(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)


@pytest.mark.parametrize("block_bytes", [4 << 20, 300])
def test_odd_texts(spark, documents, block_bytes):
    rows = [*enumerate(ODD), (None, "null id here"), (3, "again"), (3, "again"), *[(100 + k, "one very common sentence, said often") for k in range(40)]]
    assert collected(align(documents(rows), Pair(PAIR.a, PAIR.b, block_bytes, 30))) == plain(rows)


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = collected(op11_align_tokenizers(spark, sf))
    assert got == plain(rows)


def test_wide_groups_are_reduced():
    """A group beyond `wide` gives the same links as one multiplied out."""
    texts = ["日本語のテキスト" * 40, "abc " * 5, "ÀÀÀÀÀÀ"]
    found = []
    for wide in (1 << 20, 1):
        got = Aligner(Pair(PAIR.a, PAIR.b, wide=wide)).align(texts)
        found.append([got[k].tolist() for k in ("place", "link", "times", "n_links")])
    assert found[0] == found[1]


def test_overlaps():
    ia, ib, at, group = overlaps(np.array([2, 3, 1]), np.array([1, 1, 2, 2]))
    assert list(zip(ia.tolist(), ib.tolist(), at.tolist(), group.tolist(), strict=True)) == [(0, 0, 0, 0), (0, 1, 1, 0), (1, 2, 2, 1), (1, 3, 4, 1), (2, 3, 5, 1)]


def test_token_overlaps(spark, documents):
    got = token_overlaps(documents([(1, "a naïve test"), (2, None), (3, "▁")]), PAIR).collect()
    assert {r.doc_id for r in got} == {1} and min(r.first_byte for r in got) == 0
    assert all(x.group <= y.group for x, y in zip(got, got[1:], strict=False))


def test_no_rows(spark, documents):
    assert align(documents([]), PAIR).count() == 0


def test_rows_stay_small(spark, documents):
    """What is written of a block is a row for each document, and no row holds more than its share of the block's links."""
    rows = [(k, f"sentence {k} says w{k} twice, w{k}") for k in range(400)]
    got = blocks_of(documents(rows).coalesce(1), PAIR).collect()
    assert len({r.block for r in got}) == 1 and sorted(r.id for r in got) == list(range(400))
    links = [x for r in got for x in r.links]
    assert len(links) == len(set(links)) and sum(sum(r.documents) for r in got) == sum(len(r.place) for r in got)
    assert max(len(r.links) for r in got) - min(len(r.links) for r in got) <= 1


def test_workers_hold_a_piece_at_once(monkeypatch, spark):
    """A block is aligned piece by piece, with the same result; what is known is forgotten between pieces too."""
    texts = [f"piece {k} of a block {k * 7}" for k in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array(texts), pa.array([len(t) for t in texts], pa.int64())], ["id", "text", "bytes"])
    monkeypatch.setattr(alignment, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    align_texts, got = Aligner.align, []
    for pair in (Pair(PAIR.a, PAIR.b), Pair(PAIR.a, PAIR.b, most=30, piece_bytes=500)):
        sizes = []
        monkeypatch.setattr(Aligner, "align", lambda self, x: sizes.append((sum(map(len, x)), len(self.number))) or align_texts(self, x))
        got.append((pa.Table.from_batches(alignment._blocks(pair)(iter([batch]))).to_pylist(), sizes))
    assert got[0][0] == got[1][0] and len(got[0][1]) == 1 and len(got[1][1]) > 5
    assert max(n for n, _ in got[1][1]) <= 500 and max(k for _, k in got[1][1]) < 30 + 200
