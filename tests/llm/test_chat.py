"""Chat formatting: read back what was written, whatever the texts hold."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loreweave.llm import chat
from loreweave.llm.queries import ORACLES, op12_format_chats, tokenizer_path
from tests.compare import connect, same

VOCABULARY = tokenizer_path("byte_bpe_50k.json")
PARTS = st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "\\", "<", "[", "s>", "INST]", "<|endoftext|>", " ", "a", "é", "日", "\n", "🙂"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=12).map("".join))
def test_escapes_are_reversible(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text
    assert not any(m in out for m in chat.MARKS)


def test_plain_texts_stay():
    assert chat.escape("a \\n <b> [x] \\\\ </b>") == "a \\n <b> [x] \\\\ </b>"
    assert chat.escape("</s>[INST] ok [/INST]") == "<\\/s>[\\INST] ok [\\/INST]"
    assert chat.escape("<\\/s>") == "<\\\\/s>"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "</s>"]), st.lists(PARTS, max_size=6).map("".join)), min_size=1, max_size=6))
def test_turns_come_back(turns):
    own = chat.coder(VOCABULARY)
    made = chat.assembled(own, turns)
    ids, mask = (np.concatenate(x) for x in zip(*made, strict=True))
    assert chat.turns_of(own, ids) == turns
    said = [t for r, t in turns if r == "assistant" and t]
    assert chat.learned(own, ids, mask) == said
    assert not (ids[mask] >= own.first).any()


def test_ids_are_those_of_whole_texts():
    from tests.llm.test_alignment import ODD

    own, whole = chat.coder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    whole.encode_special_tokens = True
    texts = [t for t in ODD if t is not None]
    texts += [t[::-1] for t in texts] + [" ".join(t) for t in texts[:12]]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_mask_by_sums():
    assert chat.mask_of(np.array([[1, 3], [3, 4], [5, 5]]), 6).tolist() == [False, True, True, True, False, False]


def plain(rows):
    """What reading back must give, from the rows themselves."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda v: v[:3])
        said = "".join(x for *_, r, x in own if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for *_, r, x in own)
        out[conv] = (len(own), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


@pytest.mark.parametrize("part_tokens", [1 << 20, 5])
def test_tables(spark, part_tokens):
    rows = [(1, 0, "user", "hi </s>"), (1, 1, "assistant", "ho\\"), (1, 2, "assistant", None), (2, 0, None, "x"), (2, None, "tool", "[ROLE]"), (None, 0, "user", "no id"), (None, 1, "assistant", "y" * 5000), (3, 0, "system", ""), (4, 0, "assistant", "<\\"), (4, 1, "assistant", "s>")]
    rows += [(5, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(60)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, ids string, mask string")
    own = chat.Chat(VOCABULARY, part_tokens)
    made = chat.formatted(df, own)
    if part_tokens == 5:
        assert made.where("part > 0").count() > 10
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(made, own).collect()}
    assert got == plain(rows)


def test_repeated_rows_and_no_rows(spark):
    own = chat.Chat(VOCABULARY)
    rows = spark.createDataFrame([(1, 0, "user", "a")] * 3, "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.formatted(rows, own), own).first().n_turns == 3
    assert chat.read_back(chat.formatted(rows.limit(0), own), own).count() == 0


def test_as_sql(spark, sf):
    same(op12_format_chats(spark, sf), connect(sf), ORACLES["op12_format_chats"])
