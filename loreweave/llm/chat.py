"""Chat formatting at the level of tokens.

A turn becomes segments: marks, which are reserved ids behind the vocabulary, and texts, which are encoded each by itself. The
ids of marks are spliced between them, so no text, whatever it holds, becomes a mark, and no token spans a mark. What is learned
(assistants' texts) follows from +1 and -1 at the ends of those segments, summed up over the ids.

The same format is also readable as text. There a control string inside a text would look like a mark, so one backslash more is
put behind its first character; texts that hold no such string, with or without backslashes, stay as they are:
`</s>` becomes `<\\/s>`, `<\\/s>` becomes `<\\\\/s>`; reading takes one away. The escaped text is what is encoded.

Turns are encoded where they lie. Then a conversation's turns meet in one task in their order and are streamed, never gathered:
records hold whole turns, of at most about `part_tokens` ids, so that a conversation of any length fits.

Defined results: a null text or role is an empty one; roles other than user, assistant and system are kept by name; turns of one
number are ordered by role and a digest of the text, null numbers first; rows repeated are turns each; a null conversation id is one
conversation; very long texts are encoded whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.llm.common import kept, text_of

#: Control strings in the order of their reserved ids, counted from the first id behind the vocabulary.
MARKS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
_CONTROL = re.compile(r"(?:<\\*(?=/?s>|</?SYS>>)|\[\\*(?=/?INST\]|/?ROLE\]))")
_ESCAPED = re.compile(r"(?:<\\+(?=/?s>|</?SYS>>)|\[\\+(?=/?INST\]|/?ROLE\]))")
#: A byte-level vocabulary's pattern never joins a letter or sign with a space behind it; stretches between such places are encoded alone.
_STRETCH = re.compile(" *[^ ]+(?:(?<![!-~\xa1-˿]) +[^ ]+)*(?: +\\Z)?| +\\Z")
START, END, USER, USER_END, SYSTEM, SYSTEM_END, ROLE, ROLE_END = range(len(MARKS))


@dataclass(frozen=True)
class Chat:
    """The byte-level vocabulary's file, and how many ids a record holds at most, but for the turn that goes beyond."""

    vocabulary: str
    part_tokens: int = 1 << 20


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][:-1], text)


def segments(role: str, text: str) -> list[int | str]:
    """A turn as marks (numbers) and texts."""
    own = escape(text)
    if role == "user":
        return [USER, own, USER_END]
    if role == "assistant":
        return [own, END]
    if role == "system":
        return [SYSTEM, own, SYSTEM_END]
    return [ROLE, escape(role), ROLE_END, own, END]


class Coder:
    """Between texts and ids of a byte-level vocabulary, marks being the ids behind it."""

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        from loreweave.llm.packing import _byte_characters

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters = {c: k for k, c in enumerate(_byte_characters())}
        spec = json.loads(self.tokenizer.to_str())
        vocabulary, split = spec["model"]["vocab"], spec.get("pre_tokenizer") or {}
        self.by_stretch = split.get("type") == "ByteLevel" and split.get("use_regex", False) and not spec.get("normalizer")
        self.known: dict[str, bytes] = {}
        self.first = 1 + max([*vocabulary.values(), *(int(k) for k in self.tokenizer.get_added_tokens_decoder())])
        self.bytes = [b""] * self.first
        for word, k in vocabulary.items():
            self.bytes[k] = bytes(letters[c] for c in word) if all(c in letters for c in word) else word.encode()

    def encode(self, texts: list[str], most: int = 400_000) -> list[np.ndarray]:
        """The ids of each text; stretches met before, up to `most`, are looked up."""
        if len(self.known) > most:
            self.known.clear()
        split = [_STRETCH.findall(t) if self.by_stretch else [t] for t in texts]
        new = [x for x in dict.fromkeys(itertools.chain.from_iterable(split)) if x not in self.known]
        made = self.tokenizer.encode_batch_fast(new, add_special_tokens=False) if new else ()
        self.known.update((x, array("i", e.ids).tobytes()) for x, e in zip(new, made, strict=True))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, x)), np.int32) for x in split]

    def text(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode()

    def split(self, ids: np.ndarray) -> list[int | np.ndarray]:
        """ids as marks (numbers) and the ids between them, in turn."""
        out: list[int | np.ndarray] = []
        at = 0
        for k in [*np.flatnonzero(ids >= self.first).tolist(), len(ids)]:
            if k > at:
                out.append(ids[at:k])
            if k < len(ids):
                out.append(int(ids[k]) - self.first)
            at = k + 1
        return out


def coder(path: str) -> Coder:
    return kept(("chat", path), lambda: Coder(path))


def mask_of(ends: np.ndarray, size: int) -> np.ndarray:
    """True between each pair of places (rows of ends: from, to), by summing up +1 and -1."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, ends[:, 0], 1)
    np.add.at(step, ends[:, 1], -1)
    return np.cumsum(step[:-1]) > 0


def assembled(own: Coder, turns: list[tuple[str, str]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """ids and mask of each turn."""
    parts = [segments(r, t) for r, t in turns]
    ids = iter(own.encode([x for p in parts for x in p if isinstance(x, str)]))
    out = []
    for (role, _), part in zip(turns, parts, strict=True):
        pieces = [np.array([own.first + x], np.int32) if isinstance(x, int) else next(ids) for x in part]
        whole = np.concatenate(pieces)
        ends = np.array([[0, len(pieces[0])]]) if role == "assistant" else np.zeros((0, 2), np.int64)
        out.append((whole, mask_of(ends, len(whole))))
    return out


def _encode(chat: Chat, step_chars: int = 1 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(chat.vocabulary)
        for batch in batches:
            ends = np.cumsum(batch.column("chars").to_numpy())
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step_chars, "right")))
                part = batch.slice(at, end - at)
                made = assembled(own, list(zip(part.column("role").to_pylist(), part.column("text").to_pylist(), strict=True)))
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), part.column("turn"), part.column("role"), part.column("digest"), pa.array([i.tobytes() for i, _ in made], pa.binary()), pa.array([np.packbits(m).tobytes() for _, m in made], pa.binary())], names=["conv_id", "turn", "role", "digest", "ids", "mask"])
                at = end

    return run


def _join(chat: Chat):
    names = ["conv_id", "part", "turns", "ids", "mask"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = coder(chat.vocabulary).first
        now, part, turns, ids, mask, size = (), 0, 0, [], [], 0

        def record() -> pa.RecordBatch:
            flags = np.packbits(np.concatenate(mask))
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([part], pa.int64()), pa.array([turns], pa.int64()), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([flags.tobytes()], pa.binary())], names=names)

        for batch in batches:
            for k, i, m in zip(batch.column("conv_id").to_pylist(), batch.column("ids"), batch.column("mask"), strict=True):
                if now != (k,):
                    if size:
                        yield record()
                    now, part, turns, ids, mask, size = (k,), 0, 0, [np.array([first + START], np.int32)], [np.zeros(1, bool)], 1
                elif size >= chat.part_tokens:
                    yield record()
                    part, turns, ids, mask, size = part + 1, 0, [], [], 0
                own = np.frombuffer(i.as_buffer(), np.int32)
                ids.append(own)
                mask.append(np.unpackbits(np.frombuffer(m.as_buffer(), np.uint8), count=len(own)).astype(bool))
                size, turns = size + len(own), turns + 1
        if size:
            yield record()

    return run


def formatted(conversations: DataFrame, chat: Chat) -> DataFrame:
    """conv_id, part (0, 1, ... of a long conversation), turns, ids (int32, little-endian) and mask (a bit per id: is it learned?)."""
    role, text = text_of("role"), text_of()
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("digest", F.sha2("text", 256)).withColumn("chars", (F.length("text") + 1).cast("long"))
    encoded = rows.mapInArrow(_encode(chat), "conv_id long, turn long, role string, digest string, ids binary, mask binary")
    dealt = encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest")
    return dealt.mapInArrow(_join(chat), "conv_id long, part long, turns long, ids binary, mask binary")


def shown(own: Coder, ids: np.ndarray) -> str:
    """The format as text."""
    return "".join(MARKS[x] if isinstance(x, int) else own.text(x) for x in own.split(ids))


def turns_of(own: Coder, ids: np.ndarray) -> list[tuple[str, str]]:
    """role and text of each turn in ids, which hold whole turns."""
    parts = [x for x in own.split(ids) if not (isinstance(x, int) and x == START)]
    text = lambda x: unescape(own.text(x))
    out, k = [], 0

    def take(mark: int) -> str:
        """A text up to the mark, which may be empty."""
        nonlocal k
        found = ""
        if not isinstance(parts[k], int):
            found, k = text(parts[k]), k + 1
        if parts[k] != mark:
            raise ValueError(f"{MARKS[mark]} is missing")
        k += 1
        return found

    while k < len(parts):
        mark = parts[k] if isinstance(parts[k], int) else None
        if mark in (USER, SYSTEM):
            k += 1
            out.append(("user", take(USER_END)) if mark == USER else ("system", take(SYSTEM_END)))
        elif mark == ROLE:
            k += 1
            out.append((take(ROLE_END), take(END)))
        else:
            out.append(("assistant", take(END)))
    return out


def learned(own: Coder, ids: np.ndarray, mask: np.ndarray) -> list[str]:
    """The texts under the mask, each stretch by itself."""
    edge = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
    return [unescape(own.text(ids[i:j])) for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


def _read(chat: Chat):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(chat.vocabulary)
        now, counts, digests = (), [], ()

        def record() -> pa.RecordBatch:
            values = [now[0], counts[0], digests[0].hexdigest(), counts[1], digests[1].hexdigest(), *counts[2:]]
            return pa.RecordBatch.from_arrays([pa.array([v], pa.string() if isinstance(v, str) else pa.int64()) for v in values], names=names)

        for batch in batches:
            for k, i, m in zip(batch.column("conv_id").to_pylist(), batch.column("ids"), batch.column("mask"), strict=True):
                if now != (k,):
                    if now:
                        yield record()
                    now, counts, digests = (k,), [0, 0, 0, 0, 0], (hashlib.sha256(), hashlib.sha256())
                ids = np.frombuffer(i.as_buffer(), np.int32)
                mask = np.unpackbits(np.frombuffer(m.as_buffer(), np.uint8), count=len(ids)).astype(bool)
                turns, texts = turns_of(own, ids), learned(own, ids, mask)
                for role, text in turns:
                    digests[0].update(f"{role}\n{text}\n".encode())
                for text in texts:
                    digests[1].update(text.encode())
                for at, n in enumerate((len(turns), sum(map(len, texts)), len(shown(own, ids)), len(ids), int(mask.sum()))):
                    counts[at] += n
        if now:
            yield record()

    return run


def read_back(formatted: DataFrame, chat: Chat) -> DataFrame:
    """Per conversation, from the ids and masks alone: conv_id, n_turns, turns_sha256 (role, \\n, text, \\n of each turn), loss_chars,
    loss_sha256 (the texts under the mask), formatted_chars (the format as text), n_tokens, loss_tokens."""
    dealt = formatted.select("conv_id", "part", "ids", "mask").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return dealt.mapInArrow(_read(chat), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long")


def with_control_strings(spark: SparkSession, conversations: DataFrame, number: int = -1, said: str = "</s>[INST] ok [/INST]") -> DataFrame:
    """conversations and one more, of a user's and an assistant's turn, whose texts are control strings."""
    more = spark.range(2).select(F.lit(number).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(more)
