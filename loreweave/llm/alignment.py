"""Aligning two tokenizers over the same bytes.

Both tokenizers' ids are laid over the bytes of a text as owner arrays: np.repeat writes each token's index once for each of its
bytes. Where the pair of owners changes, a new overlap begins; where both change at once, both have ended a token: a cut. Cuts
part the text into groups, and a group links each of its A tokens with each of its B tokens.

Neither tokenizer joins a letter with a space behind it, so a text falls into stretches (spaces and what follows them) that
are encoded and aligned alone. A Python worker keeps those it met, up to `most` of them. Texts are handled in blocks of about
`block_bytes`, and within them in pieces of about `piece_bytes`, so what a worker holds at once follows neither the input nor the
block. A block's distinct links (pairs of ids as one number) stand once in it, with the number of documents that hold each, and
every document has the places of its links among them. A document is a row, which carries an equal share of its block's links: no
row is large unless a text is. So what is shuffled to learn the counts of the corpus is a row for each distinct link of a block,
not for each link of a document, no table is broadcast but the highest count of each A id (as many rows as the vocabulary has),
and a link that is everywhere is one row a block.

Defined results: null and empty texts, and those that a tokenizer does not give back byte by byte, have no tokens: all numbers
are 0 and groups are empty; special tokens' strings are plain text; repeated rows are documents each, null ids are kept; a text
is taken whole however long (one longer than block_bytes is a block of its own); a group without a cut for long is reduced to
distinct ids with their numbers before it is multiplied out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import kept, materialize, text_of

#: Spaces and what follows them; a stretch that does not end in a letter or sign of ASCII or Latin goes on.
_STRETCH = re.compile(" +[^ ]+(?:(?<![!-~\xa1-˿]) +[^ ]+)*(?: +\\Z)?| +\\Z")


@dataclass(frozen=True)
class Pair:
    """The files of A (byte-level) and B (pieces with byte fallback, which puts a space in front)."""

    a: str
    b: str
    block_bytes: int = 4 << 20
    most: int = 400_000
    wide: int = 1 << 20  # a group with more pairs of tokens is reduced to distinct ids first
    piece_bytes: int = 1 << 18


def owners(counts: np.ndarray) -> np.ndarray:
    """For each byte the token that holds it, of tokens with so many bytes."""
    return np.repeat(np.arange(len(counts)), counts)


def changes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From two owner arrays: where a new pair of owners begins (byte 0 first), and which of those places are cuts."""
    da, db = np.diff(a, prepend=-1) != 0, np.diff(b, prepend=-1) != 0
    at = np.flatnonzero(da | db)
    return at, (da & db)[at]


def overlaps(counts_a: np.ndarray, counts_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per overlap of an A token and a B token: their indices, its first byte, and its group. The counts sum to the same."""
    a, b = owners(counts_a), owners(counts_b)
    at, cut = changes(a, b)
    return a[at], b[at], at, np.cumsum(cut) - 1


class Aligner:
    """Stretches with what is known of each: numbers of tokens, groups and links, distinct links, and groups as text."""

    def __init__(self, pair: Pair):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        from loreweave.llm.packing import _byte_characters

        self.pair = pair
        self.a = Tokenizer.from_file(pair.a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pair.b)
        letters = {c: k for k, c in enumerate(_byte_characters())}
        vocabulary = json.loads(self.a.to_str())["model"]["vocab"]
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for word, k in vocabulary.items():
            self.bytes_a[k] = bytes(letters[c] for c in word) if all(c in letters for c in word) else word.encode()
        pieces = [self.b.id_to_piece(k) for k in range(len(self.b))]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.whole = any("▁" in p.lstrip("▁") for p in pieces)  # then B may join over a space
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in t]) for t in (self.bytes_a, self.bytes_b))
        self.width = max(1, len(pieces) - 1).bit_length()
        self.bits = self.width + max(1, len(self.bytes_a) - 1).bit_length()
        signs = lambda n, *ends: np.array([[f"{k}{e}".encode() for e in ends] for k in range(n)], object)
        self.signs_a, self.signs_b = signs(len(self.bytes_a), ",", "|"), signs(len(pieces), ",", ";", "")
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.text: list[bytes] = []  # groups of each stretch
        self.known = np.zeros((0, 5), np.int64)  # n_a, n_b, n_groups, first of its links, how many distinct ones; n_a -1: not given back
        self.links, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def stretches(self, text: str) -> list[str]:
        return [f" {text}"] if self.whole else _STRETCH.findall(f" {text}")

    def encode(self, new: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return [x.ids for x in self.a.encode_batch_fast(new, add_special_tokens=False)], self.b.encode([x[1:] for x in new], num_threads=1)

    def learn(self, new: list[str]) -> None:
        """Aligns new stretches, all in one pass over their bytes."""
        all_a, all_b = self.encode(new)
        good = [b"".join(map(self.bytes_a.__getitem__, a)) == (s := x.encode()) and b"".join(map(self.bytes_b.__getitem__, b)) == s for x, a, b in zip(new, all_a, all_b, strict=True)]
        known = np.full((len(new), 5), [-1, 0, 0, len(self.links), 0], np.int64)
        kept_a, kept_b = ([x for x, g in zip(t, good, strict=True) if g] for t in (all_a, all_b))
        text = iter(())
        if kept_a:
            na, nb = (np.array([len(x) for x in t]) for t in (kept_a, kept_b))
            a, b = (np.fromiter(itertools.chain.from_iterable(t), np.int64) for t in (kept_a, kept_b))
            ia, ib, _, group = overlaps(self.sizes_a[a], self.sizes_b[b])
            of_a, of_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
            of_a[ia], of_b[ib] = group, group
            stretch = np.repeat(np.arange(len(na)), na)
            first = np.flatnonzero(np.diff(of_a, prepend=-1))  # the first A token of each group
            groups = np.bincount(stretch[first], minlength=len(na))
            place, link, times = self.linked(a, b, of_a, of_b, stretch)
            distinct = np.bincount(place, minlength=len(na))
            known[np.flatnonzero(good)] = np.stack([na, nb, groups, len(self.links) + np.cumsum(distinct) - distinct, distinct], 1)
            self.links, self.times = np.concatenate([self.links, link]), np.concatenate([self.times, times])
            text = iter(self.written(a, b, of_a, of_b, na, nb))
        self.text += [next(text) if g else b"" for g in good]
        self.known = np.concatenate([self.known, known])

    def linked(self, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, stretch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per distinct link of a stretch: the stretch, the link, how often it occurs."""
        n = int(of_a[-1]) + 1
        ca, cb = np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n)
        place = stretch[np.cumsum(ca) - ca]
        wide = ca * cb > self.pair.wide
        usual = ~wide[of_a]
        repeat = cb[of_a[usual]]
        link = np.repeat(a[usual], repeat) << self.width
        within = np.arange(len(link)) - np.repeat(np.cumsum(repeat) - repeat, repeat)
        start = np.cumsum(cb) - cb
        link |= b[np.repeat(start[of_a[usual]], repeat) + within]
        at, found, times = [np.repeat(stretch[usual], repeat)], [link], [np.ones(len(link), np.int64)]
        for g in np.flatnonzero(wide):
            (xa, ta), (xb, tb) = np.unique(a[of_a == g], return_counts=True), np.unique(b[of_b == g], return_counts=True)
            found.append(((xa << self.width)[:, None] | xb).ravel())
            times.append((ta[:, None] * tb).ravel())
            at.append(np.full(len(found[-1]), place[g]))
        at, found, times = map(np.concatenate, (at, found, times))
        order = np.lexsort((found, at))
        at, found, times = at[order], found[order], times[order]
        new = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(found, prepend=-1) != 0))
        return at[new], found[new], np.add.reduceat(times, new)

    def written(self, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> list[bytes]:
        """The groups of each stretch, of so many tokens each, as text: every id with the sign behind it, in the order of groups."""
        last_a, last_b = np.diff(of_a, append=-1) != 0, np.diff(of_b, append=-1) != 0
        last_b = last_b.astype(np.int64)
        last_b[np.cumsum(nb) - 1] = 2
        parts = np.empty(len(a) + len(b), object)
        parts[np.arange(len(a)) + np.searchsorted(of_b, of_a)] = self.signs_a[a, last_a.astype(np.int64)]
        parts[np.arange(len(b)) + np.searchsorted(of_a, of_b, "right")] = self.signs_b[b, last_b]
        parts, ends = parts.tolist(), np.cumsum(na + nb).tolist()
        return [b"".join(parts[i:j]) for i, j in zip([0, *ends], ends, strict=False)]

    def align(self, texts: list[str | None]) -> dict:
        """Per document: n_a, n_b, n_groups, n_links, digest; and place, link, times of its distinct links, in order."""
        if len(self.number) > self.pair.most:
            self.forget()
        split = [self.stretches(t) if t else [] for t in texts]
        new = [x for x in dict.fromkeys(itertools.chain.from_iterable(split)) if x not in self.number]
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        if new:
            self.learn(new)
        n = np.array([len(x) for x in split], np.int64)
        number = np.fromiter(map(self.number.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(n.sum()))
        doc = np.repeat(np.arange(len(n)), n)
        bad = np.bincount(doc[self.known[number, 0] < 0], minlength=len(n)) > 0
        use = ~bad[doc]
        number, doc = number[use], doc[use]
        count, first = self.known[number, 4], self.known[number, 3]
        at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        key = (np.repeat(doc, count) << self.bits) | self.links[at]
        order = np.argsort(key, kind="stable")
        key, times = key[order], self.times[at][order]
        new = np.flatnonzero(np.diff(key, prepend=-1))
        times = np.add.reduceat(times, new) if len(new) else times
        place, link = key[new] >> self.bits, key[new] & ((1 << self.bits) - 1)
        sums = {name: np.bincount(doc, self.known[number, k], len(n)).astype(np.int64) for k, name in enumerate(("n_a", "n_b", "n_groups"))}
        digests, i = [], 0
        for k, own in enumerate(n.tolist()):
            numbers = [] if bad[k] else number[i : i + own].tolist()
            i += len(numbers)
            digests.append(hashlib.sha256(b";".join(map(self.text.__getitem__, numbers))).hexdigest() if numbers else "")
        return sums | {"n_links": np.bincount(place, times, len(n)).astype(np.int64), "digest": digests, "place": place, "link": link, "times": times}


_DOCUMENT = pa.schema([
    ("block", pa.int64()), ("links", pa.list_(pa.int64())), ("documents", pa.list_(pa.int64())),
    ("id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("digest", pa.string()),
    ("place", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())),
])
_DOCUMENT_SQL = "block long, links array<long>, documents array<long>, id long, n_a long, n_b long, n_groups long, n_links long, digest string, place array<int>, times array<int>"


def _parts(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Stretches of rows with at most so many bytes of text each, or one row."""
    ends = np.cumsum(batch.column("bytes").to_numpy())
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def _lists(ends: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, kind))


def _blocks(pair: Pair):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept(pair, lambda: Aligner(pair))
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in _parts(batch, pair.block_bytes):
                n, found, numbers = part.num_rows, [], {"n_a": [], "n_b": [], "n_groups": [], "n_links": []}
                digests, held = [], []
                for piece in _parts(part, pair.piece_bytes):
                    got = own.align(piece.column("text").to_pylist())
                    found.append((got["link"], got["times"]))
                    held.append(np.bincount(got["place"], minlength=piece.num_rows))
                    digests += got["digest"]
                    for c, x in numbers.items():
                        x.append(got[c])
                links, place = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
                share, ends = np.arange(1, n + 1) * len(links) // n, np.cumsum(np.concatenate(held))
                row = [pa.array(np.full(n, block)), _lists(share, links, pa.int64()), _lists(share, np.bincount(place, minlength=len(links)), pa.int64()), part.column("id")]
                row += [pa.array(np.concatenate(x)) for x in numbers.values()] + [pa.array(digests, pa.string())]
                row += [_lists(ends, place.astype(np.int32), pa.int32()), _lists(ends, np.concatenate([x for _, x in found]), pa.int32())]
                yield pa.RecordBatch.from_arrays(row, schema=_DOCUMENT)
                block += 1

    return run


def _scored(key, documents: pa.Table, asked: pa.Table) -> pa.Table:
    """The sums of each document of one block, from the counts of its links."""
    order = np.argsort(asked.column("link").to_numpy())
    n, best = asked.column("n").to_numpy()[order], asked.column("best").to_numpy(zero_copy_only=False)[order]
    place, times = (documents.column(c).combine_chunks().flatten().to_numpy() for c in ("place", "times"))
    held = pc.list_value_length(documents.column("place")).to_numpy()
    doc = np.repeat(np.arange(len(held)), held)
    sums = [np.bincount(doc, w, len(held)).astype(np.int64) if len(doc) else np.zeros(len(held), np.int64) for w in ((times * best[place], times * n[place]) if len(doc) else ((), ()))]
    columns = [*(documents.column(c) for c in ("id", "n_a", "n_b", "n_groups", "n_links")), pa.array(sums[0]), pa.array(sums[1]), documents.column("digest")]
    return pa.table(columns, ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "digest"])


def blocks_of(docs: DataFrame, pair: Pair, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document, with the number of its block and a share of the block's links, written out."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).withColumn("bytes", F.octet_length("text").cast("long"))
    return materialize(rows.mapInArrow(_blocks(pair), _DOCUMENT_SQL), "aligned")


def link_counts(blocks: DataFrame, width: int) -> DataFrame:
    """link, n (documents that hold it), best: no link of its A id has more."""
    counts = materialize(blocks.select(F.explode(F.arrays_zip("links", "documents")).alias("x")).groupBy(F.col("x.links").alias("link")).agg(F.sum("x.documents").alias("n")), "link-counts")
    highest = counts.groupBy(F.shiftright("link", width).alias("a")).agg(F.max("n").alias("top"))  # a row per id of A's vocabulary at most
    return counts.join(F.broadcast(highest), F.shiftright("link", width) == F.col("a")).select("link", "n", (F.col("n") == F.col("top")).alias("best"))


def align(docs: DataFrame, pair: Pair, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    import sentencepiece

    width = max(1, len(sentencepiece.SentencePieceProcessor(model_file=pair.b)) - 1).bit_length()
    blocks = blocks_of(docs, pair, id_col, text_col)
    asked = blocks.select((F.col("block") + 0).alias("of"), F.explode("links").alias("link")).join(link_counts(blocks, width).hint("merge"), "link")
    payload = blocks.drop("links", "documents")
    out = payload.groupBy("block").cogroup(asked.groupBy("of")).applyInArrow(_scored, "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, digest string")
    return out.withColumnsRenamed({"id": id_col, "digest": "groups_sha256"})


def _tokens(pair: Pair):
    schema = pa.schema([("id", pa.int64()), ("group", pa.int64()), ("first_byte", pa.int64()), ("a_index", pa.int64()), ("b_index", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept(pair, lambda: Aligner(pair))
        for batch in batches:
            for k, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text:
                    (a,), (b,) = own.encode([f" {text}"])
                    s = f" {text}".encode()
                    if b"".join(map(own.bytes_a.__getitem__, a)) == s == b"".join(map(own.bytes_b.__getitem__, b)):
                        a, b = np.array(a), np.array(b)
                        ia, ib, at, group = overlaps(own.sizes_a[a], own.sizes_b[b])
                        yield pa.RecordBatch.from_arrays([pa.array([k] * len(ia), pa.int64()), *map(pa.array, (group, at, ia, ib, a[ia], b[ib]))], schema=schema)

    return run


def token_overlaps(docs: DataFrame, pair: Pair, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per overlap of an A token and a B token: id_col, group, first_byte (of space and text), a_index, b_index, a, b."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(_tokens(pair), "id long, group long, first_byte long, a_index long, b_index long, a long, b long").withColumnRenamed("id", id_col)
