"""Packing documents into sequences of a fixed window by minimum bin slack.

Every document becomes its token ids and an end id. Whole windows are cut off its front; what remains is shorter than a window.
How many remainders of each length there are (a bounded histogram) is all the driver sees. It plans on that: for the longest
remainder left, a bitset subset-sum over the other lengths (with their counts) finds the multiset that fills the window
closest to its capacity; it is traced back from the reached bits and applied as often as the counts allow. Where the best
multiset leaves a gap, some remainders of another length are cut in two, one part as long as the gap. The last tokens, fewer
than a window, fill sequences whose lengths are powers of two. So no sequence has padding.

Items of one length are numbered by two-level sums (length and hash bucket, then inside a bucket), so a length that a third
of all documents share is spread over `buckets` tasks; the plan, ranges of those numbers, is small and goes to every task.

Defined results: a null or empty text is the end id alone; rows repeated with one id are separate documents; an empty table
gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loreweave.llm.common import kept, materialize, text_of

PIECES = "id {id}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

#: Fixed values of the word tokenizer's file: its normalisers, and the pattern it splits words by.
WORD_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Printable ASCII and Latin-1 letters: in lower case their pieces follow from the pattern, and they are in normal form.
_PLAIN = re.compile("[\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
_PART = re.compile(" |'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^ a-z0-9\xdf-\xf6\xf8-\xff]+")


def _byte_characters() -> list[str]:
    """The characters that byte-level vocabularies write bytes as: printable bytes as themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class _Numbers(dict):
    """Numbers words as they are first met."""

    def __missing__(self, word: bytes) -> int:
        out = self[word] = len(self)
        self.new.append(word)
        return out


class Encoder:
    """Texts to packed ids, each with the end id behind it. A tokenizer that drops white space encodes word by word: words are
    numbered, the ids of each number are kept in one array (bounded by `most` words), and texts are gathered from it."""

    def __init__(self, path: str, width: str, end_id: int, most: int = 400_000):
        import json

        from tokenizers import Tokenizer

        self.tokenizer, self.width, self.end_id, self.most = Tokenizer.from_file(path), width, end_id, most
        self.dtype, self.model = np.dtype(width), self.tokenizer.model
        spec = json.loads(self.tokenizer.to_str())
        names = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = [x.get("pattern", {}).get("Regex") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.by_word = names == WORD_NORMALIZERS and split[:1] == [WORD_PATTERN]
        self.added = [x["content"].encode() for x in spec.get("added_tokens", [])]
        shown = _byte_characters()
        self.letters = {c: "".join([shown[b] for b in chr(c).encode()]) for c in range(0xC0, 0x100)}  # ASCII marks stand for themselves
        self.forget()

    def forget(self) -> None:
        self.numbers, self.parts = _Numbers(), {}
        self.numbers.new = []
        self.flat, self.size = np.zeros(1 << 20, self.dtype), 0
        self.starts, self.counts = np.zeros(1 << 18, np.int32), np.zeros(1 << 18, np.int32)
        self.numbers[b""] = 0  # no word is empty; this one is the end of a text
        self.keep([self.pack([self.end_id])], 0)

    def pack(self, ids: list[int]) -> bytes:
        return array(self.width, ids).tobytes()

    def whole(self, texts: list[str]) -> list[bytes]:
        return [self.pack(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def keep(self, ids: list[bytes], first: int) -> None:
        """Stores the ids of the words numbered from first on."""
        counts = np.fromiter(map(len, ids), np.int32, len(ids)) // self.dtype.itemsize
        last, size = first + len(ids), self.size + int(counts.sum())
        while size > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while last > len(self.starts):
            self.starts, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.counts))
        self.flat[self.size : size] = np.frombuffer(b"".join(ids), self.dtype)
        self.starts[first:last] = self.size + np.cumsum(counts) - counts
        self.counts[first:last] = counts
        self.size = size

    def part(self, x: str) -> bytes:
        """The ids of a piece that the pattern gives as one, from the vocabulary's merges."""
        out = self.parts[x] = self.pack([t.id for t in self.model.tokenize(x if x.isascii() else x.translate(self.letters))])
        return out

    def learned(self, words: list[bytes]) -> list[bytes]:
        joined = b" ".join(words)
        if not _PLAIN.fullmatch(joined.decode()) or any(a in joined for a in self.added):
            plain = [_PLAIN.fullmatch(w.decode()) is not None and not any(a in w for a in self.added) for w in words]
            odd = iter(self.whole([w.decode() for w, p in zip(words, plain, strict=True) if not p]))
            even = iter(self.learned([w for w, p in zip(words, plain, strict=True) if p]) if any(plain) else [])
            return [next(even) if p else next(odd) for p in plain]
        out, held, parts = [], [], self.parts
        for x in _PART.findall(joined.decode().lower()):
            if x == " ":
                out.append(b"".join(held))
                held = []
            else:
                held.append(parts.get(x) or self.part(x))
        return [*out, b"".join(held)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text ends in them."""
        if not self.by_word:
            ids = [x + self.pack([self.end_id]) for x in self.whole(texts)]
            return np.frombuffer(b"".join(ids), self.dtype), np.cumsum([len(x) // self.dtype.itemsize for x in ids])
        if len(self.numbers) > self.most:
            self.forget()
        split = [t.encode().split() for t in texts]
        for x in split:
            x.append(b"")
        words = np.cumsum([len(x) for x in split])
        number = np.fromiter(map(self.numbers.__getitem__, itertools.chain.from_iterable(split)), np.int32, int(words[-1]))
        if new := self.numbers.new:
            self.keep(self.learned(new), len(self.numbers) - len(new))
            self.numbers.new = []
        counts = self.counts[number]
        ends = np.cumsum(counts)
        at = np.repeat(self.starts[number] - (ends - counts).astype(np.int32), counts)
        at += np.arange(len(at), dtype=np.int32)
        return self.flat[at], ends[words - 1]


def encoder(*key) -> Encoder:
    """One for each Python worker: its words outlive a task."""
    return kept(key, lambda: Encoder(*key))


def _tokenise(path: str, width: str, end_id: int, kind: pa.DataType, step: int = 200):
    schema = pa.schema([("row", pa.int64()), ("id", kind), ("ids", pa.binary()), ("tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, width, end_id)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                ids, ends = own.encode(batch.column("text").to_pylist())
                ends = np.concatenate([[0], ends])
                packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((ends * ids.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids))])
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), packed, pa.array(np.diff(ends))], schema=schema)

    return run


class Plan:
    """Where items go. ranges: for a length, (first number, end, kind, a, b, c): kind 0 puts item j of the range into sequence
    a + j div b at offset c + (j mod b) * length; kind 1 cuts it: its first c tokens become item a + j of length c, the rest item b + j."""

    def __init__(self, counts: dict[int, int], window: int):
        self.window, self.total, self.used, self.sequences = window, defaultdict(int, counts), defaultdict(int), 0
        self.ranges: dict[int, list[tuple[int, int, int, int, int, int]]] = defaultdict(list)
        self.build()

    def left(self, length: int) -> int:
        return self.total[length] - self.used[length]

    def place(self, chosen: dict[int, int], copies: int) -> None:
        offset = 0
        for length, count in chosen.items():
            at = self.used[length]
            self.ranges[length].append((at, at + count * copies, 0, self.sequences, count, offset))
            self.used[length] += count * copies
            offset += count * length
        self.sequences += copies

    def cut(self, length: int, first: int, copies: int) -> None:
        at, rest = self.used[length], length - first
        a = self.total[first]
        self.total[first] += copies
        b = self.total[rest]
        self.total[rest] += copies
        self.ranges[length].append((at, at + copies, 1, a, b, first))
        self.used[length] += copies

    def best(self, capacity: int, seed: int) -> dict[int, int]:
        """The multiset with seed whose sum is closest to capacity: bitset subset sums, traced back."""
        room, reach, steps = capacity - seed, 1, []
        mask = (1 << (room + 1)) - 1
        for length in sorted((x for x in self.total if self.left(x) and x <= room), reverse=True):
            most, size = min(self.left(length) - (length == seed), room // length), 1
            while most > 0:
                take = min(size, most)
                steps.append((reach, length, take))
                reach |= (reach << (length * take)) & mask
                most, size = most - take, size * 2
            if reach >> room & 1:
                break
        at, chosen = reach.bit_length() - 1, defaultdict(int, {seed: 1})
        for before, length, take in reversed(steps):
            if not before >> at & 1:
                chosen[length] += take
                at -= length * take
        return dict(chosen)

    def build(self) -> None:
        tokens = sum(n * length for length, n in self.total.items())
        while tokens:
            capacity = self.window if tokens >= self.window else 1 << (tokens.bit_length() - 1)
            capacity = min(capacity, self.window)
            most = tokens // capacity
            lengths = [x for x in self.total if self.left(x)]
            fitting = [x for x in lengths if x <= capacity]
            if not fitting:
                self.cut(min(lengths), capacity, 1)
                continue
            chosen = self.best(capacity, max(fitting))
            gap = capacity - sum(n * x for x, n in chosen.items())
            if gap:  # whatever is left is longer than the gap
                spare = min(x for x in lengths if self.left(x) > chosen.get(x, 0) and x > gap)
                copies = min(most, *(self.left(x) // (n + (x == spare)) for x, n in chosen.items()), self.left(spare) // (chosen.get(spare, 0) + 1))
                self.cut(spare, gap, copies)
                chosen[gap] = chosen.get(gap, 0) + 1
            copies = min(most, *(self.left(x) // n for x, n in chosen.items())) if not gap else copies
            self.place(chosen, copies)
            tokens -= copies * capacity

    def arrays(self) -> dict[int, np.ndarray]:
        return {length: np.array(x, np.int64) for length, x in self.ranges.items()}


def locate(ranges: dict[int, np.ndarray], length: np.ndarray, number: np.ndarray, row: np.ndarray, start: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Follows items through the plan: (row, start, length, sequence, offset) of the pieces they end as."""
    while len(length):
        found = np.empty((len(length), 6), np.int64)
        for x in np.unique(length):
            own = np.flatnonzero(length == x)
            found[own] = ranges[int(x)][np.searchsorted(ranges[int(x)][:, 0], number[own], side="right") - 1]
        j, kind, a, b, c = number - found[:, 0], found[:, 2], found[:, 3], found[:, 4], found[:, 5]
        put, cut = kind == 0, kind == 1
        yield row[put], start[put], length[put], (a + j // np.maximum(b, 1))[put], (c + j % np.maximum(b, 1) * length)[put]
        length, number, row, start = (
            np.concatenate([c[cut], (length - c)[cut]]),
            np.concatenate([(a + j)[cut], (b + j)[cut]]),
            np.concatenate([row[cut], row[cut]]),
            np.concatenate([start[cut], (start + c)[cut]]),
        )


def _locate(ranges: dict[int, np.ndarray]):
    names = ["row", "start", "length", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, length, count, start, number = (batch.column(c).to_numpy() for c in ("row", "length", "count", "start", "number"))
            turn = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            row, length, start, number = (np.repeat(x, count) for x in (row, length, start, number))
            for out in locate(ranges, length, number + turn, row, start + turn * length):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=names)

    return run


def _slice(width: str, kind: pa.DataType):
    dtype = np.dtype({"H": "<u2", "I": "<u4"}[width])
    schema = pa.schema([("id", kind), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, ids, tokens, pieces in zip(*(batch.column(c).to_pylist() for c in ("id", "ids", "tokens", "pieces")), strict=True):
                own = np.frombuffer(ids, dtype).astype("<u4")
                rows += [(key, p["start"], p["length"], own[p["start"] : p["start"] + p["length"]].tobytes(), tokens, p["sequence_id"], p["offset"]) for p in pieces]
                if len(rows) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1, small_ids: bool = True, buckets: int = 1024) -> DataFrame:
    """Pieces of documents in sequences: id_col, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    tokenizer: path of a tokenizers file, at the same place on every executor. small_ids: all ids are below 65536.
    """
    width = "H" if small_ids else "I"
    whole = dict(docs.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint")
    sql, kind = ("bigint", pa.int64()) if whole else ("string", pa.string())
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast(sql).alias("id"), text_of(text_col).alias("text"))
    rows = materialize(rows.mapInArrow(_tokenise(tokenizer, width, end_id, kind), f"row bigint, id {sql}, ids binary, tokens bigint"), "token-ids")
    full = F.floor(F.col("tokens") / window)
    item = lambda length, count, start: F.struct(length.cast("long").alias("length"), count.cast("long").alias("count"), start.cast("long").alias("start"))
    items = rows.select("row", F.inline(F.array(item(F.lit(window), full, F.lit(0)), item(F.col("tokens") % window, F.lit(1), full * window)))).where("length > 0 and count > 0")
    items = items.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    sums = items.groupBy("length", "bucket").agg(F.sum("count").alias("n"))
    sums = materialize(sums, "packing-counts")
    plan = Plan({int(r[0]): int(r[1]) for r in sums.groupBy("length").agg(F.sum("n")).collect()}, window)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    numbered = items.withColumn("at", F.coalesce(F.sum("count").over(inside), F.lit(0))).join(base, ["length", "bucket"])
    numbered = numbered.select("row", "length", "count", "start", (F.col("at") + F.col("base")).alias("number"))
    pieces = numbered.mapInArrow(_locate(plan.arrays()), "row long, start long, length long, sequence_id long, offset long")
    pieces = pieces.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("pieces"))
    out = rows.join(pieces, "row").select("id", "ids", "tokens", "pieces").mapInArrow(_slice(width, kind), PIECES.format(id=sql))
    return out.withColumnRenamed("id", id_col)
