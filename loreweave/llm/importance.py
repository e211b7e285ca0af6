"""Resampling documents by importance: those whose hashed features look like a target set's are drawn first.

Features (runs of 1 to `n` words) fall into `buckets` by their checksum. Both corpora are counted per bucket, summed per task
first; every bucket's gain is the logarithm of how much likelier it is in the target. A document's weight is the mean gain of
its features, taken from an array of all gains. With a Gumbel noise drawn from its id added, the documents of highest score are
a draw without replacement by weight.

The draw is a merge of sorted runs. Scores are whole numbers of a narrow range, so a histogram of them (bounded by that range,
not by the documents) says which score is the last drawn and where each score's ranks begin; lower scores never enter a run.
Every task sorts its eligible rows into runs of at most `run_rows`, rows that are alike collapsed to one with their number, and
cuts them at range bounds into blocks. A range is a stretch of scores with at most about `range_rows` rows; a score that has
more is cut by ids, so ties spread too. Each range is merged by a tournament tree over its runs, two and two, block by block,
and the tree is left as soon as the draw is full. The rank of a range's first row follows from the sizes of the ranges before.

Defined results: a null text has no features, weight 0; a null id hashes as an empty string and ranks after all ids of its
score; rows with equal id and score rank by n_features, and rows alike in all of that are interchangeable; very long texts
count whole; without target texts all gains come from the smoothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import materialize, text_of

#: What counts as a word: digits, letters of ASCII, and everything beyond ASCII; the rest becomes a space, A-Z lower case.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Draw:
    n: int = 1
    buckets: int = 10_000
    seed: int = 2024
    least_words: int = 20
    percent: int = 10
    scale: int = 1000
    run_rows: int = 1 << 19
    range_rows: int = 1 << 19
    block_rows: int = 4096


class _Buckets(dict):
    """The bucket of a feature; the latest ones."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        out = self[feature] = zlib.crc32(feature) % self.buckets
        return out


def feature_buckets(text: str, draw: Draw, known: _Buckets) -> tuple[np.ndarray, int]:
    """The buckets of all features of a text, and the number of its words."""
    words = text.encode().translate(_WORDS).split(b" ")
    words = [w for w in words if w]
    features = words if draw.n == 1 else [b" ".join(words[k : k + n]) for n in range(1, draw.n + 1) for k in range(len(words) - n + 1)]
    return np.fromiter(map(known.__getitem__, features), np.int64, len(features)), len(words)


def _count(draw: Draw):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = _Buckets(draw.buckets), np.zeros(draw.buckets, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                total += np.bincount(feature_buckets(text, draw, known)[0], minlength=draw.buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return run


def bucket_counts(rows: DataFrame, draw: Draw) -> np.ndarray:
    """Features per bucket of all texts: at most `buckets` numbers a task, and as many at the driver."""
    found = rows.select(text_of().alias("text")).mapInArrow(_count(draw), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(draw.buckets, np.int64)
    for bucket, n in found:
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray, draw: Draw) -> np.ndarray:
    n, m = float(corpus.sum() + draw.buckets), float(target.sum() + draw.buckets)
    return np.array([math.floor(draw.scale * math.log((t + 1.0) * n / ((s + 1.0) * m))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(ids: list, draw: Draw) -> np.ndarray:
    """A whole number per id, Gumbel-distributed, that follows from the id alone."""
    import hashlib

    h = [int(hashlib.sha256(f"{draw.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16) for i in ids]
    return np.array([math.floor(-draw.scale * math.log(-math.log((x + 0.5) / 4294967296))) for x in h], np.int64)


def _score(draw: Draw, gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets(draw.buckets)
        for batch in batches:
            ids, n, words, weight = batch.column("id"), [], [], []
            for text in batch.column("text").to_pylist():
                own, count = feature_buckets(text, draw, known)
                n.append(len(own))
                words.append(count)
                weight.append(int(gain[own].sum()) // len(own) if len(own) else 0)
            score = np.array(weight, np.int64) + noise(ids.to_pylist(), draw)
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (n, weight, score)), pa.array([x >= draw.least_words for x in words])], schema=_SCORED)

    return run


_SCORED = pa.schema([("id", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()), ("score", pa.int64()), ("eligible", pa.bool_())])

#: A row of a run: better rows come first in the order of these fields; then how many rows are alike.
_ROW = np.dtype([("down", "<i8"), ("null", "<i8"), ("id", "<i8"), ("n_features", "<i8"), ("weight", "<i8"), ("n", "<i8")])
_KEY = ["down", "null", "id", "n_features", "weight"]


def collapsed(rows: np.ndarray) -> np.ndarray:
    """rows in order, those alike as one."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort([rows[c] for c in reversed(_KEY)])]
    new = np.flatnonzero(np.concatenate([[True], np.any([np.diff(rows[c]) != 0 for c in _KEY], axis=0)]))
    out = rows[new]
    out["n"] = np.add.reduceat(rows["n"], new)
    return out


@dataclass(frozen=True)
class Ranges:
    """Ascending bounds (down, id): range k begins at bound k and ends before the next."""

    down: np.ndarray
    id: np.ndarray

    def of(self, rows: np.ndarray) -> np.ndarray:
        """The range of each row, null ids being the last of their score."""
        ids = np.where(rows["null"] == 1, np.iinfo(np.int64).max, rows["id"])
        lo, hi = np.searchsorted(self.down, rows["down"], "left"), np.searchsorted(self.down, rows["down"], "right")
        out = hi - 1
        for k in np.unique(lo[hi - lo > 1]):  # scores cut by ids
            own = np.flatnonzero((lo == k) & (hi - lo > 1))
            out[own] = k + np.searchsorted(self.id[k : hi[own[0]]], ids[own], "right") - 1
        return out


def _runs(draw: Draw, ranges: Ranges):
    def cut(rows: np.ndarray, run: int) -> Iterator[pa.RecordBatch]:
        rows = collapsed(rows)
        of = ranges.of(rows)
        bounds = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(rows)]
        blocks = [(int(of[i]), k, rows[k : min(k + draw.block_rows, j)]) for i, j in zip(bounds, bounds[1:], strict=False) for k in range(i, j, draw.block_rows)]
        yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in blocks], pa.int64()), pa.array([run] * len(blocks), pa.int64()), pa.array([b[1] for b in blocks], pa.int64()), pa.array([int(b[2]["n"].sum()) for b in blocks], pa.int64()), pa.array([b[2].tobytes() for b in blocks], pa.binary())], names=["range", "run", "place", "n", "rows"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            rows = np.zeros(batch.num_rows, _ROW)
            rows["null"] = batch.column("id").is_null().to_numpy(zero_copy_only=False)
            rows["id"] = batch.column("id").fill_null(0).to_numpy()
            rows["down"] = -batch.column("score").to_numpy()
            rows["n_features"], rows["weight"], rows["n"] = batch.column("n_features").to_numpy(), batch.column("weight").to_numpy(), 1
            held.append(rows)
            n += len(rows)
            if n >= draw.run_rows:
                yield from cut(np.concatenate(held), run)
                run, held, n = run + 1, [], 0
        if n:
            yield from cut(np.concatenate(held), run)

    return make


def _match(left: Iterator[np.ndarray], right: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """One match of the tournament: two sorted streams of blocks to one. What cannot be beaten by either's next block goes up."""
    x, y = next(left, None), next(right, None)
    while x is not None and y is not None:
        if tuple(x[-1][_KEY]) <= tuple(y[-1][_KEY]):
            cut, out, x, y = _until(y, x[-1]), x, None, y
            out, y = collapsed(np.concatenate([out, y[:cut]])), y[cut:]
        else:
            cut = _until(x, y[-1])
            out, x, y = collapsed(np.concatenate([x[:cut], y])), x[cut:], None
        yield out
        x = next(left, None) if x is None or not len(x) else x
        y = next(right, None) if y is None or not len(y) else y
    for first, rest in ((x, left), (y, right)):
        if first is not None:
            yield first
            yield from rest


def _until(rows: np.ndarray, last: np.void) -> int:
    """How many of the sorted rows are at or before last."""
    lo, hi, key = 0, len(rows), tuple(last[_KEY])
    while lo < hi:
        mid = (lo + hi) // 2
        if tuple(rows[mid][_KEY]) <= key:
            lo = mid + 1
        else:
            hi = mid
    return lo


def tournament(runs: list[Iterator[np.ndarray]]) -> Iterator[np.ndarray]:
    """Sorted streams of blocks merged to one by a tree of matches, of which each holds a block of either side."""
    while len(runs) > 1:
        runs = [_match(*runs[k : k + 2]) if k + 1 < len(runs) else runs[k] for k in range(0, len(runs), 2)]
    return runs[0] if runs else iter(())


def _merge(first: np.ndarray, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        now = None
        for batch in batches:
            for k, run, rows in zip(batch.column("range").to_pylist(), batch.column("run").to_pylist(), batch.column("rows"), strict=True):
                if k != now and held:
                    yield from merged(now, held)
                    held = {}
                now = k
                held.setdefault(run, []).append(np.frombuffer(rows.as_buffer(), _ROW))
        if held:
            yield from merged(now, held)

    def merged(k: int, held: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        rank, left = int(first[k]), list(map(iter, held.values()))
        blocks = tournament(left)
        while rank <= most and (block := next(blocks, None)) is not None:
            ends = rank + np.cumsum(block["n"])
            yield from written(block, ends - block["n"])
            rank = int(ends[-1])
        for block in blocks if rank > most else ():  # beyond the draw nothing is ranked
            yield from written(block, np.full(len(block), most + 1))

    def written(block: np.ndarray, rank: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A record per row, alike ones many times; ranks beyond the draw are null."""
        for at in range(0, len(block), 1024):
            part, start = block[at : at + 1024], rank[at : at + 1024]
            for lo in range(0, int(part["n"].max()), 1024):  # rows alike: a thousand of each at a time
                n = np.clip(part["n"] - lo, 0, 1024)
                rows = np.repeat(part, n)
                ranks = np.repeat(start + lo, n) + np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([pa.array(rows["id"], mask=rows["null"] == 1), pa.array(rows["n_features"]), pa.array(rows["weight"]), pa.array(-rows["down"]), pa.array(ranks, mask=ranks > most)], names=["id", "n_features", "weight", "score", "rank"])

    return run


def _ranges(eligible: DataFrame, histogram: list[tuple[int, int]], draw: Draw) -> Ranges:
    """Bounds over the drawn scores, best first, for ranges of about range_rows; a score with more rows is cut by its ids' quantiles."""
    parts: dict[int, list[int]] = {}
    for s, n in histogram:
        if n > draw.range_rows:
            parts.setdefault(1 << (math.ceil(n / draw.range_rows) - 1).bit_length(), []).append(s)
    cuts: dict[int, list[int]] = {}
    for p, scores in parts.items():  # a few sizes; as many numbers as there are ranges
        quantiles = F.percentile_approx("id", [(k + 1) / p for k in range(p - 1)], 10 * p)
        cuts |= {s: sorted(set(c or ())) for s, c in eligible.where(F.col("score").isin(scores)).groupBy("score").agg(quantiles).collect()}
    bounds, held = [], draw.range_rows
    for s, n in histogram:
        if s in cuts:
            bounds += [(-s, x) for x in (np.iinfo(np.int64).min, *cuts[s])]
            held = draw.range_rows
        elif held + n > draw.range_rows:
            bounds.append((-s, np.iinfo(np.int64).min))
            held = n
        else:
            held += n
    return Ranges(*(np.array(x, np.int64) for x in zip(*bounds, strict=True)))


def resample(docs: DataFrame, target: DataFrame, draw: Draw | None = None, id_col: str = "doc_id") -> DataFrame:
    """Every row: id_col, n_features, weight, score, rank (null if not drawn). docs: id_col, text; target: text."""
    draw = draw or Draw()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of().alias("text"))
    gain = gains(bucket_counts(rows, draw), bucket_counts(target, draw), draw)
    scored = materialize(rows.mapInArrow(_score(draw, gain), "id long, n_features long, weight long, score long, eligible boolean"), "scored")
    eligible = scored.where("eligible").drop("eligible")
    histogram = sorted(((s, n) for s, n in eligible.groupBy("score").count().collect()), reverse=True)
    most = draw.percent * sum(n for _, n in histogram) // 100
    upto, last = 0, None
    for k, (s, n) in enumerate(histogram):
        if upto >= most:
            break
        upto, last = upto + n, k
    rest = lambda df: df.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    if last is None:
        return rest(scored)
    ranges = _ranges(eligible, histogram[: last + 1], draw)
    drawn = F.col("eligible") & (F.col("score") >= histogram[last][0])
    runs = materialize(scored.where(drawn).drop("eligible").mapInArrow(_runs(draw, ranges), "range long, run long, place long, n long, rows binary"), "runs")
    sizes = dict(runs.groupBy("range").agg(F.sum("n")).collect())  # a number per range
    first = np.concatenate([[1], 1 + np.cumsum([sizes.get(k, 0) for k in range(len(ranges.down))])])
    dealt = runs.drop("n").repartition(F.col("range")).sortWithinPartitions("range", "run", "place")
    merged = dealt.mapInArrow(_merge(first, most), "id long, n_features long, weight long, score long, rank long")
    return merged.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank").union(rest(scored.where(~drawn)))


def words_of(text: str) -> list[str]:
    """A text's words, by the pattern; for tests and for showing features."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
