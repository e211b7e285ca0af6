"""A quality classifier: random-indexing word vectors pooled per document, then a two-layer numpy network.

Every word has two terms: itself (lower case, without marks at its ends) and its shape (runs of small letters, capitals, digits
and marks). A term's index vector is a fixed sparse ternary vector; its context vector is the sum of the index vectors of the
terms around it, counted over the whole corpus in integers, so any order of tasks gives the same. Terms are hashed into a
fixed number of rows, which bounds a task's memory and what the driver gets (rows * dims numbers, whatever the corpus).
A document is the mean and the deviation of its terms' unit context vectors, and the mean product of neighbours. The network is fitted on a sample of at most
`max_rows` labelled ids (chosen by a hash of the id), its temperature on a fold of them that it was not fitted on.

Defined results: a null or empty text is the zero vector and gets the network's score of that; very long texts are read whole;
without usable labels every score is 0.5; of labels that repeat an id the least counts, of documents that repeat a labelled id
the text with the smallest hash teaches; rows with equal texts get equal scores, so ties stay ties; a null id is held out iff crc32('') mod 5 = 0 (it is); an empty
table gives no rows; label, language, source and id never enter a score; other columns are passed through, a column of the
score's name in any case is replaced.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import bounded_sample, kept, quoted, text_of


@dataclass(frozen=True)
class Quality:
    dims: int = 32
    nonzero: int = 4
    words: int = 1 << 15
    shapes: int = 1 << 10
    window: int = 2
    hidden: int = 32
    epochs: int = 60
    rate: float = 3e-3
    decay: float = 1e-4
    max_rows: int = 20_000
    threshold: float = 0.3
    folds: int = 5
    chunk: int = 1024  # rows of the context matrix that travel together
    seed: int = 11


_SHAPE = bytes(ord("x") if 97 <= b <= 122 or b >= 128 else ord("X") if 65 <= b <= 90 else ord("d") if 48 <= b <= 57 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def own_term(word: bytes, q: Quality) -> int:
    return xxhash.xxh64_intdigest(word.lower().strip(_MARKS)) % q.words


class _Shapes(dict):
    """Terms of shapes, by the word with its characters replaced by their kinds."""

    def __init__(self, q: Quality):
        self.q = q

    def __missing__(self, kinds: bytes) -> int:
        out = self[kinds] = self.q.words + xxhash.xxh64_intdigest(_RUN.sub(rb"\1", kinds)) % self.q.shapes
        return out


def index_vectors(q: Quality) -> np.ndarray:
    rng = np.random.default_rng(q.seed)
    out = np.zeros((q.words + q.shapes, q.dims), np.int8)
    at = np.argsort(rng.random(out.shape), axis=1)[:, : q.nonzero]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.int8), at.shape), axis=1)
    return out


class _Numbers(dict):
    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        out = self[word] = len(self)
        self.new.append(word)
        return out


class Reader:
    """Texts to term rows, through a bounded table of words met so far."""

    def __init__(self, q: Quality, most: int = 250_000):
        self.q, self.most = q, most
        self.forget()

    def forget(self):
        self.numbers, self.shapes, self.rows = _Numbers(), _Shapes(self.q), np.zeros((1 << 16, 2), np.int32)

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(words, 2) rows of the terms, and the number of words of each text."""
        if len(self.numbers) > self.most:
            self.forget()
        split = [t.encode().split() if t else [] for t in texts]
        sizes = np.array([len(x) for x in split], np.int64)
        number = np.fromiter(map(self.numbers.__getitem__, itertools.chain.from_iterable(split)), np.int32, int(sizes.sum()))
        if new := self.numbers.new:
            last = len(self.numbers)
            while last > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[last - len(new) : last, 0] = [own_term(w, self.q) for w in new]
            self.rows[last - len(new) : last, 1] = [self.shapes[w.translate(_SHAPE)] for w in new]
            if len(self.shapes) > 50_000:
                self.shapes.clear()
            new.clear()
        return self.rows[number], sizes


def reader(q: Quality) -> Reader:
    """One for each Python worker."""
    return kept(q, lambda: Reader(q))


def add_contexts(total: np.ndarray, rows: np.ndarray, sizes: np.ndarray, index: np.ndarray, q: Quality) -> None:
    """Adds the index vectors around every word to the context vectors of its terms. Texts are set apart by zeros."""
    if not len(rows):
        return
    at = np.arange(len(rows)) + np.repeat(np.arange(len(sizes)), sizes) * q.window
    own = np.zeros((at[-1] + 1 + q.window, q.dims), np.int8)
    own[at] = index[rows[:, 0]] + index[rows[:, 1]]
    near = np.zeros_like(own)
    for k in range(1, q.window + 1):
        near[k:] += own[:-k]
        near[:-k] += own[k:]
    shift = 4 * q.window  # no entry of near is below -shift, none above shift
    lanes = (near[at] + np.int16(shift)).view(np.uint64)  # four 16-bit entries are added at once; a run is too short to overflow
    most = 65_535 // (2 * shift)
    for side, start in ((0, 0), (1, q.words)):
        term = (rows[:, side] - start).astype(np.uint16)
        order = np.argsort(term, kind="stable")
        for k in range(0, len(order), most):
            own_order = order[k : k + most]
            own_term = term[own_order]
            first = np.flatnonzero(np.r_[True, own_term[1:] != own_term[:-1]])
            sums = np.add.reduceat(lanes[own_order], first, axis=0).view(np.uint16).astype(np.int64)
            count = np.diff(np.r_[first, len(own_term)])[:, None]
            total[own_term[first].astype(np.int64) + start] += sums - shift * count


#: Tasks whose sums meet in one task of the next level.
FAN_IN = 1024


def _contexts(q: Quality, step: int = 64):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        index, total, own = index_vectors(q), np.zeros((q.words + q.shapes, q.dims), np.int64), reader(q)
        group = TaskContext.get().partitionId() // FAN_IN
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                add_contexts(total, *own.read(batch.column(0).slice(at, step).to_pylist()), index, q)
        for k in range(0, len(total), q.chunk):
            if total[k : k + q.chunk].any():
                yield pa.RecordBatch.from_arrays([pa.array([group]), pa.array([k // q.chunk]), pa.array([total[k : k + q.chunk].tobytes()])], names=["group", "chunk", "sums"])

    return run


def _sum_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for group, chunk, data in zip(*(batch.column(c).to_pylist() for c in ("group", "chunk", "sums")), strict=True):
            own = np.frombuffer(data, np.int64)
            sums[group, chunk] = sums[group, chunk] + own if (group, chunk) in sums else own
    for (group, chunk), own in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([group]), pa.array([chunk]), pa.array([own.tobytes()])], names=["group", "chunk", "sums"])


def _unit(q: Quality):
    """Chunks of sums as unit vectors of 32-bit numbers; each term's is of its own sums alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sum_chunks(batches):
            for chunk, data in zip(batch.column("chunk"), batch.column("sums"), strict=True):
                own = np.frombuffer(data.as_buffer(), np.int64).reshape(-1, q.dims).astype(float)
                norm = np.linalg.norm(own, axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([pa.array([chunk.as_py()]), pa.array([(own / np.where(norm > 0, norm, 1)).astype(np.float32).tobytes()])], names=["chunk", "vectors"])

    return run


def context_vectors(texts: Column, docs: DataFrame, q: Quality) -> np.ndarray:
    """Unit context vectors of all terms, counted over all documents; zero for terms never met. Tasks' sums are added up in two
    levels, first those of FAN_IN neighbouring tasks, so that no task reads from all others; the driver gets the vectors."""
    kind = "group bigint, chunk bigint, sums binary"
    parts = docs.select(texts.alias("text")).mapInArrow(_contexts(q), kind)
    near = parts.repartition("group", "chunk").mapInArrow(_sum_chunks, kind).withColumn("group", F.lit(0).cast("long"))
    whole = near.repartition("chunk").mapInArrow(_unit(q), "chunk bigint, vectors binary").toArrow()
    out = np.zeros((q.words + q.shapes, q.dims), np.float32)
    for chunk, data in zip(whole.column("chunk").to_pylist(), whole.column("vectors"), strict=True):
        own = np.frombuffer(data.as_buffer(), np.float32).reshape(-1, q.dims)
        out[chunk * q.chunk : chunk * q.chunk + len(own)] = own
    return out


def pooled(vectors: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per text, the mean and the deviation of its terms' vectors and the mean product of neighbours, words and shapes apart; zero without words."""
    dims = vectors.shape[1]
    out = np.zeros((len(sizes), 4 * dims + 2), np.float32)
    full = np.flatnonzero(sizes)
    ends = np.cumsum(sizes)
    for side in (0, 1):
        own = vectors.take(rows[:, side], axis=0)
        square = np.square(own)
        product = np.einsum("ij,ij->i", own[1:], own[:-1]) if len(own) else own
        for k in full:
            a, b = ends[k] - sizes[k], ends[k]
            mean = own[a:b].sum(axis=0) / sizes[k]
            out[k, side * dims : (side + 1) * dims] = mean
            out[k, (2 + side) * dims : (3 + side) * dims] = np.sqrt(np.maximum(square[a:b].sum(axis=0) / sizes[k] - mean * mean, 0))
            out[k, 4 * dims + side] = product[a : b - 1].sum() / max(sizes[k] - 1, 1)
    return out


@dataclass
class Network:
    """Two layers, tanh between; inputs are standardised, logits divided by the temperature."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x).astype(np.float64) / self.temperature, -40, 40)))


def fit_network(x: np.ndarray, y: np.ndarray, check: np.ndarray, q: Quality) -> Network:
    """Adam on cross entropy over the rows not marked check; the temperature with the least cross entropy over those marked."""
    rng = np.random.default_rng(q.seed)
    if check.all() or not check.any():
        check = np.arange(len(x)) % 5 == 0 if len(x) >= 5 else np.zeros(len(x), bool)
    fit_x, fit_y = x[~check], y[~check]
    net = Network(fit_x.mean(0), fit_x.std(0) + 1e-3, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], q.hidden)), np.zeros(q.hidden), rng.normal(0, 1 / np.sqrt(q.hidden), q.hidden), 0.0)
    z = fit_x - net.centre
    z /= net.scale
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(q.epochs):
        for part in np.array_split(rng.permutation(len(z)), max(1, len(z) // 128)):
            a, h = z[part], None
            h = np.tanh(a @ params[0] + params[1])
            d = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40))) - fit_y[part]) / len(part)
            back = d[:, None] * params[2] * (1 - h * h)
            grads = [a.T @ back + q.decay * params[0], back.sum(0), h.T @ d + q.decay * params[2], d.sum(keepdims=True)]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                params[k] -= q.rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net = Network(net.centre, net.scale, params[0], params[1], params[2], float(params[3][0]))
    if check.any():
        raw, sign = net.logits(x[check]), np.where(y[check] > 0, 1.0, -1.0)
        grid = np.geomspace(0.25, 8, 41)
        net.temperature = float(grid[int(np.argmin([np.logaddexp(0, -sign * raw / g).mean() for g in grid]))])
    return net


def fold(id_: Column, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit(""))) % folds


@dataclass
class Model:
    vectors: np.ndarray
    network: Network | None
    quality: Quality


def fit(docs: DataFrame, labels: DataFrame, q: Quality | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Word vectors from all of docs; the network from labelled rows whose fold is not 0."""
    q = q or Quality()
    vectors = context_vectors(text_of(text_col), docs, q)
    key = fold(F.col("id"), q.folds)
    sample = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & (key != 0))
    sample = bounded_sample(sample.groupBy("id").agg(F.min("label").alias("label")), "id", q.max_rows).withColumn("check", key == 1)
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(sample), "id")  # at most max_rows rows
    texts = texts.groupBy("id", "label", "check").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    wide = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                x = pooled(wide.value, *reader(q).read(part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("label"), part.column("check"), pa.array([v.tobytes() for v in x], pa.binary())], names=["label", "check", "x"])

    rows = texts.select("text", "label", "check").mapInArrow(run, "label int, check boolean, x binary").toArrow()  # a row an id
    rows = rows.sort_by([(c, "ascending") for c in ("x", "label", "check")]) if rows.num_rows else rows
    label, check = rows.column("label").to_numpy(), np.array(rows.column("check").to_pylist(), bool)
    if len(set(label.tolist())) < 2:
        return Model(vectors, None, q)
    x = np.empty((rows.num_rows, 4 * q.dims + 2))
    for k, data in enumerate(rows.column("x")):
        x[k] = np.frombuffer(data.as_buffer(), np.float32)
    return Model(vectors, fit_network(x, label.astype(float), check, q), q)


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with a column of scores from 0 to 1."""
    docs = docs.select(*(quoted(c) for c in docs.columns if c.lower() != name.lower()))
    q, wide = model.quality, docs.sparkSession.sparkContext.broadcast(model)
    names = [*docs.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = wide.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                if own.network is None:
                    out = np.full(part.num_rows, 0.5)
                else:
                    out = own.network.score(pooled(own.vectors, *reader(q).read(part.column(text_col).to_pylist())))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out)], names=names)

    schema = ", ".join([*(f"`{c.replace('`', '``')}` {t}" for c, t in docs.dtypes), f"`{name}` double"])
    return docs.mapInArrow(run, schema)
