"""A vector index over chunks: inverted lists around centroids, kept as Parquet and probed within a knowledge base.

Centroids are trained per embedding space on a bounded sample (`sample` vectors, chosen by a hash of the id); every chunk is
indexed. The sample also says how many lists a query must probe to find `recall` of its nearest neighbours there, so data
without clusters get more probes, and the number is kept with the index. Lists are folders (space, list), their rows blocks of
vectors of one knowledge base in order, so a search reads the folders it probes and, by the blocks' statistics, little of other
bases. Blocks of queries meet blocks of vectors as matrices; each pair gives its best few, so memory is bounded by two blocks.
With exact=True all lists are probed, and the result is the full scan's.

Defined results: vectors that are null, of another length than their space's, or zero are not indexed; parents are not either;
of equal scores (to nine decimals) the smaller id ranks first; a query finds its own base and space only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.operators.retrieval import ranked


@dataclass(frozen=True)
class Settings:
    lists: int = 0  # 0: the square root of the number of vectors, at most most_lists
    most_lists: int = 4096
    sample: int = 20_000
    recall: float = 0.95
    neighbours: int = 10
    rounds: int = 12
    block_rows: int = 256
    block_queries: int = 256
    seed: int = 7


@dataclass(frozen=True)
class Index:
    """Where the blocks lie, and per space the centroids (rows) and the number of lists to probe; as many rows as lists."""

    path: str
    centroids: dict[str, np.ndarray]
    probes: dict[str, int]


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def _nearest(x: np.ndarray, centroids: np.ndarray, step: int = 512) -> np.ndarray:
    """The centroid of each row; `step` rows meet all centroids at once, so memory doesn't grow with the rows of a batch."""
    out = np.empty(len(x), np.int64)
    for at in range(0, len(x), step):
        out[at : at + step] = (x[at : at + step] @ centroids.T).argmax(1)
    return out


def trained(x: np.ndarray, lists: int, s: Settings) -> np.ndarray:
    """Spherical k-means; an empty list takes the vector that lies worst."""
    rng = np.random.default_rng(s.seed)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(s.rounds):
        a = _nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, a, x)
        empty = np.flatnonzero(np.bincount(a, minlength=len(c)) == 0)
        if len(empty):
            sums[empty] = x[np.argsort((x * c[a]).sum(1))[: len(empty)]]
        c = _unit(sums)
    return c


def tuned(x: np.ndarray, centroids: np.ndarray, s: Settings, most: int = 512) -> int:
    """The fewest probes that find `recall` of the nearest neighbours of up to `most` of the sample's vectors."""
    asked = np.arange(0, len(x), max(1, len(x) // most))
    k = min(s.neighbours + 1, len(x))
    best = np.argpartition(-(x[asked] @ x.T), k - 1, axis=1)[:, :k]
    order = np.argsort(-(x[asked] @ centroids.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centroids))[None, :], axis=1)
    needed = np.sort(np.take_along_axis(place, _nearest(x, centroids)[best], axis=1).ravel())
    return int(needed[min(len(needed) - 1, math.ceil(s.recall * len(needed)) - 1)]) + 1


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def _assigned(centroids: dict[str, np.ndarray]):
    schema = pa.schema([("space", pa.string()), ("list", pa.int32()), ("kb", pa.string()), ("chunk_id", pa.int64()), ("vector", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spaces = np.array(batch.column("space").to_pylist(), object)
            for space, c in centroids.items():
                own = np.flatnonzero(spaces == space)
                if len(own):
                    part = batch.take(pa.array(own))
                    x = _matrix(part.column("embedding"))
                    good = np.flatnonzero(np.linalg.norm(x, axis=1) > 0)
                    part, x = part.take(pa.array(good)), _unit(x[good])
                    yield pa.RecordBatch.from_arrays([part.column("space"), pa.array(_nearest(x, c).astype(np.int32)), part.column("kb"), part.column("chunk_id"), pa.array([v.tobytes() for v in x], pa.binary())], schema=schema)

    return run


def _blocked(columns: list[str], most: int, ids: str):
    """Rows in order of columns to blocks: ids as a list and vectors one after another, at most `most` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([v]) if isinstance(v, str) else pa.array([v], pa.int32()) for v in now), pa.array([[i for i, _ in held]], pa.list_(pa.int64())), pa.array([b"".join(v for _, v in held)], pa.binary())], names=[*columns, "ids", "vectors"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in columns), strict=True)
            for key, i, v in zip(keys, batch.column(ids).to_pylist(), batch.column("vector").to_pylist(), strict=True):
                if held and (key != now or len(held) == most):
                    yield block()
                    held = []
                now = key
                held.append((i, v))
        if held:
            yield block()

    return run


def usable(chunks: DataFrame) -> DataFrame:
    """Children and chunks of no kind that have a vector."""
    kind = F.col("kind") if "kind" in chunks.columns else F.lit(None).cast("string")
    return chunks.where(F.col("embedding").isNotNull() & F.col("space").isNotNull() & (kind.isNull() | (kind == "CHILD")))


def _share(spaces: dict[str, tuple[int, int]], most: int) -> Column:
    """Does a row belong to the sample, by its space's size?"""
    out = F.lit(False)
    for space, (n, _) in spaces.items():
        out = F.when(F.col("space") == space, F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 30)) <= min(1.0, most / n) * (1 << 30)).otherwise(out)
    return out


def build(chunks: DataFrame, path: str, settings: Settings | None = None) -> Index:
    """Indexes chunks (chunk_id long, kb, space, embedding, perhaps kind) at path. Spaces are few: one for each embedding model."""
    s = settings or Settings()
    rows = usable(chunks).select("chunk_id", "kb", "space", "embedding")
    size = F.size("embedding")
    spaces = {r.space: (r.n, r.width) for r in rows.groupBy("space").agg(F.count("*").alias("n"), F.mode(size, True).alias("width")).collect()}
    width = F.lit(0)
    for space, (_, w) in spaces.items():
        width = F.when(F.col("space") == space, w).otherwise(width)
    rows = rows.where((size == width) & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v)))
    sample = rows.where(_share(spaces, s.sample)).select("space", "embedding").toArrow()
    names, vectors = np.array(sample.column("space").to_pylist(), object), sample.column("embedding")
    centroids, probes, deal = {}, {}, F.lit(1)
    for space, (n, _) in spaces.items():
        own = np.flatnonzero(names == space)
        if not len(own):
            continue
        x = _unit(_matrix(vectors.take(pa.array(own))))
        centroids[space] = trained(x, s.lists or min(s.most_lists, max(1, math.isqrt(n))), s)
        probes[space] = tuned(x, centroids[space], s)
        # a list that would fill more than 64 blocks is dealt to several tasks
        counts = np.bincount(_nearest(x, centroids[space]), minlength=len(centroids[space])) * (n / len(x))
        for k in np.flatnonzero(counts > 64 * s.block_rows).tolist():
            deal = F.when((F.col("space") == space) & (F.col("list") == k), int(counts[k] // (64 * s.block_rows)) + 1).otherwise(deal)
    assigned = rows.mapInArrow(_assigned(centroids), "space string, list int, kb string, chunk_id long, vector binary").withColumn("deal", F.pmod(F.xxhash64("chunk_id"), deal))
    dealt = assigned.repartition("space", "list", "deal").sortWithinPartitions("space", "list", "kb", "chunk_id").drop("deal")
    blocks = dealt.mapInArrow(_blocked(["space", "list", "kb"], s.block_rows, "chunk_id"), "space string, list int, kb string, ids array<long>, vectors binary")
    blocks.write.partitionBy("space", "list").parquet(f"{path}/blocks")
    spark = chunks.sparkSession
    meta = [(space, k, probes[space], c.tolist()) for space, own in centroids.items() for k, c in enumerate(own)]
    spark.createDataFrame(meta, "space string, list int, probes int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    return Index(path, centroids, probes)


def load(spark: SparkSession, path: str) -> Index:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("space", "list").collect()
    spaces = dict.fromkeys(r.space for r in rows)
    return Index(path, {x: np.array([r.centroid for r in rows if r.space == x]) for x in spaces}, {r.space: r.probes for r in rows})


def _probed(index: Index, probes: int | None, exact: bool):
    schema = pa.schema([("space", pa.string()), ("list", pa.int32()), ("kb", pa.string()), ("query_id", pa.int64()), ("vector", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, kb, space, v in zip(*(batch.column(c).to_pylist() for c in ("query_id", "kb", "space", "embedding")), strict=True):
                c = index.centroids.get(space)
                if c is None or v is None or len(v) != c.shape[1] or not np.any(v):
                    continue
                x = _unit(np.array([v], np.float64))
                n = len(c) if exact else min(len(c), probes or index.probes[space])
                lists = np.argsort(-(x @ c.T)[0], kind="stable")[:n].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([space] * n), pa.array(lists), pa.array([kb] * n, pa.string()), pa.array([i] * n, pa.int64()), pa.array([x[0].tobytes()] * n, pa.binary())], schema=schema)

    return run


def _met(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, vectors, asked, x in zip(*(batch.column(c) for c in ("ids", "vectors", "asked", "x")), strict=True):
                ids, asked = np.array(ids.as_py(), np.int64), np.array(asked.as_py(), np.int64)
                v, q = (np.frombuffer(b.as_buffer(), np.float64).reshape(len(n), -1) for b, n in ((vectors, ids), (x, asked)))
                score = np.round((1 + q @ v.T) / 2, 9)
                order = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :most]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, order.shape[1])), pa.array(ids[order].ravel()), pa.array(np.take_along_axis(score, order, 1).ravel())], names=["query_id", "chunk_id", "score"])

    return run


def search(spark: SparkSession, index: Index, queries: DataFrame, most: int, probes: int | None = None, exact: bool = False, settings: Settings | None = None) -> DataFrame:
    """query_id, chunk_id, score ((1 + cosine) / 2), rank of the `most` nearest chunks of each query's kb and space.
    queries: query_id long, kb, space, embedding."""
    s = settings or Settings()
    asked = queries.select("query_id", "kb", "space", "embedding").mapInArrow(_probed(index, probes, exact), "space string, list int, kb string, query_id long, vector binary")
    asked = asked.repartition("space", "list", "kb").sortWithinPartitions("space", "list", "kb", "query_id")
    asked = asked.mapInArrow(_blocked(["space", "list", "kb"], s.block_queries, "query_id"), "space string, list int, kb string, asked array<long>, x binary")
    both = spark.read.parquet(f"{index.path}/blocks").join(asked, ["space", "list", "kb"])
    hits = both.select("ids", "vectors", "asked", "x").mapInArrow(_met(most), "query_id long, chunk_id long, score double")
    return ranked(hits, most, F.desc("score"), F.col("chunk_id"), by=("query_id",))


def request(spark: SparkSession, index: Index, kb: str, space: str, asked: list[tuple[str, list[float]]], most: int, exact: bool = False) -> DataFrame:
    """subquery, chunk_id, score, rank for the few vectors of one request. The lists to probe are known before the scan, so only
    their folders are listed and read."""
    c = index.centroids.get(space)
    lists: set[int] = set()
    for _, v in asked if c is not None else ():
        n = len(c) if exact else index.probes[space]
        lists |= set(np.argsort(-(_unit(np.array([v], np.float64)) @ c.T)[0], kind="stable")[:n].tolist())
    blocks = spark.read.parquet(f"{index.path}/blocks").where((F.col("space") == space) & F.col("list").isin(sorted(lists)) & (F.col("kb") == kb))
    x = _unit(np.array([v for _, v in asked], np.float64))
    one = blocks.select("ids", "vectors", F.array(*(F.lit(k).cast("long") for k in range(len(asked)))).alias("asked"), F.lit(x.tobytes()).alias("x"))
    hits = one.mapInArrow(_met(most), "query_id long, chunk_id long, score double")
    name = F.element_at(F.array(*(F.lit(n) for n, _ in asked)), (F.col("query_id") + 1).cast("int"))
    return ranked(hits.withColumn("subquery", name), most, F.desc("score"), F.col("chunk_id")).select("subquery", "chunk_id", "score", "rank")


def scan_shares(spark: SparkSession, index: Index, queries: DataFrame, probes: int | None = None) -> DataFrame:
    """Per query: the share of its base's and space's vectors that its probes read."""
    asked = queries.select("query_id", "kb", "space", "embedding").mapInArrow(_probed(index, probes, False), "space string, list int, kb string, query_id long, vector binary").drop("vector")
    sizes = spark.read.parquet(f"{index.path}/blocks").groupBy("space", "list", "kb").agg(F.sum(F.size("ids")).alias("n"))
    whole = sizes.groupBy("space", "kb").agg(F.sum("n").alias("all"))
    return asked.join(sizes, ["space", "list", "kb"]).join(whole, ["space", "kb"]).groupBy("query_id").agg((F.sum("n") / F.first("all")).alias("share"))


def recalled(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Per query: the share of the exact result that was found. Both: query_id, chunk_id."""
    both = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return both.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
