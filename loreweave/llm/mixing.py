"""Mixing sources to target weights by blocks.

A source's documents, in a fixed pseudorandom order, form one stream of words that is cut into blocks of `block` words. The
output is a run of shards of `shard_slots` slots, a block each. Every shard draws its slots' sources from one multinomial, by
the sources' shares of all slots. Slots that all shards together drew for a source beyond its quota go, in pseudorandom order,
to sources that are short of theirs, so that every source ends with exactly its quota and every shard is full. A source's slots
are numbered through all shards; slot i takes block perm(i mod blocks) of pass i div blocks, perm being a keyed Feistel
permutation of the block indexes. So any block is taken equally often, give or take one, and joins its slots by index. A
source's last slot takes only the first words of its block, as many as its target still wants: every source takes its target,
rounded to a word, whatever its size. Nothing depends on how rows are partitioned: reruns agree.

The mixed corpus holds a row for each contiguous stretch of a document that a pass takes, cut out of the text as it is; rows are
never glued from parts.

Offsets come from two-level sums (source and hash bucket, then inside a bucket), so a source that holds a third of all rows
is spread over `buckets` tasks. The driver holds a row per source (a name and two numbers) and nothing else.

Defined results: a null text has no words, a null source is a source of its own (last in the order of weights), documents
without words take none, very long texts are cut like others, documents that tie in the order (equal id and text) are
interchangeable, rows repeated with one id are separate rows, null ids are ids like any other, an empty table gives no rows,
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loreweave.llm.common import WORD, distinct_rows, hashed_rows, materialize, partitions, quoted, text_of, tick


@dataclass(frozen=True)
class Mix:
    """Weights repeat over the sources in code-point order; total is a share of all words; repeat caps a source's target."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    total: float = 1.5
    repeat: int = 2
    block: int = 1024
    shard_slots: int = 1 << 12
    buckets: int = 1024
    seed: int = 17


def targets(sizes: dict[str | None, int], mix: Mix) -> dict[str | None, float]:
    """Each source's target: its weight's share of the total, with the excess over repeat * size shared anew by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mix.weights[k % len(mix.weights)] for k, s in enumerate(order)}
    out: dict[str | None, float] = {}
    rest, open_ = mix.total * sum(sizes.values()), set(order)
    while open_:
        whole = sum(weight[s] for s in open_)
        share = {s: rest * weight[s] / whole for s in open_}
        over = {s for s in open_ if share[s] > mix.repeat * sizes[s]}
        if not over:
            out |= share
            break
        out |= {s: float(mix.repeat * sizes[s]) for s in over}
        rest -= sum(out[s] for s in over)
        open_ -= over
    return out


def _scramble(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permute(index: np.ndarray, count: int, key: int, inverse: bool = False) -> np.ndarray:
    """A keyed permutation of 0..count-1, or its inverse: a four-round Feistel network, walked until it lands inside."""
    half = np.uint64(max(1, (max(count - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)

    def once(x):
        left, right = x >> half, x & mask
        for k in range(4):
            if inverse:
                left, right = right ^ (_scramble(left, key * 4 + 3 - k) & mask), left
            else:
                left, right = right, left ^ (_scramble(right, key * 4 + k) & mask)
        return (left << half) | right

    out = once(index.astype(np.uint64))
    while (far := out >= np.uint64(count)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


@dataclass(frozen=True)
class Quota:
    """What the mix takes of a source: so many slots, the last of which takes only its block's first `last` words."""

    blocks: int
    slots: int
    last: int


def pass_key(sid: int, turn: int, mix: Mix) -> int:
    return (mix.seed * 1009 + sid) * 64 + turn


def quota(target: float, size: int, sid: int, mix: Mix) -> Quota:
    """The slots that hold round(target) words, a source's last block being shorter than the others."""
    want, blocks = round(target), -(-size // mix.block)
    if not want:
        return Quota(blocks, 0, 0)
    passes, rest = divmod(want, size)
    if not rest:
        return Quota(blocks, passes * blocks, mix.block)
    missing = blocks * mix.block - size  # words that the last block lacks; its slot in the pass that is cut short is `place`
    place = int(permute(np.array([blocks - 1]), blocks, pass_key(sid, passes, mix), inverse=True)[0])
    if rest <= place * mix.block:
        slots, before = -(-rest // mix.block), 0
    elif rest <= (place + 1) * mix.block - missing:
        slots, before = place + 1, 0
    else:
        slots, before = -(-(rest + missing) // mix.block), missing
    return Quota(blocks, passes * blocks + slots, rest - ((slots - 1) * mix.block - before))


def _draws(quotas: list[Quota], mix: Mix):
    slots = sum(q.slots for q in quotas)
    p = np.array([q.slots for q in quotas]) / slots
    schema = pa.schema([("sid", pa.int32()), ("shard", pa.int64()), ("count", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                counts = np.random.default_rng([mix.seed, shard]).multinomial(min(mix.shard_slots, slots - shard * mix.shard_slots), p)
                sid = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(sid.astype(np.int32)), pa.array(np.full(len(sid), shard)), pa.array(counts[sid].astype(np.int64))], schema=schema)

    return run


def _slots(quotas: list[Quota], drawn: list[int], mix: Mix):
    asked = [q.slots for q in quotas]
    spare, short = np.maximum(np.subtract(drawn, asked), 0), np.maximum(np.subtract(asked, drawn), 0)
    base, upto = np.cumsum(spare) - spare, np.cumsum(short)
    schema = pa.schema([("sid", pa.int32()), ("block", pa.int64()), ("pass", pa.int32()), ("upto", pa.int32()), ("shard", pa.int64())])

    def taken(sid: int, slot: np.ndarray, shard: int) -> Iterator[pa.RecordBatch]:
        q = quotas[sid]
        words = np.where(slot == q.slots - 1, q.last, mix.block).astype(np.int32)
        for turn in np.unique(slot // q.blocks):
            own = slot // q.blocks == turn
            index = permute(slot[own] % q.blocks, q.blocks, pass_key(sid, int(turn), mix))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(index), sid, np.int32)), pa.array(index), pa.array(np.full(len(index), turn, np.int32)), pa.array(words[own]), pa.array(np.full(len(index), shard))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sid, shard, start, count in zip(*(batch.column(c).to_pylist() for c in ("sid", "shard", "start", "count")), strict=True):
                slot = np.arange(start, start + count)
                yield from taken(sid, slot[slot < asked[sid]], shard)
                over = slot[slot >= asked[sid]]
                if len(over):  # given to the sources that are short
                    place = permute(over - asked[sid] + base[sid], int(spare.sum()), mix.seed)
                    other = np.searchsorted(upto, place, "right")
                    for k in np.unique(other).tolist():
                        yield from taken(k, drawn[k] + place[other == k] - (upto[k] - short[k]), shard)

    return run


def output_slots(spark: SparkSession, plan: list[tuple[float, int]], mix: Mix) -> DataFrame:
    """sid, block, pass, upto (the block's first words that are taken), shard: a row per slot of the output. plan: each source's
    target and number of words, by sid."""
    quotas = [quota(target, size, sid, mix) for sid, (target, size) in enumerate(plan)]
    slots = sum(q.slots for q in quotas)
    shards = spark.range(-(-slots // mix.shard_slots))
    drawn = shards.mapInArrow(_draws(quotas, mix), "sid int, shard long, count long") if slots else spark.createDataFrame([], "sid int, shard long, count long")
    sums = {r[0]: int(r[1]) for r in drawn.groupBy("sid").agg(F.sum("count")).collect()}
    before = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard: millions at most
    placed = drawn.withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0)))
    placed = placed.repartition(partitions(spark), "sid", "shard")
    return placed.mapInArrow(_slots(quotas, [sums.get(k, 0) for k in range(len(plan))], mix), "sid int, block long, pass int, upto int, shard long")


@dataclass
class Mixed:
    rows: DataFrame  # row, id, source, size, tie, and name if asked for; written out
    sources: DataFrame  # sid, source, source_size, target
    pieces: DataFrame  # row, id, sid, size, first (-1 without words), words, and takes: (pass, words taken of these) for each pass that takes some


def mix_blocks(docs: DataFrame, mix: Mix | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", name_col: str | None = None) -> Mixed:
    mix = mix or Mix()
    spark, text = docs.sparkSession, text_of(text_col)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(text).alias("tie"),
        *([F.col(name_col).alias("name")] if name_col else []),
    )
    rows = materialize(rows.withColumn("bucket", F.pmod(F.xxhash64("id", "tie"), F.lit(mix.buckets)).cast("int")), "mix-rows")
    sizes = {r[0]: int(r[1]) for r in rows.groupBy("source").agg(F.sum("size")).collect()}
    goal = targets(sizes, mix)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    sources = spark.createDataFrame([(k, s, sizes[s], float(goal.get(s, 0.0))) for k, s in enumerate(order)], "sid int, source string, source_size long, target double")
    light = rows.select("row", "id", "source", "size", "tie", "bucket")
    sums = light.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0)))
    sums = sums.join(sources.select("sid", F.col("source").alias("s")), F.col("source").eqNullSafe(F.col("s"))).select("sid", F.col("source").alias("s"), F.col("bucket").alias("b"), "base")
    inside = Window.partitionBy("source", "bucket").orderBy("id", "size", "tie", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = light.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).select("row", "id", "sid", "size", (F.col("at") + F.col("base")).alias("at"))
    span = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("at") / mix.block), F.floor((F.col("at") + F.col("size") - 1) / mix.block)))
    low, high = F.col("block") * mix.block, (F.col("block") + 1) * mix.block
    pieces = placed.select("*", F.explode_outer(span).alias("block")).select(
        "row", "id", "sid", "size", "block",
        F.coalesce(F.greatest(low, F.col("at")) - F.col("at"), F.lit(-1)).alias("first"),
        F.coalesce(F.least(high, F.col("at") + F.col("size")) - F.greatest(low, F.col("at")), F.lit(0)).alias("words"),
        (F.greatest(low, F.col("at")) - low).alias("inside"),
    )
    slots = output_slots(spark, [(float(goal.get(s, 0.0)), sizes[s]) for s in order], mix)
    taken = slots.groupBy("sid", "block").agg(F.collect_list(F.struct("pass", "upto")).alias("slots"))  # at most one a pass
    pieces = pieces.join(taken.hint("merge"), ["sid", "block"], "left")  # estimates for slots are far too low
    cut = F.transform("slots", lambda s: F.struct(s["pass"].alias("pass"), F.greatest(F.lit(0), F.least(F.col("words"), s["upto"] - F.col("inside"))).alias("words")))
    return Mixed(rows, sources, pieces.select("row", "id", "sid", "size", "first", "words", F.filter(cut, lambda x: x["words"] > 0).alias("takes")))


def mixed_sizes(docs: DataFrame, mix: Mix | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: id_col, size, source_size, target, taken (words the mix takes, repeats counted)."""
    m = mix_blocks(docs, mix, id_col, text_col, source_col)
    own = F.aggregate(F.coalesce("takes", F.array().cast("array<struct<pass:int,words:bigint>>")), F.lit(0).cast("long"), lambda n, x: n + x["words"])
    sums = m.pieces.groupBy("row", "id", "sid", "size").agg(F.sum(own).alias("taken"))
    return sums.join(m.sources, "sid").select(F.col("id").alias(id_col), "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def stretches(cuts: list[dict]) -> list[tuple[int, int]]:
    """The contiguous stretches (first word, number of words) that each pass takes, pass by pass. cuts: first, takes."""
    out: list[tuple[int, int]] = []
    for turn in sorted({t["pass"] for c in cuts for t in c["takes"]}):
        own = sorted((c["first"], t["words"]) for c in cuts for t in c["takes"] if t["pass"] == turn)
        start = len(out)
        for first, n in own:
            if len(out) > start and sum(out[-1]) == first:
                out[-1] = (out[-1][0], out[-1][1] + n)
            else:
                out.append((first, n))
    return out


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, text: the text as it is where a pass takes all its words, else from the first to the last word of each stretch."""
    for batch in batches:
        at, texts = [], []
        for k, (text, size, cuts) in enumerate(zip(batch.column("text").to_pylist(), batch.column("size").to_pylist(), batch.column("cuts").to_pylist(), strict=True)):
            raw, spans = b"", []
            for first, n in stretches(cuts):
                if n < size and not spans:
                    raw = text.encode()
                    spans = [m.span() for m in _WORD.finditer(raw)]
                texts.append(text if n == size else raw[spans[first][0] : spans[first + n - 1][1]].decode())
                at.append(k)
        yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(at, pa.int64())), pa.array(texts, pa.string())], names=["doc", "text"])


def mixed_documents(docs: DataFrame, mix: Mix | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus with the columns of docs: a row for each contiguous stretch of a document that a pass takes.

    Texts stay where they are until the last join, which finds them by a hash of all columns and compares id, source and text.
    """
    named, name = hashed_rows(docs)
    m = mix_blocks(named, mix, id_col, text_col, source_col, name)
    cuts = materialize(m.pieces.where("size(takes) > 0").groupBy("row").agg(F.collect_list(F.struct("first", "takes")).alias("cuts")), "cuts")
    cuts = cuts.join(m.rows.select("row", "id", "source", "size", "tie", "name"), "row").drop("row")
    others = [c for c in docs.columns if c != text_col]
    whole = distinct_rows(named.repartition(F.col(name)))
    whole = whole.select(F.col(name).alias("name"), F.col(id_col).alias("own_id"), F.col(source_col).cast("string").alias("own_source"), text_of(text_col).alias("text"), F.struct(*map(quoted, others)).alias("doc"))
    kind = whole.schema["doc"].dataType.simpleString()
    same = F.col("own_id").eqNullSafe(F.col("id")) & F.col("own_source").eqNullSafe(F.col("source")) & (F.xxhash64("text") == F.col("tie"))
    out = whole.join(cuts, "name").where(same).select("doc", "text", "size", "cuts").mapInArrow(_assemble, f"doc {kind}, text string")
    return out.select(*((F.col("text") if c == text_col else F.col(f"doc.{tick(c)}")).alias(c) for c in docs.columns))
