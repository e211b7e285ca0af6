"""Near-duplicate detection: a multi-index Hamming join over b-bit MinHash signatures.

A document's set holds its distinct shingles of `words` words, as 64-bit digests; documents with equal sets are one class. A
class's signature has chunks * size symbols of 16 bits, each the low bits of a minimum over a hash order. The symbol distance
of two signatures estimates their dissimilarity. Signatures are split into `chunks` chunks; by the pigeonhole principle, two
that differ in at most 2 * chunks - 1 symbols agree in some chunk up to one symbol. So a class gets a key for every chunk and
every position left out of it, and all pairs under that distance share a key.

Pairs of a key's bucket are not listed. Every member is first compared with one leader of its bucket, the member that meets
the most others over all its buckets. Only members of buckets that then lie in more than one component are looked at again,
grouped by leader. A group's core holds the shingles that more than `common` of its members have. The member closest to the
core becomes the group's second leader and is compared with all. After that only pairs across components could change
anything, and what x and y share is at most what either shares with the core plus what they share outside it. So a pair
either shares a shingle outside the core, which at most `common` members have (and of which the prefix bound leaves the rare
ones that could still add up to a link), or shares core shingles alone, enough of them for a link. Those pairs are found over
the least common core shingles: in one order of them, from the least common on, the first that both have leaves either side
with at least as many as the link asks for. How many a member is listed under depends on its partner's size, so sizes are
dealt into narrow classes. Documents of one template, whose own parts tell them apart too far for a link, share none of these
and don't meet. Nothing else can be linked, so no link that changes a component is lost, and a large group of copies costs a
few pairs per member. Every candidate is confirmed on the full sets.

Defined results: a null or empty text has an empty set and is linked with nothing; with fewer words than a shingle the whole
sequence is one; rows repeated with one id are a class of their own or join one, and are both kept if their id is the
component's; null ids count after all others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import hashed_rows, kept, materialize, text_of, without_dropped
from loreweave.llm.components import components


@dataclass(frozen=True)
class Near:
    words: int = 5
    percent: int = 80  # linked if 100 * intersection >= percent * union
    chunks: int = 10
    size: int = 5
    common: int = 16
    ratio: float = 1.05  # sizes of one class differ by at most this factor
    seed: int = 5

    @property
    def symbols(self) -> int:
        return self.chunks * self.size

    @property
    def distance(self) -> int:
        """The largest distance under which every pair shares a key: one error a chunk leaves some chunk with at most one."""
        return 2 * self.chunks - 1


_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Digests(dict):
    """Digest of a word; a worker's cache."""

    def __missing__(self, word: bytes) -> int:
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def shingles(text: str, words: int) -> np.ndarray:
    """The sorted distinct digests of a text's shingles. bytes.lower and bytes.split know ASCII only, as is asked for."""
    split = text.encode().lower().split()
    if not split:
        return np.empty(0, np.uint64)
    digests = kept("word digests", _Digests)
    if len(digests) > 250_000:
        digests.clear()
    w = np.fromiter(map(digests.__getitem__, split), np.uint64, len(split))
    if len(w) < words:
        return mix(np.array([len(w) + int.from_bytes(xxhash.xxh64_digest(w.tobytes()), "little") & 0xFFFFFFFFFFFFFFFF], np.uint64))
    n = len(w) - words + 1
    out = np.zeros(n, np.uint64)
    for k in range(words):
        out = mix(out + w[k : k + n] * _FACTORS[k % len(_FACTORS)] + np.uint64(k)) if k == words - 1 else (out + w[k : k + n]) * _FACTORS[k % len(_FACTORS)]
    return np.unique(out)


def signatures(sets: list[np.ndarray], near: Near) -> np.ndarray:
    """A row of 16-bit symbols per set; sets are not empty."""
    rng = np.random.default_rng(near.seed)
    a = rng.integers(0, 1 << 31, near.symbols, np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 1 << 32, near.symbols, np.uint32)
    flat = np.concatenate(sets)
    base = (flat >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), near.symbols), np.uint16)
    for k in range(near.symbols):
        out[:, k] = np.minimum.reduceat(base * a[k] + b[k], starts).astype(np.uint16)
    return out


def set_key(own: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None


def _sign(near: Near, step: int = 128):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                sets = [shingles(t, near.words) for t in batch.column("text").to_pylist()]
                full = [s for s in sets if len(s)]
                sig = iter(signatures(full, near)) if full else iter(())
                sigs = [next(sig).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "id", "tkey")), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(set_key, sets), pa.binary()), pa.array(sigs, pa.binary())], names=["row", "id", "tkey", "n", "key", "sig"])

    return run


def bucket_keys(sig: np.ndarray, near: Near) -> np.ndarray:
    """For each signature, a key for every chunk and position left out of it."""
    parts = sig.reshape(len(sig), near.chunks, near.size).astype(np.uint64)
    out = np.empty((len(sig), near.chunks, near.size), np.uint64)
    for gone in range(near.size):
        key = np.arange(near.chunks, dtype=np.uint64)[None, :] * np.uint64(near.size) + np.uint64(gone + 1)
        key = np.broadcast_to(mix(key), parts.shape[:2])
        for k in range(near.size):
            if k != gone:
                key = mix(key * _FACTORS[0] + parts[:, :, k])
        out[:, :, gone] = key
    return out.reshape(len(sig), -1).view(np.int64)


def _array(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, width)


def _keys(near: Near):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = bucket_keys(_array(batch.column("sig"), near.symbols), near)
                node, n = (np.repeat(batch.column(c).to_numpy(), keys.shape[1]) for c in ("node", "n"))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(node), pa.array(n)], names=["bucket", "node", "n"])

    return run


def _sets(near: Near, step: int = 128):
    """The set of each class, from the first of its texts whose set has the class's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                sets = [next(s.tobytes() for s in (shingles(t, near.words) for t in texts) if set_key(s) == key) for key, texts in zip(batch.column("key").to_pylist(), batch.column("texts").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return run


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which elements of a are in b; both are sorted."""
    return b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a if len(b) else np.zeros(len(a), bool)


def _pairs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
        yield np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sizes of a pair's sets and the number of shingles that they share."""
    for batch in batches:
        counts = [(len(x), len(y), int(shared(x, y).sum()) if len(x) <= len(y) else int(shared(y, x).sum())) for x, y in _pairs(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3))], names=["a", "b", "n_a", "n_b", "common"])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """leader, node, shingle: a row per shingle of a node's set."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("shingles")]
            leader, node = (np.repeat(part.column(c).to_numpy(), [len(x) for x in sets]) for c in ("leader", "node"))
            yield pa.RecordBatch.from_arrays([pa.array(leader), pa.array(node), pa.array(np.concatenate(sets))], names=["leader", "node", "shingle"])


def met(rows: DataFrame, leaders: DataFrame, key: str = "leader", by: str = "node", how: str = "inner", salts: int = 32) -> DataFrame:
    """rows with what leaders says of their key. A key's rows are spread over `salts` tasks by another column, so that a large
    group doesn't meet in one; leaders has a row each, and is repeated as often."""
    copies = leaders.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(copies, [key, "salt"], how).drop("salt")


class NearDuplicates:
    """classes (node, key, tkey, n, sig, min_id), links (a, b) between different classes that decide all components, and those as
    roots (node, root)."""

    def __init__(self, docs: DataFrame, near: Near | None = None, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None):
        self.near, self.id_col = near or Near(), id_col
        text = text_of(text_col)
        whole = dict(docs.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint")
        sql = "bigint" if whole else "string"
        row = F.col(row_col) if row_col else F.lit(0).cast("long")
        self.texts = docs.select(row.alias("row"), F.col(id_col).cast(sql).alias("id"), F.xxhash64(F.col(id_col), text).alias("tkey"), text.alias("text"))
        signed = self.texts.mapInArrow(_sign(self.near), f"row {self.texts.schema['row'].dataType.simpleString()}, id {sql}, tkey bigint, n bigint, key binary, sig binary")
        self.signed = materialize(signed, "signatures")
        self.classes = self.links = self.cross = self.roots = None

    def run(self) -> "NearDuplicates":
        near = self.near
        found = self.signed.where("n > 0").groupBy("key").agg(F.min("tkey").alias("tkey"), F.first("n").alias("n"), F.first("sig").alias("sig"))
        self.classes = materialize(found.withColumn("node", F.monotonically_increasing_id()), "classes")
        keys = self.classes.select("node", "n", "sig").mapInArrow(_keys(near), "bucket bigint, node bigint, n bigint")
        crowded = keys.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
        found = materialize(keys.join(crowded, "bucket"), "found")
        weight = found.groupBy("node").agg(F.sum("members").alias("weight"))
        lead = found.select("bucket", "node").join(weight, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("l"))
        members = materialize(found.join(lead, "bucket").select("bucket", "node", "n", F.col("l.node").alias("leader")), "members")
        sets = materialize(self.sets(found.select("node").distinct()), "sets")
        stars = materialize(self.common(members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), sets), "stars")
        linked = 100 * F.col("common") >= near.percent * (F.col("n_a") + F.col("n_b") - F.col("common"))
        first = stars.where(linked).select("a", "b")
        roots = components(first)
        placed = members.where("node <> leader").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        split = placed.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("bucket")
        groups = members.join(split, "bucket").select("leader", "node", "n").distinct()  # a leader is a member of its bucket
        rows = self.against_core(materialize(groups, "groups"), sets)
        centre = rows.groupBy("leader").agg(F.max(F.struct((2 * F.col("core") - F.col("n")).alias("near"), "node")).alias("c")).select("leader", F.col("c.node").alias("centre"))
        second = met(rows, centre).where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
        more = materialize(self.common(second, sets).where(linked).select("a", "b"), "core-links")
        roots = roots if more.isEmpty() else components(more, roots)
        rows = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        split = rows.groupBy("leader").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("leader")
        rows = materialize(met(rows, split), "split-groups")
        rare = rows.select("leader", "node", "n", "root", F.explode("rare").alias("shingle"))
        deep = self.core_keys(rows)
        apart = (F.col("x.low") == F.col("x.high")) | (F.col("x.own") != F.col("y.own"))
        enough = near.percent * (F.col("x.n") + F.col("y.n")) <= (100 + near.percent) * F.least(F.col("x.core") - F.col("x.pos"), F.col("y.core") - F.col("y.pos"))
        sizes = rows.groupBy("leader", "root").agg(F.count("*").alias("c")).groupBy("leader").agg(F.max(F.struct("c", "root")).alias("m")).select("leader", F.col("m.root").alias("main"))
        outer = met(deep, sizes).where("root <> main").drop("main")  # of two components, one is not the group's largest
        self.cross = self.across(rare, rare, ["leader", "shingle"]).union(self.across(outer, deep, ["leader", "shingle", "low", "high"], apart & enough)).distinct()
        last = materialize(self.common(self.cross, sets).where(linked).select("a", "b"), "cross-links")
        self.links, self.roots = first.union(more).union(last), roots if last.isEmpty() else components(last, roots)
        return self

    def core_keys(self, rows: DataFrame) -> DataFrame:
        """leader, node, n, core, root, own (the node's size class), low, high (its class and a partner's), pos, shingle: the core
        shingles, from the least common on, of which one is the first that the node shares with a linked partner of that size
        class, if what they share lies in the core. Nodes with too little in the core have no rows."""
        near = self.near
        size_class = lambda n: F.floor(F.log(n) / F.log(F.lit(near.ratio))).cast("int")
        least, most = F.ceil(near.percent * F.col("n") / F.lit(100)), F.floor(100 * F.col("n") / F.lit(near.percent))
        dealt = rows.where("size(frequent) > 0").withColumn("own", size_class(F.col("n"))).withColumn("other", F.explode(F.sequence(size_class(least), size_class(most))))
        smallest = F.greatest(least, F.floor(F.pow(F.lit(near.ratio), "other")))
        links_at = F.ceil(near.percent * (F.col("n") + smallest) / F.lit(100 + near.percent))
        listed = F.slice("frequent", F.lit(1), F.greatest(F.lit(0), F.col("core") - links_at + 1).cast("int"))
        return dealt.select("leader", "node", "n", "core", "root", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), F.posexplode(listed).alias("pos", "shingle"))

    def against_core(self, groups: DataFrame, sets: DataFrame) -> DataFrame:
        """leader, node, n, core (shingles the node has in its group's core), rare (those outside it that may find a partner), frequent
        (those inside it, the least common first, as many as a link's first shared one may be among). Written out.

        A partner has at least percent / 100 of a node's size, so a link shares that many shingles, and all but those in the core
        are outside it. Of `more` or more common ones, one is among all but the last more - 1 of either side, rarest first.
        """
        near = self.near
        spread = groups.select("leader", "node").join(sets, "node").mapInArrow(_spread, "leader bigint, node bigint, shingle bigint")
        often = spread.groupBy("leader", "shingle").agg(F.count("*").alias("c")).where("c > 1")
        met = spread.join(often.hint("merge"), ["leader", "shingle"])
        in_core = F.col("c") > near.common
        listed = lambda which: F.sort_array(F.collect_list(F.when(which, F.struct("c", "shingle"))))
        own = met.groupBy("leader", "node").agg(F.count_if(in_core).alias("core"), listed(~in_core).alias("met"), listed(in_core).alias("inside"))
        own = own.join(groups, ["leader", "node"])
        least = F.ceil(near.percent * F.col("n") / F.lit(100))
        more = F.greatest(F.lit(1), least - F.col("core"))
        outside = F.col("n") - F.col("core")
        keep = F.greatest(F.lit(0), outside - more + 1 - (outside - F.size("met")))
        first = lambda c, k: F.slice(F.transform(c, lambda x: x["shingle"]), F.lit(1), k.cast("int"))
        rows = own.select("leader", "node", "n", "core", first("met", keep).alias("rare"), first("inside", F.greatest(F.lit(0), F.col("core") - least + 1)).alias("frequent"))
        return materialize(rows, "cores")

    def across(self, xs: DataFrame, ys: DataFrame, keys: list[str], also: Column | None = None) -> DataFrame:
        """Pairs of nodes under one key that lie in different components and whose sizes allow a link."""
        x, y = xs.alias("x"), ys.alias("y")
        hold = (F.col("x.root") != F.col("y.root")) & (100 * F.least("x.n", "y.n") >= self.near.percent * F.greatest("x.n", "y.n"))
        if xs is ys:
            hold = hold & (F.col("x.node") < F.col("y.node"))
        for key in keys:
            hold = (F.col(f"x.{key}") == F.col(f"y.{key}")) & hold
        pairs = x.join(y, hold if also is None else hold & also)
        return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()

    def sets(self, nodes: DataFrame) -> DataFrame:
        """node, shingles of the given nodes, from the text each class's tkey names."""
        wanted = self.classes.join(nodes, "node").select("tkey", "node", "key")
        texts = self.texts.join(wanted, "tkey").groupBy("node", "key").agg(F.collect_set("text").alias("texts"))  # one text, but for hashes equal by chance
        return texts.mapInArrow(_sets(self.near), "node bigint, shingles binary")

    def common(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """a, b, n_a, n_b and the number of shingles that are in both full sets."""
        full = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}"))
        return pairs.join(full("b"), "b").join(full("a"), "a").select("a", "b", "set_a", "set_b").mapInArrow(_common, "a bigint, b bigint, n_a bigint, n_b bigint, common bigint")


def near_components(docs: DataFrame, near: Near | None = None, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Per row: id_col, n_shingles, component_id (smallest id reachable over links), kept (the row's id is that one), and first:
    the row is the one of its component with the smallest id and then the smallest row_col."""
    dup = NearDuplicates(docs, near, id_col, text_col, row_col).run()
    rows = dup.signed.select("row", "id", "n", "key")
    groups = dup.classes.select("node", "key").join(dup.roots, "node", "left").select("key", F.coalesce("root", "node").alias("root"))
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    best = materialize(rows.where("n > 0").groupBy("key").agg(F.min(rank).alias("best")).join(groups, "key"), "best")
    several = best.groupBy("root").agg(F.min("best").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    named = met(best, several, "root", "key", "left").select("key", F.coalesce("least", "best").alias("least"))
    alone = F.col("least").isNull()
    out = rows.join(named, "key", "left").select(
        "row", F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(alone, F.col("id")).otherwise(F.col("least.id")).alias("component_id"),
        (alone | (F.col("least.row") == F.col("row")) & F.col("id").eqNullSafe(F.col("least.id"))).alias("first"),
    )
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, near: Near | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component; rows with empty sets stay. Rows equal in all columns are one."""
    rows, row = hashed_rows(docs)
    return without_dropped(rows, row, near_components(rows, near, id_col, text_col, row).select("row", F.col("first").alias("kept")))
