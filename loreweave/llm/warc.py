"""WARC archives in seekable Zstandard bundles.

Records are grouped into Zstandard frames that decompress on their own; a bundle is a run of frames followed by a seek table
in a skippable frame (the public seekable format: a list of compressed and uncompressed sizes, then a nine-byte footer).
A bundle's index maps each record to its frame and its offset inside the uncompressed frame, so one record is read by
decompressing one frame. Bundles are rows of a Parquet table (the bytes of a bundle are a complete .warc.zst file), as Spark
writes them to any store and commits them task by task; export_bundles writes them out as files.

Of records with equal payloads of at least `min_revisit` bytes, the one with the largest id is the response; the others are
revisits that name it. Which is which is found on ids and digests alone, a popular page's rows spread by salt; payloads are dealt
once, by digest and id. Defined results: a null payload is empty; smaller payloads are all responses; a very long payload is one
record in a frame of its own size; rows repeated with the largest id are all responses, and record ids differ even so; null ids are revisits of a record with an id, and responses among themselves; a null or odd url is percent-encoded;
other columns are ignored, whatever their names; an empty table gives a table without bundles.
"""

from __future__ import annotations

import hashlib
import struct
import urllib.parse
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.llm.common import materialize

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1

BUNDLES = "bundle string, data binary, records array<struct<id:bigint,frame:int,offset:int>>"
RECORDS = "id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary, bundle string, frame int, offset int"


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    entries = b"".join(struct.pack("<II", *x) for x in sizes)
    body = entries + struct.pack("<IBI", len(sizes), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def frame_spans(data: bytes) -> list[tuple[int, int]]:
    """Start and end of each frame, from the seek table at the end of a bundle."""
    count, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end of the bundle")
    spans, at, table = [], 0, len(data) - 9 - 8 * count
    for k in range(count):
        size = struct.unpack_from("<I", data, table + 8 * k)[0]
        spans.append((at, at + size))
        at += size
    return spans


def urn(key: int | None, digest: str, copy: str = "") -> str:
    """A record's id: rows of one id differ by their payload's digest, repeated rows by a number."""
    return f"<urn:record:{'none' if key is None else key}:{digest[:16]}{copy}>"


def record_bytes(key: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, date: str, copy: str = "") -> bytes:
    """One WARC/1.1 record. A revisit holds the HTTP head only; its payload's length is in that head."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {urn(key, digest, copy)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {urllib.parse.quote(url or '', safe=';/?:@&=+$,#%[]!*()~')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to, digest)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(frame: bytes, at: int) -> dict:
    """The record that starts at an offset of an uncompressed frame. A response's digest is computed anew and must agree."""
    cut = frame.index(b"\r\n\r\n", at)
    head = dict(x.split(": ", 1) for x in frame[at:cut].decode().split("\r\n")[1:])
    block = frame[cut + 4 : cut + 4 + int(head["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    number = lambda x: None if x[12:-1].partition(":")[0] == "none" else int(x[12:-1].partition(":")[0])
    out = {"id": number(head["WARC-Record-ID"]), "url": urllib.parse.unquote(head["WARC-Target-URI"]), "record_type": head["WARC-Type"], "refers_to": None}
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if head["WARC-Type"] == "revisit":
        out["refers_to"], payload = number(head["WARC-Refers-To"]), None
    elif hashlib.sha1(payload).hexdigest() != digest or len(payload) != size:
        raise ValueError(f"record {out['id']} is damaged")
    return out | {"payload_bytes": size, "payload_digest": digest, "payload": payload}


def with_revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_revisit: int, salts: int = 64) -> DataFrame:
    """id, url, payload, digest, record_type, refers_to, repeated (rows share id and digest)."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(url_col).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    light = rows.groupBy("id", "digest").agg(F.count("*").alias("n"), F.max(F.octet_length("payload") >= min_revisit).alias("large"))
    groups = light.where("large").groupBy("digest").agg(F.max("id").alias("last"), F.count("*").alias("ids")).where("ids > 1").select("digest", "last")
    copies = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    found = light.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(copies, ["digest", "salt"], "left")
    found = found.where("last is not null or n > 1").select(F.col("id").alias("i"), F.col("digest").alias("d"), "last", (F.col("n") > 1).alias("several"))
    joined = rows.join(found.hint("merge"), (F.col("digest") == F.col("d")) & F.col("id").eqNullSafe(F.col("i")), "left")  # repeated rows meet in one task
    revisit = F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last"))
    return joined.select("id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("last")).alias("refers_to"), F.coalesce("several", F.lit(False)).alias("repeated"))


def _pack(frame_bytes: int, bundle_bytes: int, level: int, date: str):
    schema = pa.schema([("bundle", pa.string()), ("data", pa.binary()), ("records", pa.list_(pa.struct([("id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        squeeze, seen = zstandard.ZstdCompressor(level=level), Counter()
        frame, frames, sizes, index, total = bytearray(), [], [], [], 0

        def close_frame():
            nonlocal total
            frames.append(squeeze.compress(bytes(frame)))
            sizes.append((len(frames[-1]), len(frame)))
            total += len(frame)
            frame.clear()

        def close_bundle():
            nonlocal number, total
            out = pa.RecordBatch.from_pylist([{"bundle": f"bundle-{task:06d}-{number:05d}", "data": b"".join(frames) + seek_table(sizes), "records": index}], schema)
            frames.clear(), sizes.clear(), index.clear()
            number, total = number + 1, 0
            return out

        for batch in batches:
            for *row, repeated in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "payload", "digest", "record_type", "refers_to", "repeated")), strict=True):
                index.append({"id": row[0], "frame": len(frames), "offset": len(frame)})
                copy = ""
                if repeated:
                    seen[row[0], row[3]] += 1
                    copy = f":{task}-{seen[row[0], row[3]] - 1}" if seen[row[0], row[3]] > 1 else ""
                frame += record_bytes(*row, date, copy)
                if len(frame) >= frame_bytes:
                    close_frame()
                if total >= bundle_bytes:
                    yield close_bundle()
        if frame:
            close_frame()
        if frames:
            yield close_bundle()

    return run


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 1000, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 24, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes every row as a record of a bundle below path. frame_bytes and bundle_bytes bound what a task holds (and one record)."""
    rows = with_revisits(pages, id_col, url_col, payload_col, min_revisit)
    rows.mapInArrow(_pack(frame_bytes, bundle_bytes, level, date), BUNDLES).write.option("compression", "uncompressed").parquet(path)


def _read(payloads: bool):
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdDecompressor()
        for batch in batches:
            for k in range(batch.num_rows):
                name, data, records = (batch.column(c)[k].as_py() for c in ("bundle", "data", "records"))
                spans, rows, held, frame = frame_spans(data), [], -1, b""
                for x in sorted(records, key=lambda x: (x["frame"], x["offset"])):
                    if x["frame"] != held:
                        if rows:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                        held, rows = x["frame"], []
                        a, b = spans[held]
                        frame = squeeze.decompress(data[a:b])
                    row = parse_record(frame, x["offset"])
                    if row["id"] != x["id"]:
                        raise ValueError(f"the index of {name} names {x['id']}, the record {row['id']}")
                    rows.append(row | {"payload": row["payload"] if payloads else None, "bundle": name, "frame": x["frame"], "offset": x["offset"]})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record of the bundles below path (columns RECORDS), frame by frame."""
    return spark.read.schema(BUNDLES).parquet(path).mapInArrow(_read(payloads), RECORDS)


def lookup(spark: SparkSession, path: str, ids: DataFrame, most_files: int = 10_000) -> DataFrame:
    """The records whose id is in the first column of ids. Bundles' indexes are read first, then only the files that hold one of
    the bundles named (beyond most_files, all of them), and only the records' frames are decompressed."""
    bundles = spark.read.schema(BUNDLES).parquet(path)
    wanted = ids.select(F.col(ids.columns[0]).cast("long").alias("id")).distinct()
    listed = bundles.select("bundle", F.col("_metadata.file_path").alias("file"), F.explode("records").alias("r")).select("bundle", "file", "r.*")
    chosen = materialize(listed.join(wanted, "id").groupBy("bundle", "file").agg(F.collect_list(F.struct("id", "frame", "offset")).alias("records")), "warc-hits")
    files = [r[0] for r in chosen.select("file").distinct().limit(most_files + 1).collect()]
    if not files:
        return spark.createDataFrame([], RECORDS)
    data = (spark.read.schema(BUNDLES).parquet(*files) if len(files) <= most_files else bundles).select("bundle", "data")
    return data.join(chosen.drop("file"), "bundle").select("bundle", "data", "records").mapInArrow(_read(True), RECORDS)


def export_bundles(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Writes each bundle below path to folder (any URI that Arrow's file systems know, shared by all executors) as a file
    <bundle>.warc.zst, first under a name of the task's own, so that a task that runs twice leaves one whole file. Gives bundle, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for name, data in zip(batch.column("bundle").to_pylist(), batch.column("data").to_pylist(), strict=True):
                own = f"{root}/.{name}.{TaskContext.get().taskAttemptId()}"
                with store.open_output_stream(own) as out:
                    out.write(data)
                store.move(own, f"{root}/{name}.warc.zst")
                yield pa.RecordBatch.from_pylist([{"bundle": name, "bytes": len(data)}])

    return materialize(spark.read.schema(BUNDLES).parquet(path).select("bundle", "data").mapInArrow(run, "bundle string, bytes bigint"), "warc-export")
