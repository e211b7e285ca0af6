"""Archives: an exact round trip, the seek table, single records."""

from __future__ import annotations

import hashlib
import re

import zstandard

from loreweave.llm import warc
from loreweave.llm.common import scratch_path

SCHEMA = "page_id long, url string, html string, id int, payload string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 7, "clash") for r in rows], SCHEMA)


ROWS = [(1, "http://a/ä b\r\nX", "x" * 1000), (2, None, "x" * 1000), (3, "u", "y" * 999), (4, "u", "y" * 999), (5, "u", None), (6, "u", ""), (7, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (8, "u", "é" * 300_000), (None, "u", "x" * 1000), (9, "u", "z" * 2000), (9, "u", "z" * 2000), (10, "ü", "é" * 500)]


def test_round_trip(spark):
    path = scratch_path(spark, "t")
    warc.write_archive(pages(spark, ROWS), path, frame_bytes=2000, bundle_bytes=5000)
    got = warc.read_archive(spark, path).collect()
    assert len(got) == len(ROWS)
    kinds = {}
    for r in got:
        kinds.setdefault(r.id, []).append((r.record_type, r.refers_to, r.payload_bytes))
    assert kinds[1] == [("revisit", 2, 1000)] and kinds[None] == [("revisit", 2, 1000)] and kinds[2] == [("response", None, 1000)]
    assert kinds[3] == kinds[4] == [("response", None, 999)] and kinds[5] == kinds[6] == [("response", None, 0)]
    assert kinds[9] == [("response", None, 2000)] * 2
    whole = {i: (h or "").encode() for i, _, h in ROWS}
    for r in got:
        assert r.payload_digest == hashlib.sha1(whole[r.id] if r.id else b"x" * 1000).hexdigest()
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == whole[r.id]


def test_bundles_are_plain_zstandard(spark):
    """Any decoder reads a bundle from front to back, skipping the seek table."""
    path = scratch_path(spark, "t")
    warc.write_archive(pages(spark, ROWS), path, frame_bytes=2000, bundle_bytes=5000)
    for row in spark.read.parquet(path).collect():
        data = bytes(row.data)
        spans = warc.frame_spans(data)
        frames = [zstandard.ZstdDecompressor().decompress(data[a:b]) for a, b in spans]
        assert b"".join(frames).count(b"WARC-Record-ID: ") == len(row.records)
        assert all(frames[x.frame][x.offset :].startswith(b"WARC/1.1\r\n") for x in row.records)


def test_lookup(spark):
    path = scratch_path(spark, "t")
    warc.write_archive(pages(spark, ROWS), path, frame_bytes=2000, bundle_bytes=5000)
    got = warc.lookup(spark, path, spark.createDataFrame([(7,), (8,), (99,)], "k long")).collect()
    assert sorted((r.id, r.payload_bytes) for r in got) == [(7, 16), (8, 600_000)]


def test_record_ids_differ(spark, tmp_path):
    path = scratch_path(spark, "t")
    rows = [*ROWS, *[(20, "u", "w" * 1500)] * 5, (19, "u", "w" * 1500), *[(None, "n", "q")] * 3]
    warc.write_archive(pages(spark, rows), path, frame_bytes=2000, bundle_bytes=5000)
    out = warc.export_bundles(spark, path, f"file://{tmp_path}/out").collect()
    ids, refers, n = [], [], 0
    for r in out:
        data = (tmp_path / "out" / f"{r.bundle}.warc.zst").read_bytes()
        assert len(data) == r.bytes
        for a, b in warc.frame_spans(data):
            frame = zstandard.ZstdDecompressor().decompress(data[a:b])
            ids += re.findall(rb"WARC-Record-ID: (\S+)", frame)
            refers += re.findall(rb"WARC-Refers-To: (\S+)", frame)
    assert len(ids) == len(set(ids)) == len(rows) and set(refers) <= set(ids)
    assert len(list((tmp_path / "out").iterdir())) == len(out)


def test_lookup_reads_named_files_only(spark):
    path = scratch_path(spark, "t")
    warc.write_archive(pages(spark, [(k, "u", f"text {k} " * 300) for k in range(200)]).repartition(8), path, frame_bytes=2000, bundle_bytes=5000)
    got = warc.lookup(spark, path, spark.createDataFrame([(5,)], "k long"))
    assert [(r.id, bytes(r.payload)[:6]) for r in got.collect()] == [(5, b"text 5")]
    scans = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "data#" in x and "Scan" in x]
    assert scans and all("1 paths" in x for x in scans)


def test_empty(spark):
    path = scratch_path(spark, "t")
    warc.write_archive(pages(spark, []), path)
    assert warc.read_archive(spark, path).collect() == []
