from __future__ import annotations

import gzip
import hashlib
import io
import zlib

import pytest

from millrace.llm import warc


def _member(payload: bytes, page: int = 1, refers: int | None = None) -> bytes:
    return gzip.compress(warc.record(page, "http://a/", payload, refers, hashlib.sha256(payload).digest()))


def test_members_are_read_one_by_one():
    payloads = [b"", b"x" * 200_000, "é\r\n\r\n".encode() * 40]
    stream = io.BytesIO(b"".join(_member(p, i) for i, p in enumerate(payloads)))
    rows = [warc.parse(f, b) for f, b in warc.read_records(stream)]
    assert [(r[0], r[4], r[5], r[6]) for r in rows] == [(i, len(p), hashlib.sha256(p).hexdigest(), p) for i, p in enumerate(payloads)]


@pytest.mark.parametrize("spoil", ["cut", "digest", "length", "junk"])
def test_bad_archives_are_refused(spoil):
    data = _member(b"y" * 500)
    if spoil == "cut":
        data = data[:-20]
    elif spoil == "junk":
        data += b"not gzip"
    else:
        raw = zlib.decompress(data, 31)
        raw = raw.replace(b"yyyyy", b"zzzzz", 1) if spoil == "digest" else raw[:-1]
        data = gzip.compress(raw)
    with pytest.raises(warc.WarcError):
        [warc.parse(f, b) for f, b in warc.read_records(io.BytesIO(data))]


def test_round_trip_of_odd_pages(spark, monkeypatch):
    same = "<p>" + "same" * 50
    rows = [(5, "u5", same), (3, "u3", same), (3, "u3", same), (9, None, same), (1, "u1", None), (2, "u\r\n2", ""), (4, "u4", "short"), (6, "u6", "short"), (None, "n", same), (7, "u7", "é" * 120)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    out = {}
    for r in warc.round_trip(df).collect():
        out.setdefault(r.page_id, []).append(r)
    assert {k: [(r.record_type, r.refers_to) for r in v] for k, v in out.items()} == {
        5: [("revisit", 3)], 3: [("response", None)] * 2, 9: [("revisit", 3)], 1: [("response", None)], 2: [("response", None)],
        4: [("response", None)], 6: [("response", None)], None: [("response", None)], 7: [("response", None)],
    }
    assert all(r.payload_digest == hashlib.sha256(same.encode()).hexdigest() and r.payload_bytes == len(same) for k in (5, 3, 9) for r in out[k])
    assert bytes(out[7][0].payload).decode() == "é" * 120
    assert warc.round_trip(df.where("false")).count() == 0


def test_archives_roll_over(spark):
    pages = spark.range(200).selectExpr("id AS page_id", "'u' AS url", "sha2(cast(id AS string), 512) AS html").coalesce(1)
    folder = "file://" + warc.scratch_path(spark, "warc").removeprefix("file://")
    manifest = warc.write_archives(pages, folder, archive_bytes=20_000)
    assert manifest.count() > 2
    assert warc.read_archives(manifest, folder).selectExpr("sum(page_id)").first()[0] == 199 * 100


def test_folders_are_of_the_default_file_system(spark):
    assert warc.qualified(spark, "/tmp/x/y") == "file:///tmp/x/y" == warc.qualified(spark, "file:/tmp/x/y")
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.viewfs.mounttable.other.link./shared", "file:///tmp")
    conf.set("fs.defaultFS", "viewfs://other")
    try:
        assert warc.qualified(spark, "/shared/y") == "viewfs://other/shared/y"
    finally:
        conf.set("fs.defaultFS", before)
