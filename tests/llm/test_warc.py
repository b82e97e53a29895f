from __future__ import annotations

import base64
import gzip
import hashlib
import random
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chunkwell.llm import warc

MARK = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello"
PAGES = "page_id bigint, url string, html string"


def _expected(rows):
    """Brute force: ``{(id, payload): (bytes, digest, type, refers)}`` of rows ``(id, url, html)``."""
    first = {}
    for id_, _, html in rows:
        body = (html or "").encode()
        key = (id_ is None, id_ or 0)
        first[body] = min(first.get(body, key), key)
    out = []
    for id_, _, html in rows:
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        none, least = first[body]
        is_first = (id_ is None, id_ or 0) == first[body]
        refers = None if is_first or none else str(least)
        out.append((None if id_ is None else str(id_), len(body), digest, "response" if is_first else "revisit", refers, True))
    return sorted(out, key=str)


def _read(spark, path):
    found = warc.read_records(spark, path).select(
        warc.row_id("record_id").alias("id"), "payload_bytes", "payload_digest", "record_type",
        warc.row_id("refers_to").alias("refers"), "intact",
    )
    return sorted(map(tuple, found.collect()), key=str)


def _hard_rows():
    rng = random.Random(5)
    letters = ["a", "é", "\r\n", "\r\n\r\n", "WARC/1.", "\r\n\r\nWARC/1.1\r\n", "🎉", " ", "\n"]
    rows = [
        (1, "http://a/", None),
        (2, "http://b/", ""),
        (3, None, MARK),
        (4, "http://c d/\r\nX: y", MARK * 40),
        (5, "http://e/", "WARC/1.1"),
        (6, "http://f/", "\r\nWARC/1.1 x"),
        (7, "http://g/", "x" * 5_000),
        (8, "http://h/", "x" * 5_000),
        (8, "http://h/", "x" * 5_000),
        (9, "http://i/", "ends\r\n\r\n"),
        (10, "http://i/", "ends\r\n"),
        (None, "http://j/", "no id"),
        (11, "http://k/", "no id"),
        (None, "http://l/", "only without id"),
    ]
    return rows + [(100 + k, f"http://r/{k}", "".join(rng.choices(letters, k=rng.randrange(400)))) for k in range(200)]


@pytest.mark.parametrize("chunk, compression", [(7, "gzip"), (64, "none"), (1 << 16, "gzip")])
def test_round_trip(spark, new_dir, chunk, compression):
    rows = _hard_rows()
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    path = new_dir()
    warc.write_archives(pages, path, chunk_bytes=chunk, compression=compression)
    assert _read(spark, path) == _expected(rows)


def test_payloads_come_back_byte_by_byte(spark, new_dir):
    rows = [r for r in _hard_rows() if r[0] is not None and r[0] not in (8,)]
    path = new_dir()
    warc.write_archives(spark.createDataFrame(rows, PAGES), path, chunk_bytes=50)
    got: dict = {}
    chunks = warc.read_chunks(spark, path).where("record_type != 'revisit'")
    for r in chunks.withColumn("id", warc.row_id("record_id")).collect():
        got.setdefault(r["id"], []).append((r["segment"], bytes(r["data"])))
    for id_, _, html in rows:
        if str(id_) in got:
            parts = sorted(got[str(id_)])
            assert [n for n, _ in parts] == list(range(1, len(parts) + 1))
            assert b"".join(d for _, d in parts) == (html or "").encode()


@pytest.mark.parametrize("split", [397, 1_013])
def test_small_splits_of_plain_archives(spark, new_dir, split):
    rows = _hard_rows()[:34]
    path = new_dir()
    pages = spark.createDataFrame(rows, PAGES).where("html IS NULL OR length(html) < 1000")
    rows = [tuple(r) for r in pages.collect()]
    warc.write_archives(pages, path, chunk_bytes=100, compression="none")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert _read(spark, path) == _expected(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_archives_follow_the_format(spark, new_dir):
    rows = _hard_rows()
    path = new_dir()
    warc.write_archives(spark.createDataFrame(rows, PAGES), path, chunk_bytes=64)
    ids = []
    for file in Path(path).glob("*.gz"):
        data = gzip.decompress(file.read_bytes())
        at = 0
        while at < len(data):  # by lengths alone
            end = data.index(b"\r\n\r\n", at)
            lines = data[at:end].decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            fields = dict(line.split(": ", 1) for line in lines[1:])
            assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= set(fields)
            if fields["WARC-Type"] == "revisit":
                assert "WARC-Refers-To" in fields and "WARC-Profile" in fields
            else:
                ids.append(fields["WARC-Record-ID"])
            at = end + 4 + int(fields["Content-Length"])
            assert data[at : at + 4] == b"\r\n\r\n"
            at += 4
    assert len(ids) > len(rows)


def _foreign(bodies, version=b"WARC/1.0"):
    out = []
    for k, body in enumerate(bodies):
        block = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + body
        head = [version, b"WARC-Type: response", b"WARC-Record-ID: <urn:uuid:%d>" % k, b"Content-Type: application/http; msgtype=response"]
        out.append(b"\r\n".join([*head, b"Content-Length: %d" % len(block), b"", b""]) + block + b"\r\n\r\n")
    return out


def test_archives_of_others(spark, new_dir):
    bodies = [b"plain", MARK.encode() * 3, b"", "ü".encode() * 100]
    records = _foreign(bodies)
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:i>\r\nContent-Length: 4\r\n\r\na: b\r\n\r\n"
    place = Path(new_dir())
    place.mkdir(parents=True)
    (place / "one.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in [info, *records]))
    (place / "two.warc").write_bytes(info + b"".join(_foreign(bodies[:2], b"WARC/1.1")))
    found = warc.read_records(spark, str(place)).where("record_type = 'response'").collect()
    wanted = sorted((len(b), base64.b32encode(hashlib.sha1(b).digest()).decode()) for b in [*bodies, *bodies[:2]])
    assert sorted((r.payload_bytes, r.payload_digest) for r in found) == wanted
    assert all(r.intact for r in found)


def test_a_cut_archive_is_an_error(spark, new_dir):
    place = Path(new_dir())
    place.mkdir(parents=True)
    (place / "cut.warc").write_bytes(b"".join(_foreign([b"whole", b"x" * 100]))[:-60])
    with pytest.raises(Exception, match="is cut"):
        warc.read_records(spark, str(place)).collect()


def test_a_missing_segment_is_told(spark, new_dir):
    path = new_dir()
    warc.write_archives(spark.createDataFrame([(1, "u", "0123456789" * 3)], PAGES), path, chunk_bytes=10, compression="none")
    [file] = [f for f in Path(path).glob("part-*.txt") if f.stat().st_size]
    data = file.read_bytes()
    at = data.index(b"WARC-Segment-Number: 2")
    start, end = data.rindex(b"WARC/1.1", 0, at), data.index(b"WARC/1.1", at)
    place = Path(new_dir())
    place.mkdir(parents=True)
    (place / "a.warc").write_bytes(data[:start] + data[end:])
    [row] = warc.read_records(spark, str(place)).collect()
    assert not row.intact and row.payload_bytes == 20


def test_digests_grow_with_the_chunks(spark):
    pages = spark.createDataFrame([(1, "u", "abcdef"), (2, "v", None)], PAGES)
    rows = warc.record_chunks(pages, "page_id", "html", chunk_bytes=4).orderBy("id", "segment").collect()
    assert [(r.id, r.segment, bytes(r.data), r.upto) for r in rows] == [(1, 1, b"abcd", 4), (1, 2, b"ef", 6), (2, 1, b"", 0)]
    assert [bytes(r.digest) for r in rows] == [hashlib.sha1(x).digest() for x in (b"abcd", b"abcdef", b"")]


def test_small_payloads_are_responses(spark, new_dir):
    path = new_dir()
    rows = [(1, "a", "xy"), (2, "b", "xy"), (3, "c", "long enough"), (4, "d", "long enough")]
    warc.write_archives(spark.createDataFrame(rows, PAGES), path, least_bytes=3)
    types = {r[0]: r[3] for r in _read(spark, path)}
    assert types == {"1": "response", "2": "response", "3": "response", "4": "revisit"}


def test_empty_table_and_clashing_names(spark, new_dir):
    path = new_dir()
    warc.write_archives(spark.createDataFrame([], PAGES), path)
    assert warc.read_records(spark, path).count() == 0
    clash = spark.createDataFrame([("a b:c", "x", 1, 2)], "id string, body string, key int, size int")
    path = new_dir()
    extra = clash.withColumns({c: F.lit(uuid.uuid4().hex) for c in ("segment", "digest", "whole", "refers", "data", "upto")})
    warc.write_archives(extra, path, "id", "body", None)
    assert [r[:2] for r in _read(spark, path)] == [("a b:c", 1)]


def test_many_equal_payloads(spark, new_dir):
    path = new_dir()
    rows = [(k, "u", "same" if k % 3 == 0 else f"own {k}") for k in range(3_000)]
    warc.write_archives(spark.createDataFrame(rows, PAGES), path)
    found = _read(spark, path)
    assert found == _expected(rows)
    assert sum(r[3] == "revisit" for r in found) == 999
