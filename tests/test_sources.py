from __future__ import annotations

import os
from pathlib import PurePosixPath
from urllib.parse import urlparse

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

import chunkwell as cw
from chunkwell.sources.uris import SUPPORTED_FORMATS

URLS = [
    "http://h/a/b.pdf", "https://h/a/b/", "http://h", "http://h/", "http://h?x=.pdf", "h/a.TXT",
    "file:///x/y.md", "//h/x.txt", "http://a_b/x", "http://h/a b/c.docx", "HTTP://H/A.HTML",
    "http://h/docs/12", "http://h/PDF/x", "http://h/x.pdf?q=1", "http://h/x.pdf#top", "/a/.pdf",
    ".pdf", "x.tar.gz", "a.", "", "/", "not a url", "http:///x", "mailto:a@b.c", "ftp://h/a.eml",
    "http://h/a;v=1/b.txt;p=2", "http://h/a.b/c", "x/y.Msg/", "a/b/.", "1http://h/x", "é.txt",
]


def test_addresses_follow_path_and_url_rules(spark):
    rows = spark.createDataFrame([(u,) for u in URLS], "url string")
    got = {r.url: r for r in cw.classify_sources(rows, "url").collect()}
    names = {r.url: r.source_name for r in cw.infer_source_name(rows).collect()}
    for url in URLS:
        parsed = urlparse(url)
        suffix = PurePosixPath(url).suffix.lower()
        assert got[url].is_url == bool(parsed.scheme and parsed.netloc), url
        assert got[url].suffix == suffix, url
        assert got[url].is_supported == (suffix in SUPPORTED_FORMATS), url
        name = PurePosixPath(parsed.path).name
        if "." not in name:
            low = url.lower()
            name = "document." + ("pdf" if "pdf" in low else "docx" if "doc" in low else "txt")
        assert names[url] == name, url


def test_null_address(spark):
    rows = spark.createDataFrame([(None,)], "url string")
    assert cw.classify_sources(rows, "url").head().is_url is False


def _landing(folder, files):
    os.makedirs(folder)
    for name, data in files.items():
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)


def test_read_documents(spark, new_dir):
    root = new_dir()
    _landing(
        root,
        {
            "a.txt": "Grüße\n".encode(), "b.HTML": b"<p>x</p>", "c.pdf": b"%PDF-1.4",
            "d.md": b"bad \xff byte", "e": b"no suffix", "f.jsonl": b"{}", "g.json": b"{}",
        },
    )
    got = {r.file_name: r for r in cw.read_documents(spark, root).collect()}
    assert set(got) == {"a.txt", "b.HTML", "d.md", "g.json"}
    assert got["a.txt"].content == "Grüße\n" and got["a.txt"].file_size == 8
    assert got["b.HTML"].format == "html" and got["a.txt"].doc_uri.endswith("/a.txt")
    assert got["d.md"].content == "bad � byte"
    assert cw.read_documents(spark, f"{root}/*.txt").count() == 1
    with pytest.raises(AnalysisException):
        cw.read_documents(spark, root + "-missing").count()


def test_documents_from_table(spark):
    rows = spark.createDataFrame([("http://h/x.md", "tëxt", "de")], "u string, t string, lang string")
    doc = cw.documents_from_table(rows, "u", "t", metadata=["lang"]).head()
    assert (doc.file_name, doc.format, doc.file_size) == ("x.md", "md", 5)
    assert doc.source_url == "http://h/x.md" and doc.metadata == {"lang": "de"}


def test_spread_only_small_tables(spark, new_dir):
    few = spark.range(100).coalesce(1)
    assert cw.spread(few).rdd.getNumPartitions() == 4
    many = spark.range(100).repartition(9)
    assert cw.spread(many) is many


def test_stream_takes_every_file_once(spark, new_dir):
    landing, root, state = new_dir(), new_dir(), new_dir()
    _landing(landing, {"a.txt": b"One text.", "b.html": b"<p>Two</p>", "c.pdf": b"no"})

    def run():
        cw.ingest_incremental(
            spark, landing, root, "c", checkpoint=state, metadata_fields={"team": "x"}
        ).awaitTermination()
        rows = cw.read_collection(spark, root, "c")
        return sorted(r.content for r in rows.where(F.col("metadata")["team"] == "x").collect())

    assert run() == ["One text.", "Two"]
    assert run() == ["One text.", "Two"]
    with open(f"{landing}/d.md", "w") as f:
        f.write("# Three\n\nmore.")
    assert run() == ["# Three\n\nmore.", "One text.", "Two"]
    ids = cw.read_collection(spark, root, "c").select("chunk_id").distinct()
    assert ids.count() == 3


def test_a_document_per_line(spark, new_dir):
    root = new_dir()
    lines = [f'{{"k": {k}}}' for k in range(300)] + ["", "  "]
    spark.createDataFrame([(x,) for x in lines], "value string").repartition(3).write.text(root)
    rows = cw.read_records(spark, root).collect()
    assert sorted(r.content for r in rows) == sorted(lines[:300])
    assert len({r.doc_uri for r in rows}) == 300 and {r.format for r in rows} == {"txt"}
    again = cw.read_records(spark, root).collect()
    assert {(r.doc_uri, r.content) for r in again} == {(r.doc_uri, r.content) for r in rows}
