"""WARC archives (ISO 28500) as tables of chunks.

A payload travels as rows of record and chunk number, each with at most
``CHUNK_BYTES`` bytes and the digest of the payload so far, so neither a task nor an archive
ever needs a whole record. In an archive a chunk is a record of its own: the standard's
segmentation (a ``response`` and ``continuation`` records) says what belongs together. Spark's
text sink and source move the bytes, so archives can lie wherever Spark can write; a file
that a lost executor leaves unfinished is never seen.

Records are found again by their separator, the ``WARC/1.`` that begins them. A payload is cut
within any such run of bytes, so in archives written here no block holds the separator, and
as no end of the separator is also its beginning, splits of a file never disagree about it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chunkwell.session import written

CHUNK_BYTES = 64 << 10
#: What a task puts out at a time.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20
#: Payloads that occur many times are looked up by so many parts of their copies.
SALTS = 16

# Fixed values of the format.
END = b"\r\n\r\n"
SEPARATOR = b"WARC/1."
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_TYPES = {"string": T.StringType, "long": T.LongType, "binary": T.BinaryType, "boolean": T.BooleanType}


def _struct(names: str) -> T.StructType:
    pairs = (pair.split() for pair in names.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]()) for name, kind in pairs])


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


class _Rows:
    """Rows gathered into batches of bounded size."""

    def __init__(self, schema: T.StructType):
        self.arrow, self.rows, self.bytes = to_arrow_schema(schema), [], 0

    def add(self, row: tuple, size: int = 0) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.bytes += size
        if len(self.rows) >= BATCH_ROWS or self.bytes >= BATCH_BYTES:
            yield from self.take()

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.arrow)]
            self.rows, self.bytes = [], 0
            yield pa.RecordBatch.from_arrays(columns, names=self.arrow.names)


def pieces(data: bytes) -> Iterator[bytes]:
    """Cuts a block so that none holds the separator."""
    while (at := data.find(SEPARATOR)) >= 0:
        yield data[: at + 3]
        data = data[at + 3 :]
    yield data


def record_chunks(
    docs: DataFrame,
    id_col: str,
    payload_col: str,
    uri_col: str | None = None,
    chunk_bytes: int = CHUNK_BYTES,
    with_data: bool = True,
) -> DataFrame:
    """``(id, key, uri, size, segment, data, upto, digest)``, one row per chunk of a payload.

    ``segment`` counts from 1; ``upto`` and ``digest`` (SHA-1) are of the payload up to the end of the
    chunk, so the row with ``upto = size`` has those of the whole. ``key`` is a hash of the payload. A
    text's payload is its UTF-8; NULL and empty payloads are one empty chunk. Without
    ``with_data`` the chunks' bytes are left out.
    """
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit(bytearray()))
    uri = F.col(uri_col).cast("string") if uri_col else F.lit(None).cast("string")
    whole = docs.select(F.col(id_col).alias("id"), uri.alias("uri"), body.alias("body")).withColumns(
        {"key": F.xxhash64("body"), "size": F.octet_length("body").cast("bigint")}
    )
    last = F.expr(f"greatest(0, (size - 1) div {chunk_bytes})")
    cut = whole.withColumn("at", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).select(
        "id", "key", "uri", "size", "at", F.expr(f"substring(body, int(at * {chunk_bytes}) + 1, {chunk_bytes})").alias("data")
    )
    fields = [cut.schema[c] for c in ("id", "key", "uri", "size")]
    made = _struct("segment long, data binary, upto long, digest binary")
    schema = T.StructType([*fields, *made.fields])

    def chunks(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(schema)
        sha, segment, upto = hashlib.sha1(), 0, 0
        for batch in stream:
            heads = zip(*(batch.column(k).to_pylist() for k in range(5)))
            for (*head, at), data in zip(heads, batch.column(5)):
                if at == 0:
                    sha, segment, upto = hashlib.sha1(), 0, 0
                for piece in pieces(data.as_py()):
                    sha.update(piece)
                    segment += 1
                    upto += len(piece)
                    kept = piece if with_data else None
                    yield from out.add((*head, segment, kept, upto, sha.digest()), len(piece) if with_data else 0)
        yield from out.take()

    return cut.mapInArrow(chunks, schema)


def payload_originals(chunks: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``(id, key, size, digest, refers)``: which record each payload repeats, if any.

    ``chunks`` are rows of :func:`record_chunks`. Among records of equal payloads (digest and
    size) of at least ``least_bytes`` bytes the one with the smallest id is the original, NULL
    ids last; ``refers`` is a struct with the original's id for the others, else NULL. Rows that
    repeat id and payload are one row here.

    Copies are combined before they are shuffled; the copies of a payload are looked up
    in ``SALTS`` parts, and payloads that stand alone are not looked up at all.
    """
    ends = chunks.where("upto = size").select("id", "key", "size", "digest")
    ends = written(ends.dropDuplicates(["id", "key"]))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("first")
    shared = ends.where(F.col("size") >= least_bytes).groupBy("digest", "size")
    shared = shared.agg(first, F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    shared = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = ends.withColumn("salt", F.pmod(F.xxhash64("id", "key"), F.lit(SALTS)).cast("int"))
    found = salted.join(shared, ["digest", "size", "salt"], "left")
    other = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first.id"))
    refers = F.when(other, F.struct(F.col("first.id").alias("id")))
    return found.select("id", "key", "size", "digest", refers.alias("refers"))


def _record_uri(value: object, digest: bytes) -> str:
    return f"urn:page:{'' if value is None else quote(str(value), safe='')}:{base32(digest)}"


def _head(fields: list[tuple[str, object]], length: int) -> bytes:
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in fields], f"Content-Length: {length}", "", ""]
    return "\r\n".join(lines).encode()


def _records(date: str):
    """From chunks with the digest of the whole and the original to WARC records."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(_struct("record binary"))
        names = ("id", "uri", "size", "segment", "upto", "whole", "refers")
        for batch in stream:
            rows = zip(*(batch[n].to_pylist() for n in names))
            for (id_, uri, size, segment, upto, whole, refers), chunk in zip(rows, batch["data"]):
                data, own = chunk.as_py(), _record_uri(id_, whole)
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
                http = http.encode()
                target = own if uri is None else quote(uri, safe="!#$%&'()*+,/:;=?@[]~")
                common = [("WARC-Target-URI", target), ("WARC-Date", date)]
                if refers is not None:
                    fields = [
                        ("WARC-Type", "revisit"),
                        ("WARC-Record-ID", f"<{own}>"),
                        ("WARC-Refers-To", f"<{_record_uri(refers['id'], whole)}>"),
                        ("WARC-Profile", REVISIT_PROFILE),
                    ]
                    data = b""
                elif segment == 1:
                    fields = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{own}>")]
                    if upto < size:
                        fields.append(("WARC-Segment-Number", 1))
                else:
                    fields = [
                        ("WARC-Type", "continuation"),
                        ("WARC-Record-ID", f"<{own}:{segment}>"),
                        ("WARC-Segment-Origin-ID", f"<{own}>"),
                        ("WARC-Segment-Number", segment),
                    ]
                    if upto == size:
                        fields.append(("WARC-Segment-Total-Length", len(http) + size))
                if segment == 1:
                    common += [
                        ("WARC-Payload-Digest", f"sha1:{base32(whole)}"),
                        ("Content-Type", "application/http; msgtype=response"),
                    ]
                    data = http + data
                # the sink ends every row with a line feed
                record = _head(fields + common, len(data)) + data + b"\r\n\r"
                yield from out.add((record,), len(record))
        yield from out.take()

    return run


def write_archives(
    docs: DataFrame,
    path: str,
    id_col: str = "page_id",
    payload_col: str = "html",
    uri_col: str | None = "url",
    *,
    least_bytes: int = 0,
    chunk_bytes: int = CHUNK_BYTES,
    compression: str = "gzip",
) -> None:
    """Writes a WARC record per row to a new folder of archives.

    The payload of the smallest id among equal payloads of at least ``least_bytes`` bytes is
    written as a ``response``, the others as ``revisit`` records that refer to it and carry
    no payload, only its size and digest.

    NULL payloads are empty; a NULL id is an id of its own, larger than all others; rows that
    repeat id and payload are records of the same kind; an empty table makes an empty folder.
    Only the named columns are read, so names cannot clash.

    Payloads are scanned twice: for digests alone, then in chunks that meet the decision
    on their record in one shuffle by id and payload hash.
    """
    ends = record_chunks(docs, id_col, payload_col, None, chunk_bytes, with_data=False)
    decided = payload_originals(ends, least_bytes).withColumnRenamed("digest", "whole")
    chunks = record_chunks(docs, id_col, payload_col, uri_col, chunk_bytes)
    same = chunks["id"].eqNullSafe(decided["id"]) & (chunks["key"] == decided["key"])
    joined = chunks.join(decided.drop("size"), same).where("refers IS NULL OR segment = 1")
    rows = joined.select(
        chunks["id"], "uri", "size", "segment", "upto", "whole", "refers",
        F.when(F.col("refers").isNull(), F.col("data")).otherwise(F.lit(bytearray())).alias("data"),
    )
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    records = rows.mapInArrow(_records(date), "record binary")
    values = records.select(F.col("record").cast("string").alias("value"))
    values.write.option("compression", compression).text(path)


_CHUNK = _struct(
    "record_id string, record_type string, uri string, refers_to string, stated_digest string, "
    "stated_bytes long, segment long, single boolean, data binary, n_bytes long, digest string"
)


def _fields(head: bytes) -> dict[str, str]:
    """Names (lower case) to values of a header; the first line is left out."""
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def _blocks(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and blocks of the records of a task's rows, which are cut at separators.

    A block that holds the separator, as in archives of others, arrives in several rows and
    is put together; if its rows stand in another split, that is an error.
    """
    fields, block, wanted, place = None, b"", 0, None
    for batch in stream:
        for path, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            piece = value.as_py()
            if fields is not None:
                if path != place:
                    raise ValueError(f"a record of {place} is shorter than it says")
                block += SEPARATOR + piece
            else:
                if not piece:  # what stands before the first separator of a file
                    continue
                head, end, block = piece.partition(END)
                fields, place = _fields(head), path
                if not end or "content-length" not in fields or "warc-type" not in fields:
                    raise ValueError(f"{path} has a record without header; read it with larger splits")
                wanted = int(fields["content-length"])
            if len(block) >= wanted:
                yield fields, block[:wanted]
                fields = None
    if fields is not None:
        raise ValueError(f"a record of {place} is cut; read it with larger splits")


def _bare(uri: str | None) -> str | None:
    return None if uri is None else uri.strip("<>")


def _chunk_rows(with_data: bool):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(_CHUNK)
        for fields, block in _blocks(stream):
            kind, segment = fields["warc-type"], int(fields.get("warc-segment-number", 1))
            single = "warc-segment-number" not in fields
            own = fields.get("warc-segment-origin-id", fields.get("warc-record-id"))
            stated = None
            if segment == 1 and fields.get("content-type", "").startswith("application/http"):
                http, _, block = block.partition(END)
                size = _fields(http).get("content-length", "")
                stated = int(size) if size.isdigit() else None
            named, _, digest = fields.get("warc-payload-digest", "").rpartition(":")
            digest = digest if named.lower() == "sha1" else ""
            row = [_bare(own), kind, fields.get("warc-target-uri"), _bare(fields.get("warc-refers-to"))]
            row += [digest or None, stated, segment, single]
            if kind == "revisit":
                row += [None, stated, digest or None]
            elif single and not with_data:
                row += [None, len(block), base32(hashlib.sha1(block).digest())]
            else:
                row += [block, len(block), None]
            yield from out.add(tuple(row), len(block))
        yield from out.take()

    return run


def read_chunks(spark: SparkSession, path: str, with_data: bool = True) -> DataFrame:
    """The records of WARC archives as rows of record and chunk number.

    ``path`` names files or folders, plain or gzip. A record without segments is one row.
    ``data`` has the payload's bytes: the block without its HTTP header. Without ``with_data`` rows
    of whole records have the digest of their payload instead.
    """
    lines = spark.read.option("lineSep", SEPARATOR.decode()).text(path)
    rows = lines.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("value"))
    return rows.mapInArrow(_chunk_rows(with_data), _CHUNK)


_WHOLE = _struct(
    "record_id string, record_type string, uri string, refers_to string, "
    "payload_bytes long, payload_digest string, intact boolean"
)


class _Joined:
    """A segmented record whose chunks come in order; repeated chunks are other copies of it."""

    def __init__(self, row: dict):
        self.first, self.copies, self.segment, self.bytes = row, 0, 0, 0
        self.sha, self.gap = hashlib.sha1(), False

    def add(self, row: dict, data: bytes) -> None:
        if row["segment"] == self.segment:
            self.copies += self.segment == 1
            return
        self.gap |= row["segment"] != self.segment + 1
        self.copies += self.segment == 0
        self.segment = row["segment"]
        self.sha.update(data)
        self.bytes += len(data)

    def row(self) -> tuple:
        return _whole_row(self.first, self.bytes, base32(self.sha.digest()), not self.gap)


def _whole_row(row: dict, size: int | None, digest: str | None, intact: bool) -> tuple:
    intact &= row["stated_bytes"] is None or row["stated_bytes"] == size
    intact &= row["stated_digest"] is None or row["stated_digest"] == digest
    return row["record_id"], row["record_type"], row["uri"], row["refers_to"], size, digest, intact


def _whole_records(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, joined = _Rows(_WHOLE), None
    for batch in stream:
        chunks = batch["data"]
        for row, chunk in zip(batch.drop_columns(["data"]).to_pylist(), chunks):
            if joined and (row["single"] or row["record_id"] != joined.first["record_id"]):
                for _ in range(joined.copies):
                    yield from out.add(joined.row())
                joined = None
            if row["single"]:
                yield from out.add(_whole_row(row, row["n_bytes"], row["digest"], True))
                continue
            joined = joined or _Joined(row)
            joined.add(row, chunk.as_py())
    for _ in range(joined.copies if joined else 0):
        yield from out.add(joined.row())
    yield from out.take()


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of WARC archives, with size and digest of its whole payload.

    ``(record_id, record_type, uri, refers_to, payload_bytes, payload_digest, intact)``. Digests are
    taken from the bytes that were read, those of ``revisit`` records from their header; ``intact`` is
    false if they contradict the header or a segment is missing. The chunks of a segmented
    record are streamed in order through one digest; other records move without payload.
    """
    chunks = read_chunks(spark, path, with_data=False)
    dealt = chunks.repartition("record_id").sortWithinPartitions("record_id", "single", "segment")
    return dealt.mapInArrow(_whole_records, _WHOLE)


def row_id(record_uri: str | Column) -> Column:
    """The id, as text, of the row that :func:`write_archives` made a record of; else NULL."""
    found = F.regexp_extract(record_uri, "^urn:page:([^:]*):", 1)
    return F.url_decode(F.nullif(found, F.lit("")))
