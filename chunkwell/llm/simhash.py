"""SimHash fingerprints and the search for near ones in permuted block tables.

A text's terms are its character n-grams, weighted by how often they occur and, if several
lengths are used, by length. The hash of each votes for or against every bit with its weight, and the signs
of the sums are the fingerprint. Texts that share most of their terms differ in few bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chunkwell.llm.common import slices
from chunkwell.llm.words import mix
from chunkwell.session import written

#: Lengths of the n-grams and the weight of one occurrence of each.
TERMS = ((8, 1),)
BITS = 64
_PIECE = 1 << 18
_SIGNS = np.array([[1 if v >> b & 1 else -1 for b in range(8)] for v in range(256)], dtype=np.int64)


def votes(text: str) -> np.ndarray:
    """The 64 sums of votes; a text shorter than an n-gram is one term of its own length."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    total = np.zeros(BITS, dtype=np.int64)
    for n, weight in TERMS:
        width = min(n, len(codes))
        for at in range(0, len(codes) - width + 1 if width else 0, _PIECE):
            part = codes[at : at + _PIECE + width - 1]
            count = len(part) - width + 1
            hashes = np.full(count, n, dtype=np.uint64)
            for k in range(width):
                hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + part[k : k + count]
            lanes = mix(hashes).view(np.uint8).reshape(-1, 8)
            for lane in range(8):
                seen = np.bincount(lanes[:, lane], minlength=256)
                total[8 * lane : 8 * lane + 8] += weight * (seen @ _SIGNS)
    return total


def fingerprint(text: str) -> int:
    """The fingerprint as a signed 64-bit integer; the empty text has 0."""
    bits = votes(text) > 0
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def likeness(a: Column, b: Column) -> Column:
    """The cosine that the share of equal bits stands for, from 0 to 1; 1 for equal fingerprints."""
    apart = F.bit_count(a.bitwiseXOR(b))
    return F.greatest(F.lit(0.0), F.cos(apart * F.lit(np.pi / BITS)))


def edited_text(text: str, following: str) -> str:
    """The last quarter of a text replaced by as much of the beginning of another."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def fingerprints(
    docs: DataFrame, partitions: int | None = None, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, n_chars, edited, fingerprint, edited_fingerprint, next_fingerprint)`` per row.

    ``edited`` is the SHA-256 of the edited text (UTF-8, hex) and the next document the
    next by id, after the last the first. Rows with the same id follow each other by a
    hash of the text; NULL ids come first. A NULL text is the empty text. A table of one
    row is its own successor; an empty table gives an empty result.

    Rows are range-partitioned by id, so that a task meets each document's successor but
    one; only the first and last texts of the ranges, two per task, are looked up in a
    second small step. Equal ids are dealt by text hash too, so none is a hot key.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    dealt = rows.repartitionByRange(partitions, "id", "h") if partitions else rows.repartitionByRange("id", "h")
    dealt = dealt.sortWithinPartitions("id", "h").select("id", "text")
    schema = T.StructType(
        [T.StructField("id", rows.schema["id"].dataType)]
        + T.StructType.fromDDL(
            "n_chars bigint, edited string, fingerprint bigint, edited_fingerprint bigint, "
            "next_fingerprint bigint, task bigint, first string, last string"
        ).fields
    )
    arrow = to_arrow_schema(schema)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held = None  # the row before: id, text, fingerprint
        first = None
        for batch in slices(stream):
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                mark = fingerprint(text)
                if held is None:
                    first = (text, mark)
                else:
                    out.append((*_row(*held, text, mark), None, None, None))
                held = (key, text, mark)
            yield _batch(out, arrow)
        if held is not None:
            key, text, mark = held
            yield _batch([(key, len(text), None, mark, None, first[1], task, first[0], text)], arrow)

    done = written(dealt.mapInArrow(run, schema))
    ends = done.where("task IS NOT NULL")
    # one row per range and only numbers: the ranges in order, the last followed by the first
    order = Window.orderBy("task")
    tasks = ends.select("task").withColumn("following", F.lead("task").over(order))
    tasks = tasks.withColumn("following", F.coalesce("following", F.min("task").over(Window.partitionBy())))
    heads = ends.select(
        F.col("task").alias("following"), F.col("first").alias("head"), F.col("next_fingerprint").alias("mark")
    )
    rest = ends.drop("next_fingerprint").join(tasks, "task").join(heads, "following")

    def finish(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(stream):
            columns = (c.to_pylist() for c in batch.columns)
            yield _batch([_row(k, t, m, head, mark) for k, t, m, head, mark in zip(*columns)], short)

    short = pa.schema(list(arrow)[:6])
    joined = rest.select("id", "last", "fingerprint", "head", "mark").mapInArrow(finish, T.StructType(schema.fields[:6]))
    return done.where("task IS NULL").select(*schema.names[:6]).union(joined)


def _row(key, text: str, mark: int, following: str, following_mark: int) -> tuple:
    edited = edited_text(text, following)
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return key, len(text), sha, mark, mark if edited == text else fingerprint(edited), following_mark


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def block_keys(mark: Column, radius: int, blocks: int) -> Column:
    """``array<struct<table, key>>``: the fingerprint's key in every permuted table.

    The bits are cut into ``blocks`` blocks. Two fingerprints at most ``radius`` bits apart
    agree in ``blocks - radius`` blocks at least, and there is a table for every choice of
    that many blocks, keyed by their bits: no near pair is missed in all of them.
    """
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("need 0 <= radius < blocks <= 64")
    cuts = [BITS * k // blocks for k in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << cuts[c + 1]) - (1 << cuts[c])) for c in chosen)
        signed = mask - (1 << BITS) if mask >> (BITS - 1) else mask
        keys.append(F.struct(F.lit(number).alias("table"), mark.bitwiseAND(F.lit(signed)).alias("key")))
    return F.array(*keys)


def near_fingerprints(
    queries: DataFrame, marks: DataFrame, radius: int = 3, blocks: int = 6
) -> DataFrame:
    """``(fingerprint, n_near)``: for each query fingerprint, the rows within ``radius`` bits.

    ``queries`` are ``(fingerprint)``, ``marks`` ``(fingerprint, copies)`` with distinct
    fingerprints. All are found. Copies have been combined before, so a group of equal
    texts is one row; a pair that meets in several tables counts once, in the first of the
    tables in which it meets, so pairs need no second shuffle but for the sum.
    """
    def keyed(df: DataFrame, name: str) -> DataFrame:
        k = F.explode(block_keys(F.col("fingerprint"), radius, blocks)).alias("k")
        rest = [c for c in df.columns if c != "fingerprint"]
        return df.select(F.col("fingerprint").alias(name), *rest, k).select(name, *rest, "k.table", "k.key")

    pairs = keyed(queries.distinct(), "q").join(keyed(marks, "m"), ["table", "key"])
    here = F.filter(
        F.arrays_zip(
            block_keys(F.col("q"), radius, blocks).getField("key").alias("a"),
            block_keys(F.col("m"), radius, blocks).getField("key").alias("b"),
            block_keys(F.col("q"), radius, blocks).getField("table").alias("t"),
        ),
        lambda z: z["a"] == z["b"],
    )[0]["t"]
    near = F.bit_count(F.col("q").bitwiseXOR(F.col("m"))) <= radius
    return (
        pairs.where(near)
        .where(F.col("table") == here)
        .groupBy(F.col("q").alias("fingerprint"))
        .agg(F.sum("copies").alias("n_near"))
    )
