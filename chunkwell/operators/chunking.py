"""Chunking: pack a document's elements, or cut its text into windows.

Every operator here works inside the document row. Elements arrive as an
array and chunks leave through one ``explode``, so chunking needs no shuffle
and a frequent document key cannot gather rows in one task.
"""

from __future__ import annotations

from collections.abc import Mapping
from types import MappingProxyType

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkwell.functions.rows import with_computed
from chunkwell.functions.text import (
    as_column,
    check_window_sizes,
    sliding_windows,
    strip,
)

#: Elements are joined by this inside a chunk.
JOINER = "\n\n"

DEFAULT_CHUNK_SIZE = 1000
DEFAULT_CHUNK_OVERLAP = 200

# Chunk size and overlap by document type; the last is the default.
CHUNK_PARAMS_BY_TYPE = {"contracts": (800, 100), "reports": (600, 75)}
CHUNK_PARAMS_DEFAULT = (400, 50)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _group_starts(lengths: pa.Array, max_chunk_size: pa.Array) -> pa.Array:
    """Indexes of the elements that open a group; a negative length forces one.

    Each decision needs the one before, which no built-in function expresses
    without copying its result per step. Only lengths cross into Python, as
    one flat Arrow buffer; the text stays in the JVM.
    """
    flat = lengths.flatten().to_pylist()
    starts: list[int] = []
    ends = [0]
    at = 0
    for n, size in zip(pc.list_value_length(lengths).to_pylist(), max_chunk_size.to_pylist()):
        room = 0  # characters the open group can still take, joiner included
        for i in range(n or 0):
            length = flat[at + i]
            need = abs(length) + len(JOINER)
            if length < 0 or need > room:
                starts.append(i)
                # an oversize element leaves no room behind it
                room = size - abs(length)
            else:
                room -= need
        at += n or 0
        ends.append(len(starts))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(starts, pa.int32()))


def _piece(text: Column, first: Column) -> Column:
    return F.struct(
        text.alias("content"),
        first["category"].alias("element_type"),
        first["page_number"].alias("page_number"),
    )


def _packed(elements: Column, starts: Column, size: Column, overlap: Column) -> Column:
    """Chunk structs of one document, before metadata is attached."""

    def group(start: Column, i: Column) -> Column:
        end = F.coalesce(F.get(starts, i + 1), F.size(elements))
        members = F.slice(elements, start + 1, end - start)
        first = F.get(elements, start)
        joined = F.array_join(F.transform(members, lambda e: e["text"]), JOINER)
        return F.when(
            F.length(first["text"]) > size,
            F.transform(
                sliding_windows(first["text"], size, overlap),
                lambda w: _piece(w, first),
            ),
        ).otherwise(F.array(_piece(joined, first)))

    return F.flatten(F.transform(starts, group))


def chunk_metadata(
    df: DataFrame, chunking_strategy: str, chunks_col: str = "chunks"
) -> DataFrame:
    """Turn a document's array of raw chunks into finished chunk rows.

    Text is stripped, blank chunks drop out, and the rest is numbered densely
    from 0 while still inside the document row.
    """
    stripped = F.transform(
        F.col(chunks_col),
        lambda c: F.struct(
            strip(c["content"]).alias("content"),
            c["element_type"].alias("element_type"),
            c["page_number"].alias("page_number"),
        ),
    )
    keep = [c for c in df.columns if c not in (chunks_col, "content", "elements")]
    kept = F.filter(stripped, lambda c: c["content"] != "")
    # the count is taken below the explode: above it, every chunk row would have to
    # carry all chunks of its document along
    counted = with_computed(df, chunks_col, kept).select(
        *keep, chunks_col, F.size(chunks_col).alias("total_chunks")
    )
    return counted.select(
        *keep, "total_chunks", F.posexplode(chunks_col).alias("chunk_index", "_c")
    ).select(
        *keep,
        "chunk_index",
        F.col("_c.content").alias("content"),
        F.lit(chunking_strategy).alias("chunking_strategy"),
        F.length("_c.content").alias("chunk_size"),
        F.col("_c.element_type").alias("element_type"),
        F.col("_c.page_number").alias("page_number"),
        "total_chunks",
    )


def _chunk_packed(
    df: DataFrame,
    strategy: str,
    max_chunk_size: int | Column,
    chunk_overlap: int | Column,
) -> DataFrame:
    check_window_sizes(max_chunk_size, chunk_overlap)
    size, overlap = as_column(max_chunk_size), as_column(chunk_overlap)
    lengths = F.transform("elements", lambda e: F.length(e["text"]))
    if strategy == "by_title":
        lengths = F.transform(
            "elements",
            lambda e: F.when(e["category"] == "Title", -F.length(e["text"])).otherwise(
                F.length(e["text"])
            ),
        )
    grouped = df.withColumn("_starts", _group_starts(lengths, size))
    packed = _packed(F.col("elements"), F.col("_starts"), size, overlap)
    return chunk_metadata(grouped.withColumn("chunks", packed).drop("_starts"), strategy)


def chunk_basic(
    df: DataFrame,
    max_chunk_size: int | Column = DEFAULT_CHUNK_SIZE,
    chunk_overlap: int | Column = DEFAULT_CHUNK_OVERLAP,
) -> DataFrame:
    """Pack consecutive elements greedily up to ``max_chunk_size`` characters.

    An element longer than that stands alone and is cut into windows; only
    those overlap.
    """
    return _chunk_packed(df, "basic", max_chunk_size, chunk_overlap)


def chunk_by_title(
    df: DataFrame,
    max_chunk_size: int | Column = DEFAULT_CHUNK_SIZE,
    chunk_overlap: int | Column = DEFAULT_CHUNK_OVERLAP,
) -> DataFrame:
    """As :func:`chunk_basic`, and every title opens a new chunk."""
    return _chunk_packed(df, "by_title", max_chunk_size, chunk_overlap)


def chunk_documents(
    df: DataFrame,
    chunking_strategy: str = "by_title",
    max_chunk_size: int | Column = DEFAULT_CHUNK_SIZE,
    chunk_overlap: int | Column = DEFAULT_CHUNK_OVERLAP,
) -> DataFrame:
    """Chunk by the named strategy; any name but ``by_title`` packs plainly.

    The given name is kept in ``chunking_strategy`` either way.
    """
    chunked = (chunk_by_title if chunking_strategy == "by_title" else chunk_basic)(
        df, max_chunk_size, chunk_overlap
    )
    return chunked.withColumn("chunking_strategy", F.lit(chunking_strategy))


def chunk_windows(
    df: DataFrame,
    max_chunk_size: int | Column = DEFAULT_CHUNK_SIZE,
    chunk_overlap: int | Column = DEFAULT_CHUNK_OVERLAP,
    text_col: str = "content",
) -> DataFrame:
    """Fixed character windows over the whole text, elements or not."""
    check_window_sizes(max_chunk_size, chunk_overlap)
    keep = [c for c in df.columns if c != text_col]
    windows = sliding_windows(F.col(text_col), max_chunk_size, chunk_overlap)
    # ``with_computed`` first: ``explode`` alone would make Catalyst add a
    # "not empty" filter that evaluates the windows a second time
    return with_computed(df, "_windows", windows).select(
        *keep, F.posexplode("_windows").alias("chunk_index", "content")
    )


def chunk_params_by_type(
    df: DataFrame,
    type_col: str = "document_type",
    params: Mapping[str, tuple[int, int]] = MappingProxyType(CHUNK_PARAMS_BY_TYPE),
    default: tuple[int, int] = CHUNK_PARAMS_DEFAULT,
) -> DataFrame:
    """Add ``max_chunk_size`` and ``chunk_overlap`` by document type.

    The settings are a handful of constants, so a CASE expression does the
    lookup inside the scan's stage and no join is needed at all.
    """
    for size, overlap in (*params.values(), default):
        check_window_sizes(size, overlap)
    size, overlap = (F.lit(v) for v in default)
    for name, (s, o) in params.items():
        hit = F.col(type_col) == name
        size = F.when(hit, F.lit(s)).otherwise(size)
        overlap = F.when(hit, F.lit(o)).otherwise(overlap)
    return df.withColumns({"max_chunk_size": size, "chunk_overlap": overlap})
