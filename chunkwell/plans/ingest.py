"""Ingest: documents to stored, searchable chunks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkwell.functions.hashing import DEFAULT_DIMS, hashed_model
from chunkwell.functions.membership import split_by_keys
from chunkwell.functions.metadata import merge_metadata, string_map
from chunkwell.operators.chunking import (
    DEFAULT_CHUNK_OVERLAP,
    DEFAULT_CHUNK_SIZE,
    chunk_documents,
)
from chunkwell.operators.elements import partition_documents
from chunkwell.operators.embedding import BATCH_SIZE, Model, embed_texts
from chunkwell.session import written
from chunkwell.sources.collections import read_target, read_write, store_chunks
from chunkwell.sources.commits import finished_write

STORED = "stored"
SKIPPED = "skipped"
NO_CONTENT = "no content"
INCOMPLETE = "embedding count differs from chunk count"


def prepare_chunks(
    documents: DataFrame,
    chunking_strategy: str = "by_title",
    metadata_fields: Mapping[str, object] | None = None,
    max_chunk_size: int | Column = DEFAULT_CHUNK_SIZE,
    chunk_overlap: int | Column = DEFAULT_CHUNK_OVERLAP,
    *,
    fn: Model | None = None,
    factory: Callable[[], Model] | None = None,
    embedding_model: str | None = None,
    batch_size: int = BATCH_SIZE,
    error_col: str | None = None,
) -> DataFrame:
    """Documents to embedded chunks: narrow steps only, no shuffle anywhere.

    Without a model the built-in hashing embedder is used. With ``error_col`` a chunk
    without a usable vector says there why, and a failing model fails no other chunk.
    """
    chunks = _chunked(documents, chunking_strategy, metadata_fields, max_chunk_size, chunk_overlap)
    return _embedded(chunks, fn, factory, embedding_model, batch_size, error_col)


def _chunked(documents, chunking_strategy, metadata_fields, max_chunk_size, chunk_overlap) -> DataFrame:
    own = F.col("metadata") if "metadata" in documents.columns else string_map(None)
    described = documents.withColumn("metadata", merge_metadata(own, string_map(metadata_fields)))
    described = described.withColumn("document_hash", F.xxhash64("content"))
    chunks = chunk_documents(
        partition_documents(described), chunking_strategy, max_chunk_size, chunk_overlap
    )
    names = {"document_url": F.col("doc_uri")}
    if "file_name" in documents.columns:
        names |= {"source_file": F.col("file_name"), "source_path": F.col("doc_uri")}
    return chunks.withColumns(names)


def _embedded(chunks, fn, factory, embedding_model, batch_size, error_col) -> DataFrame:
    if fn is None and factory is None:
        factory = partial(hashed_model, DEFAULT_DIMS)
        embedding_model = embedding_model or f"hashed-{DEFAULT_DIMS}"
    embedded = embed_texts(
        chunks, fn, batch_size=batch_size, factory=factory, keep_blank=True, error_col=error_col
    )
    return embedded.withColumn("embedding_model", F.lit(embedding_model))


def ingest_documents(
    documents: DataFrame,
    root: str,
    collection_name: str | Column = "documents",
    chunking_strategy: str = "by_title",
    metadata_fields: Mapping[str, object] | None = None,
    max_chunk_size: int | Column = DEFAULT_CHUNK_SIZE,
    chunk_overlap: int | Column = DEFAULT_CHUNK_OVERLAP,
    *,
    fn: Model | None = None,
    factory: Callable[[], Model] | None = None,
    embedding_model: str | None = None,
    batch_size: int = BATCH_SIZE,
    mode: str = "append",
    changed: str = "add",
    strict: bool = False,
    ingest_id: str | None = None,
    promote: Sequence[str] = (),
) -> dict:
    """Partition, chunk, embed and store a table of documents in one write.

    A chunk without a usable vector cannot be searched. It is set aside in the same write
    with its cause (see :func:`read_lost`), its document is incomplete and all others are
    stored; with ``strict`` it is an error and nothing is stored. Readers see all of an
    ingest or nothing; an ``ingest_id`` that is stored already is not stored again.
    Filters on the caller fields named in ``promote`` reach the scans of later searches.

    ``mode="skip_existing"`` skips documents whose address and content the
    collection has, before anything is chunked or embedded. Of a document that is
    incomplete there, the chunks that lack are made and stored. A document that is
    stored with other content is added as a new version (``changed="add"``) or
    an error (``changed="error"``).

    Returns the report of :func:`store_chunks` with a lazy ``summary``: one row
    per document with a status of stored, skipped, incomplete or no content, and the
    first cause if a chunk was lost.
    """
    if mode not in ("append", "skip_existing"):
        raise ValueError("mode must be append or skip_existing")
    if changed not in ("add", "error"):
        raise ValueError("changed must be add or error")
    ingest_id = ingest_id or uuid.uuid4().hex
    spark = documents.sparkSession
    plan = (chunking_strategy, metadata_fields, max_chunk_size, chunk_overlap)
    skipped = None
    if mode == "append" or finished_write(spark, root, ingest_id):
        chunks = _chunked(documents, *plan)
    else:
        stored = read_target(spark, root, collection_name)
        states = document_states(documents, stored, collection_name)
        if changed == "error":
            _refuse_versions(states)
        fresh, partial_ones, skipped = _by_state(documents, states, collection_name)
        chunks = _chunked(fresh, *plan)
        if partial_ones is not None:
            chunks = chunks.unionByName(_missing(_chunked(partial_ones, *plan), stored, collection_name))
    made = _embedded(chunks, fn, factory, embedding_model, batch_size, "ingest_error")
    report = store_chunks(made, root, collection_name, ingest_id=ingest_id, strict=strict, promote=promote)
    report["summary"] = write_summary(documents, read_write(spark, root, report["write_id"]), skipped)
    return report


def _name(collection_name: str | Column) -> Column:
    return collection_name if isinstance(collection_name, Column) else F.lit(collection_name)


def document_states(
    documents: DataFrame, stored: DataFrame, collection_name: str | Column
) -> DataFrame:
    """``(name, doc_uri, hash, state, other)``: what the collection has of each document.

    ``state`` is ``whole`` if all chunks of this content are stored, ``part`` if some are, else ``none``;
    ``other`` says whether the address is stored with other content. Only addresses, hashes
    and counts move.
    """
    asked = documents.select(
        _name(collection_name).alias("name"), "doc_uri", F.xxhash64("content").alias("hash")
    ).distinct()
    known = stored.groupBy(
        F.col("collection_name").alias("name"),
        F.col("document_url").alias("doc_uri"),
        F.col("document_hash").alias("hash"),
    ).agg(F.count_distinct("chunk_index").alias("has"), F.max("total_chunks").alias("needs"))
    addresses = known.select("name", "doc_uri").distinct().withColumn("known", F.lit(True))
    found = asked.join(known, ["name", "doc_uri", "hash"], "left").join(addresses, ["name", "doc_uri"], "left")
    state = F.when(F.col("has").isNull(), "none").when(F.col("has") < F.col("needs"), "part").otherwise("whole")
    other = F.col("has").isNull() & F.col("known").isNotNull()
    return written(found.select("name", "doc_uri", "hash", state.alias("state"), other.alias("other")))


def _refuse_versions(states: DataFrame) -> None:
    first = states.where("other").select("doc_uri").orderBy("doc_uri").head()
    if first:
        raise ValueError(f"document is stored with other content: {first[0]}")


def _by_state(
    documents: DataFrame, states: DataFrame, collection_name: str | Column
) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """``(new documents, those stored in part or None, addresses of the others)``.

    Filters of the keys say of nearly every document where it belongs; the contents of
    only those that two filters know are moved.
    """
    key = ["name", "doc_uri", "hash"]
    asked = [_name(collection_name), F.col("doc_uri"), F.xxhash64("content")]

    def chosen(state: str, others: DataFrame) -> DataFrame:
        near, _ = split_by_keys(documents, states.where(F.col("state") == state).select(*key), asked)
        doubtful, sure = split_by_keys(near, others.select(*key), asked)
        wanted = states.where(F.col("state") == state).select(*[F.col(k).alias(f"_{k}") for k in key])
        same = reduce(lambda x, y: x & y, (a.eqNullSafe(F.col(f"_{k}")) for a, k in zip(asked, key)))
        return sure.union(doubtful.join(wanted, same, "left_semi"))

    fresh = chosen("none", states.where("state != 'none'"))
    partly = None
    if not states.where("state = 'part'").isEmpty():
        partly = chosen("part", states.where("state != 'part'"))
    return fresh, partly, states.where("state = 'whole'").select("doc_uri").distinct()


def _missing(chunks: DataFrame, stored: DataFrame, collection_name: str | Column) -> DataFrame:
    """The chunks of documents stored in part that are not stored."""
    has = stored.select(
        F.col("collection_name").alias("_name"),
        F.col("document_url").alias("_url"),
        F.col("document_hash").alias("_hash"),
        F.col("chunk_index").alias("_index"),
    )
    same = (
        (_name(collection_name) == F.col("_name"))
        & F.col("document_url").eqNullSafe(F.col("_url"))
        & (F.col("document_hash") == F.col("_hash"))
        & (F.col("chunk_index") == F.col("_index"))
    )
    return chunks.join(has, same, "left_anti")


def write_summary(
    documents: DataFrame, rows: DataFrame, skipped: DataFrame | None = None
) -> DataFrame:
    """Per document: chunks made and stored by a write, what became of it and the first cause.

    ``rows`` are those of :func:`read_write`, ``skipped`` the addresses that were stored before.
    """
    counts = rows.groupBy(F.col("document_url").alias("doc_uri")).agg(
        F.count(F.lit(1)).alias("_made"),
        F.count_if(F.col("cause").isNull()).alias("_stored"),
        F.min(F.when(F.col("cause").isNotNull(), F.struct("chunk_index", "cause")))["cause"].alias("cause"),
    )
    found = documents.select("doc_uri").distinct().join(counts, "doc_uri", "left")
    old = F.lit(False)
    if skipped is not None:
        found = found.join(skipped.withColumn("_old", F.lit(True)), "doc_uri", "left")
        old = F.coalesce("_old", F.lit(False))
    made, stored = (F.coalesce(c, F.lit(0)) for c in ("_made", "_stored"))
    return found.select(
        "doc_uri",
        made.alias("chunks_made"),
        stored.alias("chunks_stored"),
        F.when(stored < made, INCOMPLETE)
        .when(made > 0, STORED)
        .when(old, SKIPPED)
        .otherwise(NO_CONTENT)
        .alias("status"),
        "cause",
    )


def ingest_summary(
    documents: DataFrame, elements: DataFrame, embeddings: DataFrame, stored: DataFrame,
    key: str = "doc_uri",
) -> DataFrame:
    """Per document: elements extracted, embeddings made, chunks stored.

    The four inputs become one stream of ones and zeros that is summed by
    document in a single shuffle; sums are combined before it, so a document
    with very many elements costs no more there than any other.
    """

    def ones(df: DataFrame, *flags: int) -> DataFrame:
        names = ("_doc", "elements_extracted", "embeddings_generated", "chunks_stored")
        return df.select(
            key, *[F.lit(v).cast("bigint").alias(n) for n, v in zip(names, flags)]
        )

    stages = (
        ones(documents, 1, 0, 0, 0)
        .unionByName(ones(elements, 0, 1, 0, 0))
        .unionByName(ones(embeddings.where(F.size("embedding") > 0), 0, 0, 1, 0))
        .unionByName(ones(stored, 0, 0, 0, 1))
    )
    counts = stages.groupBy(key).agg(
        F.max("_doc").alias("_doc"),
        *[F.sum(c).alias(c) for c in ("elements_extracted", "embeddings_generated", "chunks_stored")],
    )
    return counts.where(F.col("_doc") == 1).select(
        key,
        "elements_extracted",
        "embeddings_generated",
        "chunks_stored",
        F.when(F.col("elements_extracted") == 0, NO_CONTENT)
        .when(F.col("embeddings_generated") != F.col("chunks_stored"), INCOMPLETE)
        .otherwise(STORED)
        .alias("status"),
    )
