"""Named collections of chunks: one Parquet dataset, one partition per name."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkwell.functions.metadata import merge_metadata, promoted_column, string_map
from chunkwell.schemas import COLLECTION
from chunkwell.session import path_exists
from chunkwell.sources.commits import (
    LOST,
    finish,
    finished_write,
    finished_writes,
    new_write,
    promote_fields,
    promoted_fields,
)

_MODES = ("append", "skip_existing")

#: Names that a folder name shows as they are.
PLAIN_NAME = re.compile(r"[A-Za-z0-9_-][A-Za-z0-9_.-]*")


def logical_size(df: DataFrame) -> Column:
    """Bytes of content plus four per vector component."""
    vector = F.coalesce(F.size("embedding"), F.lit(0))
    return (
        F.coalesce(F.octet_length("content"), F.lit(0)) + 4 * F.greatest(vector, F.lit(0))
    ).cast("bigint")


def collection_rows(
    df: DataFrame,
    collection_name: str | Column,
    source_metadata: Mapping[str, object] | None = None,
    ingest_id: str = "",
    row_ids: bool = True,
    write_id: str = "",
    promote: Sequence[str] = (),
) -> DataFrame:
    """Chunks with vectors in the stored layout; absent columns become NULL.

    Caller fields in ``promote`` also get a column of their own, which scans can test.

    A row with an ``ingest_error`` is set aside: it goes to folders that no search
    reads, with the error among its metadata.

    A chunk without an id gets one made of its collection, document, position,
    ingest and row, so every stored row has an id of its own, as in a store that
    hands out ids, even if a document comes twice. Ids are fixed by being written.
    """
    name = collection_name if isinstance(collection_name, Column) else F.lit(collection_name)
    own = F.col("metadata") if "metadata" in df.columns else string_map(None)
    url = F.col("document_url" if "document_url" in df.columns else "doc_uri")
    new_id = F.sha2(
        F.concat_ws(
            "\x1f",
            name,
            url,
            F.col("chunk_index").cast("string"),
            F.lit(ingest_id),
            F.monotonically_increasing_id().cast("string") if row_ids else F.lit(""),
        ),
        256,
    )
    metadata, write = merge_metadata(own, string_map(source_metadata)), F.lit(write_id)
    if "ingest_error" in df.columns:
        error = F.col("ingest_error")
        noted = merge_metadata(metadata, F.create_map(F.lit("ingest_error"), error))
        metadata = F.when(error.isNull(), metadata).otherwise(noted)
        write = F.when(error.isNull(), write).otherwise(F.lit(LOST + write_id))
    given = {
        "chunk_id": F.coalesce(F.col("chunk_id"), new_id) if "chunk_id" in df.columns else new_id,
        "document_url": url,
        "metadata": metadata,
        "processed_at": F.current_timestamp(),
        "logical_size": logical_size(df),
        "ingest_id": F.lit(ingest_id),
        "overrides": F.coalesce(
            F.arrays_overlap(F.map_keys(metadata), F.array(*[F.lit(f.name) for f in COLLECTION.fields])), F.lit(False)
        ),
        "collection_name": name,
        "write_id": write,
    }
    columns = []
    for field in COLLECTION.fields:
        if field.name in given:
            value = given[field.name]
        elif field.name in df.columns:
            value = F.col(field.name)
        else:
            value = F.lit(None)
        columns.append(value.cast(field.dataType).alias(field.name))
    columns += [metadata[field].alias(promoted_column(field)) for field in promote]
    return df.select(*columns)


def store_chunks(
    df: DataFrame,
    root: str,
    collection_name: str | Column,
    source_metadata: Mapping[str, object] | None = None,
    *,
    mode: str = "append",
    ingest_id: str | None = None,
    strict: bool = False,
    promote: Sequence[str] = (),
) -> dict:
    """Append chunks with vectors to a collection and report what was stored.

    A name writes straight from the tasks that made the rows. A column routes
    rows to many collections; they are rebalanced by name first, which splits a
    large collection over many tasks and keeps small ones in few files.

    The rows can be read from the moment a marker is created, after all files are in
    place, so a reader sees all of them or none and a crash leaves nothing to be seen. An
    ``ingest_id`` that is stored already is not stored again: its report comes back,
    with ``already_stored``.

    Caller fields named in ``promote`` are stored as columns as well, so that filters on them
    reach the scan; other writes need not promote the same.

    Rows with an ``ingest_error`` are set aside in the same write (see :func:`read_lost`);
    with ``strict`` one of them is an error and nothing is stored.

    ``mode="skip_existing"`` leaves out documents that the collection has: by address and
    ``document_hash`` if the chunks have one, else by address, so versions never mix.
    ``inserted_ids`` is a lazy DataFrame. Only the collection that is written is looked at, all
    of them if a column routes rows.
    """
    if mode not in _MODES:
        raise ValueError(f"mode must be one of {_MODES}")
    spark = df.sparkSession
    ingest_id = ingest_id or uuid.uuid4().hex
    done = finished_write(spark, root, ingest_id)
    if done is None:
        write_id = new_write(ingest_id)
        promote_fields(spark, root, promote)
        rows = collection_rows(
            df, collection_name, source_metadata, ingest_id, write_id=write_id, promote=promote
        )
        names = rows.columns
        if mode == "skip_existing":
            key = ["collection_name", "document_url"]
            key += ["document_hash"] if "document_hash" in df.columns else []
            stored = read_target(spark, root, collection_name)
            rows = rows.join(stored.select(*key).distinct(), key, "left_anti").select(
                *[F.col(f"`{name}`") for name in names]
            )
        if isinstance(collection_name, Column):
            rows = rows.hint("rebalance", "collection_name")
        counted, kept = Observation(), F.col("write_id") == write_id
        (
            rows.observe(counted, F.count_if(kept).alias("stored"), F.count_if(~kept).alias("lost"))
            .write.mode("append")
            .partitionBy("collection_name", "write_id")
            .parquet(root)
        )
        facts = {"ingest_id": ingest_id, "chunks_stored": counted.get["stored"], "chunks_lost": counted.get["lost"]}
        if strict and facts["chunks_lost"]:
            lost = _read(spark, root, root).where(F.col("write_id") == LOST + write_id)
            first = lost.select("document_url", F.col("metadata")["ingest_error"]).head()
            raise ValueError(f"{first[1]} for a chunk of {first[0]}")
        finish(spark, root, write_id, facts)
    else:
        write_id, facts = done
    return {
        "success": True,
        "already_stored": done is not None,
        "collection_name": collection_name if isinstance(collection_name, str) else None,
        "chunks_stored": facts["chunks_stored"],
        "chunks_lost": facts["chunks_lost"],
        "ingest_id": ingest_id,
        "write_id": write_id,
        "inserted_ids": _read(spark, root, root).where(F.col("write_id") == write_id).select("chunk_id"),
    }


def _read(spark: SparkSession, root: str, path: str) -> DataFrame:
    """All rows of a path, also of writes that are not finished."""
    extra = [T.StructField(name, T.StringType()) for name in promoted_fields(spark, root)]
    schema = T.StructType(COLLECTION.fields[:-2] + extra + COLLECTION.fields[-2:])
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", root).parquet(path)


def _read_finished(spark: SparkSession, root: str, path: str) -> DataFrame:
    """The rows of the writes that are finished now; later ones do not change the result."""
    return _read(spark, root, path).where(F.col("write_id").isin(finished_writes(spark, root)))


def read_all(spark: SparkSession, root: str) -> DataFrame:
    """All collections under a root; nothing stored yet is an empty table."""
    return _read_finished(spark, root, root)


def read_write(spark: SparkSession, root: str, write_id: str) -> DataFrame:
    """What one finished write has stored and, with a ``cause``, what it has set aside."""
    rows = _read(spark, root, root).where(F.col("write_id").isin(write_id, LOST + write_id))
    cause = F.when(F.col("write_id") != write_id, F.col("metadata")["ingest_error"])
    return rows.withColumn("cause", cause)


def read_lost(spark: SparkSession, root: str, collection_name: str) -> DataFrame:
    """The chunks of a collection that could not be stored, with a ``cause``.

    A chunk that a later ingest has stored is no longer among them.
    """
    lost = [LOST + write for write in finished_writes(spark, root)]
    rows = _read(spark, root, root).where(F.col("collection_name") == collection_name)
    rows = rows.where(F.col("write_id").isin(lost)).withColumn("cause", F.col("metadata")["ingest_error"])
    key = ["document_url", "document_hash", "chunk_index"]
    stored = read_collection(spark, root, collection_name).select(*key)
    same = reduce(lambda x, y: x & y, (rows[k].eqNullSafe(stored[k]) for k in key))
    return rows.join(stored, same, "left_anti")


def read_target(spark: SparkSession, root: str, collection_name: str | Column) -> DataFrame:
    """What a write to ``collection_name`` may touch: one collection, or all if a column routes."""
    if isinstance(collection_name, Column):
        return read_all(spark, root)
    return read_collection(spark, root, collection_name)


def read_collection(spark: SparkSession, root: str, collection_name: str) -> DataFrame:
    """One collection by name, its partition only; an unknown name is empty.

    With a plain name only that folder is listed, however many collections
    there are; any other name is found among the partitions of the root.
    """
    path = root
    if PLAIN_NAME.fullmatch(collection_name):
        path = f"{root}/collection_name={collection_name}"
    named = _read(spark, root, path).where(F.col("collection_name") == collection_name)
    return named.where(F.col("write_id").isin(finished_writes(spark, root)))


def list_collections(spark: SparkSession, root: str) -> DataFrame:
    """Names of all collections under a root, from its folders; no file is listed or read."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.listStatus(place) if system.exists(place) else []
    folders = [f.getPath().getName() for f in found if f.isDirectory()]
    prefix = "collection_name="
    names = [unquote(f.removeprefix(prefix)) for f in folders if f.startswith(prefix)]
    return spark.createDataFrame([(n,) for n in sorted(names)], "collection_name string")


def catalog(spark: SparkSession, root: str, names: DataFrame | None = None) -> DataFrame:
    """:func:`storage_stats` of every collection by name, zeros for those without rows.

    ``names`` adds collections that are expected but not stored yet.
    """
    known = list_collections(spark, root)
    if names is not None:
        known = known.union(names.select("collection_name")).distinct()
    columns = ("document_count", "size_bytes", "storage_size_bytes", "file_count")
    stats = storage_stats(spark, root)
    return known.join(stats, "collection_name", "left").select(
        "collection_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in columns], "avg_obj_size"
    )


def collection_stats(collections: DataFrame) -> DataFrame:
    """Documents (records), total and average logical size per collection.

    Stored collections carry the size as a number, so neither contents nor
    vectors are read. Counts are combined before the shuffle.
    """
    if "logical_size" in collections.columns:
        size = F.col("logical_size")
    else:
        size = logical_size(collections)
    return collections.groupBy("collection_name").agg(
        F.count(F.lit(1)).alias("document_count"),
        F.sum(size).alias("size_bytes"),
        F.avg(size).alias("avg_obj_size"),
    )


def storage_stats(spark: SparkSession, root: str) -> DataFrame:
    """:func:`collection_stats` of stored collections, with bytes on disk.

    Rows are first combined per file, so a file's size counts once.
    """
    files = (
        read_all(spark, root)
        .select(
            "collection_name",
            "logical_size",
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_size").alias("file_size"),
        )
        .groupBy("collection_name", "file_path")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("logical_size").alias("bytes"),
            F.max("file_size").alias("stored"),
        )
    )
    return files.groupBy("collection_name").agg(
        F.sum("n").alias("document_count"),
        F.sum("bytes").alias("size_bytes"),
        F.sum("stored").alias("storage_size_bytes"),
        F.count(F.lit(1)).alias("file_count"),
        (F.sum("bytes") / F.sum("n")).alias("avg_obj_size"),
    )
