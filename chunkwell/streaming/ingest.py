"""Ingest of a growing folder, as a stream into a collection."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from chunkwell.plans.ingest import ingest_documents
from chunkwell.session import shared_dir
from chunkwell.sources.documents import TEXT_FILES, as_documents

# The columns of Spark's binary file source.
BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def ingest_incremental(
    spark: SparkSession,
    source: str,
    root: str,
    collection_name: str = "documents",
    *,
    checkpoint: str | None = None,
    max_files_per_trigger: int | None = None,
    available_now: bool = True,
    **options: object,
) -> StreamingQuery:
    """Ingest files as they arrive; with ``available_now`` what is there, then stop.

    Files seen before are skipped thanks to the checkpoint. Every batch is stored
    as :func:`ingest_documents` would store it, in the same collection that batch
    jobs write to, under an ingest id made of the checkpoint and the batch number. A
    batch counts as stored once its marker stands: one that comes again after a crash is
    left out if it does, and else stored anew, while what the crash left is never
    read. ``options`` are those of :func:`ingest_documents`.
    """
    if checkpoint is None:
        checkpoint = f"{shared_dir(spark)}/ingest-{collection_name}"
    reader = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE)
        .option("pathGlobFilter", TEXT_FILES)
    )
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def store(batch: DataFrame, batch_id: int) -> None:
        ingest_id = f"{stream}-{batch_id}"
        ingest_documents(as_documents(batch), root, collection_name, ingest_id=ingest_id, **options)

    writer = reader.load(source).writeStream.foreachBatch(store)
    writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
