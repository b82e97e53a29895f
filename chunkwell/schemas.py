"""Row layouts shared by sources, operators and sinks."""

from __future__ import annotations

from pyspark.sql import types as T

STRING_MAP = T.MapType(T.StringType(), T.StringType())

#: One text unit of a document. Elements travel as an array inside the
#: document row, so no operator has to regroup them by document.
ELEMENT = T.StructType(
    [
        T.StructField("element_index", T.IntegerType()),
        T.StructField("category", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("page_number", T.IntegerType()),
    ]
)

ELEMENTS = T.ArrayType(ELEMENT)

#: The grid of a table: every cell once, where its upper left corner stands.
TABLES = T.ArrayType(
    T.StructType(
        [
            T.StructField("element_index", T.IntegerType()),
            T.StructField("depth", T.IntegerType()),
            T.StructField("n_rows", T.IntegerType()),
            T.StructField("n_columns", T.IntegerType()),
            T.StructField("header_rows", T.IntegerType()),
            T.StructField(
                "cells",
                T.ArrayType(
                    T.StructType(
                        [
                            T.StructField("row", T.IntegerType()),
                            T.StructField("column", T.IntegerType()),
                            T.StructField("row_span", T.IntegerType()),
                            T.StructField("column_span", T.IntegerType()),
                            T.StructField("header", T.BooleanType()),
                            T.StructField("text", T.StringType()),
                        ]
                    )
                ),
            ),
        ]
    )
)

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_uri", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("content", T.StringType()),
    ]
)

#: A stored chunk. System fields are typed columns, so they prune and push
#: down; caller fields stay in the map. ``logical_size`` is kept so that
#: statistics never have to read the content or the vectors; ``overrides`` says whether a
#: caller field has the name of one of these columns and hides it. The last two are
#: partitions: the collection, and the attempt that wrote the row.
COLLECTION = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("document_url", T.StringType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("content", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("chunking_strategy", T.StringType()),
        T.StructField("chunk_size", T.IntegerType()),
        T.StructField("element_type", T.StringType()),
        T.StructField("page_number", T.IntegerType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("embedding_model", T.StringType()),
        T.StructField("total_chunks", T.IntegerType()),
        T.StructField("processed_at", T.TimestampType()),
        T.StructField("metadata", STRING_MAP),
        T.StructField("logical_size", T.LongType()),
        T.StructField("document_hash", T.LongType()),
        T.StructField("ingest_id", T.StringType()),
        T.StructField("overrides", T.BooleanType()),
        T.StructField("collection_name", T.StringType()),
        T.StructField("write_id", T.StringType()),
    ]
)

#: System columns that appear in the merged metadata view of a record.
SYSTEM_FIELDS = (
    "document_url",
    "chunk_index",
    "chunking_strategy",
    "chunk_size",
    "element_type",
    "page_number",
    "source_file",
    "source_path",
    "source_url",
    "file_size",
    "embedding_model",
    "total_chunks",
    "processed_at",
    "collection_name",
)
