"""Inputs of the registered queries, all derived from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import chunkwell as cw
from chunkwell.session import shared_dir

CORPUS = "documents"
FIELDS = ("lang", "source")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_dir(spark: SparkSession) -> str:
    """A new folder every executor can reach, for a table a query writes."""
    return f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as document rows ``doc/<doc_id>.txt`` with two caller fields."""
    rows = cw.spread(table(spark, sf_dir, "documents")).withColumn(
        "uri", F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    )
    return cw.documents_from_table(rows, "uri", "text", metadata=FIELDS)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return cw.spread(rows)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored vector once more as a query."""
    return vectors(spark, sf_dir).select(F.col("vec_id").alias("query_id"), "embedding")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query_text")
    )


def last_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector with the highest id, as a single query."""
    return vectors(spark, sf_dir).orderBy(F.desc("vec_id")).select("embedding").head()[0]


_CORPORA: dict[tuple[str, str], str] = {}


def corpus_root(spark: SparkSession, sf_dir: str) -> str:
    """``documents`` ingested once per session; queries that search share it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CORPORA:
        root = fresh_dir(spark)
        cw.ingest_documents(documents(spark, sf_dir), root, CORPUS)
        _CORPORA[key] = root
    return _CORPORA[key]


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ingested documents with ids that do not change between ingests."""
    stored = cw.read_collection(spark, corpus_root(spark, sf_dir), CORPUS)
    return stored.withColumn(
        "chunk_id", F.concat_ws("#", "document_url", F.col("chunk_index").cast("string"))
    )


def doc_number(url: str = "document_url") -> Column:
    return F.regexp_extract(url, r"(\d+)", 1).cast("bigint").alias("doc_id")


def plain(df: DataFrame) -> DataFrame:
    """Integers as BIGINT and scores at six decimals, as the checks compare them."""
    columns = []
    for f in df.schema.fields:
        value = F.col(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            value = value.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            value = F.round(value.cast("double"), 6)
        columns.append(value.alias(f.name))
    return df.select(*columns)
