"""A corpus from raw documents to a training mix, stage by stage.

Every stage takes what the one before it kept. All but the last return the columns of
``documents``; the last returns the mix, a row per copy of a document in training order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwell.llm import decontaminate, language, mixing, ngram_join, pii
from chunkwell.functions.membership import split_by_keys
from chunkwell.session import shared_dir, written


def _key() -> list:
    """What a row is told by: its id and its text's hash."""
    return [F.col("doc_id"), F.xxhash64("text")]


def _meet(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """The rows of documents that are (or, ``left_anti``, are not) among keys ``(id, tid)``."""
    names = [f"key_{uuid.uuid4().hex}" for _ in range(2)]  # no column of the documents
    named = keys.toDF(*names).hint("merge")
    mine = [own.eqNullSafe(F.col(name)) for own, name in zip(_key(), names)]
    return docs.join(named, mine[0] & mine[1], how)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents that are not among ``gone``, a written table of ``(id, tid)``.

    Texts stay where they are, but for those that a filter of ``gone`` knows.
    """
    near, rest = split_by_keys(docs, gone, _key())
    return rest.union(_meet(near, gone, "left_anti"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is known; a text without letters goes.

    The source stands for the host and the ``lang`` column for the declared language. The
    trigram model is fitted on a bounded sample of the documents that declare one.
    """
    model = language.fit_languages(docs)
    rows = docs.select(
        F.col("doc_id").alias("id"),
        F.xxhash64("text").alias("tid"),
        F.col("source").alias("host"),
        F.lit(None).cast("string").alias("suffix"),
        F.col("lang").alias("declared"),
        "text",
    )
    rejected = language.identify(rows, model).where("NOT accepted").select("id", "tid").distinct()
    return _without(docs, written(rejected))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the one with the smallest id.

    Documents without words are in no group and stay.
    """
    found = written(ngram_join.jaccard_members(docs).where("component IS NOT NULL"))
    row = F.struct(F.col("id").isNull().alias("none"), "id", "tid")
    first = found.groupBy("component").agg(F.min(row).alias("first"))
    gone = found.join(first, "component").where(row != F.col("first")).select("id", "tid").distinct()
    gone = written(gone)
    kept = _without(docs, gone)
    # the same row may stand there several times
    twice = written(found.groupBy("id", "tid").count().where("count > 1").select("id", "tid"))
    if twice.isEmpty():
        return kept
    near, rest = split_by_keys(kept, twice, _key())
    tid = f"key_{uuid.uuid4().hex}"
    once = _meet(near, twice, "left_semi").withColumn(tid, F.xxhash64("text"))
    once = once.dropDuplicates(["doc_id", tid]).select(*docs.columns)
    return rest.union(_meet(near, twice, "left_anti")).union(once)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in every text and counts its characters anew; no document goes."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def training_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, source, copy, taken_words, position)`` of every copy, by training position."""
    return mixing.training_order(mixing.curriculum(docs, in_order=False)).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("PII", personal_data),
    ("mixing sources to target weights", training_mix),
]

#: Models are fitted and near copies searched: SQL cannot express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{root}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{root}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
