"""One query per operator over its whole table, with the columns the checks compare."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwell.llm import (
    decontaminate,
    divergence,
    language,
    mixing,
    ngram_join,
    pii,
    resampling,
    simhash,
    sparse_suffix,
    token_counts,
    toxicity,
    url_rules,
    warc,
)
from chunkwell.llm.common import table
from chunkwell.session import shared_dir, written

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    REGISTRY[fn.__name__] = fn
    return fn


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    counts = [count(kind).alias(f"n_{kind}") for kind in pii.BASE_KINDS]
    return found.select(
        F.col("id").alias("doc_id"),
        *counts,
        F.sha2(pii.span_list("spans", pii.BASE_KINDS), 256).alias("base_sha256"),
        pii.span_list("spans").alias("spans"),
    )


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.curriculum(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        "size",
        "source_size",
        F.round("target", 6).alias("target"),
        "taken",
        F.round("position", 6).alias("position"),
        F.round("last_position", 6).alias("last_position"),
    )


RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


@query
def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_rules.filter_urls(table(spark, sf_dir, "pages"), RULES)
    return judged.withColumnRenamed("id", "page_id")


@query
def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = ngram_join.jaccard_components(table(spark, sf_dir, "documents"))
    return linked.withColumnRenamed("id", "doc_id")


#: Fingerprint search takes every document whose id is divisible by this as a query.
EVERY = 100


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = written(simhash.fingerprints(table(spark, sf_dir, "documents")))
    asked = marks.where(F.col("id") % EVERY == 0).select("fingerprint")
    distinct = marks.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("copies"))
    near = simhash.near_fingerprints(asked, distinct)
    own, edited, following = map(F.col, ("fingerprint", "edited_fingerprint", "next_fingerprint"))
    return marks.join(near, "fingerprint", "left").select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.col("edited").alias("edited_sha256"),
        F.lpad(F.lower(F.hex(own)), 16, "0").alias("fingerprint"),
        F.lpad(F.lower(F.hex(edited)), 16, "0").alias("edited_fingerprint"),
        simhash.likeness(own, edited).alias("near_edited"),
        simhash.likeness(own, following).alias("near_next"),
        F.when(F.col("id") % EVERY == 0, F.col("n_near")).alias("n_near"),
    )


@query
def op10_sparse_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sparse_suffix.repeated_passages(table(spark, sf_dir, "documents"))
    spans = F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"]))
    return found.select(
        F.col("id").alias("doc_id"),
        (F.col("n_repeated") > 0).alias("repeats"),
        "n_words",
        "n_repeated",
        F.array_join(spans, ",").alias("spans"),
        "copies",
    )


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, name) for name in ("documents", "labels"))
    labelled = docs.join(labels.where(~toxicity.held_out()).select("doc_id", "toxic"), "doc_id")
    model = toxicity.fit_toxicity(labelled)
    scored = toxicity.score_toxicity(docs, model)
    return scored.select(
        F.col("id").alias("doc_id"),
        toxicity.held_out("id").alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


def _addressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages as rows with what is known of their address and markup."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    host = url_rules.url_host(F.col("url"))
    none = F.lit(None)
    return docs.select(
        "doc_id",
        none.cast("bigint").alias("page_id"),
        F.col("source").alias("host"),
        none.cast("string").alias("suffix"),
        none.cast("string").alias("declared"),  # the label of the fit is no evidence
        "text",
    ).unionByName(
        pages.select(
            none.cast("bigint").alias("doc_id"),
            "page_id",
            F.nullif(host, F.lit("")).alias("host"),
            language.address_suffix(host).alias("suffix"),
            language.declared_language(F.col("html")).alias("declared"),
            language.markup_text(F.col("html")).alias("text"),
        )
    )


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.fit_languages(table(spark, sf_dir, "documents"))
    found = language.identify(_addressed(spark, sf_dir), model)
    return found.withColumn("confidence", F.round("confidence", 4))


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        (F.size("items") > 0).alias("contaminated"),
        F.array_join(F.col("items").cast("array<string>"), ",").alias("items"),
        "edits",
    )


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"))
    return counted.withColumnRenamed("id", "doc_id")


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


@query
def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.withColumnRenamed("id", "doc_id")


@query
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_records(spark, path).select(
        warc.row_id("record_id").cast("bigint").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.row_id("refers_to").cast("bigint").alias("refers_to"),
        "intact",
    )
