"""Result tables: formatted hits, excerpts, prompts and answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkwell.functions.metadata import merged_view
from chunkwell.operators.embedding import (
    BATCH_SIZE,
    Model,
    _check_batch_size,
    _loader,
    _run_batches,
)

# How results are laid out.
PREVIEW_CHARS = 500
ELLIPSIS = "..."
SCORE_FORMAT = "%.3f"
HIDDEN_FIELDS = ("_id", "embedding")

SYSTEM_PROMPT = (
    "You answer questions about documents. Use nothing but the numbered excerpts "
    "that follow the question, name the excerpts an answer rests on, and say so "
    "plainly when they do not contain the answer."
)


def score_text(score: Column) -> Column:
    return F.format_string(SCORE_FORMAT, score)


def _source_line(fields: Column) -> Column:
    shown = F.filter(F.map_entries(fields), lambda e: ~e["key"].isin(*HIDDEN_FIELDS))
    return F.array_join(
        F.transform(
            shown,
            lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("None"))),
        ),
        ", ",
    )


def format_hits(
    hits: DataFrame,
    include_scores: bool = True,
    *,
    rank_col: str = "rank",
    metadata_col: str | None = None,
) -> DataFrame:
    """Ready-to-show columns: ``rank, score, excerpt, source``.

    Content over 500 characters is cut and marked; ``source`` lists all fields
    of the record. Without ``metadata_col`` it is made from the system columns
    and the caller's map.
    """
    fields = F.col(metadata_col) if metadata_col else merged_view(hits)
    content = F.col("content")
    shown = {
        "rank": F.col(rank_col).cast("bigint"),
        "excerpt": F.when(
            F.length(content) > PREVIEW_CHARS,
            F.concat(F.left(content, F.lit(PREVIEW_CHARS)), F.lit(ELLIPSIS)),
        ).otherwise(content),
        "source": _source_line(fields),
    }
    if include_scores:
        shown["score"] = score_text(F.col("similarity_score"))
    return hits.withColumns(shown)


def source_attribution(hits: DataFrame) -> DataFrame:
    """Add ``attribution``: file, URL, page and chunk, leaving out absent parts.

    An empty name and page 0 count as absent; chunk 0 does not.
    """

    def part(label: str, name: str, present: Callable[[Column], Column]) -> Column:
        if name not in hits.columns:
            return F.lit(None).cast("string")
        value = F.col(name)
        return F.when(present(value), F.concat(F.lit(label), value.cast("string")))

    return hits.withColumn(
        "attribution",
        F.concat_ws(
            " | ",
            part("File: ", "source_file", lambda v: v != ""),
            part("URL: ", "source_url", lambda v: v != ""),
            part("Page: ", "page_number", lambda v: v != 0),
            part("Chunk: ", "chunk_index", lambda v: v.isNotNull()),
        ),
    )


def _excerpt(df: DataFrame) -> Column:
    origin: Column = F.lit("")
    if "source_file" in df.columns:
        page = F.lit("")
        if "page_number" in df.columns:
            page = F.coalesce(
                F.concat(F.lit(", page "), F.col("page_number").cast("string")), F.lit("")
            )
        origin = F.coalesce(
            F.concat(F.lit(" (from "), F.col("source_file"), page, F.lit(")")), F.lit("")
        )
    return F.concat(
        F.lit("[Excerpt "),
        F.col("rank").cast("string"),
        F.lit(", similarity: "),
        score_text(F.col("similarity_score")),
        origin,
        F.lit("]\n"),
        F.col("content"),
        F.lit("\n"),
    )


def context_of(hits: DataFrame) -> Column:
    """Aggregate of one question's hits: numbered excerpts in rank order."""
    part = F.struct(F.col("rank").alias("rank"), _excerpt(hits).alias("text"))
    parts = F.array_sort(F.collect_list(part))
    return F.array_join(F.transform(parts, lambda p: p["text"]), "\n")


def scores_of() -> Column:
    """Aggregate of one question's hits: its scores in rank order."""
    part = F.struct(
        F.col("rank").alias("rank"), score_text(F.col("similarity_score")).alias("score")
    )
    return F.array_join(
        F.transform(F.array_sort(F.collect_list(part)), lambda s: s["score"]), ", "
    )


def build_context(hits: DataFrame, query_id_col: str = "query_id") -> DataFrame:
    """One row per question: its hits as numbered excerpts in rank order.

    A question has at most ``limit`` hits, so the collected list is bounded.
    """
    return hits.groupBy(query_id_col).agg(context_of(hits).alias("context"))


def build_prompts(
    contexts: DataFrame, question_col: str = "query_text", context_col: str = "context"
) -> DataFrame:
    """Add the system and the user prompt around each context."""
    return contexts.withColumns(
        {
            "system_prompt": F.lit(SYSTEM_PROMPT),
            "user_prompt": F.concat(
                F.lit("Question: "),
                F.col(question_col),
                F.lit("\n\nExcerpts:\n"),
                F.col(context_col),
                F.lit("\n\nAnswer the question from these excerpts."),
            ),
        }
    )


def apply_model(
    prompts: DataFrame,
    fn: Model | None = None,
    *,
    factory: Callable[[], Model] | None = None,
    system_col: str = "system_prompt",
    user_col: str = "user_prompt",
    answer_col: str = "answer",
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """Add the answers of ``fn(list of (system, user)) -> list of texts``."""
    _check_batch_size(batch_size)
    load = _loader(fn, factory)

    def adapted() -> Callable[[Sequence[dict]], Sequence[str]]:
        model = load()
        return lambda rows: model([(r["system"], r["user"]) for r in rows])

    @F.arrow_udf(T.StringType())
    def answers(rows: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _run_batches(
            rows, adapted, batch_size, lambda out: pa.array(out, pa.string())
        )

    prompt = F.struct(F.col(system_col).alias("system"), F.col(user_col).alias("user"))
    return prompts.withColumn(answer_col, answers.asNondeterministic()(prompt))


def answer_summary(
    hits: DataFrame, collection_name: str | Column, query_id_col: str = "query_id"
) -> DataFrame:
    """Per question: number of sources, collection, scores in rank order."""
    name = collection_name if isinstance(collection_name, Column) else F.lit(collection_name)
    return hits.groupBy(query_id_col).agg(
        F.count(F.lit(1)).alias("sources_consulted"),
        F.max(name).alias("collection_name"),
        scores_of().alias("similarity_scores"),
    )
