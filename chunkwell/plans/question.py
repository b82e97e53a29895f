"""Question answering over a collection: search, excerpts, prompt, answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwell.operators.embedding import Model
from chunkwell.operators.requests import (
    QUESTION_LIMIT,
    QUESTION_MAX_LIMIT,
    SIMILARITY_THRESHOLD,
)
from chunkwell.operators.results import (
    apply_model,
    build_prompts,
    context_of,
    scores_of,
)
from chunkwell.operators.search import NO_HIT_ADVICE
from chunkwell.plans.search import ranked_chunks


def query_contract(
    collection: DataFrame,
    questions: DataFrame,
    collection_name: str = "contract_analysis",
    limit: int = QUESTION_LIMIT,
    similarity_threshold: float | None = SIMILARITY_THRESHOLD,
    *,
    answer_fn: Model | None = None,
    answer_factory: Callable[[], Model] | None = None,
    **options: object,
) -> DataFrame:
    """One row per question ``(query_id, query_text)``, answered or not.

    Columns: the context, both prompts, how many excerpts were consulted and
    their scores; with an answering function also ``answer``. A question
    without a relevant excerpt has NULL there and says so in ``advice``. A context
    is of one ranking, so lists per group (``group_col``) are refused.
    """
    if options.get("group_col") is not None:
        raise ValueError("query_contract answers from one ranking: group_col is not possible")
    wanted = ("content", "source_file", "page_number")
    columns = [c for c in wanted if c in collection.columns]
    hits = ranked_chunks(
        collection, questions, limit, QUESTION_MAX_LIMIT, similarity_threshold,
        columns=columns, **options,
    )
    # one aggregate for all of it: the ranking below it runs once
    found = hits.groupBy("query_id").agg(
        context_of(hits).alias("context"),
        F.count(F.lit(1)).alias("sources_consulted"),
        scores_of().alias("similarity_scores"),
    )
    rows = questions.select("query_id", "query_text").join(found, "query_id", "left")
    prompts = build_prompts(rows).withColumns(
        {
            "system_prompt": F.when(F.col("context").isNotNull(), F.col("system_prompt")),
            "collection_name": F.lit(collection_name),
            "sources_consulted": F.coalesce("sources_consulted", F.lit(0)),
            "advice": F.when(F.col("context").isNull(), NO_HIT_ADVICE),
        }
    )
    if answer_fn is None and answer_factory is None:
        return prompts
    # a question without excerpts never reaches the model
    asked = prompts.where(F.col("context").isNotNull())
    silent = prompts.where(F.col("context").isNull())
    answered = apply_model(asked, answer_fn, factory=answer_factory)
    return answered.unionByName(silent, allowMissingColumns=True)
