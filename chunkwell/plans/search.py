"""Search with texts: check, embed, rank, format."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkwell.functions.hashing import DEFAULT_DIMS, hashed_model
from chunkwell.operators.embedding import Model, embed_queries
from chunkwell.operators.requests import (
    SEARCH_LIMIT,
    SEARCH_MAX_LIMIT,
    SIMILARITY_THRESHOLD,
    check_request,
    validate_requests,
)
from chunkwell.operators.results import format_hits
from chunkwell.operators.search import search_batch
from chunkwell.schemas import SYSTEM_FIELDS


def with_defaults(
    requests: DataFrame, limit: int, similarity_threshold: float | None, max_limit: int
) -> DataFrame:
    """Requests with ``limit`` and ``similarity_threshold`` columns filled in.

    The given values apply to all requests alike, so a wrong one is an error.
    """
    check_request("any", limit, similarity_threshold or 0.0, max_limit)
    missing = {}
    if "limit" not in requests.columns:
        missing["limit"] = F.lit(limit)
    if "similarity_threshold" not in requests.columns:
        missing["similarity_threshold"] = F.lit(similarity_threshold).cast("double")
    return requests.withColumns(missing) if missing else requests


def ranked_chunks(
    collection: DataFrame,
    requests: DataFrame,
    limit: int,
    max_limit: int,
    similarity_threshold: float | None,
    metadata_filter: Mapping[str, object] | Column | None = None,
    *,
    fn: Model | None = None,
    factory: Callable[[], Model] | None = None,
    filter_mode: str = "post",
    columns: Sequence[str] | None = None,
    id_col: str = "chunk_id",
    group_col: str | None = None,
) -> DataFrame:
    """Hits of all valid requests ``(query_id, query_text, …)`` with their rows."""
    if fn is None and factory is None:
        factory = partial(hashed_model, DEFAULT_DIMS)
    filled = with_defaults(requests, limit, similarity_threshold, max_limit)
    checked = validate_requests(filled, max_limit)
    queries = embed_queries(checked.where(F.col("error").isNull()), fn, factory=factory)
    if columns is None:
        wanted = ("content", "metadata", *SYSTEM_FIELDS)
        columns = [c for c in wanted if c in collection.columns]
    return search_batch(
        collection, queries, "limit", "similarity_threshold", metadata_filter,
        filter_mode=filter_mode, id_col=id_col, columns=columns, max_limit=max_limit,
        group_col=group_col,
    )


def search_documents(
    collection: DataFrame,
    requests: DataFrame,
    limit: int = SEARCH_LIMIT,
    similarity_threshold: float | None = SIMILARITY_THRESHOLD,
    metadata_filter: Mapping[str, object] | Column | None = None,
    include_similarity_scores: bool = True,
    **options: object,
) -> DataFrame:
    """Formatted hits for a table of requests ``(query_id, query_text)``.

    ``limit`` (1 to 50) and ``similarity_threshold`` (0 to 1) may be columns of
    the requests. Requests that are not acceptable give no hits; list them with
    :func:`validate_requests`, and those without hits with
    :func:`unmatched_queries`. With ``group_col="collection_name"`` every request
    gets one list per collection.
    """
    hits = ranked_chunks(
        collection, requests, limit, SEARCH_MAX_LIMIT, similarity_threshold,
        metadata_filter, **options,
    )
    return format_hits(hits, include_similarity_scores)
