"""Checks on search requests, for one request and for a table of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwell.functions.text import BLANKS, is_blank

# Bounds and defaults of the two kinds of request.
SEARCH_MAX_LIMIT = 50
QUESTION_MAX_LIMIT = 10
SEARCH_LIMIT = 5
QUESTION_LIMIT = 3
SIMILARITY_THRESHOLD = 0.7


def check_request(
    query_text: str | None,
    limit: int,
    similarity_threshold: float,
    max_limit: int = SEARCH_MAX_LIMIT,
) -> None:
    """Raise ``ValueError`` if a single request is not acceptable."""
    if query_text is None or not query_text.strip(BLANKS):
        raise ValueError(_BLANK)
    if not 1 <= limit <= max_limit:
        raise ValueError(_bad_limit(max_limit))
    if not 0.0 <= similarity_threshold <= 1.0:
        raise ValueError(_BAD_THRESHOLD)


_BLANK = "query text is blank"
_BAD_THRESHOLD = "similarity threshold is outside 0 to 1"


def _bad_limit(max_limit: int) -> str:
    return f"limit is outside 1 to {max_limit}"


def validate_requests(
    requests: DataFrame,
    max_limit: int = SEARCH_MAX_LIMIT,
    *,
    text_col: str = "query_text",
    limit_col: str = "limit",
    threshold_col: str = "similarity_threshold",
) -> DataFrame:
    """Add ``error``: the first thing wrong with a request, NULL if none.

    Nothing is dropped, so a caller can go on with the valid rows and still
    answer the others. A NULL threshold means that none is wanted.
    """
    limit, threshold = F.col(limit_col), F.col(threshold_col)
    return requests.withColumn(
        "error",
        F.when(is_blank(F.col(text_col)), _BLANK)
        .when(~F.coalesce(limit.between(1, max_limit), F.lit(False)), _bad_limit(max_limit))
        .when(
            ~F.coalesce(threshold.between(0.0, 1.0), F.lit(True)) | F.isnan(threshold),
            _BAD_THRESHOLD,
        ),
    )
