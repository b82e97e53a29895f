"""Which collection a record belongs to, and which collections are there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Collection names by strategy, with what stands in for a
# missing part. Any other strategy gives the default collection.
SINGLE_COLLECTION = "all_documents"
DEFAULT_COLLECTION = "default_collection"
MISSING_TYPE = "general"
MISSING_USER = "anonymous"
MISSING_TENANT = "default"

# What the coverage report says.
COVERED = "EXISTS"
NOT_COVERED = "NEEDS INDEX"


def route_collection(
    df: DataFrame,
    strategy: str | Column,
    *,
    type_col: str = "document_type",
    user_col: str = "user_id",
    tenant_col: str = "tenant",
    out_col: str = "collection_name",
) -> DataFrame:
    """Add the collection name; it becomes the partition when written."""
    strategy = strategy if isinstance(strategy, Column) else F.lit(strategy)

    def field(name: str, missing: str) -> Column:
        if name not in df.columns:
            return F.lit(missing)
        return F.coalesce(F.col(name).cast("string"), F.lit(missing))

    kind = field(type_col, MISSING_TYPE)
    name = (
        F.when(strategy == "single", F.lit(SINGLE_COLLECTION))
        .when(strategy == "by_type", F.concat(kind, F.lit("_docs")))
        .when(
            strategy == "by_user",
            F.concat(F.lit("user_"), field(user_col, MISSING_USER), F.lit("_docs")),
        )
        .when(
            strategy == "hybrid",
            F.concat(field(tenant_col, MISSING_TENANT), F.lit("_"), kind, F.lit("_docs")),
        )
        .otherwise(F.lit(DEFAULT_COLLECTION))
    )
    return df.withColumn(out_col, name)


def index_coverage(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Wanted collections against existing ones: ``EXISTS`` or ``NEEDS INDEX``."""
    there = existing.select("collection_name").distinct().withColumn("_there", F.lit(True))
    return wanted.join(there, "collection_name", "left").select(
        *wanted.columns,
        F.when(F.col("_there"), COVERED).otherwise(NOT_COVERED).alias("status"),
    )
