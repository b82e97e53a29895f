"""Helpers that act on whole rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``withColumn`` for a costly value that later expressions read often.

    Catalyst merges stacked projections, and a reference inside a lambda counts
    as one even if it runs per array entry, so a costly expression could end up
    evaluated once per chunk. Passing it through ``explode(array(value))`` keeps
    the one row and makes the value a plain attribute from there on.
    """
    keep = [c for c in df.columns if c != name]
    return df.select(*keep, F.explode(F.array(value)).alias(name))
