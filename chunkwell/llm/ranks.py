"""Places of rows in a total order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkwell.session import written


def ranked(rows: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """The rows with their place (from 1) in an order that must tell all rows apart.

    Rows are dealt by ranges of the order, sorted within them and written, with the place
    in the range; a second step adds the sizes of the ranges before. What is gathered
    is one number per range. An empty table gives an empty table.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    joined = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return joined.select(*rows.columns, (F.col("_start") + within + 1).alias(name))
