"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from chunkwell.session import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node with a link; the component is its smallest node.

    ``edges`` may repeat, run in either direction and link a node with itself; rows with
    a NULL end are left out. Nodes without a link to another node are not in the result.

    Every round points nodes at the smallest neighbour and writes the edges to the shared
    folder, so a lost executor costs one round at most. Minima are combined before each
    shuffle and edges of a hub are spread by a splittable join; the number of rounds grows
    with the logarithm of the longest chain. Nothing is collected but a checksum.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v")
    now = ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, seen = _kept(now)
    while True:
        if seen[0] == 0:
            break
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following, sums = _kept(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        if sums == seen:
            break
        now, seen = following, sums
    roots = now.select(F.col("v").alias("u"), "v").distinct()
    return now.union(roots).toDF("node", "component")


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a written table, with their number and checksums."""
    sums = Observation()
    mixed = F.xxhash64("u", "v")
    table = written(
        edges.observe(
            sums,
            F.count(F.lit(1)).alias("n"),
            F.sum(F.shiftright(mixed, 24)).alias("high"),
            F.sum(mixed.bitwiseAND(0xFFFFFFFF)).alias("low"),
        )
    )
    got = sums.get
    return table, (got["n"], got["high"], got["low"])
