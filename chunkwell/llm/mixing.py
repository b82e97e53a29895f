"""Mixing sources to target weights along a curriculum that changes over time.

Every source has a weight and a schedule, the rate at which its words are wanted from
the start (0) to the end (1) of training. What a source weighs in the whole is its weight
integrated along its schedule. The integral up to any time says how much of the
source's target is used up by then; inverting it turns the place of a document in
its source's stream into a training position, and a range sort by position gives the mix.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkwell.session import written

WORD = r"[^\x20\x09-\x0D]+"

Schedule = Sequence[tuple[float, float]]
#: Rates at training times 0 and 1: early, even, late; used in turn like the weights.
SCHEDULES: tuple[Schedule, ...] = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)


def _areas(schedule: Schedule) -> list[float]:
    """The integral of a piecewise linear rate over each of its pieces."""
    return [(t1 - t0) * (r0 + r1) / 2 for (t0, r0), (t1, r1) in zip(schedule, schedule[1:])]


def integrated_weights(weights: Sequence[int], schedules: Sequence[Schedule]) -> list[int]:
    """Weights of the sources in turn, integrated along their schedules, as integers in proportion.

    Integrals are taken to the nearest millionth, so that targets stay exact in integers.
    """
    turns = range(math.lcm(len(weights), len(schedules)))
    areas = [Fraction(round(sum(_areas(s)) * 1_000_000), 1_000_000) for s in schedules]
    found = [weights[k % len(weights)] * areas[k % len(schedules)] for k in turns]
    if min(found) <= 0:
        raise ValueError("every weight and every integral of a schedule must be above 0")
    whole = [int(w * math.lcm(*(x.denominator for x in found))) for w in found]
    return [w // math.gcd(*whole) for w in whole]


def invert_schedule(schedule: Schedule, share: Column) -> Column:
    """The time at which a piecewise linear rate has delivered ``share`` (0 to 1) of its integral."""
    times = [t for t, _ in schedule]
    if times != sorted(set(times)) or times[0] != 0 or times[-1] != 1:
        raise ValueError("schedule times must rise from 0 to 1")
    if min(r for _, r in schedule) < 0 or all(r == 0 for _, r in schedule):
        raise ValueError("rates must not be negative and not all 0")
    pieces = list(zip(schedule, schedule[1:]))
    areas = _areas(schedule)
    whole, before, at = sum(areas), 0.0, F.lit(1.0)
    chosen = None
    for ((t0, r0), (t1, r1)), area in zip(pieces, areas):
        rest = F.greatest(share * F.lit(whole) - F.lit(before), F.lit(0.0))
        slope = (r1 - r0) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(r0 * r0) + F.lit(2 * slope) * rest, F.lit(0.0)))
        # rest = r0 x + slope x^2 / 2, solved so that a slope of 0 is no special case
        here = F.lit(t0) + F.coalesce(F.try_divide(F.lit(2.0) * rest, F.lit(r0) + root), F.lit(0.0))
        under = share * F.lit(whole) < F.lit(before + area)
        chosen = F.when(under, here) if chosen is None else chosen.when(under, here)
        before += area
    return chosen.otherwise(at)


def source_targets(sizes: DataFrame, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """``(skey, place, source_size, target, words)`` from ``(skey, source, source_size)``.

    Sources share all words by weight; what a source cannot use, since it may be repeated
    ``max_repeats`` times at most, is shared among the others. Sorted by how soon they are
    full, the full sources are the first few, so running sums decide without a loop.
    ``words`` is the target in whole words, exact in integers. One row per source.
    """
    cap = F.col("source_size") * max_repeats
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(cap / F.col("weight"), "place")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    ranked = (
        sizes.withColumn("place", F.row_number().over(order) - 1)
        .withColumn(
            "weight",
            F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
            .cast("bigint"),
        )
        .withColumn("left", F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(rest))
        .withColumn("full", cap * F.col("open") < F.col("left") * F.col("weight"))
    )
    everyone = Window.partitionBy()
    free = F.sum("source_size").over(everyone) - F.sum(F.when(F.col("full"), cap).otherwise(0)).over(everyone)
    share = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everyone)
    return ranked.withColumn("free", free).withColumn("share", share).select(
        "skey",
        "place",
        "source_size",
        F.when(F.col("full"), cap.cast("double"))
        .otherwise(F.col("free") * F.col("weight") / F.col("share"))
        .alias("target"),
        F.when(F.col("full"), cap).otherwise(F.expr("free * weight div share")).alias("words"),
    )


def curriculum(
    docs: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    schedules: Sequence[Schedule] = SCHEDULES,
    max_repeats: int = 3,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    rows_per_group: int = 50_000,
    in_order: bool = True,
) -> DataFrame:
    """``(id, size, source_size, target, taken, position, last_position)``, one row per input row.

    A source's documents stand in a stream in the order of a hash of their id; the stream
    repeats until the target is used up, so a document is taken whole once per full round
    and perhaps a part of it in the last. ``position`` and ``last_position`` are the
    training times of its first and last copy, NULL if nothing is taken.

    Rows come in the order of training, by a range partitioning on position, then id; rows of
    which nothing is taken are last. ``in_order=False`` leaves the sort out, for callers that
    sort copies themselves (:func:`training_order`). Sources share all words by
    :func:`integrated_weights`.

    A NULL or empty text has size 0 and is not taken; a NULL source is a source of its own,
    the last one; repeated rows are placed like different documents; an empty table gives
    an empty result. Only the three named columns are read.

    Running sums are made in two steps, within hash ranges of a source of about
    ``rows_per_group`` rows and over the sums of the ranges, so a source that holds a
    third of all rows is spread over many tasks. Texts are read once; what moves is
    ids and numbers.
    """
    source = F.col(source_col)
    rows = written(
        docs.select(
            F.col(id_col).alias("id"),
            F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("skey"),
            source.alias("source"),
            F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
            F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("key"),
        )
    )
    sources = written(
        rows.groupBy("skey", "source").agg(
            F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")
        )
    )
    most = sources.agg(F.max("n")).head()[0] or 1
    digits = max(1, math.ceil(math.log(most / rows_per_group + 1, 16)))
    rows = rows.withColumn("part", F.substring("key", 1, digits))
    shares = integrated_weights(weights, schedules)
    targets = source_targets(sources.select("skey", "source", "source_size"), shares, max_repeats)
    parts = rows.groupBy("skey", "part").agg(F.sum("size").alias("part_size"))
    earlier = Window.partitionBy("skey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("offset", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)))
    parts = parts.join(targets, "skey")
    within = Window.partitionBy("skey", "part").orderBy("key", "id", "size")
    within = within.rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        rows.join(parts, ["skey", "part"])
        .withColumn("start", F.col("offset") + F.sum("size").over(within) - F.col("size"))
        .withColumn("rounds", F.expr("CASE WHEN source_size > 0 THEN words div source_size ELSE 0L END"))
        .withColumn(
            "tail",
            F.greatest(
                F.lit(0),
                F.least("size", F.col("words") - F.col("rounds") * F.col("source_size") - F.col("start")),
            ),
        )
        .withColumn("taken", F.col("rounds") * F.col("size") + F.col("tail"))
        .withColumn("copies", F.col("rounds") + (F.col("tail") > 0).cast("bigint"))
    )
    placed = placed.select(
        "id",
        F.col(  # as given, so that callers can group by it
            "source"
        ),
        "size",
        "source_size",
        "target",
        "taken",
        "rounds",
        "tail",
        F.when(F.col("taken") > 0, _time("start", schedules)).alias("position"),
        F.when(
            F.col("taken") > 0,
            _time(F.col("start") + (F.col("copies") - 1) * F.col("source_size"), schedules),
        ).alias("last_position"),
        "start",
        "words",
        "place",
    )
    return placed.orderBy(F.asc_nulls_last("position"), "id", "source") if in_order else placed


def _time(start: str | Column, schedules: Sequence[Schedule]) -> Column:
    """The training time at which a place in a source's stream is due."""
    start = F.col(start) if isinstance(start, str) else start
    share = start.cast("double") / F.col("words")
    chosen = None
    for k, schedule in enumerate(schedules):
        mine = F.col("place") % len(schedules) == k
        at = invert_schedule(schedule, share)
        chosen = F.when(mine, at) if chosen is None else chosen.when(mine, at)
    return chosen


def training_order(placed: DataFrame, schedules: Sequence[Schedule] = SCHEDULES) -> DataFrame:
    """``(id, source, copy, words, position)`` sorted by position: the mix itself.

    Takes the result of :func:`curriculum` with the same schedules, in any order. A row per copy that
    is taken; ``words`` is less than the document's size only for a last, cut copy. The
    sort is a range partitioning on position, then id, so no task holds more than its range.
    """
    copies = placed.where("taken > 0").withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.col("rounds") - (F.col("tail") == 0).cast("bigint")))
    )
    return copies.select(
        "id",
        "source",
        "copy",
        F.when(F.col("copy") < F.col("rounds"), F.col("size")).otherwise(F.col("tail")).alias("taken_words"),
        _time(F.col("start") + F.col("copy") * F.col("source_size"), schedules).alias("position"),
    ).orderBy("position", "id", "copy")
