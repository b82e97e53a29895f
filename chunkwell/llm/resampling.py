"""Importance resampling: draw the documents that look most like a target set.

Documents and targets are bags of hashed words. A bucket's gain is the logarithm of how
much more frequent it is in the target; a document's weight is the mean gain of its
features, and Gumbel noise by its id turns the highest scores into a weighted draw
without replacement (Xie et al., 2023, "Data selection for language models via
importance resampling").
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chunkwell.llm.ranks import ranked
from chunkwell.llm.terms import folded, runs
from chunkwell.session import written

#: Words after A-Z are lower-cased: digits, small letters and all beyond ASCII.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BUCKETS = 10_000
#: Distinct features remembered per task; beyond that the memory starts afresh.
CACHE_FEATURES = 200_000
#: Places gathered before they are counted.
COUNT_AT_ONCE = 200_000
#: Accuracy of the quantile sketch: its rank error is at most a part in so many.
ACCURACY = 10_000


class _Buckets(dict):
    """Feature to bucket."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        bucket = crc32(feature) % self.buckets
        if len(self) >= CACHE_FEATURES:
            self.clear()
        self[feature] = bucket
        return bucket


def _places(data: bytes, buckets: _Buckets, longest: int) -> Iterator[np.ndarray]:
    """Buckets of all features of a text: runs of 1 to ``longest`` words."""
    last: list[bytes] = []
    for words in runs(WORD, data):
        yield np.fromiter(map(buckets.__getitem__, words), np.int64, len(words))
        if longest > 1:
            fresh = len(last)
            words = last + words
            grams = [
                b" ".join(words[at : at + n])
                for n in range(2, longest + 1)
                for at in range(max(0, fresh - n + 1), len(words) - n + 1)
            ]
            yield np.fromiter(map(buckets.__getitem__, grams), np.int64, len(grams))
            last = words[1 - longest :]


def bucket_counts(rows: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = 1) -> np.ndarray:
    """How many features of all texts fall into each bucket.

    Every task counts into one array and returns its buckets, which are summed by Spark;
    the driver gets at most ``buckets`` rows.
    """

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = _Buckets(buckets), np.zeros(buckets, np.int64)
        held, size = [], 0
        for batch in stream:
            for data in folded(batch.column(0)):
                for found in _places(data, known, longest):
                    held.append(found)
                    size += len(found)
                if size > COUNT_AT_ONCE:
                    total += np.bincount(np.concatenate(held), minlength=buckets)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    counted = rows.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket bigint, n bigint")
    out = np.zeros(buckets, np.int64)
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousand times the log ratio of smoothed shares, rounded down, per bucket."""
    buckets, total, wanted = len(corpus), int(corpus.sum()), int(target.sum())
    out = np.zeros(buckets, np.int64)
    for k, (s, t) in enumerate(zip(corpus.tolist(), target.tolist())):
        up, down = float(t + 1) * float(total + buckets), float(s + 1) * float(wanted + buckets)
        out[k] = math.floor(1000.0 * math.log(up / down))
    return out


def weigh_documents(
    docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = 1
) -> DataFrame:
    """``(id, n_features, weight)``: the floored mean gain, 0 without features."""
    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_col].dataType),
            T.StructField("n_features", T.LongType()),
            T.StructField("weight", T.LongType()),
        ]
    )
    arrow, buckets = to_arrow_schema(schema), len(gains)

    def weigh(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets(buckets)
        for batch in stream:
            sizes, weights = [], []
            for data in folded(batch.column(1)):
                n = total = 0
                for found in _places(data, known, longest):
                    n += len(found)
                    total += int(gains[found].sum())
                sizes.append(n)
                weights.append(total // n if n else 0)
            columns = [batch.column(0).cast(arrow.field(0).type), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(weights, pa.int64())], names=arrow.names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(weigh, schema)


def gumbel(id_col: str | Column, seed: str) -> Column:
    """Thousand times standard Gumbel noise, rounded down; a NULL id counts as no characters."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _key() -> list[Column]:
    """The order of the draw: score, then id (NULL last), then the row."""
    return [-F.col("score"), F.col("id").isNull(), F.col("id"), F.col("row")]


def cutoff(scored: DataFrame, wanted: int, accuracy: int = ACCURACY):
    """The last of the ``wanted`` first rows in the draw's order; ``None`` for none.

    A mergeable quantile sketch brackets the score. Rows above and inside the bracket are
    counted exactly; if the cutoff is outside, the bracket is widened, in the end to all
    rows. Only the bracket is sorted.
    """
    if wanted <= 0:
        return None
    score, width = F.col("score"), 2 / accuracy
    n = scored.count()
    while True:
        low, high = 1 - wanted / n - width, 1 - wanted / n + width
        sketch = F.percentile_approx("score", [max(0.0, low), min(1.0, high)], accuracy)
        least, most = scored.agg(sketch).head()[0]
        above = (score > most) if high < 1 else F.lit(False)
        inside = (score >= least) & ~above if low > 0 else ~above
        over, held = scored.agg(F.count_if(above), F.count_if(inside)).head()
        if over < wanted <= over + held:
            break
        width *= 4
    bracket = scored.where(inside).select("id", "score", "row")
    return ranked(bracket, *_key()).where(F.col("rank") == wanted - over).head()


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    *,
    percent: int = 10,
    least_features: int = 20,
    seed: str = "2024",
    buckets: int = BUCKETS,
    longest: int = 1,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """``(id, n_features, weight, score, rank)``, one row per input row.

    ``rank`` counts the drawn documents from the highest score; it is NULL for others.
    Of the documents with at least ``least_features`` features, ``percent`` hundredths,
    rounded down, are drawn.

    A NULL or empty text has no features and weight 0; a NULL id counts as no characters in the
    noise and comes last in ties; repeated rows are drawn like different documents; an empty
    table gives an empty result, an empty target gains that favour rare buckets. No other
    column is read, so names cannot clash.

    Texts are read twice, once to count buckets and once to weigh; weights are written
    and all that follows reads numbers only. The driver holds two arrays of ``buckets``
    numbers and, of the rows, the cutoff.
    """
    corpus = bucket_counts(docs, text_col, buckets, longest)
    gains = bucket_gains(corpus, bucket_counts(target, target_col, buckets, longest))
    weighed = weigh_documents(docs, gains, id_col, text_col, longest)
    scored = written(
        weighed.withColumn("score", F.col("weight") + gumbel("id", seed)).withColumn(
            "row", F.monotonically_increasing_id()
        )
    )
    able = F.col("n_features") >= least_features
    pool = scored.where(able)
    last = cutoff(pool, percent * pool.count() // 100, accuracy)
    if last is None:
        drawn = F.lit(False)
    else:
        same_id = F.col("id").eqNullSafe(F.lit(last["id"]))
        earlier_id = F.col("id").isNotNull() & (F.lit(last["id"]).isNull() | (F.col("id") < F.lit(last["id"])))
        tied = earlier_id | (same_id & (F.col("row") <= last["row"]))
        tied = F.coalesce(tied, F.lit(False))
        drawn = able & ((F.col("score") > last["score"]) | ((F.col("score") == last["score"]) & tied))
    first = ranked(scored.where(drawn), *_key())
    rest = scored.where(~drawn).withColumn("rank", F.lit(None).cast("bigint"))
    names = ("id", "n_features", "weight", "score", "rank")
    return first.select(*names).unionAll(rest.select(*names))
