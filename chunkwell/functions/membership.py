"""Which rows can be among given keys, told where the rows lie.

Joining whole texts with a narrow table of keys moves every text. A Bloom filter of the keys
has a bounded size and goes to the rows instead: rows that it does not know stay where they
are, and only the others meet the keys exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits per key: two of them are looked at, so one row in 60 is taken for a key in vain.
BITS_PER_KEY = 16
#: Bits of a filter are two to the power of these; the largest has 16 MB. With more keys than
#: it can tell apart it lets more rows pass, in the end all.
LEAST_BITS, MOST_BITS = 16, 27
_WORD = 6


def known_keys(keys: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """The filter of a table's keys, as 64-bit words."""
    n = keys.count()
    bits = min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(max(1, n) * BITS_PER_KEY)))))
    mixed = F.xxhash64(*columns)
    last = (1 << bits) - 1
    places = F.array(mixed.bitwiseAND(last), F.shiftright(mixed, 32).bitwiseAND(last))
    place = keys.select(F.explode(places).alias("at"))
    words = place.groupBy(F.shiftright("at", _WORD).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, int(at & {(1 << _WORD) - 1}))")).alias("held")
    )
    found = words.toArrow()
    out = np.zeros(1 << (bits - _WORD), np.uint64)
    out[found["word"].to_numpy()] = found["held"].to_numpy().view(np.uint64)
    return out


def may_be_known(rows: DataFrame, words: np.ndarray, columns: Sequence[Column | str]) -> Column:
    """True for every row whose columns are a key, and for a few others."""
    shared = rows.sparkSession.sparkContext.broadcast(words)

    @F.arrow_udf(T.BooleanType())
    def known(keys: pa.Array) -> pa.Array:
        held = shared.value
        mixed = keys.to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.ones(len(mixed), bool)
        for at in (mixed, mixed >> 32):
            at = at & (len(held) * 64 - 1)
            out &= (held[at >> _WORD] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        return pa.array(out)

    return known(F.xxhash64(*columns))


def split_by_keys(rows: DataFrame, keys: DataFrame, columns: Sequence[Column | str]) -> tuple[DataFrame, DataFrame]:
    """``(rows that can be among the keys, rows that cannot)``.

    ``keys`` has the key's columns in the order of ``columns`` and of the same types, and
    should be a written table: it is read here.
    """
    known = may_be_known(rows, known_keys(keys, keys.columns), columns)
    return rows.where(known), rows.where(~known)
