"""Runs of wanted bytes in texts, in lists of bounded length."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa

#: Texts of more bytes are read in several lists.
WHOLE_BYTES = 1 << 20
LIST_ITEMS = 100_000


def folded(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of a text column with A-Z lower-cased; NULL is the empty text."""
    for value in column.cast(pa.binary()):
        yield (value.as_py() or b"").lower()  # bytes.lower() folds A-Z only


def runs(pattern: re.Pattern, data: bytes) -> Iterator[list[bytes]]:
    """All matches in order; a long text gives several lists, an empty one none.

    The separators of the patterns used here are single bytes below 0x80, so scanning
    bytes finds what scanning code points would.
    """
    if len(data) <= WHOLE_BYTES:
        if found := pattern.findall(data):
            yield found
        return
    matches = pattern.finditer(data)
    while part := [m[0] for m in islice(matches, LIST_ITEMS)]:
        yield part
