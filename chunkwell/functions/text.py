"""Column expressions over text. Lengths count code points throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that count as blank when a text is stripped.
BLANK_CODE_POINTS = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0,
    0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007,
    0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
BLANKS = "".join(map(chr, BLANK_CODE_POINTS))


def as_column(value: Column | str | int | float) -> Column:
    """A Column as it is, a plain Python value as a literal."""
    return value if isinstance(value, Column) else F.lit(value)


def strip(text: Column) -> Column:
    """Remove blanks at both ends in one pass, Unicode blanks included."""
    return F.btrim(text, F.lit(BLANKS))


def is_blank(text: Column) -> Column:
    """True for NULL and for texts that are empty once stripped."""
    return F.coalesce(strip(text) == "", F.lit(True))


def sliding_windows(
    text: Column, size: Column | int, overlap: Column | int
) -> Column:
    """Windows of ``size`` characters, each sharing ``overlap`` with the last.

    One pass of a regular expression: every match consumes ``size - overlap``
    characters while a look-ahead captures the whole window. Past the start
    a window must hold more than the overlap, else it would repeat text only.
    Cost is linear in the text, which repeated ``substring`` calls are not.
    """
    from_data = isinstance(size, Column) or isinstance(overlap, Column)
    size, overlap = as_column(size), as_column(overlap)
    pattern = F.concat(
        F.lit(r"(?s)(?=(\A.{1,"),
        size.cast("string"),
        F.lit("}|.{"),
        (overlap + 1).cast("string"),
        F.lit(","),
        size.cast("string"),
        F.lit("})).{1,"),
        (size - overlap).cast("string"),
        F.lit("}"),
    )
    found = F.regexp_extract_all(text, pattern, 1)
    if not from_data:
        return found
    fine = F.coalesce((size >= 1) & (overlap >= 0) & (overlap < size), F.lit(False))
    wrong = F.raise_error(F.lit("window sizes need 0 <= overlap < size, not NULL"))
    return F.when(fine, found).otherwise(wrong.cast("array<string>"))


def check_window_sizes(size: Column | int, overlap: Column | int) -> None:
    """``0 <= overlap < size`` for plain numbers; columns are data."""
    if isinstance(size, Column) or isinstance(overlap, Column):
        return
    if size < 1:
        raise ValueError("max_chunk_size must be at least 1")
    if not 0 <= overlap < size:
        raise ValueError("chunk_overlap must be at least 0 and below max_chunk_size")
