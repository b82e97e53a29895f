from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import chunkwell as cw
from chunkwell.functions.text import BLANKS, check_window_sizes, is_blank, strip


def brute_windows(text: str, size: int, overlap: int) -> list[str]:
    starts = range(0, max(len(text) - 1 - overlap, 0) + 1, size - overlap)
    return [text[s : s + size] for s in starts] if text else []


def test_strip_is_the_language_rule(spark):
    samples = [BLANKS + "a b" + BLANKS, "​a​", "", BLANKS, "x", "﻿x", "a b"]
    rows = spark.createDataFrame([(s,) for s in samples], "t string")
    got = [r.s for r in rows.select(strip(F.col("t")).alias("s")).collect()]
    assert got == [s.strip() for s in samples]
    blanks = rows.select(is_blank(F.col("t")).alias("b")).collect()
    assert [r.b for r in blanks] == [not s.strip() for s in samples]


@pytest.mark.parametrize("size,overlap", [(10, 0), (10, 3), (10, 9), (1, 0), (1000, 200)])
def test_windows(spark, size, overlap):
    rng = random.Random(size * 31 + overlap)
    alphabet = "ab\n\f é \U0001f600\U0001d54f"
    samples = ["", "a", "a" * 1000, "b" * 1001, "c" * 1800, "d" * 1801, "\U0001f600a" * 700]
    samples += ["".join(rng.choices(alphabet, k=n)) for n in (9, 10, 11, 12, 13, 20, 47, 2500)]
    rows = spark.createDataFrame(list(enumerate(samples)), "i int, content string")
    got = cw.chunk_windows(rows, size, overlap).orderBy("i", "chunk_index").collect()
    for i, text in enumerate(samples):
        mine = [r.content for r in got if r.i == i]
        assert mine == brute_windows(text, size, overlap)
        # windows without their overlaps give the text back
        assert "".join([w if n == 0 else w[overlap:] for n, w in enumerate(mine)]) == text


def test_window_sizes_may_be_columns(spark):
    rows = spark.createDataFrame(
        [("contracts", "x" * 2000), ("reports", "y" * 2000), (None, "z" * 2000)],
        "document_type string, content string",
    )
    sized = cw.chunk_params_by_type(rows)
    chunks = cw.chunk_windows(sized, F.col("max_chunk_size"), F.col("chunk_overlap"))
    longest = {
        r.document_type: (r.n, r.k)
        for r in chunks.groupBy("document_type")
        .agg(F.max(F.length("content")).alias("n"), F.count("*").alias("k"))
        .collect()
    }
    assert longest == {
        kind: (size, len(brute_windows("x" * 2000, size, overlap)))
        for kind, (size, overlap) in {
            "contracts": (800, 100), "reports": (600, 75), None: (400, 50)
        }.items()
    }


@pytest.mark.parametrize("size,overlap", [(0, 0), (10, 10), (10, -1), (10, 11)])
def test_bad_sizes(size, overlap):
    with pytest.raises(ValueError):
        check_window_sizes(size, overlap)


def test_very_long_text_stays_linear(spark):
    text = "word " * 400_000
    rows = spark.createDataFrame([(text,)], "content string")
    assert cw.chunk_windows(rows, 1000, 200).count() == len(brute_windows(text, 1000, 200))
