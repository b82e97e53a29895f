from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkwell.llm import resampling
from chunkwell.llm.ranks import ranked

DOCS = "doc_id bigint, text string"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def _features(text, longest=1):
    words = WORD.findall((text or "").translate(UPPER))
    return [" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]


def _brute(docs, target, percent=10, least=20, longest=1):
    def bucket(feature):
        return crc32(feature.encode()) % 10_000

    bags = [(id_, [bucket(f) for f in _features(text, longest)]) for id_, text in docs]
    corpus = Counter(b for _, bag in bags for b in bag)
    wanted = Counter(bucket(f) for text in target for f in _features(text, longest))
    s_all, t_all = sum(corpus.values()), sum(wanted.values())

    def gain(b):
        return math.floor(1000 * math.log((wanted[b] + 1) * (s_all + 10_000) / ((corpus[b] + 1) * (t_all + 10_000))))

    rows = []
    for id_, bag in bags:
        weight = sum(map(gain, bag)) // len(bag) if bag else 0
        h = int(hashlib.sha256(f"2024:{'' if id_ is None else id_}".encode()).hexdigest()[:8], 16)
        rows.append((id_, len(bag), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = {}
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        drawn.setdefault(r, []).append(place)
    return sorted(((*r, drawn[r].pop(0) if drawn.get(r) else None) for r in rows), key=str)


def _rows(seed, n=400):
    rng = random.Random(seed)
    words = [f"word{k}" for k in range(300)] + ["Größe", "日本", "A1", "it's"]
    return [(k, rng.choice([None, "", *[" ".join(rng.choices(words, k=rng.randrange(80)))] * 20])) for k in range(n)]


TARGET = ["word1 word2 Größe word3", "word4 word1 A1", None, ""]


def _draw(spark, rows, target=TARGET, **options):
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    asked = spark.createDataFrame([(t,) for t in target], "text string")
    return sorted(map(tuple, resampling.resample(docs, asked, **options).collect()), key=str)


def test_same_as_brute_force(spark):
    assert _draw(spark, _rows(1)) == _brute(_rows(1), TARGET)


def test_longer_features_share_and_bound(spark):
    options = {"percent": 33, "longest": 3}
    wanted = _brute(_rows(2), TARGET, 33, 5, 3)
    assert _draw(spark, _rows(2), least_features=5, **options) == wanted


def test_long_texts_give_the_same_features(spark, monkeypatch):
    text = " ".join(f"W{k % 700}x" for k in range(250_000))
    rows = [*_rows(3, 60), (1_000, text), (1_001, "y" * 2_000_000)]
    assert _draw(spark, rows, longest=2) == _brute(rows, TARGET, longest=2)


def test_null_ids_ties_and_repeated_rows(spark):
    text = " ".join(["word1"] * 25)
    rows = [(7, text)] * 40 + [(None, text)] * 20 + _rows(4, 100)
    for percent in (20, 50, 100):
        assert _draw(spark, rows, percent=percent) == _brute(rows, TARGET, percent)


def test_empty_tables_and_clashing_names(spark):
    assert _draw(spark, []) == []
    assert _draw(spark, _rows(5), target=[]) == _brute(_rows(5), [])
    short = [(k, "too short") for k in range(30)]
    assert all(r[4] is None for r in _draw(spark, short))
    docs = spark.createDataFrame(_rows(6), DOCS)
    clash = docs.withColumns({c: F.lit("x") for c in ("id", "row", "score", "rank", "weight", "n_features")})
    asked = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = sorted(map(tuple, resampling.resample(clash, asked).collect()), key=str)
    assert got == _brute(_rows(6), TARGET)


@pytest.mark.parametrize("accuracy", [2, 10, 1_000])
def test_the_bracket_is_widened_until_it_holds_the_cutoff(spark, accuracy):
    rng = np.random.default_rng(accuracy)
    scores = np.concatenate([rng.normal(0, 1_000, 3_000), np.full(2_000, 17)]).astype(int).tolist()
    scored = spark.createDataFrame([(k, s, k) for k, s in enumerate(scores)], "id bigint, score bigint, row bigint")
    order = sorted(range(len(scores)), key=lambda k: (-scores[k], k))
    for wanted in (1, 2, 777, 2_500, 4_999, 5_000):
        assert resampling.cutoff(scored, wanted, accuracy)["id"] == order[wanted - 1]
    assert resampling.cutoff(scored, 0) is None


def test_ranks_of_many_ranges(spark):
    rows = spark.range(10_000).select("id", (F.col("id") * 7919 % 101).alias("v")).repartition(9)
    got = ranked(rows, F.desc("v"), "id").collect()
    wanted = sorted(((r.id, r.v) for r in got), key=lambda x: (-x[1], x[0]))
    assert {(r.id, r.v): r["rank"] for r in got} == {x: k for k, x in enumerate(wanted, 1)}
