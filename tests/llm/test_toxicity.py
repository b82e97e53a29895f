"""Segments against brute force; held-out accuracy; odd rows."""

from __future__ import annotations

import random

import pytest

from chunkwell.llm import toxicity
from chunkwell.llm.queries import REGISTRY

MEDIUM = "/root/testdata/sf0.1"
SMALL = "/root/testdata/sf0.001"


def maximal(scores):
    """All maximal scoring runs of a list, by definition: the best one, then each side of it."""
    best = max(
        ((sum(scores[i:j]), -(j - i), -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)),
        default=(0,),
    )
    if best[0] <= 0:
        return []
    i, j = -best[2], -best[2] - best[1]
    right = [(s, a + j, b + j) for s, a, b in maximal(scores[j:])]
    return maximal(scores[:i]) + [(best[0], i, j - 1)] + right


def test_segments_are_all_maximal_ones():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randrange(1, 24)
        scores = [rng.choice([-1, -1, -1, 2, 3.5]) for _ in range(n)]
        got = toxicity.segments([(i, s) for i, s in enumerate(scores) if s > 0], -1)
        # a run of sum 0 may or may not be joined to a maximal one: compare the sums
        assert sorted(round(s, 6) for s, _, _ in got) == sorted(round(s, 6) for s, _, _ in maximal(scores))


def test_chance_rate_solves_its_equation():
    import math

    rate, scale = toxicity.chance_rate({4.0: 9, 6.0: 1}, 10_000, {"a": 4.0})
    total = 10_000 + 11
    mean = (10 * math.exp(4 * rate) + math.exp(6 * rate)) / total + (1 - 11 / total) * math.exp(rate * toxicity.DRIFT)
    assert abs(mean - 1) < 1e-6 and abs(scale - 11 / total) < 1e-12


@pytest.fixture(scope="module")
def scored(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    return labels, REGISTRY["op2_toxicity"](spark, MEDIUM).collect()


def test_held_out_accuracy(scored):
    import zlib

    labels, rows = scored
    assert len(rows) == 10_000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    better = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert better > 0.95
    assert sum(s >= 0.7 for s in neg) < 0.02 * len(neg)
    assert sum(s >= 0.7 for s in pos) > 0.8 * len(pos)


def test_odd_rows(spark):
    words = "the quick brown fox jumps over lazy dogs again"
    bad = [(f"{words} you utter scumbag {i}", 1) for i in range(30)]
    good = [(f"{words} dear friend of mine {i}", 0) for i in range(90)]
    labelled = spark.createDataFrame(bad + good + [("x", None), (None, 0)], "text string, toxic int")
    model = toxicity.fit_toxicity(labelled)
    rows = [(1, None), (2, ""), (2, ""), (None, "scumbag"), (4, "a " * 300_000 + "scumbag"), (5, "%%% 123")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS score", "2 AS id")
    got = [(r.id, r.score, len(r.passages)) for r in toxicity.score_toxicity(docs, model).collect()]
    score = {k: (s, n) for k, s, n in got}
    assert len(got) == 6 and score[1] == score[2] == score[5]
    assert score[None][1] == 1 and score[None][0] > score[1][0]
    assert toxicity.score_toxicity(docs.limit(0), model).collect() == []
    flat = toxicity.fit_toxicity(labelled.limit(0))
    assert {r.score for r in toxicity.score_toxicity(docs, flat).collect()} == {toxicity._probability(flat, 0.0)}


@pytest.mark.parametrize("share", [0.05, 0.12, 0.3, 0.5])
def test_any_share_of_toxic_labels(spark, share):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text")
    rows = docs.join(spark.read.parquet(f"{MEDIUM}/labels.parquet"), "doc_id").orderBy("doc_id").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    n = min(len(toxic) / share, len(clean) / (1 - share))
    mixed = toxic[: int(n * share)] + clean[: int(n * (1 - share))]
    kept = spark.createDataFrame([(r.doc_id, r.text, r.toxic) for r in mixed], "doc_id bigint, text string, toxic int")
    model = toxicity.fit_toxicity(kept.where("doc_id % 3 != 1"))
    held = kept.where("doc_id % 3 = 1")
    labels = {r.doc_id: r.toxic for r in held.collect()}
    found = {r.id: r.score >= 0.7 for r in toxicity.score_toxicity(held, model).collect()}
    caught = [found[d] for d, y in labels.items() if y]
    alarms = [found[d] for d, y in labels.items() if not y]
    assert sum(caught) >= 0.75 * len(caught), (sum(caught), len(caught))
    assert sum(alarms) <= 0.03 * len(alarms), (sum(alarms), len(alarms))
