"""Repeated passages against brute force over all runs of words."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest

from chunkwell.llm import sparse_suffix

SMALL = "/root/testdata/sf0.001"


def brute(rows, least):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    owners = defaultdict(set)
    for k, w in enumerate(words):
        for i in range(len(w) - least + 1):
            owners[tuple(w[i : i + least])].add(k)
    out = []
    for k, w in enumerate(words):
        hit = [False] * len(w)
        for i in range(len(w) - least + 1):
            if len(owners[tuple(w[i : i + least])]) > 1:
                hit[i : i + least] = [True] * least
        spans = [m.span() for m in re.finditer("1+", "".join("01"[h] for h in hit))]
        out.append((rows[k][0], len(w), sum(hit), spans))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.id, r.n_words, r.n_repeated, [tuple(s) for s in r.spans]) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_spans_are_those_of_all_runs(spark, monkeypatch, seed):
    if seed == 2:
        monkeypatch.setattr(sparse_suffix, "LOCAL_COUNT", 3)
        monkeypatch.setattr(sparse_suffix, "SALT", 3)
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "a", "A"]

    def words(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    passages = [words(n) for n in (20, 24, 25, 26, 31, 40, 70, 200)]
    rows = []
    for d in range(120):
        text = words(rng.choice([0, 5, 40, 100]))
        for _ in range(rng.choice([0, 1, 1, 2])):
            p = rng.choice(passages)
            cut = rng.choice([0, 0, 3])
            text += p[cut:] + words(rng.choice([0, 1, 12]))
        rows.append((d, rng.choice([" ", "\n "]).join(text)))
    # touching passages that two different texts share with a third
    rows += [(500, None), (501, ""), (502, rows[7][1]), (7, rows[7][1]), (None, rows[8][1]), (503, " ".join(["x"] * 300))]
    rows += [(504, " ".join(passages[6][:30] + passages[7][:30])), (505, "z " + " ".join(["x"] * 60))]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id bigint, text string, tid int, n_words int")
    docs = docs.repartition(3)
    # whole copies repeat as a whole, also if a text has another copy of the same run inside
    assert got(sparse_suffix.repeated_passages(docs, 25)) == brute(rows, 25)


def test_runs_salted_in_one_text_only(spark, monkeypatch):
    monkeypatch.setattr(sparse_suffix, "LOCAL_COUNT", 3)
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(5000)]

    def words(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    rows = []
    for k in range(40):
        often, tail = words(rng.randrange(40, 50)), words(rng.randrange(10, 30))
        for _ in range(5):
            rows.append((len(rows), " ".join(words(20) + often + words(20))))
        for _ in range(2):
            rows.append((len(rows), " ".join(words(rng.choice([0, 1, 20])) + often + tail)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(1)
    assert got(sparse_suffix.repeated_passages(docs, 50)) == brute(rows, 50)


def test_query_and_empty_table(spark):
    from chunkwell.llm.queries import REGISTRY

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    found = REGISTRY["op10_sparse_suffix"](spark, SMALL).collect()
    wanted = [(d, n, k, ",".join(f"{a}:{b}" for a, b in s)) for d, n, k, s in brute(rows, 50)]
    assert sorted((r.doc_id, r.n_words, r.n_repeated, r.spans) for r in found) == sorted(wanted)
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert sparse_suffix.repeated_passages(empty).collect() == []


def test_cutting():
    assert sparse_suffix.without_spans("a  b c\nd e", [(1, 3)]) == "a  d e"
    assert sparse_suffix.without_spans("a b", [(0, 2)]) == ""
    assert sparse_suffix.without_spans("a b", []) == "a b"
