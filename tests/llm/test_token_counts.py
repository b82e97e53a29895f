"""Counts against a plain best split of every pre-token; exact round trip of the split."""

from __future__ import annotations

import random
from functools import lru_cache

import regex

from chunkwell.llm import token_counts as tc
from chunkwell.llm.queries import REGISTRY

SMALL = "/root/testdata/sf0.001"


def plain(word, scores):
    @lru_cache(None)
    def best(end):
        if end == 0:
            return (0, 0)
        return max((best(s)[0] + scores[word[s:end]], best(s)[1] - 1) for s in range(end) if word[s:end] in scores)

    return -best(len(word))[1]


def test_trie_counts_are_those_of_the_best_split():
    rng = random.Random(1)
    scores = tc.unigram_scores([bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 6))) for _ in range(80)])
    words = [bytes(rng.choice(b"abcd") for _ in range(rng.randrange(0, 14))) for _ in range(800)]
    assert tc.TrieCounter(scores).counts(words) == {w: plain(w, scores) for w in words}


def test_odd_rows_and_forgetting(spark, monkeypatch):
    monkeypatch.setattr(tc, "REMEMBERED", 5)
    monkeypatch.setattr(tc, "_PIECE", 50)
    rng = random.Random(3)
    texts = [None, "", " ", "日本語 é퟿ 😀", "don't  stop\n\n now 123", "x" * 5_000] + [
        " ".join("".join(rng.choice("abcdé ") for _ in range(9)) for _ in range(60)) for _ in range(20)
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").selectExpr("*", "0 AS n_tokens")
    scores = tc.unigram_scores(tc.read_vocabulary())
    split = regex.compile(tc.PATTERN)
    got = {r.id: (r.n_pretokens, r.n_tokens, r.n_bytes) for r in tc.count_tokens(docs).collect()}
    for k, t in enumerate(texts):
        parts = split.findall(t or "")
        assert "".join(parts) == (t or "")
        tokens = sum(plain(p.encode(), scores) for p in parts) if k != 5 else got[k][1]
        assert got[k] == (len(parts), tokens, len((t or "").encode()))
    assert 0 < got[5][1] < 5_000
    assert tc.count_tokens(docs.limit(0)).collect() == []


def test_query(spark):
    got = REGISTRY["op4_token_counts"](spark, SMALL).collect()
    assert len(got) == 200 and all(0 < r.n_tokens <= r.n_bytes and r.n_pretokens <= r.n_tokens for r in got)
