from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from chunkwell.llm import divergence

DOCS = "doc_id bigint, lang string, source string, text string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def _brute(rows, least=3, ranks=200):
    docs = [(lang or "", source or "", Counter(TERM.findall((text or "").translate(UPPER)))) for _, lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in d[2])
        kept = sorted(t for t in df if df[t] >= least)
        sources = sorted({d[1] for d in mine})
        counts = defaultdict(Counter)
        for _, source, terms in mine:
            counts[source].update({t: n for t, n in terms.items() if df[t] >= least})
        counts_all = sum(counts.values(), Counter())

        def shares(held):
            n = sum(held.values())
            return {t: 1 + 10**9 * (held[t] + 1) // (n + len(kept)) for t in kept}

        p = {s: shares(counts[s]) for s in sources}
        q = shares(counts_all)
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, ranks)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items)]
    return sorted(out)


def _rows(seed, n=300, sources=("a", "b", "ü", "", None)):
    rng = random.Random(seed)
    words = ["Haus", "haus", "ÄRGER", "ärger", "x1y", "tree", "é", "日本", "a-b", "it's", "Zoo"] + [f"w{chr(97 + k)}" for k in range(26)]
    rows = []
    for k in range(n):
        text = " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=rng.randrange(30)))
        rows.append((k, rng.choice(["en", "de", None]), rng.choice(sources), rng.choice([text, text, text, None, ""])))
    return rows


def _found(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


def test_same_as_brute_force(spark):
    rows = _rows(1)
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    assert _found(divergence.source_divergence(docs)) == _brute(rows)


def test_spills_blocks_and_small_batches(spark, monkeypatch):
    rows = _rows(2, 400, sources=[f"s{k:02}" for k in range(23)])
    wanted = _brute(rows, ranks=3)
    for name, value in (("SPILL_ENTRIES", 7), ("BATCH_STRIPES", 5), ("BLOCK_SOURCES", 4), ("CELLS", 50), ("HELD_PAIRS", 2)):
        monkeypatch.setattr(divergence, name, value)
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    assert _found(divergence.source_divergence(docs, ranks=3)) == wanted


def test_stripes_are_merged_whole(spark):
    rows = [(k, "en", f"s{k % 3}", "the The tree") for k in range(30)] + [(99, "en", "s0", "tree")]
    stripes = divergence.term_stripes(spark.createDataFrame(rows, DOCS).repartition(7)).collect()
    got = {r.term: (r.n_docs, dict(zip(r.sources, r.counts))) for r in stripes}
    assert got == {b"the": (30, {"s0": 20, "s1": 20, "s2": 20}), b"tree": (31, {"s0": 11, "s1": 10, "s2": 10})}


def test_shares_are_exact_beyond_64_bits():
    count, total = np.array([1, 3 * 10**12, 10**13]), 10**13 + 7
    assert divergence.share(count, total).tolist() == [1 + 10**9 * int(c) // total for c in count]
    assert divergence.share(np.array([8]), 8).tolist() == [1 + 10**9]


def test_nothing_kept_empty_and_clashing(spark):
    rows = [(1, "en", "a", "one"), (2, "en", "b", None), (3, "de", None, "")]
    docs = spark.createDataFrame(rows, DOCS)
    assert _found(divergence.source_divergence(docs)) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert _found(divergence.source_divergence(docs.limit(0))) == []
    rows = _rows(3, 60)
    clash = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(c) for c in ("n", "term", "i", "value", "block", "salt")})
    assert _found(divergence.source_divergence(clash)) == _brute(rows)


def test_repeated_rows_and_a_hot_source(spark):
    rows = _rows(4, 60) * 3 + [(k, "en", "hot", f"the same text with {'abcdefg'[k % 7]} tree") for k in range(200)]
    docs = spark.createDataFrame(rows, DOCS).repartition(6)
    assert _found(divergence.source_divergence(docs)) == _brute(rows)


def test_very_long_text(spark):
    rows = [(1, "en", "a", "tree Haus " * 150_000), (2, "en", "b", "tree"), (3, "en", "b", "tree Haus"), (4, "en", "a", "haus")]
    assert _found(divergence.source_divergence(spark.createDataFrame(rows, DOCS))) == _brute(rows)
