"""Fingerprints, successors and the Hamming search against brute force."""

from __future__ import annotations

import hashlib
import random

from chunkwell.llm import simhash
from chunkwell.llm.queries import REGISTRY

SMALL = "/root/testdata/sf0.001"


def apart(a, b):
    return bin((a ^ b) & (2**64 - 1)).count("1")


def check(got, rows):
    rows = sorted(rows, key=lambda r: r[0])
    for (key, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        text, following = text or "", following or ""
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + following[:quarter]
        r = got[key]
        assert r.n_chars == len(text)
        assert r.edited == hashlib.sha256(edited.encode()).hexdigest()
        marks = [simhash.fingerprint(t) for t in (text, edited, following)]
        assert [r.fingerprint, r.edited_fingerprint, r.next_fingerprint] == marks


def test_successors_over_many_ranges(spark):
    rng = random.Random(3)
    rows = [(k * 7 - 50, "".join(rng.choice("abc é😀") for _ in range(rng.choice([0, 1, 3, 9, 200])))) for k in range(60)]
    rows += [(10_000, None), (10_001, "x" * 600_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumnRenamed("n", "n")
    docs = docs.selectExpr("doc_id", "text", "1 AS fingerprint", "'z' AS task").repartition(3)
    for partitions in (1, 4, 90):
        got = {r.id: r for r in simhash.fingerprints(docs, partitions).collect()}
        check(got, rows)
    assert simhash.fingerprints(docs.limit(0)).collect() == []
    one = simhash.fingerprints(docs.where("doc_id = 10001")).collect()
    assert one[0].fingerprint == one[0].edited_fingerprint == one[0].next_fingerprint


def test_search_finds_all_within_the_radius(spark):
    rng = random.Random(5)
    marks = {rng.getrandbits(64) - 2**63 for _ in range(150)}
    for m in list(marks)[:60]:
        for _ in range(3):
            near = m
            for _ in range(rng.randrange(1, 6)):
                bit = rng.randrange(64)
                near ^= -(1 << 63) if bit == 63 else 1 << bit
            marks.add(near)
    table = spark.createDataFrame([(m, 2) for m in marks], "fingerprint bigint, copies bigint")
    asked = table.select("fingerprint").limit(80)
    for radius, blocks in ((3, 6), (3, 4), (0, 1), (2, 5)):
        got = {r.fingerprint: r.n_near for r in simhash.near_fingerprints(asked, table, radius, blocks).collect()}
        assert got == {q: 2 * sum(apart(q, m) <= radius for m in marks) for q in got}
        assert len(got) == 80


def test_query(spark):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: r for r in REGISTRY["op3_simhash"](spark, SMALL).collect()}
    assert len(got) == len(rows)
    marks = {k: simhash.fingerprint(t) for k, t in rows.items()}
    for k, r in got.items():
        assert r.fingerprint == f"{marks[k] & (2**64 - 1):016x}"
        if k % 100 == 0:
            assert r.n_near == sum(apart(marks[k], m) <= 3 for m in marks.values())
        else:
            assert r.n_near is None
    better = sum(r.near_edited > r.near_next for r in got.values() if rows[r.doc_id])
    assert better > 0.97 * len(got)
