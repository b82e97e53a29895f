"""The stages over small tables, their columns and decisions, and odd rows."""

from __future__ import annotations

import re

import corpus_pipeline
from chunkwell.llm import decontaminate, pii
from tests.llm.test_ngram_join import brute

SMALL = "/root/testdata/sf0.001"


def stage(name, spark, docs, sf_dir=SMALL):
    return dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir)


def test_stages_follow_one_another(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    index = decontaminate.make_index(items)
    for k, (name, fn) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = fn(spark, docs, SMALL)
        rows = out.collect()
        if k < 4:
            assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
            kept = {r.doc_id: r for r in rows}
            assert len(kept) == len(rows)
        if k == 0:
            assert set(kept) == {d for d, r in before.items() if re.search(r"[^\W\d_]", r.text)}
        if k == 1:
            wanted = {c for _, _, c in brute([(d, r.text) for d, r in before.items()])}
            assert set(kept) == wanted
        if k == 2:
            assert set(kept) == {d for d, r in before.items() if not decontaminate.leaks(r.text, index)}
            assert len(kept) < len(before)
        if k == 3:
            assert set(kept) == set(before)
            auto = pii.anchors()
            assert not any(s[0] in ("email", "phone") for r in rows for s in pii.find_spans(r.text, auto))
            assert all(r.n_chars == len(r.text) for r in rows)
        if k == 4:
            assert {r.doc_id for r in rows} <= set(before)
            places = [r.position for r in rows]
            assert places == sorted(places) and 0 <= places[0] and places[-1] <= 1
            size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for d, r in before.items()}
            assert sum(r.taken_words for r in rows) <= sum(size.values())
            assert sum(r.taken_words for r in rows) >= sum(size.values()) - 20
        docs = out


def test_run_gives_the_mix(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == ["doc_id", "source", "copy", "taken_words", "position"]
    assert out.count() > 0


def test_odd_rows(spark):
    text = " ".join(f"word{i}x" for i in range(60))
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (None, text, "en", None), (2, None, None, None), (3, "", "en", "a"),
            (4, "12 34 !!", "en", "a"), (5, "a@b.co " + text[::-1], None, "b"), (6, "x" * 400_000, "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    docs = docs.selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as bigint) AS n_chars")
    kept = stage("language ID", spark, docs).collect()
    assert sorted((r.doc_id or 0) for r in kept)[:3] == [0, 1, 1] and not {2, 3, 4} & {r.doc_id for r in kept}
    single = stage("n-gram Jaccard join", spark, docs).collect()
    assert sorted((r.doc_id or 0) for r in single) == [1, 2, 3, 4, 5, 6]
    assert stage("benchmark decontamination", spark, docs).count() == 8
    assert stage("PII", spark, docs).count() == 8
    empty = docs.limit(0)
    for name, _ in corpus_pipeline.STAGES:
        assert stage(name, spark, empty).collect() == []
