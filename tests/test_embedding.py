from __future__ import annotations

import sys
from hashlib import md5

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.errors import PythonException
from pyspark.sql import functions as F

import chunkwell as cw
from chunkwell.functions.hashing import TOKEN, hashed_model

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers lack the tests


def lengths(texts):
    return [[float(len(t)), float(len(texts))] for t in texts]


def test_batches_are_split_and_order_kept(spark):
    rows = spark.createDataFrame([(i, "x" * (i + 1)) for i in range(5)], "i int, content string")
    got = cw.embed_texts(rows.coalesce(1), lengths, batch_size=2).orderBy("i").collect()
    assert [r.embedding for r in got] == [[1, 2], [2, 2], [3, 2], [4, 2], [5, 1]]


def test_blank_texts_never_shift_their_neighbours(spark):
    rows = spark.createDataFrame(
        [(0, "valid"), (1, ""), (2, "  　 "), (3, None), (4, " other ")], "i int, content string"
    ).coalesce(1)
    got = {r.i: r.embedding for r in cw.embed_texts(rows, lengths).collect()}
    assert got == {0: [5, 2], 4: [5, 2]}
    kept = {r.i: r.embedding for r in cw.embed_texts(rows, lengths, keep_blank=True).collect()}
    assert kept == {**got, 1: None, 2: None, 3: None}


def test_texts_are_stripped_and_cut(spark):
    rows = spark.createDataFrame([(" " + "a" * 9000,), ("\n",)], "content string")
    assert [len(r.content) for r in cw.clean_texts(rows).collect()] == [8000]
    assert cw.embed_texts(rows, lengths).head().embedding == [9000, 1]
    assert cw.embed_texts(rows, lengths, max_chars=8000).head().embedding == [8000, 1]


def test_queries(spark):
    rows = spark.createDataFrame([(1, "test text"), (2, " "), (3, None)], "query_id int, query_text string")
    got = {r.query_id: r.embedding for r in cw.embed_queries(rows, lengths).collect()}
    assert got == {1: [9, 1], 2: [], 3: []}


def test_model_is_loaded_once_per_task_and_called_once_per_row(spark, plan_of):
    def factory():
        calls = {"loads": 0}
        calls["loads"] += 1

        def model(texts):
            return [[float(calls["loads"])] for _ in texts]

        return model

    rows = spark.createDataFrame([(str(i),) for i in range(50)], "content string").coalesce(1)
    embedded = cw.embed_texts(rows, factory=factory, batch_size=7)
    assert {r.embedding[0] for r in embedded.collect()} == {1.0}
    # a filter on the vectors does not run the model a second time, a count not at all
    assert plan_of(embedded.where(F.size("embedding") > 0)).count("ArrowEvalPython") == 1
    assert "ArrowEvalPython" not in plan_of(embedded.groupBy().count())


def test_wrong_number_of_results_is_an_error(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "content string").coalesce(1)
    with pytest.raises(PythonException, match="returned 1 results for 2 texts"):
        cw.embed_texts(rows, lambda texts: [[1.0]]).collect()


@pytest.mark.parametrize("options", [{}, {"fn": lengths, "factory": lambda: lengths}])
def test_exactly_one_model(spark, options):
    rows = spark.createDataFrame([("a",)], "content string")
    with pytest.raises(ValueError):
        cw.embed_texts(rows, **options)
    with pytest.raises(ValueError):
        cw.embed_texts(rows, lengths, batch_size=0)


def brute_hashed(text, dims):
    sums = np.zeros(dims)
    for token in TOKEN.findall(text.lower()):
        digest = md5(token.encode()).hexdigest()
        sums[int(digest[:6], 16) % dims] += 1 if int(digest[6], 16) < 8 else -1
    norm = np.linalg.norm(sums)
    return None if norm == 0 else (sums / norm).astype(np.float32)


def test_hashed_model():
    texts = ["The cat, the CAT!", "ünïcode über_all 42", "...", "", "a a a b"]
    for text, vector in zip(texts, hashed_model(32)(texts)):
        wanted = brute_hashed(text, 32)
        assert (vector is None) == (wanted is None)
        if wanted is not None:
            assert (vector == wanted).all()
    with pytest.raises(ValueError):
        hashed_model(0)


def test_tokens_are_those_of_the_unicode_classes(spark):
    """Letters and numbers of any script, as ``[^\\p{L}\\p{N}]+`` separates them."""
    text = "Ärger—naïve_2 日本語 १२३ x² ½ áb Ⅷ it's"
    rows = spark.createDataFrame([(text,)], "t string")
    parts = rows.select(F.split(F.lower("t"), r"[^\p{L}\p{N}]+").alias("p")).head().p
    assert TOKEN.findall(text.lower()) == [p for p in parts if p]


def test_validate(spark):
    chunks = spark.createDataFrame([(i,) for i in range(5)], "chunk_id int")
    vectors = spark.createDataFrame(
        [(0, [1.0, 2.0]), (1, [1.0]), (2, None), (3, [1.0]), (3, [3.0, 4.0])],
        "chunk_id int, embedding array<float>",
    )
    got = {r.chunk_id: r.problem for r in cw.validate_embeddings(chunks, vectors, dims=2).collect()}
    assert got == {1: "wrong width", 2: "no embedding", 4: "no embedding"}
    with pytest.raises(Exception, match="embedding check failed"):
        cw.validate_embeddings(chunks, vectors, dims=2, strict=True).collect()
    ok = cw.validate_embeddings(chunks.where("chunk_id = 0"), vectors, dims=2, strict=True)
    assert ok.count() == 0


def test_strict_fails_under_any_action_and_flat_vectors_are_reported(spark):
    chunks = spark.createDataFrame([(k,) for k in range(5)], "chunk_id int")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0])]
    vectors = spark.createDataFrame(rows, "chunk_id int, embedding array<float>")
    got = {r.chunk_id: r.problem for r in cw.validate_embeddings(chunks, vectors).collect()}
    flat = "zero or not finite"
    assert got == {1: flat, 2: flat, 3: flat, 4: "no embedding"}
    with pytest.raises(Exception, match="embedding check failed"):
        cw.validate_embeddings(chunks, vectors, strict=True).count()
