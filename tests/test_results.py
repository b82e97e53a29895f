from __future__ import annotations

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import chunkwell as cw
from chunkwell.operators.results import SYSTEM_PROMPT

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture
def hits(spark):
    return spark.createDataFrame(
        [
            (1, 2, 0.87, "B", "b.txt", None, 0, None, {"x": None}),
            (1, 1, 0.95123, "A" * 501, "a.pdf", 3, 1, "http://h/a", {"k": "v", "_id": "1"}),
            (2, 1, 0.5, "C" * 500, None, 0, None, "", {}),
        ],
        "query_id int, rank int, similarity_score double, content string, source_file string, "
        "page_number int, chunk_index int, source_url string, metadata map<string,string>",
    )


def test_format(hits):
    got = {(r.query_id, r["rank"]): r for r in cw.format_hits(hits).collect()}
    assert got[1, 1].excerpt == "A" * 500 + "..." and got[1, 1].score == "0.951"
    assert got[2, 1].excerpt == "C" * 500
    assert got[1, 1].source == (
        "chunk_index: 1, page_number: 3, source_file: a.pdf, source_url: http://h/a, k: v"
    )
    assert got[1, 2].source == "chunk_index: 0, source_file: b.txt, x: None"
    assert "score" not in cw.format_hits(hits, include_scores=False).columns
    own = cw.format_hits(hits, metadata_col="metadata").where("query_id = 2").head()
    assert own.source == ""


def test_attribution(hits):
    got = {(r.query_id, r["rank"]): r.attribution for r in cw.source_attribution(hits).collect()}
    assert got == {
        (1, 1): "File: a.pdf | URL: http://h/a | Page: 3 | Chunk: 1",
        (1, 2): "File: b.txt | Chunk: 0",
        (2, 1): "",
    }


def test_context_prompts_and_summary(hits, spark):
    contexts = {r.query_id: r.context for r in cw.build_context(hits).collect()}
    assert contexts[1] == (
        "[Excerpt 1, similarity: 0.951 (from a.pdf, page 3)]\n" + "A" * 501 + "\n\n"
        "[Excerpt 2, similarity: 0.870 (from b.txt)]\nB\n"
    )
    assert contexts[2].startswith("[Excerpt 1, similarity: 0.500]\nC")
    summary = {r.query_id: r for r in cw.answer_summary(hits, "c").collect()}
    assert summary[1].similarity_scores == "0.951, 0.870"
    assert summary[1].sources_consulted == 2 and summary[2].collection_name == "c"
    asked = cw.build_context(hits).withColumn("query_text", F.lit("Why?"))
    prompts = cw.build_prompts(asked).where("query_id = 2").head()
    assert prompts.system_prompt == SYSTEM_PROMPT
    assert prompts.user_prompt.startswith("Question: Why?\n\nExcerpts:\n[Excerpt 1")


def test_model_sees_pairs_in_batches(spark):
    prompts = spark.createDataFrame(
        [(i, "sys", f"user {i}") for i in range(5)], "i int, system_prompt string, user_prompt string"
    ).coalesce(1)

    def model(pairs):
        return [f"{len(pairs)}:{s}:{u}" for s, u in pairs]

    got = [r.answer for r in cw.apply_model(prompts, model, batch_size=3).orderBy("i").collect()]
    assert got == [f"{n}:sys:user {i}" for i, n in enumerate([3, 3, 3, 2, 2])]


@pytest.mark.parametrize(
    "text,limit,threshold,problem",
    [
        ("q", 1, 0.0, None), ("q", 50, 1.0, None), ("q", 5, None, None),
        ("", 5, 0.5, "blank"), (" \t　", 5, 0.5, "blank"), (None, 5, 0.5, "blank"),
        ("q", 0, 0.5, "limit"), ("q", 51, 0.5, "limit"), ("q", None, 0.5, "limit"),
        ("q", 5, -0.1, "threshold"), ("q", 5, 1.1, "threshold"),
        ("q", 5, float("nan"), "threshold"),
    ],
)
def test_requests(spark, text, limit, threshold, problem):
    row = spark.createDataFrame(
        [(text, limit, threshold)], "query_text string, limit int, similarity_threshold double"
    )
    error = cw.validate_requests(row).head().error
    assert (error is None) if problem is None else (problem in error)
    if limit is not None and threshold is not None:
        if problem is None:
            cw.check_request(text, limit, threshold)
        else:
            with pytest.raises(ValueError, match=problem):
                cw.check_request(text, limit, threshold)


def test_question_limit():
    cw.check_request("q", 10, 0.7, max_limit=10)
    with pytest.raises(ValueError):
        cw.check_request("q", 11, 0.7, max_limit=10)
