from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import chunkwell as cw
from chunkwell.functions.metadata import metadata_predicate


def test_later_layers_win_even_with_null(spark):
    rows = spark.createDataFrame(
        [
            ({"a": "1", "b": "2"}, {"b": "3", "c": None}, {"a": None}),
            ({"a": "1"}, None, {}),
            (None, None, None),
        ],
        "low map<string,string>, mid map<string,string>, high map<string,string>",
    )
    merged = rows.select(cw.merge_metadata(F.col("low"), F.col("mid"), F.col("high")).alias("m"))
    assert [r.m for r in merged.collect()] == [
        {"a": None, "b": "3", "c": None},
        {"a": "1"},
        {},
    ]


def test_caller_fields_win_in_the_merged_view(spark):
    rows = spark.createDataFrame(
        [("u", 4, {"document_url": "mine", "team": "x"}), (None, None, None)],
        "document_url string, chunk_index int, metadata map<string,string>",
    )
    views = [r.v for r in rows.select(cw.merged_view(rows).alias("v")).collect()]
    assert views == [{"document_url": "mine", "chunk_index": "4", "team": "x"}, {}]


@pytest.fixture
def records(spark):
    return spark.createDataFrame(
        [
            (1, "a", 1, {"user_id": "u1", "kind": "x"}),
            (2, "b", 2, {"user_id": "u1", "kind": None}),
            (3, "a", 3, {"user_id": "u2", "name": "own"}),
            (4, "own", 4, None),
        ],
        "id int, name string, page_number int, metadata map<string,string>",
    )


@pytest.mark.parametrize(
    "given,ids",
    [
        (None, [1, 2, 3, 4]),
        ({}, [1, 2, 3, 4]),
        ({"user_id": "u1"}, [1, 2]),
        ({"metadata.user_id": "u1"}, [1, 2]),
        ({"user_id": "u1", "kind": "x"}, [1]),
        ({"kind": None, "user_id": "u1"}, [2]),
        ({"name": "own"}, [3, 4]),  # the record's own field hides the column
        ({"name": "a"}, [1]),
        ({"page_number": 2}, [2]),
        ({"page_number": "2"}, [2]),
        ({"page_number": "two"}, []),
        ({"absent": "x"}, []),
        ("page_number > 2", [3, 4]),
    ],
)
def test_filters(records, given, ids):
    got = cw.filter_hits(records, F.expr(given) if isinstance(given, str) else given)
    assert sorted(r.id for r in got.collect()) == ids


def test_a_key_that_names_nothing(records):
    plain = records.drop("metadata")
    with pytest.raises(ValueError, match="user_id"):
        metadata_predicate(plain, {"user_id": "u1"})


def test_lists_ranges_and_booleans(spark):
    df = spark.createDataFrame(
        [(1, {"lab": "1", "size": "9", "on": "true"}), (2, {"lab": "2", "size": "10", "on": "false"}),
         (3, {"lab": "x", "size": "y"})],
        "page_number int, metadata map<string,string>",
    )

    def found(wanted):
        return {r.page_number for r in df.where(metadata_predicate(df, wanted)).collect()}

    assert found({"lab": ["1", "2"]}) == {1, 2} and found({"lab": []}) == set()
    assert found({"on": True}) == {1} and found({"metadata.on": [False, None]}) == {2, 3}
    assert found({"size": {"gte": 9, "lt": 10}}) == {1} and found({"size": {"$gt": 9.5}}) == {2}
    assert found({"lab": {"ne": "1"}}) == {2, 3} and found({"lab": {"nin": ["1", "x"]}}) == {2}
    assert found({"page_number": [1, 3], "lab": {"in": ["x"]}}) == {3}
    assert found({"page_number": {"gt": 1, "lte": 2}}) == {2}
    for wrong in ({"lab": {"like": "a"}}, {"lab": {}}, {"lab": {"in": "a"}}):
        with pytest.raises(ValueError):
            metadata_predicate(df, wrong)
