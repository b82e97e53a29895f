from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import chunkwell as cw
from chunkwell.operators import search as search_module


@pytest.fixture(scope="module")
def clustered(spark):
    """Vectors around 40 centres; one cluster holds a third of all of them."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 16))
    which = np.where(rng.random(1500) < 1 / 3, 0, rng.integers(0, 40, 1500))
    points = centres[which] + 0.15 * rng.normal(size=(1500, 16))
    df = spark.createDataFrame(
        [(i, p.tolist(), int(w)) for i, (p, w) in enumerate(zip(points, which))],
        "chunk_id int, embedding array<float>, label int",
    )
    asked = centres + 0.15 * rng.normal(size=(40, 16))
    q = spark.createDataFrame(
        [(i, p.tolist()) for i, p in enumerate(asked)], "query_id int, embedding array<float>"
    )
    return df.repartition(4).cache(), q


def pairs(df):
    return {(r.query_id, r.chunk_id): r.similarity_score for r in df.collect()}


@pytest.mark.parametrize("tables", [1, 3])
def test_recall_and_exact_scores(spark, clustered, new_dir, tables):
    df, q = clustered
    root = new_dir()
    spec = cw.build_index(df, root, "c", 16, tables=tables, bits=6, filter_columns=["label"]).head()
    assert (spec.dims, spec.tables, spec.bits, spec.similarity) == (16, tables, 6, "cosine")
    exact = pairs(cw.search_batch(df, q, 5))
    everything = pairs(cw.search_batch(df, q, 1500))
    found = pairs(cw.search_ann(spark, root, "c", q, 5, probes=8))
    recall = len(found.keys() & exact.keys()) / len(exact)
    assert recall > 0.9
    assert all(everything[k] == s for k, s in found.items())
    assert pairs(cw.search_ann(spark, root, "c", q, 5, probes=64)) == exact
    # a third of the rows share their buckets, and still every row is in every table
    index = cw.operators.ann.read_index(spark, root, "c")
    assert index.groupBy("table_no").count().where("count = 1500").count() == tables


def test_default_probes_reach_the_recall(spark, clustered, new_dir):
    df, q = clustered
    root = new_dir()
    # few buckets do for clusters, most are needed without any structure
    rng = np.random.default_rng(5)
    flat = spark.createDataFrame(
        [(i, p.tolist()) for i, p in enumerate(rng.normal(size=(1500, 16)))], "chunk_id int, embedding array<float>"
    )
    chosen = {}
    for name, rows in (("clustered", df), ("flat", flat)):
        chosen[name] = cw.build_index(rows, root, name, 16, bits=6).head().probes
        asked = rows.where("chunk_id % 5 = 0").withColumnRenamed("chunk_id", "query_id") if name == "flat" else q
        exact = pairs(cw.search_batch(rows, asked, 5))
        found = pairs(cw.search_ann(spark, root, name, asked, 5))
        assert len(found.keys() & exact.keys()) / len(exact) >= 0.9
    assert chosen["clustered"] < chosen["flat"] <= 64


def test_registered_query_reaches_the_recall(spark):
    from checks.queries import REGISTRY

    rows = REGISTRY["search_ann"](spark, "/root/testdata/sf0.001").collect()
    assert sum(r.recall for r in rows) / len(rows) >= 0.9


def test_caller_fields_empty_indexes_and_wild_limits(spark, new_dir):
    root = new_dir()
    schema = "chunk_id string, embedding array<float>, metadata map<string,string>"
    rows = [(str(i), [1.0, i / 10], {"user_id": f"u{i % 2}"}) for i in range(10)]
    df = spark.createDataFrame(rows, schema)
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<float>")
    cw.build_index(df, root, "c", 2, bits=1, filter_columns=["metadata.user_id"])
    found = cw.search_ann(spark, root, "c", q, 5, None, {"user_id": "u1"}, probes=2).collect()
    assert {r.chunk_id for r in found} == {"1", "3", "5", "7", "9"}
    with pytest.raises(ValueError, match="tenant"):
        cw.search_ann(spark, root, "c", q, 5, None, {"tenant": "t"}, probes=2)
    with pytest.raises(ValueError, match="no field 'missing'"):
        cw.build_index(df.drop("metadata"), root, "c", 2, filter_columns=["missing"])
    with pytest.raises(ValueError, match="limit"):
        cw.search_ann(spark, root, "c", q, 2_000_000, probes=2)
    # the failed build changed nothing; a new one takes over as a whole
    assert cw.search_ann(spark, root, "c", q, 5, probes=2).count() == 5
    cw.build_index(df.limit(0), root, "c", 2, bits=1)
    assert cw.search_ann(spark, root, "c", q, 5, probes=2).collect() == []


def test_filter_threshold_and_columns(spark, clustered, new_dir):
    df, q = clustered
    root = new_dir()
    cw.build_index(df, root, "c", 16, bits=5, filter_columns=["label"])
    found = cw.search_ann(
        spark, root, "c", q, 3, 0.9, {"label": 0}, probes=32, collection=df, columns=["label"]
    ).collect()
    wanted = cw.search_batch(df, q, 3, 0.9, {"label": 0}, filter_mode="pre").collect()
    assert found and {r.label for r in found} == {0}
    assert {(r.query_id, r.chunk_id) for r in found} == {(r.query_id, r.chunk_id) for r in wanted}


def test_unwanted_buckets_are_not_read(spark, clustered, new_dir, plan_of):
    df, q = clustered
    root = new_dir()
    cw.build_index(df, root, "c", 16, bits=6)
    plan = plan_of(cw.search_ann(spark, root, "c", q.where("query_id = 1"), 3, probes=2))
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:200]


def test_more_queries_than_can_be_broadcast(spark, clustered, new_dir, monkeypatch):
    df, q = clustered
    root = new_dir()
    cw.build_index(df, root, "c", 16, bits=4)
    wanted = pairs(cw.search_ann(spark, root, "c", q, 3, probes=4))
    monkeypatch.setattr(search_module, "BROADCAST_BYTES", 8 * 16 * 15)
    assert pairs(cw.search_ann(spark, root, "c", q, 3, probes=4)) == wanted


def test_bad_options(spark, clustered, new_dir):
    df, q = clustered
    root = new_dir()
    for options in ({"bits": 0}, {"bits": 13}, {"tables": 0}):
        with pytest.raises(ValueError):
            cw.build_index(df, root, "c", 16, **options)
    with pytest.raises(Exception, match="different widths"):
        cw.build_index(df, root, "c", 8)
    root = new_dir()
    cw.build_index(df, root, "c", 16, bits=3)
    for options in ({"limit": 0}, {"probes": 0}, {"probes": 9}, {"columns": ["label"]}):
        with pytest.raises(ValueError):
            cw.search_ann(spark, root, "c", q, **options)
    with pytest.raises(ValueError, match="different widths"):
        cw.search_ann(spark, root, "c", q.withColumn("embedding", F.array(F.lit(1.0))))


def test_tasks_hold_blocks_of_many_queries(spark, clustered, new_dir, monkeypatch):
    df, q = clustered
    root = new_dir()
    many = df.select(F.col("chunk_id").alias("query_id"), "embedding")
    cw.build_index(df, root, "c", 16, bits=4, tables=2)
    wanted = pairs(cw.search_ann(spark, root, "c", many, 3, probes=4))
    # a task holds 512 / 8 queries of 16 doubles at most, and no table of queries goes to every task
    monkeypatch.setattr(search_module, "BLOCK_BYTES", 512 * 16 * 8)
    monkeypatch.setattr(cw.operators.ann, "broadcast_top_k", None)
    assert pairs(cw.search_ann(spark, root, "c", many, 3, probes=4)) == wanted
    # buckets that no query wants are not read
    near = many.where("query_id < 20")
    seen = search_module.wanted_groups(near.withColumn("vector", F.col("embedding")), 16, 32, lambda v: cw.operators.ann.probe_mask(v, 16, 2, 4, 0, 1))
    assert seen.shape == (1, 32) and 2 <= seen.sum() < 32


def test_width_of_many_queries(spark, clustered, new_dir, monkeypatch):
    df, q = clustered
    root = new_dir()
    cw.build_index(df, root, "c", 16, bits=3)
    monkeypatch.setattr(search_module, "BROADCAST_BYTES", 0)
    assert cw.search_ann(spark, root, "c", q.withColumn("embedding", F.lit(None).cast("array<float>")), 3).collect() == []
    with pytest.raises(ValueError, match="different widths"):
        cw.search_ann(spark, root, "c", q.withColumn("embedding", F.array(F.lit(1.0))))


def test_repeated_ids_take_one_place_each(spark, new_dir):
    rows = [(i, [1.0, i / 10]) for i in range(1, 13) for _ in range(6)]
    df = spark.createDataFrame(rows, "chunk_id int, embedding array<float>").coalesce(1)
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<float>")
    root = new_dir()
    cw.build_index(df, root, "c", 2, bits=1, tables=2)
    found = cw.search_ann(spark, root, "c", q, 5, probes=2).orderBy("rank").collect()
    assert [r.chunk_id for r in found] == [1, 2, 3, 4, 5]
