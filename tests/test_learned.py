from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import chunkwell as cw
from chunkwell.operators import learned
from chunkwell.operators import search as search_module
from tests.test_ann import clustered, pairs  # noqa: F401 - a fixture


def test_recall_share_read_and_exact_scores(spark, clustered, new_dir, plan_of):  # noqa: F811
    df, q = clustered
    root = new_dir()
    spec = cw.build_learned_index(df, root, "c", 16, lists=32, fine=2, filter_columns=["label"]).head()
    assert (spec.dims, spec.lists, spec.fine, spec.code_bytes) == (16, 32, 2, 0)
    exact = pairs(cw.search_batch(df, q, 5))
    everything = pairs(cw.search_batch(df, q, 1500))
    few = cw.search_learned(spark, root, "c", q, 5, probes=8)
    found = pairs(few)
    assert len(found.keys() & exact.keys()) / len(exact) >= 0.9
    assert all(everything[k] == s for k, s in found.items())
    # an eighth of the cells; the hot cluster alone has a third of the rows
    index = learned.read_learned_index(spark, root, "c")
    assert index.count() == 1500 and index.select("chunk_id").distinct().count() == 1500
    one = cw.search_learned(spark, root, "c", q.where("query_id = 1"), 5, probes=2)
    plan = plan_of(one)
    assert "PartitionFilters: [list_no" in plan.replace("isnotnull(list_no#", "list_no#") or "list_no" in plan.split("PartitionFilters")[1][:200]
    assert "cell" in plan.split("PushedFilters")[1][:200]
    assert pairs(cw.search_learned(spark, root, "c", q, 5, probes=64)) == exact


def test_default_number_of_cells_reaches_the_recall(spark, clustered, new_dir):  # noqa: F811
    df, q = clustered
    root = new_dir()
    spec = cw.build_learned_index(df, root, "c", 16, lists=40).head()
    assert 1 <= spec.probes <= 8 and spec.share_read < 0.5
    exact, found = pairs(cw.search_batch(df, q, 5)), pairs(cw.search_learned(spark, root, "c", q, 5))
    assert len(found.keys() & exact.keys()) / len(exact) >= 0.85


def test_codes_rank_and_vectors_decide(spark, clustered, new_dir, plan_of):  # noqa: F811
    df, q = clustered
    root = new_dir()
    spec = cw.build_learned_index(df, root, "c", 16, lists=8, code_bytes=4, fit_rows=1_000).head()
    assert spec.code_bytes == 4 and len(spec.code_centres) == 256 * 16
    index = learned.read_learned_index(spark, root, "c")
    assert index.select(F.length("code").alias("n")).distinct().collect()[0].n == 4
    exact = pairs(cw.search_batch(df, q, 5))
    everything = pairs(cw.search_batch(df, q, 1500))
    found = pairs(cw.search_learned(spark, root, "c", q, 5, probes=8))
    assert len(found.keys() & exact.keys()) / len(exact) >= 0.9
    assert all(everything[k] == s for k, s in found.items())
    # the first pass reads codes, not vectors
    seen = []
    first = learned._coded_top_k
    learned._coded_top_k = lambda rows, *args: seen.append(plan_of(rows)) or first(rows, *args)
    try:
        cw.search_learned(spark, root, "c", q, 5, probes=4, candidates=3)
    finally:
        learned._coded_top_k = first
    assert "code" in seen[0] and "embedding" not in seen[0].split("ReadSchema")[1]
    # enough candidates and all cells: exact
    assert pairs(cw.search_learned(spark, root, "c", q, 5, probes=8, candidates=300)) == exact
    best = cw.search_learned(spark, root, "c", q, 5, 0.99, probes=8, candidates=300)
    assert pairs(best) == {k: s for k, s in exact.items() if s >= 0.99}


def test_an_index_follows_ingests(spark, new_dir):
    rng = np.random.default_rng(3)
    root, place = new_dir(), new_dir()

    def chunks(start, n):
        rows = [(str(k), f"d{k}", 0, f"text {k}", v.tolist(), {"user": f"u{k % 2}"}) for k, v in enumerate(rng.normal(size=(n, 8)), start)]
        return spark.createDataFrame(
            rows, "chunk_id string, doc_uri string, chunk_index int, content string, embedding array<float>, metadata map<string,string>"
        )

    q = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.normal(size=(6, 8)))], "query_id int, embedding array<float>")
    cw.store_chunks(chunks(0, 200), root, "c")
    cw.build_learned_index(cw.read_collection(spark, root, "c"), place, "c", 8, lists=6, filter_columns=["metadata.user"])
    old = cw.read_collection(spark, root, "c")
    cw.store_chunks(chunks(200, 50), root, "c")
    cw.store_chunks(chunks(250, 50), root, "c")
    stored = cw.read_collection(spark, root, "c")
    exact = pairs(cw.search_batch(stored, q, 20))
    assert any(int(c) >= 200 for _, c in exact)

    def found(**options):
        return pairs(cw.search_learned(spark, place, "c", q, 20, probes=6, **options))

    assert found(collection=stored) == exact  # not indexed yet
    assert found() == pairs(cw.search_batch(old, q, 20))
    assert cw.extend_learned_index(stored, place, "c") == 2
    assert cw.extend_learned_index(stored, place, "c") == 0
    assert found() == found(collection=stored) == exact
    filtered = cw.search_learned(spark, place, "c", q, 5, None, {"user": "u1"}, probes=6, collection=stored, columns=["content"])
    wanted = cw.search_batch(stored, q, 5, None, {"user": "u1"}, filter_mode="pre")
    assert pairs(filtered) == pairs(wanted) and all(r.content == f"text {r.chunk_id}" for r in filtered.collect())
    assert cw.merge_learned_index(spark, place, "c") == 2
    assert cw.merge_learned_index(spark, place, "c") == 1
    assert found() == exact
    assert learned.read_learned_index(spark, place, "c").count() == 300


def test_odd_rows_and_many_queries(spark, new_dir, monkeypatch, clustered):  # noqa: F811
    root = new_dir()
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, 0.0]), (6, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "chunk_id int, embedding array<float>")
    q = spark.createDataFrame([(1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0])], "query_id int, embedding array<float>")
    cw.build_learned_index(df, root, "c", 2, lists=2)
    found = cw.search_learned(spark, root, "c", q, 5, probes=2).orderBy("rank").collect()
    assert [(r.query_id, r.chunk_id) for r in found] == [(1, 1), (1, 5), (1, 6)]
    cw.build_learned_index(df.limit(0), root, "c", 2)
    assert cw.search_learned(spark, root, "c", q, 5).collect() == []
    big, asked = clustered
    cw.build_learned_index(big, root, "d", 16, lists=8)
    wanted = pairs(cw.search_learned(spark, root, "d", asked, 3, probes=2))
    monkeypatch.setattr(search_module, "BROADCAST_BYTES", 8 * 16 * 15)
    assert pairs(cw.search_learned(spark, root, "d", asked, 3, probes=2)) == wanted


def test_bad_options(spark, clustered, new_dir):  # noqa: F811
    df, q = clustered
    root = new_dir()
    for options in ({"lists": 0}, {"lists": 5_000}, {"code_bytes": 5}, {"fine": 0}, {"centroids": [[1.0]]}):
        with pytest.raises(ValueError):
            cw.build_learned_index(df, root, "c", 16, **({"lists": 4} | options))
    cw.build_learned_index(df, root, "c", 16, lists=4)
    for options in ({"limit": 0}, {"probes": 0}, {"probes": 5}, {"columns": ["label"]}, {"candidates": 0}):
        with pytest.raises(ValueError):
            cw.search_learned(spark, root, "c", q, **options)
    with pytest.raises(ValueError, match="different widths"):
        cw.search_learned(spark, root, "c", q.withColumn("embedding", F.array(F.lit(1.0))))


def test_tasks_hold_blocks_of_many_queries(spark, clustered, new_dir, monkeypatch):  # noqa: F811
    df, _ = clustered
    many = df.select(F.col("chunk_id").alias("query_id"), "embedding")
    places = {}
    for code_bytes in (0, 4):
        places[code_bytes] = new_dir()
        cw.build_learned_index(df, places[code_bytes], "c", 16, lists=8, fine=2, code_bytes=code_bytes, fit_rows=1_000)
    wanted = {k: pairs(cw.search_learned(spark, root, "c", many, 3, probes=4)) for k, root in places.items()}
    # a task holds 512 / 8 queries of 16 doubles at most, and no table of queries goes to every task
    monkeypatch.setattr(search_module, "BLOCK_BYTES", 512 * 16 * 8)
    monkeypatch.setattr(learned, "broadcast_top_k", None)
    monkeypatch.setattr(learned, "_coded_top_k", None)
    for k, root in places.items():
        assert pairs(cw.search_learned(spark, root, "c", many, 3, probes=4)) == wanted[k]
