from __future__ import annotations

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

import chunkwell as cw
from chunkwell.operators import search as search_module


def brute(vectors, queries, k, raw=False):
    """``{query: [(id, score), …]}`` by plain arithmetic, ties by id."""
    out = {}
    for qid, q in queries.items():
        scored = []
        for vid, v in vectors:
            a, b = np.asarray(q, float), np.asarray(v, float)
            c = a @ b / np.sqrt((a @ a) * (b @ b))
            scored.append((-round(c if raw else (1 + c) / 2, 9), vid))
        out[qid] = [(vid, -s) for s, vid in sorted(scored)[:k]]
    return out


def lists(df, id_col="id", query_col="query_id"):
    out = {}
    for r in df.orderBy(query_col, "rank").collect():
        out.setdefault(r[query_col], []).append((r[id_col], r.similarity_score))
    return out


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 8)).astype(np.float32)
    # a third of all rows are copies of one vector, more than any limit
    copies = np.repeat(base[:1], 100, axis=0)
    everything = np.concatenate([copies, base, base[10:30] * 3, rng.normal(size=(120, 8))])
    order = rng.permutation(len(everything))
    vectors = [
        (f"v{i:04d}", everything[j].astype(np.float32).tolist(), int(j % 3))
        for i, j in enumerate(order)
    ]
    df = spark.createDataFrame(
        vectors, "id string, embedding array<float>, label int"
    ).repartition(5)
    queries = {i: base[i * 3].tolist() for i in range(20)}
    qdf = spark.createDataFrame(list(queries.items()), "query_id int, embedding array<float>")
    return [(v[0], v[1]) for v in vectors], df, queries, qdf


@pytest.mark.parametrize("k", [1, 7, 50, 1000])
def test_batch_is_exact_with_many_copies(data, k):
    vectors, df, queries, qdf = data
    assert lists(cw.search_batch(df, qdf, k, id_col="id")) == brute(vectors, queries, k)


def test_raw_scores(data):
    vectors, df, queries, qdf = data
    got = lists(cw.search_batch(df, qdf, 5, id_col="id", score="cosine"))
    assert got == brute(vectors, queries, 5, raw=True)


def test_block_pairs_give_the_same(data, monkeypatch):
    vectors, df, queries, qdf = data
    monkeypatch.setattr(search_module, "BROADCAST_BYTES", 8 * 8 * 4)
    monkeypatch.setattr(search_module, "BLOCK_BYTES", 8 * 8 * 30)
    got = lists(cw.search_batch(df, qdf, 7, id_col="id"))
    assert got == brute(vectors, queries, 7)
    filtered = cw.search_batch(df, qdf, 7, 0.8, {"label": 1}, id_col="id", columns=["label"])
    monkeypatch.undo()
    again = cw.search_batch(df, qdf, 7, 0.8, {"label": 1}, id_col="id", columns=["label"])
    assert lists(filtered) == lists(again)


def test_too_many_scores_are_dealt_in_pairs_of_blocks(data, monkeypatch):
    vectors, df, queries, qdf = data
    monkeypatch.setattr(search_module, "BLOCK_BYTES", 8 * 8 * 30)  # 30 rows, 3 queries
    asked = search_module.query_rows(qdf, 7, 7, None, "query_id", "embedding")
    rows = df.selectExpr("id", "embedding AS vector", "'' AS grp")
    local = search_module._block_top_k(rows, asked, 8, search_module.hit_schema(rows, asked), False)
    assert local.rdd.getNumPartitions() >= (len(vectors) // 30) * (len(queries) // 3)

    def never(*_):
        raise AssertionError("all queries went to every task")

    monkeypatch.setattr(search_module, "broadcast_top_k", never)
    assert lists(cw.search_batch(df, qdf, 7, id_col="id")) == brute(vectors, queries, 7)


def test_batches_and_small_blocks_do_not_matter(spark, data, monkeypatch):
    vectors, df, queries, qdf = data
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert lists(cw.search_batch(df, qdf, 7, id_col="id")) == brute(vectors, queries, 7)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_one_query_is_a_batch_of_one(data):
    vectors, df, queries, qdf = data
    one = cw.vector_search(df, queries[4], 9, id_col="id", columns=["id"]).collect()
    wanted = brute(vectors, {4: queries[4]}, 9)[4]
    assert [(r.id, r.similarity_score) for r in one] == wanted


def test_expression_equals_blocks(data):
    _, df, queries, _ = data
    q = F.array(*[F.lit(float(x)) for x in queries[2]])
    both = df.select(
        cw.similarity_score(F.col("embedding"), q).alias("a"),
        search_module.score_query(queries[2], F.col("embedding")).alias("b"),
    ).collect()
    assert all(abs(r.a - r.b) < 1e-9 for r in both)


def test_limits_and_thresholds_per_query(spark, data):
    vectors, df, queries, qdf = data
    own = qdf.withColumn("limit", F.col("query_id") % 4 + 1).withColumn(
        "t", F.when(F.col("query_id") % 3 == 0, 0.0).when(F.col("query_id") % 3 == 1, 0.85)
    )
    got = lists(cw.search_batch(df, own, "limit", "t", id_col="id"))
    for qid, hits in brute(vectors, queries, 4).items():
        least = 0.85 if qid % 3 == 1 else -1
        assert got[qid] == [h for h in hits[: qid % 4 + 1] if h[1] >= least]
    with pytest.raises(Exception, match="limit is outside 1 to 3"):
        cw.search_batch(df, own, "limit", id_col="id", max_limit=3).collect()


def test_filter_after_or_before(data):
    vectors, df, queries, qdf = data
    labels = {r.id: r.label for r in df.collect()}
    full = brute(vectors, queries, len(vectors))
    for mode in ("post", "pre"):
        got = lists(
            cw.search_batch(df, qdf, 10, 0.6, {"metadata.label": 1}, id_col="id", filter_mode=mode)
        )
        for qid, hits in full.items():
            first = hits[:10] if mode == "post" else [h for h in hits if labels[h[0]] == 1][:10]
            wanted = [h for h in first if labels[h[0]] == 1 and h[1] >= 0.6]
            assert got.get(qid, []) == wanted
    # with room for everything there is no difference
    a, b = (
        lists(cw.search_batch(df, qdf, 400, None, {"label": 2}, id_col="id", filter_mode=m))
        for m in ("post", "pre")
    )
    assert a == b


def test_ranks_are_dense_after_a_filter(data):
    _, df, _, qdf = data
    hits = cw.search_batch(df, qdf, 20, metadata_filter={"label": 0}, id_col="id").collect()
    by_query = {}
    for h in hits:
        by_query.setdefault(h.query_id, []).append(h["rank"])
    assert all(sorted(r) == list(range(1, len(r) + 1)) for r in by_query.values())


def test_one_list_per_collection(data):
    vectors, df, queries, qdf = data
    named = df.withColumn("collection_name", F.concat(F.lit("c"), "label"))
    got = cw.search_collections(named, qdf, ["c0", "c2", "nothing"], 4, id_col="id").collect()
    labels = {r.id: r.label for r in df.collect()}
    for label in (0, 2):
        part = [v for v in vectors if labels[v[0]] == label]
        for qid, wanted in brute(part, queries, 4).items():
            mine = [r for r in got if r.query_id == qid and r.collection_name == f"c{label}"]
            mine = [(r.id, r.similarity_score) for r in sorted(mine, key=lambda r: r["rank"])]
            assert mine == wanted
    assert {r.collection_name for r in got} == {"c0", "c2"}


def test_vectors_without_direction(spark):
    df = spark.createDataFrame(
        [(1, [0.0, 0.0]), (2, None), (3, []), (4, [1.0, 0.0]), (5, [-1.0, 0.0]),
         (6, [float("nan"), 1.0]), (7, [None, 1.0])],
        "id int, embedding array<float>",
    )
    got = cw.vector_search(df, [2.0, 0.0], 10, id_col="id", columns=["id"]).collect()
    assert [(r.id, r.similarity_score) for r in got] == [(4, 1.0), (5, 0.0)]
    q = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, []), (4, None)],
        "query_id int, embedding array<float>",
    )
    assert lists(cw.search_batch(df, q, 10, id_col="id")) == {1: [(4, 1.0), (5, 0.0)]}
    expression = df.select(
        "id", cw.similarity_score(F.col("embedding"), F.array(F.lit(2.0), F.lit(0.0))).alias("s")
    ).collect()
    assert {r.id: r.s for r in expression if r.s is not None} == {4: 1.0, 5: 0.0}
    assert cw.vector_search(df, [0.0, 0.0], 3, id_col="id", columns=["id"]).count() == 0
    assert cw.search_batch(df, q.where("query_id = 3"), 3, id_col="id").count() == 0
    assert cw.search_batch(df.where("id < 0"), q, 3, id_col="id").count() == 0


def test_widths_must_agree(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id int, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<float>")
    with pytest.raises(PythonException, match="different widths"):
        cw.search_batch(df, q, id_col="id").collect()
    with pytest.raises(PythonException, match="different widths"):
        cw.vector_search(df, [1.0, 0.0], id_col="id", columns=["id"]).collect()
    with pytest.raises(Exception, match="different widths"):
        df.select(cw.similarity_score(F.col("embedding"), F.array(F.lit(1.0)))).collect()


def test_threshold_switches_off(data):
    _, df, _, _ = data
    hits = df.select(F.lit(0.5).alias("similarity_score"))
    for t in (None, 0, 0.0, 0.5):
        assert cw.threshold_filter(hits, t).count() == hits.count()
    assert cw.threshold_filter(hits, 0.51).count() == 0


@pytest.mark.parametrize("options", [{"limit": 0}, {"filter_mode": "x"}, {"score": "x"}])
def test_bad_options(data, options):
    _, df, queries, qdf = data
    with pytest.raises(ValueError):
        cw.vector_search(df, queries[0], id_col="id", **options)
    with pytest.raises(ValueError):
        cw.search_batch(df, qdf, id_col="id", **options)


def test_unmatched(spark, data):
    _, df, _, qdf = data
    hits = cw.search_batch(df, qdf, 1, 1.0, id_col="id").where("query_id != 5")
    assert [r.query_id for r in cw.unmatched_queries(qdf, hits).collect()] == [5]


def test_plans(spark, data, plan_of, new_dir):
    _, df, queries, qdf = data
    root = new_dir()
    named = df.withColumn("collection_name", F.concat(F.lit("c"), "label"))
    named.write.partitionBy("collection_name").parquet(root)
    stored = spark.read.parquet(root)
    single = plan_of(cw.vector_search(stored, queries[0], id_col="id", columns=["id"]))
    assert "TakeOrderedAndProject" in single and "Exchange" not in single
    assert single.count("ArrowEvalPython") == 1
    batch = plan_of(cw.search_batch(stored, qdf, 3, id_col="id"))
    assert "WindowGroupLimit" in batch
    assert batch.count("Exchange") == 1 and "Join" not in batch
    # a few rows more per task do not matter, many more tasks would
    assert "Coalesce" in batch
    some = plan_of(cw.search_collections(stored, qdf, ["c1"], 3, id_col="id"))
    assert "= c1)" in some.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    before = plan_of(
        cw.vector_search(
            stored, queries[0], 3, metadata_filter={"label": 1}, filter_mode="pre",
            id_col="id", columns=["id"],
        )
    )
    assert "EqualTo(label,1)" in before
    after = plan_of(
        cw.vector_search(
            stored, queries[0], 3, metadata_filter={"label": 1}, id_col="id", columns=["label"]
        )
    )
    # the ranking has run; contents come by broadcast, from the files of the winners
    assert "BroadcastHashJoin" in after and after.count("TakeOrderedAndProject") == 1
    assert "file_path" in after and "label,1" not in after.split("DataFilters")[1].split("Format")[0]


def test_contents_come_from_the_files_of_the_winners(spark, new_dir):
    root = new_dir()
    rows = spark.range(400).selectExpr("cast(id AS string) chunk_id", "concat('text ', id) content",
                                       "array(cast(id AS float), 400f - id) embedding")
    rows.repartitionByRange(20, "chunk_id").write.parquet(root)
    stored = spark.read.parquet(root)
    hits = cw.vector_search(stored, [1.0, 0.0], 2, columns=["chunk_id", "content"])
    assert [r.content for r in hits.collect()] == ["text 399", "text 398"]

    def files(node):
        metrics, children = node.metrics(), node.children()
        own = [metrics.apply("numFiles").value()] if metrics.contains("numFiles") else []
        return own + [n for i in range(children.size()) for n in files(children.apply(i))]

    fetched = stored.where(F.col("_metadata.file_path").isin(
        [r[0] for r in stored.where("chunk_id IN ('398', '399')").select("_metadata.file_path").distinct().collect()]
    ))
    fetched.collect()
    assert 1 <= sum(files(fetched._jdf.queryExecution().executedPlan())) <= 2
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("file_path") and ".parquet" in plan


def test_contents_of_a_batch_come_from_the_files_of_its_winners(spark, new_dir):
    root = new_dir()
    rows = spark.range(400).selectExpr("cast(id AS string) chunk_id", "concat('text ', id) content",
                                       "array(cast(id AS float), 400f - id) embedding", "id % 5 AS label")
    rows.repartitionByRange(20, "chunk_id").write.parquet(root)
    stored = spark.read.parquet(root)
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id int, embedding array<float>")
    hits = cw.search_batch(stored, asked, 1, columns=["content"])
    assert {(r.query_id, r.content) for r in hits.collect()} == {(1, "text 399"), (2, "text 0")}

    def files(node):
        metrics, children = node.metrics(), node.children()
        own = [metrics.apply("numFiles").value()] if metrics.contains("numFiles") else []
        inner = [n for i in range(children.size()) for n in files(children.apply(i))]
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            inner = files(node.executedPlan())
        elif "QueryStage" in node.getClass().getSimpleName():
            inner = files(node.plan())
        return own + inner

    # two files hold the winners, one more the ranking; never all twenty
    assert 1 <= sum(files(hits._jdf.queryExecution().executedPlan())) <= 4
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Exchange hash" not in plan
    late = cw.search_batch(stored, asked, 3, metadata_filter={"label": 4}, columns=["content"])
    assert {(r.query_id, r.content, r["rank"]) for r in late.collect()} == {(1, "text 399", 1)}
