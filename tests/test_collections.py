from __future__ import annotations

import os
from glob import glob

import pytest
from pyspark.sql import functions as F

import chunkwell as cw


@pytest.fixture
def chunks(spark):
    return spark.createDataFrame(
        [("d1", 0, "äb", [1.0, 2.0], {"k": "own"}), ("d1", 1, "b", [1.0, 0.0], None),
         ("d2", 0, "ccc", [0.0, 1.0], {})],
        "doc_uri string, chunk_index int, content string, embedding array<float>, "
        "metadata map<string,string>",
    )


def test_store_and_read(spark, chunks, new_dir):
    root = new_dir()
    assert cw.read_collection(spark, root, "a").count() == 0  # nothing stored yet
    report = cw.store_chunks(chunks, root, "a", {"k": "source", "z": 1})
    assert report["success"] and report["chunks_stored"] == 3
    assert report["collection_name"] == "a"
    rows = cw.read_collection(spark, root, "a").orderBy("document_url", "chunk_index").collect()
    assert [r.content for r in rows] == ["äb", "b", "ccc"]
    assert rows[0].metadata == {"k": "source", "z": "1"}
    assert rows[0].processed_at is not None and rows[0].logical_size == 3 + 8
    assert {r.chunk_id for r in rows} == {r.chunk_id for r in report["inserted_ids"].collect()}
    assert len({r.chunk_id for r in rows}) == 3
    assert cw.read_collection(spark, root, "other").count() == 0


def test_again_duplicates_unless_told_otherwise(spark, chunks, new_dir):
    root = new_dir()
    first = cw.store_chunks(chunks, root, "a")
    again = cw.store_chunks(chunks, root, "a")
    assert again["inserted_ids"].intersect(first["inserted_ids"]).count() == 0
    rows = cw.read_collection(spark, root, "a")
    assert rows.count() == 6 and rows.select("chunk_id").distinct().count() == 6
    more = chunks.unionByName(chunks.limit(1).withColumn("doc_uri", F.lit("d3")))
    third = cw.store_chunks(more, root, "a", mode="skip_existing")
    assert third["chunks_stored"] == 1
    assert cw.store_chunks(chunks, root, "b", mode="skip_existing")["chunks_stored"] == 3
    with pytest.raises(ValueError):
        cw.store_chunks(chunks, root, "a", mode="replace")


def test_copies_of_a_document_get_ids_of_their_own(spark, chunks, new_dir):
    root = new_dir()
    cw.store_chunks(chunks.unionByName(chunks), root, "a")
    rows = cw.read_collection(spark, root, "a")
    assert rows.select("chunk_id").distinct().count() == 6
    q = spark.createDataFrame([(1, [1.0, 2.0])], "query_id int, embedding array<float>")
    hits = cw.search_batch(rows, q, 3, columns=["content"]).orderBy("rank").collect()
    assert [h.content for h in hits] == ["äb", "äb", hits[2].content] and len(hits) == 3


def test_given_ids_are_kept(spark, chunks, new_dir):
    root = new_dir()
    given = chunks.withColumn("chunk_id", F.when(F.col("chunk_index") == 0, F.col("doc_uri")))
    cw.store_chunks(given, root, "a")
    ids = [r.chunk_id for r in cw.read_collection(spark, root, "a").collect()]
    assert {"d1", "d2"} < set(ids) and len(set(ids)) == 3


def test_one_large_collection_is_written_by_many_tasks(spark, new_dir):
    root = new_dir()
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        rows = spark.range(20_000).select(
            F.concat(F.lit("d"), F.col("id")).alias("doc_uri"),
            F.lit(0).alias("chunk_index"),
            F.sha2(F.col("id").cast("string"), 512).alias("content"),
            F.array(F.rand(1).cast("float"), F.rand(2).cast("float")).alias("embedding"),
            F.when(F.col("id") % 3 == 0, "big").otherwise(
                F.concat(F.lit("small"), F.col("id") % 7)
            ).alias("name"),
        )
        report = cw.store_chunks(rows.repartition(4), root, F.col("name"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert report["chunks_stored"] == 20_000
    files = glob(f"{root}/collection_name=big/*/*.parquet")
    assert len(files) > 1


def test_statistics(spark, chunks, new_dir, plan_of):
    root = new_dir()
    cw.store_chunks(chunks, root, "a")
    cw.store_chunks(chunks.limit(1), root, "b")
    stored = cw.read_all(spark, root)
    assert {r.collection_name for r in cw.list_collections(spark, root).collect()} == {"a", "b"}
    stats = {r.collection_name: r for r in cw.collection_stats(stored).collect()}
    assert stats["a"].document_count == 3 and stats["a"].size_bytes == 3 + 1 + 3 + 24
    assert stats["a"].avg_obj_size == 31 / 3
    disk = {r.collection_name: r for r in cw.storage_stats(spark, root).collect()}
    for name in ("a", "b"):
        folder = f"{root}/collection_name={name}"
        files = glob(f"{folder}/*/*.parquet")
        assert disk[name].storage_size_bytes == sum(map(os.path.getsize, files))
        assert disk[name].size_bytes == stats[name].size_bytes
    # neither contents nor vectors are read for it
    assert "ReadSchema: struct<logical_size:bigint>" in plan_of(cw.collection_stats(stored))
    assert "FileScan" not in plan_of(cw.list_collections(spark, root))
    wanted = spark.createDataFrame([("a",), ("none",)], "collection_name string")
    rows = {r.collection_name: r for r in cw.catalog(spark, root, wanted).collect()}
    assert rows.keys() == {"a", "b", "none"} and rows["none"].document_count == 0
    assert rows["a"].storage_size_bytes == disk["a"].storage_size_bytes
    given = chunks.withColumn("collection_name", F.lit("c"))
    assert cw.collection_stats(given).head().size_bytes == 31


def test_reading_prunes_partitions(spark, chunks, new_dir, plan_of):
    root = new_dir()
    cw.store_chunks(chunks, root, "a")
    plan = plan_of(cw.read_collection(spark, root, "a"))
    assert "= a)" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]


@pytest.mark.parametrize("name", ["plain-1.x", "with space", "a/b=c", "ünï", ".dot", "..", ""])
def test_any_name(spark, chunks, new_dir, name):
    root = new_dir()
    cw.store_chunks(chunks, root, "other")
    if name == "":
        assert cw.read_collection(spark, root, name).count() == 0
        return
    cw.store_chunks(chunks, root, name)
    rows = cw.read_collection(spark, root, name).collect()
    assert len(rows) == 3 and {r.collection_name for r in rows} == {name}
    assert cw.store_chunks(chunks, root, name, mode="skip_existing")["chunks_stored"] == 0
    assert {r.collection_name for r in cw.list_collections(spark, root).collect()} == {name, "other"}


def test_routes(spark):
    rows = spark.createDataFrame(
        [
            ("single", "t", "u", "c", "all_documents"),
            ("by_type", "t", "u", "c", "t_docs"),
            ("by_type", None, "u", "c", "general_docs"),
            ("by_user", "t", "u", "c", "user_u_docs"),
            ("by_user", "t", None, "c", "user_anonymous_docs"),
            ("hybrid", "t", "u", "c", "c_t_docs"),
            ("hybrid", None, "u", None, "default_general_docs"),
            ("x", "t", "u", "c", "default_collection"),
            (None, "t", "u", "c", "default_collection"),
        ],
        "strategy string, document_type string, user_id string, tenant string, wanted string",
    )
    for r in cw.route_collection(rows, F.col("strategy")).collect():
        assert r.collection_name == r.wanted
    only_type = rows.select("document_type").limit(1)
    assert cw.route_collection(only_type, "hybrid").head().collection_name == "default_t_docs"


def test_coverage(spark):
    wanted = spark.createDataFrame([("a",), ("b",)], "collection_name string")
    existing = spark.createDataFrame([("a",), ("a",), ("z",)], "collection_name string")
    got = {r.collection_name: r.status for r in cw.index_coverage(wanted, existing).collect()}
    assert got == {"a": "EXISTS", "b": "NEEDS INDEX"}


def test_filters_reach_the_scan_of_a_stored_collection(spark, new_dir, plan_of):
    rows = [(f"c{k}", "d", k, "t", [1.0], {"user": f"u{k % 3}"} | ({"page_number": "7"} if k == 5 else {}), k % 4) for k in range(12)]
    df = spark.createDataFrame(
        rows, "chunk_id string, doc_uri string, chunk_index int, content string, embedding array<float>, "
        "metadata map<string,string>, page_number int",
    )
    root = new_dir()
    cw.store_chunks(df.where("chunk_index < 6"), root, "c", {"address": {"town": "X", "geo": {"lat": 1.5}}, "tags": ["a", 2]},
                    promote=["user", "address.town"])
    cw.store_chunks(df.where("chunk_index >= 6"), root, "c")
    stored = cw.read_collection(spark, root, "c")

    def found(wanted):
        return {r.chunk_index for r in cw.filter_hits(stored, wanted).collect()}

    def pushed(wanted):
        return plan_of(cw.filter_hits(stored, wanted)).split("PushedFilters: ")[1].split("ReadSchema")[0]

    assert found({"page_number": 1}) == {1, 9}  # the fifth has a page number of its own
    assert found({"page_number": 7}) == {5} and found({"page_number": {"gte": 3}}) == {3, 5, 7, 11}
    assert "EqualTo(page_number,1)" in pushed({"page_number": 1}) and "EqualTo(overrides,true)" in pushed({"page_number": 1})
    assert found({"user": "u1"}) == {1, 4, 7, 10} and found({"metadata.user": ["u0", "u2"]}) == {0, 2, 3, 5, 6, 8, 9, 11}
    assert "EqualTo(field_user,u1)" in pushed({"user": "u1"}) and "In(field_user, [u0,u2])" in pushed({"user": ["u0", "u2"]})
    assert found({"address.town": "X"}) == set(range(6)) and "field_address%2Etown" in pushed({"address.town": "X"})
    assert found({"address.geo.lat": {"gt": 1}}) == set(range(6)) and found({"tags": '["a", 2]'}) == set(range(6))
    assert found({"address.town": None}) == set(range(6, 12)) and found({"user": {"ne": "u0"}}) == {1, 2, 4, 5, 7, 8, 10, 11}
    assert [r.overrides for r in stored.orderBy("chunk_index").collect()] == [k == 5 for k in range(12)]
