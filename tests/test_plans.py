from __future__ import annotations

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import chunkwell as cw

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TEXT = (
    "Machine Learning Fundamentals\n\n"
    "Machine learning is a subset of artificial intelligence that learns from data.\n\n"
    "Popular algorithms include:\n- Linear regression for continuous values\n"
    "- Decision trees for classification\n\n"
    "Payment Terms\nInvoices are payable within thirty days of receipt.\n"
)


@pytest.fixture(scope="module")
def documents(spark):
    rows = spark.createDataFrame(
        [
            ("a/ml.txt", TEXT, "u1"),
            ("b/page.html", "<h1>Termination</h1><p>Either party may end this contract.</p>", "u2"),
            ("c/empty.txt", " \n \n", "u1"),
            ("d/marks.txt", "words here.\n" + "* * *" + "\nTitle Now\n***", "u2"),
        ],
        "uri string, content string, user_id string",
    )
    return cw.documents_from_table(rows, "uri", "content", metadata=["user_id"])


@pytest.fixture(scope="module")
def stored(spark, documents):
    import uuid

    from chunkwell.session import shared_dir

    root = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    report = cw.ingest_documents(
        documents, root, "demo", metadata_fields={"team": "x", "user_id": "all"}, max_chunk_size=200,
        chunk_overlap=20,
    )
    return root, report


def test_ingest(spark, stored):
    root, report = stored
    rows = cw.read_collection(spark, root, "demo").collect()
    assert report["chunks_stored"] == len(rows)
    assert all(r.metadata == {"user_id": "all", "team": "x"} for r in rows)
    assert all(len(r.embedding) == 256 and r.embedding_model == "hashed-256" for r in rows)
    ml = sorted((r for r in rows if r.source_file == "ml.txt"), key=lambda r: r.chunk_index)
    assert [r.chunk_index for r in ml] == list(range(ml[0].total_chunks))
    assert ml[-1].content.startswith("Payment Terms") and ml[-1].element_type == "Title"
    assert ml[0].file_size == len(TEXT) and ml[0].source_path == "a/ml.txt"
    summary = {r.doc_uri: (r.chunks_stored, r.status) for r in report["summary"].collect()}
    assert summary["c/empty.txt"] == (0, "no content")
    assert summary["a/ml.txt"] == (len(ml), "stored")
    assert summary["b/page.html"][1] == "stored"


def test_chunks_without_a_vector(spark, documents, new_dir):
    def no_titles(texts):
        return [None if "Title" in t else [1.0] for t in texts]

    root = new_dir()
    report = cw.ingest_documents(documents, root, "c", fn=no_titles)
    summary = {r.doc_uri: r for r in report["summary"].collect()}
    assert summary["d/marks.txt"].status == "embedding count differs from chunk count"
    assert summary["d/marks.txt"].cause == "no embedding" and report["chunks_lost"] == 1
    assert summary["a/ml.txt"].status == "stored" and summary["a/ml.txt"].cause is None
    [lost] = cw.read_lost(spark, root, "c").collect()
    assert lost.document_url == "d/marks.txt" and "Title" in lost.content and lost.cause == "no embedding"
    strict = new_dir()
    with pytest.raises(Exception, match="no embedding for a chunk of d/marks.txt"):
        cw.ingest_documents(documents, strict, "c", fn=no_titles, strict=True)
    assert cw.read_collection(spark, strict, "c").count() == 0
    again = cw.ingest_documents(documents, root, "c", fn=lambda texts: [None] * len(texts))
    got = {r.doc_uri: r for r in again["summary"].collect()}
    assert got["a/ml.txt"].status == "embedding count differs from chunk count"
    assert got["a/ml.txt"].chunks_made > 0 == got["a/ml.txt"].chunks_stored


def test_stored_documents_are_skipped_before_they_are_embedded(spark, new_dir):
    def docs(*rows):
        return spark.createDataFrame(list(rows), "doc_uri string, content string")

    calls = spark.sparkContext.accumulator(0)

    def model(texts):
        calls.add(len(texts))
        return [[1.0, float(len(t))] for t in texts]

    root = new_dir()
    cw.ingest_documents(docs(("a", "one"), ("b", "two")), root, "c", fn=model)
    before = calls.value
    second = docs(("a", "one"), ("b", "two, longer now"), ("c", "three"), ("d", " "))
    report = cw.ingest_documents(second, root, "c", fn=model, mode="skip_existing")
    status = {r.doc_uri: r.status for r in report["summary"].collect()}
    assert status == {"a": "skipped", "b": "stored", "c": "stored", "d": "no content"}
    assert calls.value - before == 2
    with pytest.raises(Exception, match="stored with other content: b"):
        cw.ingest_documents(
            docs(("b", "third")), root, "c", fn=model, mode="skip_existing", changed="error"
        )


def test_a_batch_of_a_stream_is_stored_once(spark, new_dir):
    import shutil

    landing, root, state = new_dir(), new_dir(), new_dir()
    spark.createDataFrame([("hello there",)], "value string").coalesce(1).write.text(landing)
    cw.ingest_incremental(spark, landing, root, "c", checkpoint=state).awaitTermination()
    assert cw.read_collection(spark, root, "c").count() == 1
    # a crash after the write and before the commit: the batch comes once more
    shutil.rmtree(f"{state.removeprefix('file:')}/commits")
    cw.ingest_incremental(spark, landing, root, "c", checkpoint=state).awaitTermination()
    assert cw.read_collection(spark, root, "c").count() == 1


def test_a_half_stored_batch_comes_again_whole(spark, new_dir):
    import shutil
    from pathlib import Path

    landing, root, state = new_dir(), new_dir(), new_dir()
    texts = spark.createDataFrame([(f"text number {k}",) for k in range(3)], "value string")
    texts.repartition(3).write.text(landing)
    cw.ingest_incremental(spark, landing, root, "c", checkpoint=state).awaitTermination()
    # the crash: files of one document in place, the marker not, the batch not committed
    files = sorted(Path(root).glob("collection_name=c/*/*.parquet"))
    assert len(files) == 3
    for file in files[1:]:
        file.unlink()
    shutil.rmtree(f"{root}/_finished")
    shutil.rmtree(f"{state}/commits")
    assert cw.read_collection(spark, root, "c").count() == 0  # no reader sees half
    cw.ingest_incremental(spark, landing, root, "c", checkpoint=state).awaitTermination()
    rows = cw.read_collection(spark, root, "c")
    assert sorted(r.content for r in rows.collect()) == [f"text number {k}" for k in range(3)]
    assert len(cw.remove_unfinished(spark, root)) == 0  # too young
    assert len(cw.remove_unfinished(spark, root, older_than=-60)) == 1
    assert cw.read_collection(spark, root, "c").count() == 3
    assert len(list(Path(root).glob("collection_name=c/*"))) == 1


def test_an_ingest_is_stored_once_however_often_it_is_tried(spark, new_dir, documents):
    import shutil
    from pathlib import Path

    root = new_dir()
    first = cw.ingest_documents(documents, root, "c", ingest_id="monday")
    again = cw.ingest_documents(documents, root, "c", ingest_id="monday")
    assert again["already_stored"] and not first["already_stored"]
    assert again["chunks_stored"] == first["chunks_stored"] == cw.read_collection(spark, root, "c").count()
    assert {tuple(r) for r in again["summary"].collect()} == {tuple(r) for r in first["summary"].collect()}
    # two attempts that both end: one of them counts
    shutil.move(f"{root}/_finished", f"{root}/_aside")
    cw.ingest_documents(documents, root, "c", ingest_id="monday")
    for marker in Path(f"{root}/_aside").glob("[!.]*"):
        shutil.copy(marker, f"{root}/_finished")
    assert cw.read_collection(spark, root, "c").count() == first["chunks_stored"]
    before = cw.read_collection(spark, root, "c")
    cw.ingest_documents(documents, root, "c", ingest_id="tuesday")
    assert before.count() == first["chunks_stored"]  # a reader keeps what it saw


def test_incomplete_documents_are_mended(spark, new_dir):
    long = "\n\n".join(f"Paragraph {k} has words enough to fill a chunk on its own." for k in range(4))
    rows = spark.createDataFrame([("a", long), ("b", "sound text"), ("c", "also sound")], "doc_uri string, content string")
    calls = spark.sparkContext.accumulator(0)

    def broken(texts):
        return [None if "Paragraph 2" in t else [1.0, 2.0] for t in texts]

    def sound(texts):
        calls.add(len(texts))
        return [[1.0, 2.0] for _ in texts]

    root = new_dir()
    options = {"max_chunk_size": 70, "chunk_overlap": 0, "mode": "skip_existing"}
    first = cw.ingest_documents(rows, root, "c", fn=broken, **options)
    assert (first["chunks_stored"], first["chunks_lost"]) == (5, 1)
    more = rows.unionByName(spark.createDataFrame([("d", "new")], rows.schema))
    report = cw.ingest_documents(more, root, "c", fn=sound, **options)
    assert report["chunks_stored"] == calls.value == 2
    got = {r.doc_uri: (r.chunks_made, r.status) for r in report["summary"].collect()}
    assert got == {"a": (1, "stored"), "b": (0, "skipped"), "c": (0, "skipped"), "d": (1, "stored")}
    stored = cw.read_collection(spark, root, "c").where("document_url = 'a'").collect()
    assert sorted(r.chunk_index for r in stored) == [0, 1, 2, 3]
    assert cw.read_lost(spark, root, "c").count() == 0
    third = cw.ingest_documents(more, root, "c", fn=sound, **options)
    assert third["chunks_stored"] == 0 and {r.status for r in third["summary"].collect()} == {"skipped"}


def test_a_text_the_model_fails_on_fails_its_document_only(spark, new_dir):
    def model(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("service said no")
        return [[1.0] for _ in texts]

    rows = [(f"d{k}", "bad text" if k == 3 else f"text {k}") for k in range(7)] + [("junk", "---"), ("blank", " ")]
    docs = spark.createDataFrame(rows, "doc_uri string, content string").coalesce(1)
    root = new_dir()
    report = cw.ingest_documents(docs, root, "c", fn=model)
    got = {r.doc_uri: (r.status, r.cause) for r in report["summary"].collect()}
    assert got.pop("d3") == ("embedding count differs from chunk count", "RuntimeError: service said no")
    assert got.pop("blank") == ("no content", None)
    assert set(got.values()) == {("stored", None)}
    # the default model has no vector for a text without letters or digits
    report = cw.ingest_documents(docs, new_dir(), "c")
    got = {r.doc_uri: r.cause for r in report["summary"].collect()}
    assert got["junk"] == "no embedding" and report["chunks_stored"] == 7


def test_skipping_moves_no_contents_of_known_documents(spark, new_dir, plan_of):
    from chunkwell.plans.ingest import _by_state, document_states

    docs = spark.createDataFrame([(f"d{k}", f"text {k} " * 50) for k in range(2_000)], "doc_uri string, content string")
    root = new_dir()
    cw.ingest_documents(docs.where("doc_uri < 'd5'"), root, "c", fn=lambda texts: [[1.0] for _ in texts])
    stored = cw.read_collection(spark, root, "c")
    states = document_states(docs, stored, "c")
    fresh, partly, skipped = _by_state(docs, states, "c")
    assert partly is None and fresh.count() + skipped.count() == 2_000
    assert fresh.where("doc_uri < 'd5'").count() == 0


@pytest.fixture(scope="module")
def requests(spark):
    return spark.createDataFrame(
        [
            (1, "When are invoices payable?", 5, 0.5),
            (2, "who may end this contract", 1, 0.0),
            (3, "  ", 5, 0.5),
            (4, "zebra xylophone", 5, 0.99),
            (5, "machine learning", 51, 0.5),
            (6, "linear regression and decision trees", 2, None),
        ],
        "query_id int, query_text string, limit int, similarity_threshold double",
    )


def test_search(spark, stored, requests):
    collection = cw.read_collection(spark, stored[0], "demo")
    got = {}
    for r in cw.search_documents(collection, requests).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == {1, 2, 6}
    assert "thirty days" in got[1][0].content and len(got[2]) == 1 and len(got[6]) == 2
    assert "party may end" in got[2][0].excerpt
    assert "team: x" in got[1][0].source and "collection_name: demo" in got[1][0].source
    filtered = cw.search_documents(collection, requests, metadata_filter={"source_file": "page.html"})
    assert {r.source_file for r in filtered.collect()} == {"page.html"}
    errors = {r.query_id: r.error for r in cw.validate_requests(requests).collect()}
    assert [q for q, e in errors.items() if e] == [3, 5]


def test_search_in_every_collection(spark, stored, documents, requests):
    cw.ingest_documents(documents, stored[0], "second")
    both = cw.read_all(spark, stored[0]).where(F.col("collection_name").isin("demo", "second"))
    found = cw.search_documents(both, requests, group_col="collection_name")
    first = found.where("query_id = 1 and rank = 1").collect()
    assert {r.collection_name for r in first} == {"demo", "second"}
    assert all("thirty days" in r.content for r in first)


@pytest.mark.parametrize("limit,threshold", [(0, 0.5), (51, 0.5), (5, 1.5), (5, -0.1)])
def test_wrong_settings_for_all(spark, stored, requests, limit, threshold):
    with pytest.raises(ValueError):
        cw.search_documents(requests, requests, limit, threshold)


def test_questions(spark, stored):
    collection = cw.read_collection(spark, stored[0], "demo")
    questions = spark.createDataFrame(
        [(1, "When are invoices payable?"), (2, "zebra xylophone"), (3, " ")],
        "query_id int, query_text string",
    )

    def model(pairs):
        return [f"{user.count('[Excerpt')} excerpts" for _, user in pairs]

    rows = cw.query_contract(collection, questions, "demo", 2, 0.55, answer_fn=model).collect()
    got = {r.query_id: r for r in rows}
    assert len(rows) == 3
    assert got[1].answer == f"{got[1].sources_consulted} excerpts" and "(from ml.txt, page 1)" in got[1].context
    assert got[1].advice is None and len(got[1].similarity_scores.split(", ")) == got[1].sources_consulted
    for q in (2, 3):
        assert got[q].answer is None and got[q].user_prompt is None and got[q].advice
        assert got[q].sources_consulted == 0


def test_ingest_has_no_shuffle(spark, documents, plan_of):
    assert "Exchange" not in plan_of(cw.prepare_chunks(documents))


def test_summary_counts_stages(spark):
    def docs(*names):
        return spark.createDataFrame([(n,) for n in names], "doc_uri string")

    vectors = spark.createDataFrame(
        [("a", [1.0]), ("a", [1.0]), ("a", None), ("b", [1.0])], "doc_uri string, embedding array<float>"
    )
    got = cw.ingest_summary(docs("a", "b", "c"), docs("a", "a", "a", "b", "x"), vectors, docs("a", "b"))
    assert {tuple(r) for r in got.collect()} == {
        ("a", 3, 2, 1, "embedding count differs from chunk count"),
        ("b", 1, 1, 1, "stored"),
        ("c", 0, 0, 0, "no content"),
    }


def test_functions_travel_without_the_package():
    """Python workers do not need the package installed: nothing refers to it by name."""
    by_name = cloudpickle.cloudpickle._should_pickle_by_reference
    assert not by_name(cw.operators.search.local_top_k)
    assert not by_name(cw.functions.hashing.hashed_model)
