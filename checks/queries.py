"""One query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import chunkwell as cw
from checks.tables import (
    CORPUS,
    corpus,
    corpus_root,
    doc_number,
    documents,
    fresh_dir,
    last_vector,
    plain,
    questions,
    table,
    texts,
    vector_queries,
    vectors,
)
from chunkwell.operators.ann import index_rows, read_index
from chunkwell.operators.learned import read_learned_index
from chunkwell.plans.search import ranked_chunks
from chunkwell.session import written

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = lambda spark, sf_dir: plain(fn(spark, sf_dir))
    return fn


# sources and sinks ---------------------------------------------------------


@query
def read_documents(spark, sf_dir):
    """Text files written by Spark, read back as documents and taken apart."""
    root = fresh_dir(spark)
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows.write.option("maxRecordsPerFile", 500).json(root)
    lines = cw.read_documents(spark, root).select(
        "format", F.explode(F.split("content", "\n")).alias("line")
    )
    parsed = F.from_json("line", "doc_id bigint, text string")
    return (
        lines.where("line != ''")
        .select("format", parsed.alias("r"))
        .select("format", "r.doc_id", "r.text")
    )


@query
def classify_sources(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return cw.classify_sources(pages, "url")


@query
def infer_source_name(spark, sf_dir):
    return cw.infer_source_name(table(spark, sf_dir, "pages").select("page_id", "url"))


def _labelled_chunks(spark, sf_dir):
    """Vectors as chunks of one document per label, named after it."""
    return vectors(spark, sf_dir).select(
        F.col("vec_id").cast("string").alias("chunk_id"),
        F.concat(F.lit("label/"), "label").alias("document_url"),
        F.col("vec_id").cast("int").alias("chunk_index"),
        F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("content"),
        "embedding",
        F.concat(F.lit("label_"), F.col("label").cast("string")).alias("name"),
    )


@query
def store_chunks(spark, sf_dir):
    root = fresh_dir(spark)
    report = cw.store_chunks(
        _labelled_chunks(spark, sf_dir), root, "vectors", {"batch": "first"}
    )
    return cw.read_all(spark, root).select(
        "chunk_id",
        "collection_name",
        "document_url",
        "content",
        F.size("embedding").alias("dims"),
        F.col("metadata")["batch"].alias("batch"),
        "logical_size",
        F.lit(report["chunks_stored"]).cast("bigint").alias("chunks_stored"),
    )


@query
def read_collection(spark, sf_dir):
    root = fresh_dir(spark)
    cw.store_chunks(_labelled_chunks(spark, sf_dir), root, F.col("name"))
    return cw.read_collection(spark, root, "label_3").select(
        "chunk_id", "collection_name", "content"
    )


@query
def ingest_incremental(spark, sf_dir):
    """Files of fifty documents each, ingested by a stream that stops when done."""
    landing, root, state = (fresh_dir(spark) for _ in range(3))
    files = texts(spark, sf_dir).withColumn("file_no", F.floor(F.col("doc_id") / 50))
    (
        files.repartition("file_no")
        .sortWithinPartitions("file_no", "doc_id")
        .select("file_no", "content")
        .write.partitionBy("file_no")
        .text(landing)
    )
    cw.ingest_incremental(
        spark, f"{landing}/*", root, "stream", checkpoint=state, max_files_per_trigger=5000
    ).awaitTermination()
    return cw.read_collection(spark, root, "stream").select(
        F.regexp_extract("document_url", r"file_no=(\d+)", 1).cast("bigint").alias("doc_id"),
        "chunk_index",
        "content",
        "element_type",
        "page_number",
    )


@query
def live_collection(spark, sf_dir):
    """Even documents ingested by batch, odd ones in files by a stream, into one collection.

    The batch comes twice and is skipped the second time.
    """
    landing, root, state = (fresh_dir(spark) for _ in range(3))
    odd = texts(spark, sf_dir).where("doc_id % 2 = 1").withColumn("file_no", F.floor(F.col("doc_id") / 50))
    (
        odd.repartition("file_no")
        .sortWithinPartitions("file_no", "doc_id")
        .select("file_no", "content")
        .write.partitionBy("file_no")
        .text(landing)
    )
    even = documents(spark, sf_dir).where(doc_number("doc_uri") % 2 == 0)
    cw.ingest_documents(even, root, "live")
    cw.ingest_incremental(spark, f"{landing}/*", root, "live", checkpoint=state).awaitTermination()
    again = cw.ingest_documents(even, root, "live", mode="skip_existing")
    if again["chunks_stored"]:
        raise ValueError("documents were stored twice")
    file_no = F.regexp_extract("document_url", r"file_no=(\d+)", 1)
    number = F.when(file_no != "", -1 - file_no.try_cast("bigint")).otherwise(doc_number())
    return cw.read_collection(spark, root, "live").select(
        number.alias("doc_id"), "chunk_index", "content", "element_type", "page_number"
    )


# partitioning and chunking ---------------------------------------------------


@query
def partition_text(spark, sf_dir):
    return cw.element_rows(cw.partition_text(texts(spark, sf_dir)))


@query
def partition_html(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("content"))
    pages = cw.spread(pages)
    parted = cw.partition_html(pages)
    titles = F.filter("elements", lambda e: e["category"] == "Title")
    return parted.select(
        "page_id",
        F.array_join(F.transform(titles, lambda e: e["text"]), " | ").alias("titles"),
        F.size(F.filter("elements", lambda e: e["category"] == "ListItem")).alias("list_items"),
    )


@query
def html_elements(spark, sf_dir):
    """All elements of every page in order."""
    pages = cw.spread(table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("content")))
    shown = F.transform("elements", lambda e: F.concat_ws(": ", e["category"], e["text"]))
    return cw.partition_html(pages).select("page_id", F.array_join(shown, "\n").alias("elements"))


@query
def html_tables(spark, sf_dir):
    """Tables made of every page's links, with spans, missing end tags and a heading that ends them."""
    items = F.regexp_extract_all("html", F.lit('<li><a href="[^"]*">([^<&]*)</a></li>'), F.lit(1))
    pages = cw.spread(table(spark, sf_dir, "pages").select("page_id", items.alias("items")))
    rows = F.transform(
        "items",
        lambda item, k: F.concat(
            F.lit("<tr><td>"), item, F.lit("<td>"), F.length(item).cast("string"),
            F.when(k == 0, F.concat(F.lit('<td rowspan="99">'), F.size("items").cast("string"))).otherwise(""),
        ),
    )
    end = F.when(F.col("page_id") % 2 == 0, "</table>").otherwise("</tr>")
    html = F.concat(
        F.lit('<p>before<table><thead><tr><th colspan="2">'), F.col("page_id").cast("string"),
        F.lit("<th>side<tbody>"), F.array_join(rows, ""), end, F.lit("<h1>after</h1>"),
    )
    parted = cw.partition_html(pages.select("page_id", html.alias("content")), tables=True)
    return cw.table_cells(parted)


_CHUNK_COLUMNS = ("doc_id", "chunk_index", "content", "element_type", "page_number")


@query
def chunk_basic(spark, sf_dir):
    return cw.chunk_basic(cw.partition_text(texts(spark, sf_dir))).select(*_CHUNK_COLUMNS)


@query
def chunk_by_title(spark, sf_dir):
    return cw.chunk_by_title(cw.partition_text(texts(spark, sf_dir))).select(*_CHUNK_COLUMNS)


@query
def chunk_windows(spark, sf_dir):
    return cw.chunk_windows(texts(spark, sf_dir))


@query
def chunk_metadata(spark, sf_dir):
    """Windows of the raw text as chunks: stripped, numbered and described."""
    from chunkwell.functions.text import sliding_windows

    raw = texts(spark, sf_dir).withColumn(
        "chunks",
        F.transform(
            sliding_windows(F.col("content"), 100, 20),
            lambda w: F.struct(
                w.alias("content"),
                F.lit("NarrativeText").alias("element_type"),
                F.lit(1).alias("page_number"),
            ),
        ),
    )
    return cw.chunk_metadata(raw, "windows")


@query
def chunk_params_by_type(spark, sf_dir):
    """Window sizes that depend on the document, here by language."""
    typed = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(F.col("lang") == "en", "contracts")
        .when(F.col("lang") == "de", "reports")
        .otherwise(F.col("lang"))
        .alias("document_type"),
        F.col("text").alias("content"),
    )
    sized = cw.chunk_params_by_type(typed)
    return cw.chunk_windows(sized, F.col("max_chunk_size"), F.col("chunk_overlap")).select(
        "doc_id", "document_type", "chunk_index", "content"
    )


@query
def merge_metadata(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    low = F.create_map(
        F.lit("lang"), "lang", F.lit("source"), "source",
        F.lit("quality"), F.lit("unknown"), F.lit("n_chars"), F.col("n_chars").cast("string"),
    )
    high = F.create_map(
        F.lit("source"), F.upper("source"), F.lit("quality"), F.col("quality").cast("string")
    )
    merged = F.array_sort(F.map_entries(cw.merge_metadata(low, high)))
    shown = F.transform(
        merged, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("NULL")))
    )
    return rows.select("doc_id", F.array_join(shown, ";").alias("fields"))


@query
def ingest_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doc_uri"), F.col("text").alias("content")
    )
    parted = cw.partition_text(docs)
    chunks = cw.embed_hashed(cw.chunk_basic(parted), keep_blank=True)
    return cw.ingest_summary(
        docs, cw.element_rows(parted), chunks, chunks.where(F.size("embedding") > 0)
    )


# embedding -------------------------------------------------------------------


@query
def clean_texts(spark, sf_dir):
    cleaned = cw.clean_texts(texts(spark, sf_dir))
    return cleaned.select("doc_id", "content", F.length("content").alias("n"))


def _letter_counts(batch: Sequence[str]) -> list[list[float]]:
    """A toy model that SQL can reproduce: length and counts of three letters."""
    return [[len(t), t.count("e"), t.count("n"), t.count("q")] for t in batch]


@query
def embed_texts(spark, sf_dir):
    embedded = cw.embed_texts(texts(spark, sf_dir), _letter_counts)
    return embedded.select(
        "doc_id",
        *[F.get("embedding", i).cast("double").alias(f"v{i}") for i in range(4)],
    )


@query
def embed_hashed(spark, sf_dir):
    """Vectors as rows of their non-zero components."""
    embedded = cw.embed_hashed(texts(spark, sf_dir), dims=64)
    return embedded.select("doc_id", F.posexplode("embedding").alias("bucket", "value")).where(
        "value != 0"
    )


@query
def embed_queries(spark, sf_dir):
    """Every turn of a conversation as a query, and blank ones besides."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.select("conv_id", "turn", F.col("text").alias("query_text"))
    blanks = turns.where("role = 'assistant'").select(
        "conv_id", (-1 - F.col("turn")).alias("turn"), F.lit("  ").alias("query_text")
    )
    embedded = cw.embed_queries(asked.union(blanks), _letter_counts)
    return embedded.select(
        "conv_id",
        "turn",
        F.size("embedding").alias("dims"),
        F.get("embedding", 1).cast("double").alias("v1"),
    )


@query
def validate_embeddings(spark, sf_dir):
    """Documents against vectors of the same number, odd labels of another width."""
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"))
    given = vectors(spark, sf_dir).select(
        F.col("vec_id").alias("chunk_id"),
        F.when(F.col("label") % 2 == 1, F.slice("embedding", 1, 32))
        .otherwise(F.col("embedding"))
        .alias("embedding"),
    )
    return cw.validate_embeddings(chunks, given, dims=64)


# vector search ---------------------------------------------------------------


def _single(spark, sf_dir, *args, **options):
    return cw.vector_search(
        vectors(spark, sf_dir), last_vector(spark, sf_dir), *args,
        id_col="vec_id", columns=["vec_id", "label"], **options,
    )


@query
def vector_search(spark, sf_dir):
    return _single(spark, sf_dir, 10)


@query
def similarity_score(spark, sf_dir):
    """The expression form, for every vector against the last one."""
    last = F.array(*[F.lit(float(x)) for x in last_vector(spark, sf_dir)])
    return vectors(spark, sf_dir).select(
        "vec_id",
        cw.similarity_score(F.col("embedding"), last).alias("similarity_score"),
        cw.similarity_score(F.col("embedding"), last, "cosine").alias("cosine"),
    )


@query
def threshold_filter(spark, sf_dir):
    return cw.threshold_filter(_single(spark, sf_dir, 50), 0.68)


@query
def filter_post(spark, sf_dir):
    return _single(spark, sf_dir, 50, 0.6, {"metadata.label": 3})


@query
def filter_post_list(spark, sf_dir):
    return _single(spark, sf_dir, 50, 0.6, {"label": [1, 3, 8]})


@query
def filter_pre_range(spark, sf_dir):
    """A range on a column and a boolean among the caller's own fields."""
    even = F.create_map(F.lit("even"), (F.col("vec_id") % 2 == 0).cast("string"))
    rows = vectors(spark, sf_dir).withColumn("metadata", even)
    hits = cw.vector_search(
        rows, last_vector(spark, sf_dir), 50, None,
        {"label": {"gte": 3, "lt": 6}, "metadata.even": True}, filter_mode="pre",
        id_col="vec_id", columns=["vec_id", "label"],
    )
    return hits.select("vec_id", "label", "similarity_score")


@query
def filter_promoted(spark, sf_dir):
    """Filters on a stored collection whose caller fields are columns as well, some nested ones too."""
    root = fresh_dir(spark)
    chunks = _labelled_chunks(spark, sf_dir).withColumn(
        "metadata", F.create_map(F.lit("label"), F.regexp_extract("name", r"(\d+)", 1))
    )
    half = chunks.where("chunk_index % 2 = 0"), chunks.where("chunk_index % 2 = 1")
    cw.store_chunks(half[0], root, "c", {"place": {"town": "x"}, "page_number": 3}, promote=["label", "place.town"])
    cw.store_chunks(half[1], root, "c", {"place": {"town": "y"}})
    stored = cw.read_collection(spark, root, "c")
    hits = cw.search_batch(
        stored, vector_queries(spark, sf_dir), 3, None, {"label": ["1", "3"], "place.town": "x", "page_number": 3},
        filter_mode="pre",
    )
    return hits.withColumn("vec_id", F.col("chunk_id").cast("bigint")).drop("chunk_id")


@query
def filter_pre(spark, sf_dir):
    return _single(spark, sf_dir, 50, 0.6, {"label": 3}, filter_mode="pre")


@query
def search_batch(spark, sf_dir):
    return cw.search_batch(
        vectors(spark, sf_dir), vector_queries(spark, sf_dir), 5, 0.65, id_col="vec_id",
        columns=["label"],
    )


@query
def search_batch_filtered(spark, sf_dir):
    """A filter after the ranking closes ranks but pulls nothing in."""
    return cw.search_batch(
        vectors(spark, sf_dir), vector_queries(spark, sf_dir), 10,
        metadata_filter={"label": 3}, id_col="vec_id",
    )


def _indexed(spark, sf_dir, probes):
    root = fresh_dir(spark)
    cw.build_index(
        vectors(spark, sf_dir), root, "vectors", 64, bits=6, id_col="vec_id",
        filter_columns=["label"],
    )
    return cw.search_ann(
        spark, root, "vectors", vector_queries(spark, sf_dir), 5, probes=probes, id_col="vec_id"
    )


@query
def search_ann(spark, sf_dir):
    """Recall of the default probes, per query, against the exact result."""
    found = _indexed(spark, sf_dir, None).select("query_id", "vec_id", F.lit(1).alias("hit"))
    exact = cw.search_batch(
        vectors(spark, sf_dir), vector_queries(spark, sf_dir), 5, id_col="vec_id"
    )
    return (
        exact.join(found, ["query_id", "vec_id"], "left")
        .groupBy("query_id")
        .agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    )


@query
def search_ann_all_buckets(spark, sf_dir):
    """With all buckets probed the index gives the exact result."""
    return _indexed(spark, sf_dir, 64)


def _given_centres(spark, sf_dir):
    rows = vectors(spark, sf_dir).where("vec_id < 16").orderBy("vec_id").select("embedding")
    return [r[0] for r in rows.collect()]


def _with_given_centres(spark, sf_dir):
    root = fresh_dir(spark)
    cw.build_learned_index(
        vectors(spark, sf_dir), root, "vectors", 64, centroids=_given_centres(spark, sf_dir), id_col="vec_id",
        filter_columns=["label"],
    )
    return root


@query
def search_learned(spark, sf_dir):
    """Four of sixteen lists, whose centres are vectors of the table."""
    root = _with_given_centres(spark, sf_dir)
    return cw.search_learned(spark, root, "vectors", vector_queries(spark, sf_dir), 5, 0.6, probes=4)


@query
def build_learned_index(spark, sf_dir):
    """The list of every vector."""
    root = _with_given_centres(spark, sf_dir)
    return read_learned_index(spark, root, "vectors").select("vec_id", "label", F.col("list_no").cast("bigint").alias("list_no"))


@query
def search_learned_recall(spark, sf_dir):
    """Fitted centres in two levels and the default number of cells, against the exact result."""
    root = fresh_dir(spark)
    rows, asked = vectors(spark, sf_dir), vector_queries(spark, sf_dir)
    cw.build_learned_index(rows, root, "vectors", 64, fine=2, id_col="vec_id")
    found = cw.search_learned(spark, root, "vectors", asked, 5).select("query_id", "vec_id", F.lit(1).alias("hit"))
    exact = cw.search_batch(rows, asked, 5, id_col="vec_id").join(found, ["query_id", "vec_id"], "left")
    recall = exact.agg((F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("recall_reached"), F.count_distinct("query_id").alias("queries"))
    held = read_learned_index(spark, root, "vectors").agg(F.count(F.lit(1)).alias("rows_indexed"))
    return recall.crossJoin(held)


@query
def index_segments(spark, sf_dir):
    """An index that follows ingests: rows are found before they have a segment, then in it, then merged."""
    root, place = fresh_dir(spark), fresh_dir(spark)
    chunks = _labelled_chunks(spark, sf_dir)
    asked = vector_queries(spark, sf_dir)
    cw.store_chunks(chunks.where("chunk_index % 2 = 0"), root, "vectors")
    cw.build_learned_index(cw.read_collection(spark, root, "vectors"), place, "vectors", 64, lists=8)
    cw.store_chunks(chunks.where("chunk_index % 2 = 1"), root, "vectors")
    stored = cw.read_collection(spark, root, "vectors")

    def found(state):
        hits = cw.search_learned(spark, place, "vectors", asked, 5, probes=8, collection=stored)
        return written(hits.withColumn("state", F.lit(state)))

    states = [found("not indexed")]
    cw.extend_learned_index(stored, place, "vectors")
    states.append(found("two segments"))
    cw.merge_learned_index(spark, place, "vectors")
    states.append(found("merged"))
    rows = states[0].union(states[1]).union(states[2])
    return rows.withColumn("vec_id", F.col("chunk_id").cast("bigint")).drop("chunk_id")


@query
def search_collections(spark, sf_dir):
    coll = vectors(spark, sf_dir).withColumn(
        "collection_name", F.concat(F.lit("part_"), (F.col("label") % 3).cast("string"))
    )
    return cw.search_collections(
        coll, vector_queries(spark, sf_dir), ["part_0", "part_2"], 3, id_col="vec_id"
    )


@query
def unmatched_queries(spark, sf_dir):
    """Vectors of small labels searched among those of large ones."""
    queries = vectors(spark, sf_dir).where("label < 5").select(
        F.col("vec_id").alias("query_id"), "embedding"
    )
    hits = cw.search_batch(
        vectors(spark, sf_dir), queries, 5, 0.68, F.col("label") >= 5, filter_mode="pre",
        id_col="vec_id",
    )
    return cw.unmatched_queries(queries.select("query_id"), hits)


@query
def validate_requests(spark, sf_dir):
    """Requests made of all conversation turns, good and bad ones, and blank ones besides."""
    n = F.length("text")
    turns = table(spark, sf_dir, "conversations")
    requests = turns.select(
        "conv_id",
        "turn",
        F.col("text").alias("query_text"),
        (n % 60 - 4).alias("limit"),
        ((n % 14 - 1) / 10.0).alias("similarity_threshold"),
    )
    blanks = turns.where("turn % 5 = 4").select(
        "conv_id", (-1 - F.col("turn")).alias("turn"), F.lit(" \t "), F.lit(5), F.lit(0.5)
    )
    checked = cw.validate_requests(requests.union(blanks))
    return checked.select("conv_id", "turn", "limit", "error")


# results and prompts -----------------------------------------------------------


def _hits(spark, sf_dir, limit=3, threshold=0.7, max_limit=10):
    return ranked_chunks(
        corpus(spark, sf_dir), questions(spark, sf_dir), limit, max_limit, threshold,
        columns=["content", "document_url", "chunk_index", "metadata", "source_file",
                 "page_number"],
    )


@query
def format_hits(spark, sf_dir):
    hits = _hits(spark, sf_dir).drop("source_file", "page_number")
    return cw.format_hits(hits).select("query_id", "rank", "score", "excerpt", "source")


@query
def source_attribution(spark, sf_dir):
    return cw.source_attribution(_hits(spark, sf_dir)).select("query_id", "rank", "attribution")


@query
def build_context(spark, sf_dir):
    return cw.build_context(_hits(spark, sf_dir))


@query
def build_prompts(spark, sf_dir):
    contexts = cw.build_context(_hits(spark, sf_dir)).join(
        questions(spark, sf_dir), "query_id"
    )
    return cw.build_prompts(contexts).select("query_id", "system_prompt", "user_prompt")


def _count_words(prompts: Sequence[tuple[str, str]]) -> list[str]:
    """A stand-in for a chat model that SQL can reproduce."""
    return [f"{len(user)} characters after {len(system)}" for system, user in prompts]


@query
def apply_model(spark, sf_dir):
    prompts = cw.build_prompts(
        texts(spark, sf_dir).withColumn("query_text", F.concat(F.lit("Document "), "doc_id")),
        context_col="content",
    )
    return cw.apply_model(prompts, _count_words).select("doc_id", "answer")


@query
def answer_summary(spark, sf_dir):
    return cw.answer_summary(_hits(spark, sf_dir), CORPUS)


# collections -------------------------------------------------------------------


def _routed(spark, sf_dir):
    """Documents stored as single chunks in a collection per language."""
    root = fresh_dir(spark)
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("chunk_id"),
        F.concat(F.lit("doc/"), "doc_id").alias("document_url"),
        F.lit(0).alias("chunk_index"),
        F.col("text").alias("content"),
        F.array(F.lit(1.0), F.lit(0.5)).cast("array<float>").alias("embedding"),
        F.col("lang").alias("document_type"),
    )
    cw.store_chunks(cw.route_collection(rows, "by_type"), root, F.col("collection_name"))
    return root


@query
def list_collections(spark, sf_dir):
    return cw.list_collections(spark, _routed(spark, sf_dir))


@query
def collection_stats(spark, sf_dir):
    return cw.collection_stats(cw.read_all(spark, _routed(spark, sf_dir)))


@query
def catalog(spark, sf_dir):
    """Names with statistics, a collection without rows included; bytes depend on the codec."""
    wanted = spark.createDataFrame([("empty_docs",)], "collection_name string")
    return cw.catalog(spark, _routed(spark, sf_dir), wanted).select(
        "collection_name",
        "document_count",
        "size_bytes",
        (F.col("storage_size_bytes") > 0).alias("stored"),
        (F.col("file_count") > 0).alias("one_file_or_more"),
    )


@query
def route_collection(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.nullif(F.col("lang"), F.lit("fr")).alias("document_type"),
        F.nullif(F.col("source"), F.lit("src1")).alias("user_id"),
        F.nullif(F.col("source"), F.lit("src2")).alias("tenant"),
    )
    names = F.array(*[F.lit(s) for s in ("single", "by_type", "by_user", "hybrid", "other")])
    return cw.route_collection(
        rows, F.get(names, (F.col("doc_id") % 5).cast("int"))
    ).select("doc_id", "collection_name")


@query
def index_coverage(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("document_type"), F.col("source").alias("tenant")
    )
    wanted = cw.route_collection(rows, "hybrid").select("collection_name").distinct()
    existing = cw.route_collection(rows.where("document_type != 'fr'"), "hybrid")
    return cw.index_coverage(wanted, existing)


def _written_index(spark, sf_dir, tables, bits):
    root = fresh_dir(spark)
    cw.build_index(
        vectors(spark, sf_dir), root, "vectors", 64, tables=tables, bits=bits, id_col="vec_id",
        filter_columns=["label"],
    )
    return read_index(spark, root, "vectors")


@query
def build_index(spark, sf_dir):
    """Every vector is in every table of the written index exactly once, unchanged."""
    return _written_index(spark, sf_dir, 3, 4).groupBy("vec_id", "label").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("table_no").alias("tables"),
        F.min(F.get("embedding", 0)).cast("double").alias("first_component"),
        F.max(F.get("embedding", 63)).cast("double").alias("last_component"),
    )


@query
def build_index_buckets(spark, sf_dir):
    """Rows of the written index, per table and bucket."""
    return _written_index(spark, sf_dir, 2, 4).groupBy("table_no", "bucket").agg(
        F.count(F.lit(1)).alias("vectors"), F.count_distinct("label").alias("labels")
    )


@query
def build_index_rows(spark, sf_dir):
    """The same before it is written, with more buckets than folders would do well."""
    rows = index_rows(
        vectors(spark, sf_dir), 64, tables=3, bits=8, id_col="vec_id", filter_columns=["label"]
    )
    return rows.groupBy("vec_id", "label").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("table_no").alias("tables")
    )


# end to end ----------------------------------------------------------------------


@query
def ingest_documents(spark, sf_dir):
    root = fresh_dir(spark)
    report = cw.ingest_documents(documents(spark, sf_dir), root, CORPUS)
    return cw.read_collection(spark, root, CORPUS).select(
        doc_number(),
        "chunk_index",
        "content",
        "element_type",
        "total_chunks",
        "file_size",
        "source_file",
        F.col("metadata")["lang"].alias("lang"),
        F.lit(report["chunks_stored"]).cast("bigint").alias("chunks_stored"),
    )


def _fails_at_times(batch: Sequence[str]) -> list[list[float] | None]:
    if any(len(text) % 5 == 0 for text in batch):
        raise ValueError("length")
    return [None if len(text) % 7 == 0 else [1.0, float(len(text))] for text in batch]


def _length_vectors(batch: Sequence[str]) -> list[list[float]]:
    return [[1.0, float(len(text))] for text in batch]


@query
def ingest_partial(spark, sf_dir):
    """A model that fails on some chunks, what becomes of each document, and a second ingest that mends it."""
    root = fresh_dir(spark)
    rows = documents(spark, sf_dir)
    first = cw.ingest_documents(rows, root, CORPUS, fn=_fails_at_times)
    report = first["summary"]
    lost = cw.read_lost(spark, root, CORPUS).groupBy("document_url").agg(F.count(F.lit(1)).alias("chunks_lost"))
    lost = written(report.join(lost.withColumnRenamed("document_url", "doc_uri"), "doc_uri", "left"))
    second = cw.ingest_documents(rows, root, CORPUS, fn=_length_vectors, mode="skip_existing")
    mended = second["summary"].select("doc_uri", F.col("status").alias("then"))
    held = cw.read_collection(spark, root, CORPUS).groupBy(F.col("document_url").alias("doc_uri"))
    held = held.agg(F.count(F.lit(1)).alias("chunks_held"))
    return lost.join(mended, "doc_uri").join(held, "doc_uri", "left").select(
        doc_number("doc_uri"),
        "chunks_made",
        "chunks_stored",
        F.coalesce("chunks_lost", F.lit(0)).alias("chunks_lost"),
        "status",
        "cause",
        "then",
        F.coalesce("chunks_held", F.lit(0)).alias("chunks_held"),
    )


@query
def search_documents(spark, sf_dir):
    found = cw.search_documents(
        corpus(spark, sf_dir), questions(spark, sf_dir), metadata_filter={"lang": "en"}
    )
    return found.select("query_id", "rank", "chunk_id", "similarity_score", "score", "excerpt")


@query
def query_contract(spark, sf_dir):
    return cw.query_contract(corpus(spark, sf_dir), questions(spark, sf_dir), CORPUS).select(
        "query_id", "context", "user_prompt", "sources_consulted", "similarity_scores", "advice"
    )


__all__ = ["REGISTRY", "corpus_root"]
