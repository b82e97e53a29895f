"""Document retrieval on Spark: chunk, embed, store and search text at scale."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value, so executors
# need pyspark, numpy and pyarrow, but not the package itself.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from chunkwell.functions.metadata import merge_metadata, merged_view, string_map  # noqa: E402
from chunkwell.operators.ann import build_index, search_ann  # noqa: E402
from chunkwell.operators.chunking import (  # noqa: E402
    chunk_basic,
    chunk_by_title,
    chunk_documents,
    chunk_metadata,
    chunk_params_by_type,
    chunk_windows,
)
from chunkwell.operators.elements import (  # noqa: E402
    element_rows,
    partition_documents,
    partition_html,
    partition_text,
    table_cells,
)
from chunkwell.operators.embedding import (  # noqa: E402
    clean_texts,
    embed_hashed,
    embed_queries,
    embed_texts,
    validate_embeddings,
)
from chunkwell.operators.learned import (  # noqa: E402
    build_learned_index,
    extend_learned_index,
    merge_learned_index,
    search_learned,
)
from chunkwell.operators.requests import check_request, validate_requests  # noqa: E402
from chunkwell.operators.results import (  # noqa: E402
    answer_summary,
    apply_model,
    build_context,
    build_prompts,
    format_hits,
    source_attribution,
)
from chunkwell.operators.routing import index_coverage, route_collection  # noqa: E402
from chunkwell.operators.search import (  # noqa: E402
    fetch_rows,
    filter_hits,
    search_batch,
    search_collections,
    similarity_score,
    threshold_filter,
    unmatched_queries,
    vector_search,
)
from chunkwell.plans.ingest import ingest_documents, ingest_summary, prepare_chunks  # noqa: E402
from chunkwell.plans.question import query_contract  # noqa: E402
from chunkwell.plans.search import search_documents  # noqa: E402
from chunkwell.session import configure  # noqa: E402
from chunkwell.sources.collections import (  # noqa: E402
    catalog,
    collection_stats,
    list_collections,
    read_all,
    read_collection,
    read_lost,
    storage_stats,
    store_chunks,
)
from chunkwell.sources.commits import remove_unfinished  # noqa: E402
from chunkwell.sources.documents import (  # noqa: E402
    documents_from_table,
    read_documents,
    read_records,
    spread,
)
from chunkwell.sources.uris import classify_sources, infer_source_name  # noqa: E402
from chunkwell.streaming.ingest import ingest_incremental  # noqa: E402

__all__ = [
    "answer_summary",
    "apply_model",
    "build_context",
    "build_index",
    "build_learned_index",
    "build_prompts",
    "check_request",
    "chunk_basic",
    "chunk_by_title",
    "chunk_documents",
    "chunk_metadata",
    "chunk_params_by_type",
    "chunk_windows",
    "classify_sources",
    "clean_texts",
    "catalog",
    "collection_stats",
    "configure",
    "documents_from_table",
    "element_rows",
    "embed_hashed",
    "embed_queries",
    "embed_texts",
    "extend_learned_index",
    "fetch_rows",
    "filter_hits",
    "format_hits",
    "index_coverage",
    "infer_source_name",
    "ingest_documents",
    "ingest_incremental",
    "ingest_summary",
    "list_collections",
    "merge_learned_index",
    "merge_metadata",
    "merged_view",
    "partition_documents",
    "partition_html",
    "partition_text",
    "prepare_chunks",
    "query_contract",
    "read_all",
    "read_collection",
    "read_lost",
    "remove_unfinished",
    "read_documents",
    "read_records",
    "route_collection",
    "search_ann",
    "search_batch",
    "search_collections",
    "search_documents",
    "search_learned",
    "similarity_score",
    "source_attribution",
    "storage_stats",
    "spread",
    "store_chunks",
    "string_map",
    "threshold_filter",
    "table_cells",
    "unmatched_queries",
    "validate_embeddings",
    "validate_requests",
    "vector_search",
]
