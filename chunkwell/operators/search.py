"""Vector search: exact top-k for one query or for a whole table of queries.

Order of stages, as in the original service: top-k first, then the metadata
filter, then the score threshold. ``filter_mode="pre"`` moves the metadata
filter below the top-k. The threshold never changes which rows are in front
of it, so it is applied as early as possible.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkwell.functions.metadata import metadata_predicate
from chunkwell.functions.topk import (
    SCORE_DECIMALS,
    Queries,
    local_top_k,
    score_against,
    to_matrix,
)
from chunkwell.session import written

DEFAULT_LIMIT = 5

#: A query table goes to every task only if its vectors fit in this.
BROADCAST_BYTES = 64 << 20
#: ... and all its result lists together hold at most this many entries, which
#: bounds a task's memory and makes the hits small enough to broadcast as well.
BROADCAST_HITS = 1_000_000
#: A scan is scored by at most this many tasks per core, but never chained into
#: fewer than the second number: a young cluster does not know its size yet. Each
#: task sends a list per query to the merge, so more tasks are no free choice.
TASKS_PER_CORE = 8
LEAST_TASKS = 512
#: Rows of a block pair when queries and rows are too many for whole scans, as doubles, and
#: how many times fewer its queries are. A task scores one pair, so this bounds its time, and
#: its memory: it holds the queries, rows stream past them.
BLOCK_BYTES, QUERY_SHARE = 64 << 20, 8
#: What a task of an approximate search holds of its queries, with the cells they want.
PROBE_BYTES = 32 << 20

#: Files that hold winners of a table of queries and are named to the scan of their contents.
READ_FILES = 10_000
#: Winners of a single query that come to the driver to name the files to read.
COLLECTED_WINNERS = 10_000

_FILTER_MODES = ("post", "pre")
_SCORES = ("unit", "cosine")


def _check(filter_mode: str, score: str) -> bool:
    """Validate the options; True if raw cosines are wanted."""
    if filter_mode not in _FILTER_MODES:
        raise ValueError(f"filter_mode must be one of {_FILTER_MODES}")
    if score not in _SCORES:
        raise ValueError(f"score must be one of {_SCORES}")
    return score == "cosine"


def similarity_score(a: Column, b: Column, score: str = "unit") -> Column:
    """Cosine similarity of two vector columns, as a built-in expression.

    ``(1 + cosine) / 2`` by default. NULL if a side is NULL, empty or zero;
    an error if the widths differ. The readable baseline of the block form.
    """
    raw = _check("post", score)

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norms))
    value = F.round(cosine if raw else (cosine + 1) / 2, SCORE_DECIMALS)
    differ = (F.size(a) != F.size(b)) & (F.size(a) > 0) & (F.size(b) > 0)
    return (
        F.when(differ, F.raise_error(F.lit("vectors have different widths")).cast("double"))
        .when((F.size(a) > 0) & (F.size(b) > 0) & (norms > 0) & (norms < float("inf")), value)
    )


def score_query(query_vector: Sequence[float], vector: Column, score: str = "unit") -> Column:
    """Scores of a vector column against one query, block by block in numpy.

    Only the vectors cross into Python; all other columns stay in the JVM.
    """
    raw = _check("post", score)
    query = np.asarray(query_vector, dtype=np.float64)
    norm = np.sqrt(query @ query) if query.size else 0.0
    unit = query / norm if norm > 0 else None

    @F.arrow_udf(T.DoubleType())
    def scores(vectors: pa.Array) -> pa.Array:
        if unit is None:
            return pa.nulls(len(vectors), pa.float64())
        return score_against(vectors, unit, raw)

    return scores(vector)


def threshold_filter(
    hits: DataFrame, similarity_threshold: float | None, score_col: str = "similarity_score"
) -> DataFrame:
    """Keep scores of at least the threshold; ``None`` and 0 both switch it off."""
    if not similarity_threshold:
        return hits
    return hits.where(F.col(score_col) >= similarity_threshold)


def filter_hits(
    rows: DataFrame, metadata_filter: Mapping[str, object] | Column | None
) -> DataFrame:
    """Apply a metadata filter to a collection (pre) or to its hits (post)."""
    predicate = metadata_predicate(rows, metadata_filter)
    return rows if predicate is None else rows.where(predicate)


def vector_search(
    collection: DataFrame,
    query_vector: Sequence[float],
    limit: int = DEFAULT_LIMIT,
    similarity_threshold: float | None = None,
    metadata_filter: Mapping[str, object] | Column | None = None,
    *,
    filter_mode: str = "post",
    score: str = "unit",
    id_col: str = "chunk_id",
    vector_col: str = "embedding",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Top ``limit`` rows for one query: ``content, metadata, similarity_score``.

    Every task keeps ``limit`` ids and scores (``TakeOrderedAndProject``); the
    table is never sorted. Where the collection lies in files, the winners carry
    theirs, and contents are read from those files only; the ranking then runs at
    once. Ties break by ascending id, which must be unique in the collection. The
    result comes in order.
    """
    _check(filter_mode, score)
    if limit < 1:
        raise ValueError("limit must be at least 1")
    if columns is None:
        columns = [c for c in ("content", "metadata") if c in collection.columns]
    rows = filter_hits(collection, metadata_filter) if filter_mode == "pre" else collection
    order = [F.desc_nulls_last("similarity_score"), F.asc(id_col)]
    files = has_files(collection) and limit <= COLLECTED_WINNERS
    place = [F.col("_metadata.file_path").alias("_file")] if files else []
    top = (
        few_tasks(rows.select(id_col, vector_col, *place))
        .select(
            id_col,
            score_query(query_vector, F.col(vector_col), score).alias("similarity_score"),
            *(["_file"] if files else []),
        )
        .orderBy(*order)
        .limit(limit)
        # above the limit: below it the test would score every vector twice
        .where(F.col("similarity_score").isNotNull())
    )
    top = threshold_filter(top, similarity_threshold)
    late = filter_mode == "post" and metadata_predicate(collection, metadata_filter) is not None
    wanted = [c for c in collection.columns if late or c in columns]
    if files and set(wanted) - {id_col}:
        found = top.collect()
        top = collection.sparkSession.createDataFrame(found, top.schema).drop("_file")
        read = sorted({r["_file"] for r in found})
        collection = collection.where(F.col("_metadata.file_path").isin(*read))
    elif files:
        top = top.drop("_file")
    hits = fetch_rows(top, collection, wanted, id_col, limit)
    if late:
        hits = filter_hits(hits, metadata_filter)
    if hits is not top:  # the join has lost the order
        hits = hits.orderBy(*order).limit(limit)
    return hits.select(*columns, "similarity_score")


def has_files(rows: DataFrame) -> bool:
    """Whether the rows still know the file they come from."""
    try:
        rows.select("_metadata.file_path")
    except AnalysisException:
        return False
    return True


def few_tasks(rows: DataFrame) -> DataFrame:
    """Bound the number of scoring tasks, and with it the lists to be merged.

    A task's list is as long for one split as for ten, so a very large scan is
    read in fewer, longer tasks. Splits are only chained, nothing is shuffled,
    and a scan with fewer tasks stays as it is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.coalesce(max(LEAST_TASKS, TASKS_PER_CORE * cores))


def query_rows(
    queries: DataFrame,
    limit: int | str,
    max_limit: int,
    similarity_threshold: float | str | None,
    query_id_col: str,
    query_vector_col: str,
) -> DataFrame:
    """Queries as ``query_id, vector, lim, least``, the last two maybe per query."""

    def value(given: object, kind: str) -> Column:
        column = F.col(given) if isinstance(given, str) else F.lit(given)
        return column.cast(kind)

    lim = value(limit, "bigint")
    if isinstance(limit, str):
        wrong = F.raise_error(F.lit(f"limit is outside 1 to {max_limit}")).cast("bigint")
        lim = F.when(lim.between(1, max_limit), lim).otherwise(wrong)
    return queries.select(
        F.col(query_id_col).alias("query_id"),
        F.col(query_vector_col).cast("array<float>").alias("vector"),
        lim.alias("lim"),
        value(similarity_threshold, "double").alias("least"),
    )


def _block_sizes(width: int) -> tuple[int, int]:
    """Rows and queries of a block pair at most, about."""
    rows = max(1, BLOCK_BYTES // (8 * max(1, width)))
    return rows, max(1, rows // QUERY_SHARE)


def probing_queries(width: int, cells: int, others: int = 0) -> int:
    """Queries that a task of an approximate search holds at most, with ``others`` more bytes each."""
    return max(1, min(_block_sizes(width)[1], PROBE_BYTES // (8 * width + cells + others)))


def bounded_queries(
    rows: DataFrame, width: int, max_limit: int, raw: bool, against: DataFrame | None = None, most: int | None = None
) -> Queries | None:
    """The query table in memory if it is small enough to broadcast, else None.

    The bound is checked before any vector moves. The count needs no vectors, so
    it does not run the model that makes them. With ``against``, the table that is searched,
    it is also None if many queries times all rows are more scores than a block pair has:
    the tasks of a scan do not grow in number with the queries. More than ``most`` are too many.
    """
    room = min(BROADCAST_BYTES // (8 * max(1, width)), BROADCAST_HITS // max_limit)
    n = rows.count()
    if n > room or (most is not None and n > most):
        return None
    row_block, query_block = _block_sizes(width)
    if against is not None and n > query_block and n * against.count() > row_block * query_block:
        return None
    return Queries.from_table(rows.where(F.size("vector") > 0).toArrow(), raw)


def vector_width(rows: DataFrame) -> int:
    """Width of the first usable vector of a collection, 0 if there is none."""
    first = rows.select(F.size("vector").alias("n")).where("n > 0").head()
    return first["n"] if first else 0


def hit_schema(rows: DataFrame, queries: DataFrame) -> T.StructType:
    """Columns of a local winner."""
    fields = [
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("id", rows.schema["id"].dataType),
        T.StructField("similarity_score", T.DoubleType()),
        T.StructField("lim", T.LongType()),
        T.StructField("grp", rows.schema["grp"].dataType),
    ]
    if "place" in rows.columns:
        fields.append(T.StructField("place", T.LongType()))
    return T.StructType(fields)


def broadcast_top_k(
    rows: DataFrame, queries: Queries, schema: T.StructType, probes: np.ndarray | None = None
) -> DataFrame:
    """Local winners of every task; ``rows`` holds ``(id, vector, grp)`` and maybe ``place``."""
    shared = rows.sparkSession.sparkContext.broadcast((queries.parts(), probes))

    def winners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, mask = shared.value
        yield from local_top_k(batches, Queries(*parts), mask)

    return few_tasks(rows).mapInArrow(winners, schema)


def _block_top_k(
    rows: DataFrame,
    queries: DataFrame,
    width: int,
    schema: T.StructType,
    raw: bool,
    max_limit: int = 1,
    scan: Callable[[Iterator[pa.RecordBatch], Queries], Iterator[pa.RecordBatch]] = local_top_k,
    most: int | None = None,
) -> DataFrame:
    """Local winners when the queries are too many for one task.

    Both sides get block numbers of bounded size and every pair of blocks is a partition
    of its own, which has its queries first; there are no fewer pairs than cores. Block
    numbers come from hashed ids, so no key can grow a block. ``scan`` gets a block's rows,
    ordered by group, and its queries, ``most`` or fewer.
    """
    queries = queries.where(F.size("vector") > 0)
    row_block, query_block = _block_sizes(width)
    query_block = max(1, min(query_block, BROADCAST_HITS // max_limit, most or query_block))
    asked, cores = queries.count(), rows.sparkSession.sparkContext.defaultParallelism
    row_blocks = max(1, -(-rows.count() // row_block))
    query_blocks = max(1, -(-asked // query_block), min(asked, -(-cores // row_blocks)))

    def block(column: str, blocks: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")

    def every(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    asking = ["query_id", "vector", "lim", "least"]
    left = queries.select(*asking, F.lit(0).alias("side"), block("query_id", query_blocks).alias("qb"), every(row_blocks).alias("rb"))
    right = rows.select("*", F.lit(1).alias("side"), block("id", row_blocks).alias("rb"), every(query_blocks).alias("qb"))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("pair", F.col("qb") * row_blocks + F.col("rb"))
    dealt = both.repartitionById(query_blocks * row_blocks, "pair").sortWithinPartitions("side", "grp")
    names = rows.columns

    def winners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches, held, first = iter(batches), [], []
        for batch in batches:
            n = pc.index(batch.column("side"), 1).as_py()
            n = batch.num_rows if n < 0 else n
            if n:
                held.append(batch.slice(0, n).select(asking))
            if n < batch.num_rows:
                first.append(batch.slice(n))
                break
        if held and first:
            table = pa.Table.from_batches(held)
            yield from scan((b.select(names) for b in chain(first, batches)), Queries.from_table(table, raw))

    return dealt.mapInArrow(winners, schema)


def probing_top_k(
    rows: DataFrame, queries: DataFrame, width: int, schema: T.StructType, raw: bool, max_limit: int,
    mask: Callable[[np.ndarray], np.ndarray], most: int,
) -> DataFrame:
    """Like :func:`_block_top_k`; ``mask`` says in each task which groups its queries look into."""

    def scan(batches: Iterator[pa.RecordBatch], held: Queries) -> Iterator[pa.RecordBatch]:
        return local_top_k(batches, held, mask(held.vectors))

    return _block_top_k(rows, queries, width, schema, raw, max_limit, scan, most)


def wanted_groups(queries: DataFrame, width: int, n_groups: int, mask: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """A mask, one row, of the groups that any query looks into."""

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(n_groups, bool)
        for batch in batches:
            seen |= mask(to_matrix(batch.column(0), width)[1]).any(axis=0)
        yield pa.RecordBatch.from_pydict({"grp": pa.array(np.flatnonzero(seen), pa.int32())})

    found = queries.select("vector").mapInArrow(wanted, "grp int").distinct().collect()
    every = np.zeros((1, n_groups), bool)
    every[0, [r["grp"] for r in found]] = True
    return every


def merge_winners(local: DataFrame, max_limit: int, distinct: bool = False) -> DataFrame:
    """Merge local lists into the final ``rank`` per query and group.

    The literal bound lets Spark cut every group while it sorts; each query's
    own limit then applies on top.
    """
    if distinct:  # several buckets can offer the same row
        local = local.groupBy("query_id", "id", "lim", "grp").agg(
            F.max("similarity_score").alias("similarity_score")
        )
    order = Window.partitionBy("query_id", "grp").orderBy(
        F.desc("similarity_score"), F.asc("id")
    )
    ranked = local.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= max_limit).where(F.col("rank") <= F.col("lim"))


def fetch_rows(
    hits: DataFrame,
    collection: DataFrame,
    columns: Sequence[str],
    id_col: str = "chunk_id",
    max_hits: int | None = None,
) -> DataFrame:
    """Add columns of the collection to hits found by id.

    Ids and scores travel through the ranking alone; contents are read for the
    winners only. The hits are broadcast if their number is known to be small,
    otherwise Spark picks the join from what it measures.
    """
    wanted = [c for c in columns if c != id_col and c not in hits.columns]
    if not wanted:
        return hits
    small = max_hits is not None and max_hits <= BROADCAST_HITS
    side = F.broadcast(hits) if small else hits
    return collection.select(id_col, *wanted).join(side, id_col).select(*hits.columns, *wanted)


def search_batch(
    collection: DataFrame,
    queries: DataFrame,
    limit: int | str = DEFAULT_LIMIT,
    similarity_threshold: float | str | None = None,
    metadata_filter: Mapping[str, object] | Column | None = None,
    *,
    filter_mode: str = "post",
    score: str = "unit",
    id_col: str = "chunk_id",
    vector_col: str = "embedding",
    query_id_col: str = "query_id",
    query_vector_col: str = "embedding",
    group_col: str | None = None,
    columns: Sequence[str] = (),
    max_limit: int = 50,
    max_groups: int | None = None,
) -> DataFrame:
    """Top ``limit`` rows for every query: ``query_id, id, similarity_score, rank``.

    ``limit`` and ``similarity_threshold`` may name columns of ``queries``; a
    limit column must stay within ``max_limit``. With ``group_col`` every query
    gets one list per group, e.g. per collection. ``id_col`` must be unique in
    the collection and ``query_id_col`` among the queries. ``columns`` are
    fetched for the winners only; say ``max_groups`` if the number of groups is
    known, so that the number of hits is.

    A query table of bounded size is broadcast and every task scores blocks of
    vectors against all of it; only ``limit`` rows per query and task are
    shuffled. A larger one, or one that makes too many scores for the tasks of a scan, is
    joined block by block, a task per pair of blocks.

    Where the collection lies in files, winners carry theirs: with ``columns`` or a filter
    afterwards the ranking runs at once, and contents are read from those files only.
    """
    raw = _check(filter_mode, score)
    if not isinstance(limit, str):
        if limit < 1:
            raise ValueError("limit must be at least 1")
        max_limit = limit
    source = filter_hits(collection, metadata_filter) if filter_mode == "pre" else collection
    if group_col:
        source = source.where(F.col(group_col).isNotNull())
    rows = source.select(
        F.col(id_col).alias("id"),
        F.col(vector_col).cast("array<float>").alias("vector"),
        (F.col(group_col) if group_col else F.lit("")).alias("grp"),
        *_places(source, bool(set(columns) - {id_col}) or (filter_mode == "post" and metadata_filter is not None)),
    )
    asked = query_rows(
        queries, limit, max_limit, similarity_threshold, query_id_col, query_vector_col
    )
    schema = hit_schema(rows, asked)
    width = vector_width(rows)
    bounded = bounded_queries(asked, width, max_limit, raw, rows)
    if bounded is not None:
        local = broadcast_top_k(rows, bounded, schema)
        groups = max_groups if group_col else 1
        max_hits = len(bounded) * max_limit * groups if groups else None
    else:  # written down, so that a model behind the vectors runs once
        local, max_hits = _block_top_k(rows, written(asked), width, schema, raw, max_limit), None
    return finish_hits(
        merge_winners(local, max_limit), collection,
        metadata_filter if filter_mode == "post" else None,
        id_col=id_col, query_id_col=query_id_col, group_col=group_col, columns=columns,
        max_hits=max_hits,
    )


def _places(source: DataFrame, wanted: bool) -> list[Column]:
    """The file of every row as a number, if contents are to be fetched and there are files."""
    if not wanted or not has_files(source):
        return []
    return [F.xxhash64(F.col("_metadata.file_path")).alias("place")]


def _winners_files(ranked: DataFrame, collection: DataFrame) -> DataFrame:
    """The rows of the files that hold winners; of all files if those are too many to name."""
    found = ranked.select("place").distinct().limit(READ_FILES + 1).collect()
    if len(found) > READ_FILES:
        return collection
    return collection.where(F.xxhash64(F.col("_metadata.file_path")).isin([r[0] for r in found]))


def finish_hits(
    ranked: DataFrame,
    collection: DataFrame,
    post_filter: Mapping[str, object] | Column | None,
    *,
    id_col: str,
    query_id_col: str,
    group_col: str | None,
    columns: Sequence[str],
    max_hits: int | None,
) -> DataFrame:
    """Name the columns of a ranking, fetch row columns, filter afterwards."""
    if "place" in ranked.columns:
        ranked = written(ranked)
        collection = _winners_files(ranked, collection)
    base = [
        F.col("query_id").alias(query_id_col),
        F.col("id").alias(id_col),
        "similarity_score",
        "rank",
    ]
    if group_col:
        base.append(F.col("grp").alias(group_col))
    hits = ranked.select(*base)
    if post_filter is None or (isinstance(post_filter, Mapping) and not post_filter):
        return fetch_rows(hits, collection, columns, id_col, max_hits)
    # the filter may look at any field, so it sees the rows before they are cut down
    keep = [c for c in collection.columns if c not in hits.columns]
    found = filter_hits(fetch_rows(hits, collection, keep, id_col, max_hits), post_filter)
    order = Window.partitionBy(*[c for c in (query_id_col, group_col) if c]).orderBy("rank")
    extra = [c for c in columns if c not in hits.columns]
    return found.withColumn("rank", F.row_number().over(order)).select(*hits.columns, *extra)


def search_collections(
    collections: DataFrame,
    queries: DataFrame,
    names: Sequence[str],
    limit: int | str = DEFAULT_LIMIT,
    similarity_threshold: float | str | None = None,
    *,
    collection_col: str = "collection_name",
    **options: object,
) -> DataFrame:
    """The same queries over several collections: one list per collection.

    The names select partitions, so only the wanted collections are read.
    """
    chosen = collections.where(F.col(collection_col).isin(*names))
    return search_batch(
        chosen, queries, limit, similarity_threshold,
        group_col=collection_col, max_groups=len(names), **options,
    )


def unmatched_queries(
    queries: DataFrame, hits: DataFrame, query_id_col: str = "query_id"
) -> DataFrame:
    """Queries without a hit, with advice."""
    return queries.join(hits.select(query_id_col), query_id_col, "left_anti").withColumn(
        "advice", F.lit(NO_HIT_ADVICE)
    )


NO_HIT_ADVICE = "lower the similarity threshold or use other search terms"
