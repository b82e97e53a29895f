"""Approximate search: a bucketed copy of the vectors, probed per query.

Sign hashes (Charikar, 2002) number the side of random hyperplanes a vector
lies on; the bits make its bucket. A query looks into the buckets nearest to
it, those that differ in the signs it is least sure of (multi-probe, Lv et
al., 2007). Buckets are partitions, so unwanted ones are never read; every row
of a probed bucket is scored exactly where it lies. No candidate pair is ever
shuffled, and a bucket that holds a third of all rows is simply read by more
tasks than the others.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkwell.functions.metadata import metadata_predicate
from chunkwell.functions.topk import BLOCK_SCORES, to_matrix
from chunkwell.operators.search import (
    BROADCAST_HITS,
    DEFAULT_LIMIT,
    _check,
    bounded_queries,
    broadcast_top_k,
    finish_hits,
    hit_schema,
    merge_winners,
    probing_queries,
    probing_top_k,
    query_rows,
    search_batch,
    vector_width,
    wanted_groups,
)
from chunkwell.session import written

#: Buckets are directories; more bits than this would make too many of them.
MAX_BITS = 12
DEFAULT_BITS = 8
DEFAULT_TABLES = 1
#: A query probes as many buckets as reach this recall on so many rows of the index, unless told otherwise.
LEAST_RECALL, RECALL_ROWS = 0.9, 256

SPEC = T.StructType(
    [
        T.StructField("collection_name", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("dims", T.IntegerType()),
        T.StructField("similarity", T.StringType()),
        T.StructField("tables", T.IntegerType()),
        T.StructField("bits", T.IntegerType()),
        T.StructField("seed", T.LongType()),
        T.StructField("filter_columns", T.ArrayType(T.StringType())),
        T.StructField("folder", T.StringType()),
        T.StructField("columns", T.StringType()),
        T.StructField("version", T.LongType()),
        T.StructField("probes", T.IntegerType()),
    ]
)


def _planes(dims: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((tables * bits, dims))


def _bucket_numbers(margins: np.ndarray, tables: int, bits: int) -> np.ndarray:
    signs = (margins >= 0).reshape(len(margins), tables, bits)
    return signs @ (1 << np.arange(bits))


def index_rows(
    collection: DataFrame,
    dims: int,
    *,
    tables: int = DEFAULT_TABLES,
    bits: int = DEFAULT_BITS,
    seed: int = 0,
    filter_columns: Sequence[str] = (),
    id_col: str = "chunk_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The index as rows: one per vector and table, with its bucket.

    Vectors without a direction are left out; a wrong width is an error.
    """
    if not 1 <= bits <= MAX_BITS:
        raise ValueError(f"bits must be within 1 to {MAX_BITS}")
    if tables < 1:
        raise ValueError("tables must be at least 1")
    planes = _planes(dims, tables, bits, seed)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def buckets(vectors: pa.Array) -> pa.Array:
        rows, matrix = to_matrix(vectors, dims)
        out: list = [None] * len(vectors)
        for row, numbers in zip(rows, _bucket_numbers(matrix @ planes.T, tables, bits)):
            out[row] = numbers
        return pa.array(out, pa.list_(pa.int32()))

    names = [field_name(c) for c in filter_columns]
    keep = [filter_column(collection, c) for c in filter_columns]
    if "collection_name" in collection.columns and "collection_name" not in names:
        names, keep = ["collection_name", *names], [F.col("collection_name"), *keep]
    once = buckets.asNondeterministic()  # the filter ``posexplode`` brings must not repeat it
    return collection.select(
        id_col, vector_col, *keep, once(F.col(vector_col)).alias("_buckets")
    ).select(F.posexplode("_buckets").alias("table_no", "bucket"), id_col, vector_col, *names)


def field_name(name: str) -> str:
    """``metadata.user_id`` and ``user_id`` are the same field."""
    return name.removeprefix("metadata.")


def filter_column(collection: DataFrame, name: str) -> Column:
    """A field of stored rows as a column of the index: the record's own value hides a system one."""
    field = field_name(name)
    column = F.col(field) if field in collection.columns else None
    if "metadata" in collection.columns and isinstance(collection.schema["metadata"].dataType, T.MapType):
        held = F.col("metadata")[field]
        if column is None:
            column = held
        else:
            kind = collection.schema[field].dataType
            own = F.map_contains_key(F.col("metadata"), F.lit(field))
            column = F.when(own, held.try_cast(kind)).otherwise(column)
    if column is None:
        raise ValueError(f"no field {name!r} to filter on")
    return column.alias(field)


def build_index(
    collection: DataFrame,
    root: str,
    collection_name: str,
    dims: int,
    *,
    tables: int = DEFAULT_TABLES,
    bits: int = DEFAULT_BITS,
    seed: int = 0,
    filter_columns: Sequence[str] = (),
    id_col: str = "chunk_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Write the vector index of one collection; returns its description.

    Rows are rebalanced by bucket, and adaptive execution splits a large bucket
    over several tasks. ``filter_columns`` can be filtered on before the search;
    they may be columns or fields of the metadata, an unknown one is an error.

    The description also has the ``probes`` that searches use by default, measured by
    :func:`enough_probes` on the rows written.

    Vectors go to a folder of their own; the description that names it is added
    last, and readers take the latest. A build that fails leaves the index as it was.
    """
    spark = collection.sparkSession
    rows = index_rows(
        collection, dims, tables=tables, bits=bits, seed=seed,
        filter_columns=filter_columns, id_col=id_col, vector_col=vector_col,
    )
    place = f"{root}/{collection_name}"
    folder = f"vectors-{uuid.uuid4().hex}"
    (
        rows.hint("rebalance", "table_no", "bucket")
        .write.partitionBy("table_no", "bucket")
        .parquet(f"{place}/{folder}")
    )
    filters = [field_name(c) for c in filter_columns]
    held = spark.read.schema(rows.schema).parquet(f"{place}/{folder}")
    probes = enough_probes(held, dims, tables, bits, seed, id_col, vector_col)
    spec = (collection_name, vector_col, dims, "cosine", tables, bits, seed, filters, folder,
            rows.schema.json(), time.time_ns(), probes)
    spark.createDataFrame([spec], SPEC).coalesce(1).write.mode("append").parquet(f"{place}/spec")
    return index_spec(spark, root, collection_name)


def enough_probes(
    index: DataFrame, dims: int, tables: int, bits: int, seed: int, id_col: str, vector_col: str
) -> int:
    """The fewest probes with recall ``LEAST_RECALL`` on a bounded sample, all buckets if none has it.

    The sample is ``RECALL_ROWS`` rows of the index by a hash of their ids. Their
    ``DEFAULT_LIMIT`` nearest other rows are found by brute force; a neighbour is found with
    as many probes as its bucket comes in a query's order, in the best of its tables.
    """
    n_buckets = 1 << bits
    rows = index.where("table_no = 0").select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(RECALL_ROWS).toArrow()
    known, matrix = to_matrix(sample.column("vector").combine_chunks(), dims)
    if not len(known):
        return n_buckets
    ids = [sample.column("id")[int(k)].as_py() for k in known]
    asked = [(k, [float(x) for x in v]) for k, v in enumerate(matrix)]
    asked = index.sparkSession.createDataFrame(asked, "query_id int, embedding array<double>")
    hits = search_batch(rows, asked, DEFAULT_LIMIT + 1, id_col="id", vector_col="vector").select("query_id", "id")
    where = index.select(F.col(id_col).alias("id"), "table_no", "bucket")
    hits = where.join(F.broadcast(hits), "id").select("query_id", "id", "table_no", "bucket")
    margins = matrix @ _planes(dims, tables, bits, seed).T
    place = [np.argsort(_probe_order(margins, t, bits), axis=1) for t in range(tables)]
    best: dict[tuple, int] = {}
    for query, row, table, bucket in hits.collect():
        if row != ids[query]:
            best[query, row] = min(best.get((query, row), n_buckets), int(place[table][query, bucket]) + 1)
    if not best:
        return n_buckets
    needed = np.sort(list(best.values()))
    return int(needed[int(np.ceil(LEAST_RECALL * len(needed))) - 1])


def index_spec(spark: SparkSession, root: str, collection_name: str) -> DataFrame:
    """The description of the latest build of an index, one row."""
    specs = spark.read.schema(SPEC).parquet(f"{root}/{collection_name}/spec")
    return specs.orderBy(F.desc("version")).limit(1)


def read_index(spark: SparkSession, root: str, collection_name: str) -> DataFrame:
    """The rows of the latest build of an index, also if there are none."""
    spec = index_spec(spark, root, collection_name).head()
    schema = T.StructType.fromJson(json.loads(spec["columns"]))
    return spark.read.schema(schema).parquet(f"{root}/{collection_name}/{spec['folder']}")


def probe_mask(
    vectors: np.ndarray, dims: int, tables: int, bits: int, seed: int, probes: int
) -> np.ndarray:
    """Which buckets a query looks into, as a mask ``(query, table and bucket)``."""
    n_buckets = 1 << bits
    mask = np.zeros((tables * n_buckets, len(vectors)), dtype=bool).T  # read by bucket
    planes, step = _planes(dims, tables, bits, seed).T, max(1, BLOCK_SCORES // n_buckets)
    for at in range(0, len(vectors), step):
        margins = vectors[at : at + step] @ planes
        for t in range(tables):
            nearest = _probe_order(margins, t, bits)[:, :probes]
            np.put_along_axis(mask[at : at + step], nearest + t * n_buckets, True, axis=1)
    return mask


def _probe_order(margins: np.ndarray, table: int, bits: int) -> np.ndarray:
    """The buckets of a table in the order in which each query looks into them."""
    bit_table = (np.arange(1 << bits)[:, None] >> np.arange(bits)) & 1
    side = margins[:, table * bits : (table + 1) * bits]
    doubt = side**2
    # cost of a bucket: squared margins of all signs in which it differs
    ones_cost = np.where(side >= 0, 0.0, doubt) @ bit_table.T
    zeros_cost = np.where(side >= 0, doubt, 0.0) @ (1 - bit_table).T
    return np.argsort(ones_cost + zeros_cost, axis=1, kind="stable")


def search_ann(
    spark: SparkSession,
    root: str,
    collection_name: str,
    queries: DataFrame,
    limit: int = DEFAULT_LIMIT,
    similarity_threshold: float | str | None = None,
    metadata_filter: object = None,
    *,
    probes: int | None = None,
    score: str = "unit",
    id_col: str = "chunk_id",
    query_id_col: str = "query_id",
    query_vector_col: str = "embedding",
    collection: DataFrame | None = None,
    columns: Sequence[str] = (),
) -> DataFrame:
    """Approximate top ``limit`` per query from the index of a collection.

    ``probes`` is the number of buckets per table a query looks into; with all
    of them the result is exact. By default it is the number that the build of the
    index measured to reach a recall of ``LEAST_RECALL`` on a sample of its rows. Every row found there is scored exactly and
    there is no cap on candidates. The filter runs before the search and may
    use the index's filter columns. ``columns`` are fetched from ``collection``.
    """
    raw = _check("pre", score)
    if limit < 1:
        raise ValueError("limit must be at least 1")
    if limit > BROADCAST_HITS:
        raise ValueError(f"limit must be at most {BROADCAST_HITS}")
    if columns and collection is None:
        raise ValueError("give the collection to fetch columns from")
    spec = index_spec(spark, root, collection_name).head()
    n_buckets = 1 << spec["bits"]
    probes = (spec["probes"] or n_buckets) if probes is None else probes
    if not 1 <= probes <= n_buckets:
        raise ValueError(f"probes must be within 1 to {n_buckets}")
    asked = query_rows(
        queries, limit, limit, similarity_threshold, query_id_col, query_vector_col
    )
    index = read_index(spark, root, collection_name)
    predicate = metadata_predicate(index, metadata_filter)
    if predicate is not None:
        index = index.where(predicate)

    dims, tables, bits, seed = (spec[c] for c in ("dims", "tables", "bits", "seed"))
    cells = tables * n_buckets

    def mask(vectors: np.ndarray) -> np.ndarray:
        return probe_mask(vectors, dims, tables, bits, seed, probes)

    def rows_of(wanted: np.ndarray) -> DataFrame:
        return _probed(index, wanted, tables, n_buckets).select(
            F.col(id_col).alias("id"),
            F.col(spec["path"]).cast("array<float>").alias("vector"),
            (F.col("table_no") * n_buckets + F.col("bucket")).cast("int").alias("grp"),
        )

    most = probing_queries(dims, cells)
    batch = bounded_queries(asked, dims, limit, raw, most=most)
    if batch is not None:
        check_width(batch.width if len(batch) else 0, dims)
        wanted = mask(batch.vectors)
        rows = rows_of(wanted)
        local = broadcast_top_k(rows, batch, hit_schema(rows, asked), wanted)
    else:
        asked = written(asked)  # a model behind the vectors runs once
        check_width(vector_width(asked), dims)
        rows = rows_of(wanted_groups(asked, dims, cells, mask))
        local = probing_top_k(rows, asked, dims, hit_schema(rows, asked), raw, limit, mask, most)
    return finish_hits(
        merge_winners(local, limit, distinct=tables > 1), collection, None, id_col=id_col,
        query_id_col=query_id_col, group_col=None, columns=columns,
        max_hits=None if batch is None else len(batch) * limit,
    )


def check_width(width: int, dims: int) -> None:
    """Queries must be as wide as the index; width 0 stands for none."""
    if width and width != dims:
        raise ValueError(f"vectors have different widths: {dims} and {width}")


def _probed(index: DataFrame, mask: np.ndarray, tables: int, n_buckets: int) -> DataFrame:
    """The partitions any query wants; the others are not even listed."""
    for t in range(tables):
        wanted = np.flatnonzero(mask[:, t * n_buckets : (t + 1) * n_buckets].any(axis=0))
        if len(wanted) < n_buckets:
            index = index.where(
                (F.col("table_no") != t) | F.col("bucket").isin(*wanted.tolist())
            )
    return index
