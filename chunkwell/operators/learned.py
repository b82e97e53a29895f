"""A learned index: vectors in cells around centres that were fitted to them.

Lists are the cells of k-means centres; a second, shared set of centres of what is left after
the first divides every list further. Lists are folders and rows are sorted by cell, so a
query reads the cells whose centres are nearest to it and little else. Optional product codes
(Jégou et al., 2011) stand for a vector in a few bytes: a first pass ranks codes by table
lookups, and vectors are read for its candidates only and scored exactly.

Centres are fitted to a sample of bounded size, all rows are indexed. An index is a model and
segments: later ingests add segments under the same model, and rows that no segment has
yet are searched exactly, so a search sees everything that is stored.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkwell.functions.metadata import metadata_predicate
from chunkwell.functions.topk import BLOCK_SCORES, Queries, Winners, to_matrix
from chunkwell.operators.ann import LEAST_RECALL, RECALL_ROWS, check_width, field_name, filter_column
from chunkwell.operators.search import (
    BROADCAST_HITS,
    DEFAULT_LIMIT,
    _check,
    _block_top_k,
    bounded_queries,
    broadcast_top_k,
    few_tasks,
    finish_hits,
    hit_schema,
    merge_winners,
    probing_queries,
    probing_top_k,
    query_rows,
    search_batch,
    similarity_score,
    vector_width,
    wanted_groups,
)
from chunkwell.session import path_exists, written

#: Rows that centres are fitted to, about: a share of the rows by a hash of their ids.
FIT_ROWS = 50_000
#: Lists are folders, cells are what a query chooses among, and centres travel to tasks.
MAX_LISTS, MAX_CELLS, MAX_CENTRE_BYTES = 4_096, 1 << 16, 64 << 20
FIT_ROUNDS = 10
#: Values of one byte of a product code, and candidates per wanted row of a first pass.
CODES, CANDIDATES = 256, 10
_FLOATS = T.ArrayType(T.FloatType())
MODEL = T.StructType(
    [
        T.StructField("collection_name", T.StringType()),
        T.StructField("model_id", T.StringType()),
        T.StructField("id_col", T.StringType()),
        T.StructField("vector_col", T.StringType()),
        T.StructField("dims", T.IntegerType()),
        T.StructField("lists", T.IntegerType()),
        T.StructField("fine", T.IntegerType()),
        T.StructField("code_bytes", T.IntegerType()),
        T.StructField("filter_columns", T.ArrayType(T.StringType())),
        T.StructField("probes", T.IntegerType()),
        T.StructField("share_read", T.DoubleType()),
        T.StructField("version", T.LongType()),
        T.StructField("list_centres", _FLOATS),
        T.StructField("fine_centres", _FLOATS),
        T.StructField("code_centres", _FLOATS),
    ]
)
SEGMENT = T.StructType(
    [
        T.StructField("model_id", T.StringType()),
        T.StructField("folder", T.StringType()),
        T.StructField("columns", T.StringType()),
        T.StructField("writes", T.ArrayType(T.StringType())),
        T.StructField("replaces", T.ArrayType(T.StringType())),
        T.StructField("version", T.LongType()),
    ]
)


def _nearest(matrix: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of the nearest centre of every row, the lower one of equals."""
    half = np.einsum("ij,ij->i", centres, centres) / 2
    out = np.zeros(len(matrix), np.int64)
    step = max(1, BLOCK_SCORES // max(1, len(centres)))
    for at in range(0, len(matrix), step):
        out[at : at + step] = np.argmax(matrix[at : at + step] @ centres.T - half, axis=1)
    return out


class Centres:
    """The numbers of a model; plain arrays, so that it can be sent to tasks."""

    def __init__(self, lists: np.ndarray, fine: np.ndarray, codes: np.ndarray | None):
        self.lists, self.fine, self.codes = lists, fine, codes

    def parts(self) -> tuple:
        return self.lists, self.fine, self.codes

    @property
    def cells(self) -> int:
        return len(self.lists) * len(self.fine)

    def cell_centres(self) -> np.ndarray:
        return (self.lists[:, None, :] + self.fine[None, :, :]).reshape(self.cells, -1)

    def assign(self, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List and cell of unit vectors, and what is left of them."""
        place = _nearest(matrix, self.lists)
        rest = matrix - self.lists[place]
        fine = _nearest(rest, self.fine)
        return place, place * len(self.fine) + fine, rest - self.fine[fine]

    def encode(self, rest: np.ndarray) -> np.ndarray:
        """The product codes of what is left, a byte per part."""
        out = np.zeros((len(rest), len(self.codes)), np.uint8)
        width = self.codes.shape[2]
        for m, book in enumerate(self.codes):
            out[:, m] = _nearest(rest[:, m * width : (m + 1) * width], book)
        return out

    def order(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of all cells for every query, and the cells from the best to the worst."""
        scores = vectors @ self.cell_centres().T
        return scores, np.argsort(-scores, axis=1, kind="stable")

    def wanted(self, vectors: np.ndarray, probes: int) -> np.ndarray:
        """The best cells of every query, as a mask ``(query, cell)``."""
        mask = np.zeros((self.cells, len(vectors)), bool).T  # read by cell
        centres, step = self.cell_centres().T, max(1, BLOCK_SCORES // self.cells)
        for at in range(0, len(vectors), step):
            order = np.argsort(-(vectors[at : at + step] @ centres), axis=1, kind="stable")
            np.put_along_axis(mask[at : at + step], order[:, :probes], True, axis=1)
        return mask


def _sampled(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """About ``most`` rows ``(id, vector)`` by a hash of their ids, all if there are fewer."""
    n = rows.count()
    if n > most:
        place = F.xxhash64("id", F.lit(seed)).cast("double") / float(1 << 64) + 0.5
        rows = rows.where(place < most / n)
    return rows


def _k_means(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """At most ``k`` centres of a written table with a column ``x`` of arrays, by MLlib."""
    points = rows.select(array_to_vector("x").alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=FIT_ROUNDS).fit(points)
    return np.array(model.clusterCenters()).astype(np.float32).astype(np.float64)


def _code_books(rows: DataFrame, dims: int, parts: int, seed: int) -> np.ndarray:
    """Centres of every part of the vectors ``x``, one task per part."""
    width = dims // parts
    cut = F.expr(f"transform(sequence(0, {parts - 1}), m -> slice(x, m * {width} + 1, {width}))")
    split = rows.select(F.posexplode(cut).alias("part", "x"))

    def fit(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        x = np.array(table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64)
        x = x.reshape(table.num_rows, -1)
        random = np.random.default_rng(seed + part)
        x = x[np.lexsort(x.T)]  # whatever order the rows came in
        centres = x[random.choice(len(x), CODES, replace=len(x) < CODES)]
        for _ in range(FIT_ROUNDS):
            near = _nearest(x, centres)
            counts = np.bincount(near, minlength=CODES)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, x)
            centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        return pa.table(
            {"part": pa.array([part] * CODES, pa.int32()), "code": pa.array(range(CODES), pa.int32()), "x": list(centres)}
        )

    found = split.groupBy("part").applyInArrow(fit, "part int, code int, x array<double>")
    books = sorted(found.collect(), key=lambda r: (r["part"], r["code"]))
    flat = np.array([r["x"] for r in books], np.float32).astype(np.float64)
    return flat.reshape(parts, CODES, -1)


def fit_centres(
    rows: DataFrame, dims: int, lists: int, fine: int = 1, code_bytes: int = 0, seed: int = 0, fit_rows: int = FIT_ROWS
) -> Centres:
    """Centres for rows ``(id, vector)``, fitted to about ``fit_rows`` of them."""
    sample = _sampled(rows, fit_rows, seed)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def unit(vectors: pa.Array) -> pa.Array:
        found, matrix = to_matrix(vectors, dims)
        out: list = [None] * len(vectors)
        for row, values in zip(found, matrix):
            out[row] = values
        return pa.array(out, pa.list_(pa.float64()))

    once = unit.asNondeterministic()
    sample = written(sample.select(once(F.col("vector")).alias("x")).where("x IS NOT NULL"))
    if sample.isEmpty():
        books = np.zeros((code_bytes, CODES, dims // code_bytes)) if code_bytes else None
        return Centres(np.zeros((1, dims)), np.zeros((1, dims)), books)

    def rest(known: Centres) -> DataFrame:
        parts = known.parts()

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def left(vectors: pa.Array) -> pa.Array:
            matrix = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), dims)
            return pa.array(list(Centres(*parts).assign(matrix)[2]), pa.list_(pa.float64()))

        return written(sample.select(left("x").alias("x")))

    none = np.zeros((1, dims))
    centres = Centres(_k_means(sample, lists, seed) if lists > 1 else none, none, None)
    if fine > 1:
        centres = Centres(centres.lists, _k_means(rest(centres), fine, seed), None)
    if code_bytes:
        centres = Centres(centres.lists, centres.fine, _code_books(rest(centres), dims, code_bytes, seed))
    return centres


def learned_rows(
    collection: DataFrame,
    centres: Centres,
    *,
    filter_columns: Sequence[str] = (),
    id_col: str = "chunk_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The index as rows: one per vector, with its list, its cell and maybe its code.

    Vectors without a direction are left out; a wrong width is an error.
    """
    shared = collection.sparkSession.sparkContext.broadcast(centres.parts())
    dims = centres.lists.shape[1]
    kind = T.StructType(
        [
            T.StructField("list_no", T.IntegerType()),
            T.StructField("cell", T.IntegerType()),
            T.StructField("code", T.BinaryType()),
        ]
    )

    @F.arrow_udf(kind)
    def placed(vectors: pa.Array) -> pa.Array:
        known = Centres(*shared.value)
        rows, matrix = to_matrix(vectors, dims)
        lists, cells, rest = known.assign(matrix)
        codes: list = [None] * len(vectors)
        if known.codes is not None:
            for row, code in zip(rows, known.encode(rest)):
                codes[row] = code.tobytes()
        out = np.zeros((2, len(vectors)), np.int32)
        out[:, rows] = lists, cells
        none = np.ones(len(vectors), bool)
        none[rows] = False
        columns = [pa.array(column, pa.int32(), mask=none) for column in out]
        return pa.StructArray.from_arrays([*columns, pa.array(codes, pa.binary())], ["list_no", "cell", "code"])

    names = [field_name(c) for c in filter_columns]
    keep = [filter_column(collection, c) for c in filter_columns]
    once = placed.asNondeterministic()
    made = collection.select(id_col, vector_col, *keep, once(F.col(vector_col)).alias("_at"))
    made = made.select(id_col, vector_col, *names, "_at.list_no", "_at.cell", "_at.code")
    return made.where("list_no IS NOT NULL")


def _place(root: str, collection_name: str) -> str:
    return f"{root}/{collection_name}/learned"


def _write_segment(rows: DataFrame, place: str, model_id: str, writes: list[str], replaces: Sequence[str] = ()) -> None:
    """Writes rows to a folder of their own, then the description that makes it part of the index."""
    spark, folder = rows.sparkSession, f"rows-{uuid.uuid4().hex}"
    dealt = rows.hint("rebalance", "list_no").sortWithinPartitions("list_no", "cell")
    dealt.write.partitionBy("list_no").parquet(f"{place}/{folder}")
    described = (model_id, folder, rows.schema.json(), writes, list(replaces), time.time_ns())
    spark.createDataFrame([described], SEGMENT).coalesce(1).write.mode("append").parquet(f"{place}/segments")


def _writes(collection: DataFrame) -> list[str]:
    """The writes a stored collection is made of; none are known of any other table."""
    if "write_id" not in collection.columns:
        return []
    return [r[0] for r in collection.select("write_id").distinct().collect()]


def build_learned_index(
    collection: DataFrame,
    root: str,
    collection_name: str,
    dims: int,
    *,
    lists: int | None = None,
    fine: int = 1,
    code_bytes: int = 0,
    centroids: Sequence[Sequence[float]] | None = None,
    filter_columns: Sequence[str] = (),
    id_col: str = "chunk_id",
    vector_col: str = "embedding",
    fit_rows: int = FIT_ROWS,
    seed: int = 0,
) -> DataFrame:
    """Fit a model, write all vectors as its first segment; returns the index's description.

    ``lists`` (the square root of the number of rows by default) times ``fine`` is the number of
    cells; ``code_bytes`` must divide ``dims``. ``centroids`` are used as the centres of the lists
    instead of fitted ones. The description has the ``probes`` that searches use by default,
    measured by :func:`enough_cells`, and the share of the rows that they read.

    Segments and then the model are described last, so a build that fails leaves the index as it was.
    """
    spark = collection.sparkSession
    if code_bytes and dims % code_bytes:
        raise ValueError("code_bytes must divide dims")
    rows = collection.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    if centroids is not None:
        lists = len(centroids)
    elif lists is None:
        lists = max(1, min(MAX_LISTS, math.isqrt(rows.count())))
    if not 1 <= lists <= MAX_LISTS or fine < 1 or lists * fine > MAX_CELLS:
        raise ValueError(f"lists must be within 1 to {MAX_LISTS} and cells at most {MAX_CELLS}")
    if 8 * dims * (lists * fine + CODES) > MAX_CENTRE_BYTES:
        raise ValueError(f"centres would have more than {MAX_CENTRE_BYTES} bytes")
    if centroids is not None:
        given = np.array(centroids, np.float32).astype(np.float64)
        if given.ndim != 2 or given.shape[1] != dims:
            raise ValueError(f"centroids must have the width {dims}")
        centres = Centres(given, np.zeros((1, dims)), None)
        if fine > 1 or code_bytes:
            raise ValueError("given centroids have no second level or codes")
    else:
        centres = fit_centres(rows, dims, lists, fine, code_bytes, seed, fit_rows)
    place, model_id = _place(root, collection_name), uuid.uuid4().hex
    filters = [field_name(c) for c in filter_columns]
    made = learned_rows(collection, centres, filter_columns=filter_columns, id_col=id_col, vector_col=vector_col)
    _write_segment(made, place, model_id, _writes(collection))
    index = _segments(spark, place, model_id)
    probes, share = enough_cells(index, centres, id_col, vector_col)
    flat = [x.astype(np.float32).ravel().tolist() for x in (centres.lists, centres.fine)]
    codes = None if centres.codes is None else centres.codes.astype(np.float32).ravel().tolist()
    spec = (collection_name, model_id, id_col, vector_col, dims, len(centres.lists), len(centres.fine), code_bytes,
            filters, probes, share, time.time_ns(), *flat, codes)
    spark.createDataFrame([spec], MODEL).coalesce(1).write.mode("append").parquet(f"{place}/models")
    return learned_spec(spark, root, collection_name)


def learned_spec(spark: SparkSession, root: str, collection_name: str) -> DataFrame:
    """The description of the latest model of an index, one row."""
    models = spark.read.schema(MODEL).parquet(f"{_place(root, collection_name)}/models")
    return models.orderBy(F.desc("version")).limit(1)


def _centres(spec) -> Centres:
    dims, parts = spec["dims"], spec["code_bytes"]

    def matrix(name: str, *shape: int) -> np.ndarray:
        return np.array(spec[name], np.float32).astype(np.float64).reshape(*shape)

    codes = matrix("code_centres", parts, CODES, dims // parts) if parts else None
    return Centres(matrix("list_centres", spec["lists"], dims), matrix("fine_centres", spec["fine"], dims), codes)


def _live(spark: SparkSession, place: str, model_id: str) -> list:
    """Descriptions of the segments of a model that no other has replaced."""
    if not path_exists(spark, f"{place}/segments"):
        return []
    found = spark.read.schema(SEGMENT).parquet(f"{place}/segments").where(F.col("model_id") == model_id)
    found = found.orderBy("version").collect()
    gone = {folder for segment in found for folder in segment["replaces"]}
    return [segment for segment in found if segment["folder"] not in gone]


def _segments(spark: SparkSession, place: str, model_id: str) -> DataFrame:
    """The rows of all live segments."""
    live = _live(spark, place, model_id)
    schema = T.StructType.fromJson(json.loads(live[0]["columns"]))
    tables = [spark.read.schema(schema).parquet(f"{place}/{s['folder']}") for s in live]
    return reduce(DataFrame.unionByName, tables)


def read_learned_index(spark: SparkSession, root: str, collection_name: str) -> DataFrame:
    """The rows of an index: id, vector, filter columns, list, cell and code."""
    spec = learned_spec(spark, root, collection_name).head()
    return _segments(spark, _place(root, collection_name), spec["model_id"])


def _uncovered(spark: SparkSession, place: str, model_id: str, collection: DataFrame) -> DataFrame | None:
    """The rows of a stored collection whose writes no segment has, None if it has all."""
    if "write_id" not in collection.columns:
        return None
    covered = {w for s in _live(spark, place, model_id) for w in s["writes"]}
    new = sorted(set(_writes(collection)) - covered)
    return collection.where(F.col("write_id").isin(new)) if new else None


def extend_learned_index(collection: DataFrame, root: str, collection_name: str) -> int:
    """Adds a segment with the writes of a stored collection that the index lacks; their number."""
    spark = collection.sparkSession
    spec, place = learned_spec(spark, root, collection_name).head(), _place(root, collection_name)
    new = _uncovered(spark, place, spec["model_id"], collection)
    if new is None:
        return 0
    rows = learned_rows(
        new, _centres(spec), filter_columns=spec["filter_columns"], id_col=spec["id_col"], vector_col=spec["vector_col"]
    )
    writes = _writes(new)
    _write_segment(rows, place, spec["model_id"], writes)
    return len(writes)


def merge_learned_index(spark: SparkSession, root: str, collection_name: str) -> int:
    """Writes all segments anew as one, under the same model; the number of segments before."""
    spec, place = learned_spec(spark, root, collection_name).head(), _place(root, collection_name)
    live = _live(spark, place, spec["model_id"])
    if len(live) > 1:
        rows = _segments(spark, place, spec["model_id"])
        writes = sorted({w for s in live for w in s["writes"]})
        _write_segment(rows, place, spec["model_id"], writes, [s["folder"] for s in live])
    return len(live)


def enough_cells(index: DataFrame, centres: Centres, id_col: str, vector_col: str) -> tuple[int, float]:
    """The fewest cells with recall ``LEAST_RECALL`` on a bounded sample, and the share of rows they hold.

    The sample is ``RECALL_ROWS`` rows by a hash of their ids, their ``DEFAULT_LIMIT`` nearest other
    rows are found by brute force; all cells if there is nothing to measure.
    """
    rows = index.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), "cell")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(RECALL_ROWS).toArrow()
    known, matrix = to_matrix(sample.column("vector").combine_chunks(), centres.lists.shape[1])
    if not len(known):
        return centres.cells, 1.0
    ids = [sample.column("id")[int(k)].as_py() for k in known]
    asked = [(k, [float(x) for x in v]) for k, v in enumerate(matrix)]
    asked = index.sparkSession.createDataFrame(asked, "query_id int, embedding array<double>")
    hits = search_batch(rows, asked, DEFAULT_LIMIT + 1, id_col="id", vector_col="vector", columns=["cell"])
    _, order = centres.order(matrix)
    place = np.argsort(order, axis=1)
    needed = [int(place[r["query_id"], r["cell"]]) + 1 for r in hits.collect() if r["id"] != ids[r["query_id"]]]
    probes = centres.cells
    if needed:
        probes = sorted(needed)[math.ceil(LEAST_RECALL * len(needed)) - 1]
    sizes = np.zeros(centres.cells)
    for cell, n in rows.groupBy("cell").count().collect():
        sizes[cell] = n
    return probes, round(float(sizes[order[:, :probes]].sum(axis=1).mean() / sizes.sum()), 6)


def _probed(index: DataFrame, mask: np.ndarray, fine: int) -> DataFrame:
    """The rows of cells that any query wants: other lists are not listed, other cells not read."""
    cells = np.flatnonzero(mask.any(axis=0))
    if len(cells) == mask.shape[1]:
        return index
    lists = np.unique(cells // fine)
    return index.where(F.col("list_no").isin(lists.tolist()) & F.col("cell").isin(cells.tolist()))


def _coded_scan(centres: Centres, probes: int, k: int) -> Callable[[Iterator[pa.RecordBatch], Queries], Iterator[pa.RecordBatch]]:
    """A task's best ``k`` rows per query by their codes; batches hold ``(id, code, grp)``."""
    known = centres.parts()

    def scan(batches: Iterator[pa.RecordBatch], queries: Queries) -> Iterator[pa.RecordBatch]:
        centres = Centres(*known)
        parts, width = len(centres.codes), centres.codes.shape[2]
        cell_centres, wanted = centres.cell_centres(), centres.wanted(queries.vectors, probes)
        # what every value of every byte adds to a query's score
        added = [(queries.vectors[:, m * width : (m + 1) * width] @ centres.codes[m].T).astype(np.float32) for m in range(parts)]
        best = id_type = None
        for batch in batches:
            ids = batch.column(0)
            id_type = ids.type
            ids = ids.to_numpy(zero_copy_only=False)
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(ids), parts)
            cells = batch.column(2).to_numpy(zero_copy_only=False)
            best = best or Winners(len(queries), k, ids.dtype, True)
            for cell in np.unique(cells):
                rows_here, asked = np.flatnonzero(cells == cell), np.flatnonzero(wanted[:, cell])
                step = max(1, BLOCK_SCORES // max(1, len(rows_here)))
                for at in range(0, len(asked), step):
                    some = asked[at : at + step]
                    base = (queries.vectors[some] @ cell_centres[cell]).astype(np.float32)
                    found = np.repeat(base[:, None], len(rows_here), axis=1)
                    for m in range(parts):
                        found += added[m][some][:, codes[rows_here, m]]
                    q, c = np.nonzero(found >= best.floor[some][:, None])
                    if len(q):
                        best.offer(some[q], found[q, c].astype(np.float64), ids[rows_here[c]])
        if best is not None and len(best.query):
            n = len(best.query)
            columns = [queries.ids.take(pa.array(best.query)), pa.array(best.id, id_type), pa.array(best.score)]
            columns += [pa.array(queries.limits[best.query] * 0 + k, pa.int64()), pa.nulls(n, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "id", "similarity_score", "lim", "grp"])

    return scan


def _coded_top_k(rows: DataFrame, queries: Queries, schema: T.StructType, centres: Centres, probes: int, k: int) -> DataFrame:
    """Each task's best ``k`` rows per query by their codes; ``rows`` holds ``(id, code, grp)``."""
    shared = rows.sparkSession.sparkContext.broadcast(queries.parts())
    scan = _coded_scan(centres, probes, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from scan(batches, Queries(*shared.value))

    return few_tasks(rows).mapInArrow(run, schema)


def search_learned(
    spark: SparkSession,
    root: str,
    collection_name: str,
    queries: DataFrame,
    limit: int = DEFAULT_LIMIT,
    similarity_threshold: float | str | None = None,
    metadata_filter: object = None,
    *,
    probes: int | None = None,
    candidates: int = CANDIDATES,
    score: str = "unit",
    query_id_col: str = "query_id",
    query_vector_col: str = "embedding",
    collection: DataFrame | None = None,
    columns: Sequence[str] = (),
) -> DataFrame:
    """Approximate top ``limit`` per query from a learned index.

    ``probes`` is the number of cells a query looks into; with all of them the result is exact.
    By default it is the number the build measured to reach a recall of ``LEAST_RECALL``. In an
    index with codes a first pass keeps ``candidates`` times ``limit`` rows per query, whose vectors
    are then read and scored; else every row of a probed cell is scored exactly.

    The filter runs before the search and may use the index's filter columns. ``columns`` are
    fetched from ``collection``; rows of it that no segment has yet are searched exactly.
    """
    raw = _check("pre", score)
    if limit < 1 or candidates < 1:
        raise ValueError("limit and candidates must be at least 1")
    spec, place = learned_spec(spark, root, collection_name).head(), _place(root, collection_name)
    centres = _centres(spec)
    wide = limit * candidates if centres.codes is not None else limit
    if wide > BROADCAST_HITS:
        raise ValueError(f"limit must be at most {BROADCAST_HITS}")
    if columns and collection is None:
        raise ValueError("give the collection to fetch columns from")
    probes = spec["probes"] if probes is None else probes
    if not 1 <= probes <= centres.cells:
        raise ValueError(f"probes must be within 1 to {centres.cells}")
    id_col, vector_col = spec["id_col"], spec["vector_col"]
    asked = query_rows(queries, limit, limit, similarity_threshold, query_id_col, query_vector_col)
    index = _segments(spark, place, spec["model_id"])
    predicate = metadata_predicate(index, metadata_filter)
    index = index if predicate is None else index.where(predicate)
    id_, grp = F.col(id_col).alias("id"), F.col("cell").alias("grp")
    vector = F.col(vector_col).cast("array<float>").alias("vector")
    new = _uncovered(spark, place, spec["model_id"], collection) if collection is not None else None
    if new is not None:
        late = metadata_predicate(new, metadata_filter)
        new = (new if late is None else new.where(late)).select(id_, vector, F.lit(0).alias("grp"))

    dims, cells, shared = spec["dims"], centres.cells, spark.sparkContext.broadcast(centres.parts())

    def mask(vectors: np.ndarray) -> np.ndarray:
        return Centres(*shared.value).wanted(vectors, probes)

    most = probing_queries(dims, cells, 4 * CODES * len(centres.codes) if centres.codes is not None else 0)
    batch = bounded_queries(asked, dims, wide, raw, most=most)
    if batch is not None:
        check_width(batch.width if len(batch) else 0, dims)
        wanted = centres.wanted(batch.vectors if len(batch) else np.zeros((0, dims)), probes)
    else:
        asked = written(asked)  # a model behind the vectors runs once
        check_width(vector_width(asked), dims)
        wanted = wanted_groups(asked, dims, cells, mask)
    held = _probed(index, wanted, len(centres.fine))
    rows = held.select(id_, vector, grp)
    schema = hit_schema(rows, asked)
    if centres.codes is not None:
        coded = held.select(id_, "code", grp)
        if batch is not None:
            first = _coded_top_k(coded, batch, schema, centres, probes, wide)
        else:
            first = _block_top_k(coded, asked, dims, schema, raw, wide, _coded_scan(centres, probes, wide), most)
        first = written(merge_winners(first, wide).select("query_id", "id"))
        found = _scored(held.select(id_, vector), first, asked, score, schema, small=batch is not None)
    elif batch is not None:
        found = broadcast_top_k(rows, batch, schema, wanted)
    else:
        found = probing_top_k(rows, asked, dims, schema, raw, limit, mask, most)
    if new is not None and batch is not None:
        found = found.unionByName(broadcast_top_k(new, batch, schema))
    elif new is not None:
        found = found.unionByName(_block_top_k(new, asked, dims, schema, raw, limit))
    return finish_hits(
        merge_winners(found.withColumn("grp", F.lit(None).cast("int")), limit), collection, None, id_col=id_col,
        query_id_col=query_id_col, group_col=None, columns=columns,
        max_hits=None if batch is None else len(batch) * limit,
    )


def _scored(rows: DataFrame, first: DataFrame, asked: DataFrame, score: str, schema: T.StructType, small: bool) -> DataFrame:
    """Exact scores of the candidates ``(query_id, id)`` of a first pass; ``small``: of a bounded number of queries."""
    query = asked.select("query_id", F.col("vector").alias("_query"), "lim", "least")
    pairs = first.join(F.broadcast(query) if small else query, "query_id")
    met = rows.join(F.broadcast(pairs) if small else pairs, "id")
    met = met.withColumn("similarity_score", similarity_score(F.col("vector"), F.col("_query"), score))
    enough = F.col("least").isNull() | (F.col("least") == 0) | (F.col("similarity_score") >= F.col("least"))
    return met.where(enough).withColumn("grp", F.lit(None).cast("int")).select(*schema.names)
