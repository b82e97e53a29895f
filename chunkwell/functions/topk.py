"""Exact local top-k over blocks of vectors, for use inside Spark tasks.

Spark decides which rows a task sees and merges the tasks' lists; this module
only turns Arrow batches into scores. A task's memory holds one batch of
vectors, one block of scores and ``limit`` winners per query, however many
rows stream through and however many of them are copies of one another.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scores held at once, as doubles: 8 MB. A worker has a few arrays of that size.
BLOCK_SCORES = 1_000_000

#: Scores are kept to nine decimals. Sums taken in another order differ in the
#: sixteenth, so without this two copies of a text could rank by noise instead
#: of by id.
SCORE_DECIMALS = 9

#: More than rounding can move a cosine, so a bound lowered by it loses nothing.
ROUNDING = 1e-8


def to_matrix(vectors: pa.Array, width: int | None) -> tuple[np.ndarray, np.ndarray]:
    """``(rows with a usable vector, their unit vectors in double)``.

    NULL, empty, zero and non-finite vectors have no direction and are left out;
    a vector of another width is an error.
    """
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes)
    if not len(rows):
        return rows, np.empty((0, width or 0))
    width = width or int(sizes[rows[0]])
    if (sizes[rows] != width).any():
        bad = sizes[rows][sizes[rows] != width][0]
        raise ValueError(f"vectors have different widths: {width} and {bad}")
    if len(rows) < len(sizes):
        vectors = vectors.take(pa.array(rows))
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(len(rows), width)
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    usable = (norms > 0) & np.isfinite(norms)
    if not usable.all():
        rows, matrix, norms = rows[usable], matrix[usable], norms[usable]
    matrix /= norms[:, None]
    return rows, matrix


def as_scores(cosines: np.ndarray, raw: bool) -> np.ndarray:
    """Cosines as final scores, in place: ``(1 + cosine) / 2`` unless raw."""
    np.clip(cosines, -1.0, 1.0, out=cosines)
    if not raw:
        cosines += 1.0
        cosines *= 0.5
    return np.round(cosines, SCORE_DECIMALS, out=cosines)


def score_against(vectors: pa.Array, query: np.ndarray, raw: bool) -> pa.Array:
    """One score per row for a single unit query vector; NULL if it has none."""
    rows, matrix = to_matrix(vectors, len(query))
    out = np.full(len(vectors), np.nan)
    if len(rows):
        out[rows] = as_scores(matrix @ query, raw)
    return pa.array(out, mask=np.isnan(out))


def _first_k(rows: np.ndarray, k: int) -> np.ndarray:
    """Mask of the first ``k`` entries of each run in sorted ``rows``."""
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    runs = np.diff(np.r_[starts, len(rows)])
    return np.arange(len(rows)) - np.repeat(starts, runs) < k


class Winners:
    """The best ``k`` ids per query so far, by score, then by ascending id."""

    def __init__(self, n_queries: int, k: int, id_dtype: np.dtype, distinct: bool) -> None:
        self.k = k
        self.distinct = distinct
        self.query = np.empty(0, np.int64)
        self.score = np.empty(0, np.float64)
        self.id = np.empty(0, id_dtype)
        self.place = np.empty(0, np.int64)
        self.floor = np.full(n_queries, -np.inf)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.n_held = 0

    def hold(self, *found: np.ndarray) -> None:
        """Keep contenders back, as merging a few costs as much as merging many."""
        if len(found[0]):
            self.held.append(found)
            self.n_held += len(found[0])
        if self.n_held > max(BLOCK_SCORES // 8, len(self.query)):
            self.settle()

    def settle(self) -> None:
        """Offer what was kept back."""
        if self.held:
            found, self.held, self.n_held = self.held, [], 0
            self.offer(*map(np.concatenate, zip(*found)))

    def offer(
        self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, place: np.ndarray | None = None
    ) -> None:
        """``place`` travels with the rows and decides nothing."""
        place = np.concatenate([self.place, np.zeros(len(ids), np.int64) if place is None else place])
        query = np.concatenate([self.query, query])
        score = np.concatenate([self.score, score])
        ids = np.concatenate([self.id, ids])
        _, id_rank = np.unique(ids, return_inverse=True)
        order = np.lexsort((id_rank, -score, query))
        if self.distinct:
            q, i = query[order], id_rank[order]
            order = order[np.r_[True, (q[1:] != q[:-1]) | (i[1:] != i[:-1])]]
        order = order[_first_k(query[order], self.k)]
        self.query, self.score, self.id, self.place = query[order], score[order], ids[order], place[order]
        # a query with a full list needs at least its worst score from now on
        ends = np.flatnonzero(np.r_[self.query[1:] != self.query[:-1], True])
        starts = np.r_[0, ends[:-1] + 1]
        full = ends - starts + 1 == self.k
        self.floor[self.query[ends[full]]] = self.score[ends[full]]


class Queries:
    """Query ids, unit vectors, and each query's own limit and least score."""

    def __init__(
        self,
        ids: pa.Array,
        vectors: np.ndarray,
        limits: np.ndarray,
        least: np.ndarray,
        raw: bool,
    ) -> None:
        self.ids = ids
        self.vectors = vectors
        self.limits = limits
        self.least = least
        self.raw = raw

    @classmethod
    def from_table(cls, table: pa.Table, raw: bool) -> Queries:
        """From columns ``query_id, vector, lim, least``; unusable vectors drop out."""
        vectors = table["vector"].combine_chunks()
        rows, matrix = to_matrix(vectors, None)
        kept = table.take(pa.array(rows, pa.int64()))
        least = kept["least"].to_numpy().astype(np.float64)
        return cls(
            kept["query_id"].combine_chunks(),
            matrix,
            kept["lim"].to_numpy().astype(np.int64),
            # no threshold and a threshold of zero both mean: any score will do
            np.where(np.isnan(least) | (least == 0), -np.inf, least),
            raw,
        )

    def parts(self) -> tuple:
        """The constructor's arguments, all of public types, to send to tasks."""
        return self.ids, self.vectors, self.limits, self.least, self.raw

    def __len__(self) -> int:
        return len(self.limits)

    @property
    def width(self) -> int:
        return self.vectors.shape[1]


def _at_least(values: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of entries that reach their row's bound."""
    # in one dimension numpy finds them several times faster than in two
    return np.divmod(np.flatnonzero(values >= bound[:, None]), values.shape[1])


def _contenders(
    winners: Winners,
    queries: Queries,
    chosen: np.ndarray,
    vectors: np.ndarray,
    id_rank: np.ndarray,
    copies: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query numbers, scores and row numbers of what can still win a place.

    If ids count once, ``copies`` is how often one comes at most: so many times more rows are kept.
    Cosines that cannot reach a list are dropped before they become scores:
    once lists are full, that is nearly all of them, and a block costs little
    more than its matrix product.
    """
    cosines = queries.vectors[chosen] @ vectors.T
    k, n = winners.k * copies, cosines.shape[1]
    floor = np.maximum(winners.floor[chosen], queries.least[chosen])
    bound = (floor if queries.raw else 2 * floor - 1) - ROUNDING
    crowded = n > k and not np.isfinite(bound).all()
    if not crowded:
        q, c = _at_least(cosines, bound)
        crowded = n > k and len(q) > 4 * k * len(chosen)
    if crowded:  # no more than the best k of this batch, and what ties with them
        kth = np.partition(cosines, n - k, axis=1)[:, n - k]
        q, c = _at_least(cosines, np.maximum(bound, kth - ROUNDING))
    values = as_scores(cosines[q, c], queries.raw)
    good = values >= floor[q]
    q, c, values = q[good], c[good], values[good]
    if len(q) > k * len(chosen):  # many ties: settle them by id
        order = np.lexsort((id_rank[c], -values, q))
        order = order[_first_k(q[order], k)]
        q, c, values = q[order], c[order], values[order]
    return chosen[q], values, c


def local_top_k(
    batches: Iterable[pa.RecordBatch],
    queries: Queries,
    probes: np.ndarray | None = None,
) -> Iterator[pa.RecordBatch]:
    """One task's best rows per query and group.

    Batches hold ``(id, vector, group)`` and maybe a number ``place`` that comes back
    with the winners. Rows of different groups (collections)
    compete in lists of their own. With ``probes``, a mask ``(query, bucket)``,
    the group is a bucket that only selects the queries to score; all rows then
    compete in one list, in which an id counts once.
    """
    if not len(queries):
        return
    limit = int(queries.limits.max())
    best: dict[object, Winners] = {}
    id_type = group_type = None
    placed = False
    everyone = np.arange(len(queries))
    for batch in batches:
        ids, vectors, groups, *places = batch.columns
        id_type, group_type, placed = ids.type, groups.type, bool(places)
        rows, matrix = to_matrix(vectors, queries.width)
        if not len(rows):
            continue
        ids = ids.to_numpy(zero_copy_only=False)[rows]
        place = places[0].to_numpy(zero_copy_only=False)[rows] if places else np.zeros(len(ids), np.int64)
        id_rank = np.empty(len(ids), np.int64)
        id_rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        copies = 1 if probes is None else int(np.unique(ids, return_counts=True)[1].max())
        labels, member = np.unique(
            groups.to_numpy(zero_copy_only=False)[rows], return_inverse=True
        )
        for g, label in enumerate(labels):
            chosen, key = everyone, label
            if probes is not None:
                chosen, key = np.flatnonzero(probes[:, label]), None
                if not len(chosen):
                    continue
            if key not in best:
                best[key] = Winners(len(queries), limit, ids.dtype, probes is not None)
            at = np.flatnonzero(member == g) if len(labels) > 1 else slice(None)
            block = (matrix[at], id_rank[at])
            step = max(1, BLOCK_SCORES // len(block[1]))
            for i in range(0, len(chosen), step):
                query, score, row = _contenders(best[key], queries, chosen[i : i + step], *block, copies)
                best[key].hold(query, score, ids[at][row], place[at][row])
        for winners in best.values():
            winners.settle()
    for label, winners in best.items():
        n = len(winners.query)
        if n:
            at = pa.array(winners.query)
            grp = pa.nulls(n, group_type) if probes is not None else pa.array([label] * n, group_type)
            columns = {
                "query_id": queries.ids.take(at),
                "id": pa.array(winners.id, id_type),
                "similarity_score": pa.array(winners.score, pa.float64()),
                "lim": pa.array(queries.limits[winners.query], pa.int64()),
                "grp": grp,
            }
            if placed:
                columns["place"] = pa.array(winners.place, pa.int64())
            yield pa.RecordBatch.from_pydict(columns)
