"""Near copies by word n-grams: a Jaccard self-join as T-occurrence search.

Two sets that are similar enough share at least T of their elements, so a document has to
be found on T of the inverted lists of another. The search divides the lists as DivideSkip
does. Long lists, of n-grams that very many documents have, are put last in a common order
and are left out of the merge as far as T allows. Short lists are merged by a distributed
sort: of a set's first elements in that order, the lists that no other document is on are
counted and dropped, and a document whose remaining lists are fewer than it needs is done.
What is left names candidates, whose sets are then merged and probed for the exact count.

Only components are wanted, so links inside a group that already hangs together are not
looked for. A first round links every set to one leader of its lists; the second takes the
lists on which more than one component is left, and there compares short marks that bound
how much two sets differ. Sets whose marks allow a link hang together in clusters, which are
searched block by block. A list alone holds nothing together: by lists that sets share by
chance most of a large corpus would be one cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkwell.llm.common import slices, texts_of
from chunkwell.llm.components import connected_components
from chunkwell.functions.membership import split_by_keys
from chunkwell.llm.words import WordHasher, ngrams, set_key
from chunkwell.session import written

#: Elements known to be on long lists: 8 bytes each, so at most 1 MB travels to each task.
LONG_LISTS = 1 << 17
#: An n-gram on so many of the sets that a task counts together, which have about so many
#: elements, is reported as a possible long list.
LOCAL_COUNT, COUNTED = 4, 1_000_000
#: Elements beyond those that must meet, as a share of the set; more prune more and move more.
EXTRA = 0.05
#: Rows of one list held in memory; of longer ones this count stands for the length.
LONGEST = 1 << 16
#: Candidates of one set that one task compares it with.
GROUP = 2_000
#: Sets and elements of one block of a cluster; a task holds two blocks.
BLOCK_SETS, BLOCK_ELEMENTS = 1_000, 400_000
#: Rows of one block of an open list; a task holds two blocks.
LIST_ROWS = 4_000
#: Bits of a set's mark for each element, at least; bits of a mark, at most.
MARK_BITS, LONGEST_MARK = 4, 1 << 16
#: Words of marks compared at a time, and candidates of a set that are compared one by one.
MARK_CELLS, FEW = 1 << 20, 64

_S = np.int64


def _needed(n, percent: int):
    """The least overlap of a set of ``n`` with any set it links with."""
    return (percent * n + 99) // 100


def _extra(n):
    return np.maximum(1, np.floor(EXTRA * n)).astype(np.int64)


def _sets(hasher: WordHasher, texts: list[str], width: int) -> Iterator[np.ndarray]:
    for _, words, _, _ in hasher.texts([t.encode("utf-8", "surrogatepass") for t in texts]):
        yield np.unique(ngrams(words, width))


def shingle_profile(rows: DataFrame, width: int) -> DataFrame:
    """Rows of two kinds: ``(id, tid, n, sig)`` per document and ``(element, seen)``.

    ``tid`` identifies the text and ``sig`` the set, NULL for an empty one. ``element`` was on at least
    ``LOCAL_COUNT`` different sets of those that a task counted together.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=True)
        parts, known, held = [], set(), 0
        kind = None

        def counts() -> pa.RecordBatch:
            values, seen = np.unique(np.concatenate(parts or [np.zeros(0, np.uint64)]), return_counts=True)
            often = seen >= LOCAL_COUNT
            n = int(often.sum())
            none = [pa.nulls(n, kind), *(pa.nulls(n, pa.int64()) for _ in range(3))]
            found = [pa.array(values[often].view(_S)), pa.array(seen[often].astype(_S))]
            return pa.RecordBatch.from_arrays(none + found, names=names)

        for batch in slices(stream):
            ns, sigs, kind = [], [], batch.column(0).type
            for found in _sets(hasher, texts_of(batch.column(1)), width):
                sig = set_key(found) if len(found) else None
                ns.append(len(found))
                sigs.append(sig)
                if sig is not None and sig not in known:
                    known.add(sig)
                    parts.append(found)
                    held += len(found)
            none = pa.nulls(len(ns), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(ns, pa.int64()), pa.array(sigs, pa.int64()), none, none],
                names=names,
            )
            if held > COUNTED:
                yield counts()
                parts, known, held = [], set(), 0
        if parts:
            yield counts()

    names = ["id", "tid", "n", "sig", "element", "seen"]
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, tid bigint, n bigint, sig bigint, element bigint, seen bigint")


def long_lists(profile: DataFrame) -> np.ndarray:
    """The elements on the longest lists, at most ``LONG_LISTS``; any choice gives the same links."""
    longest = (
        profile.where("element IS NOT NULL")
        .groupBy("element")
        .agg(F.sum("seen").alias("seen"))
        .where(F.col("seen") >= 4 * LOCAL_COUNT)
        .orderBy(F.desc("seen"), "element")
        .limit(LONG_LISTS)
        .select("element")
    )
    return np.sort(longest.toArrow().column(0).to_numpy())


def first_elements(rows: DataFrame, width: int, percent: int, long: np.ndarray) -> DataFrame:
    """``(element, sig)``: the first elements of every set in the common order.

    Elements on long lists come last, else the order is that of the hashes. Two linked
    sets, each cut after ``n - needed + extra`` elements, share at least the smaller extra.
    Equal sets of a task give their elements once.
    """
    shared = rows.sparkSession.sparkContext.broadcast(long)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, known, late = WordHasher(lower=True), set(), shared.value
        for batch in slices(stream):
            elements, sigs = [np.zeros(0, np.uint64)], [np.zeros(0, _S)]
            for found in _sets(hasher, texts_of(batch.column(0)), width):
                if not len(found) or (sig := set_key(found)) in known:
                    continue
                known.add(sig)
                n = len(found)
                size = min(n, int(n - _needed(n, percent) + _extra(n)))
                if len(late):
                    place = np.minimum(np.searchsorted(late, found.view(_S)), len(late) - 1)
                    last = late[place] == found.view(_S)
                    found = np.concatenate([found[~last], found[last]])
                elements.append(found[:size])
                sigs.append(np.full(size, sig, _S))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(elements).view(_S)), pa.array(np.concatenate(sigs))],
                names=["element", "sig"],
            )

    return rows.select("text").mapInArrow(run, "element bigint, sig bigint")


def merge_lists(postings: DataFrame) -> DataFrame:
    """``(sig, element, length, leader)`` of all lists with two sets or more.

    Sorted by element and set, the lists stream through a task; a list is held until it
    ends or ``LONGEST`` rows are reached. The leader is its first set.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        element, sig = np.zeros(0, _S), np.zeros(0, _S)
        running: tuple[int, int] | None = None  # element and leader of a list already begun

        def made(e: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
            lengths = np.diff(np.append(starts, len(e)))
            leader, length = np.repeat(s[starts], lengths), np.repeat(lengths, lengths)
            if running and len(e) and e[0] == running[0]:
                leader[: lengths[0]], length[: lengths[0]] = running[1], LONGEST
            length = np.minimum(length, LONGEST)
            keep = length > 1
            return pa.RecordBatch.from_arrays(
                [pa.array(x[keep].astype(_S)) for x in (s, e, length, leader)],
                names=["sig", "element", "length", "leader"],
            )

        for batch in stream:
            e = np.concatenate([element, batch.column(0).to_numpy()])
            s = np.concatenate([sig, batch.column(1).to_numpy()])
            if not len(e):
                continue
            new = np.concatenate([[True], (e[1:] != e[:-1]) | (s[1:] != s[:-1])])
            e, s = e[new], s[new]
            cut = int(np.searchsorted(e, e[-1]))
            if cut:
                yield made(e[:cut], s[:cut])
            if running and running[0] != e[-1]:
                running = None
            if len(e) - cut > LONGEST:  # let go of all but the last row, which may come again
                running = running or (int(e[-1]), int(s[cut]))
                yield made(e[cut:-1], s[cut:-1])
                cut = len(e) - 1
            element, sig = e[cut:], s[cut:]
        if len(element):
            yield made(element, sig)

    dealt = postings.repartition("element").sortWithinPartitions("element", "sig")
    return dealt.mapInArrow(run, "sig bigint, element bigint, length bigint, leader bigint")


def overlaps(query: np.ndarray, sets: list[np.ndarray], needed: np.ndarray) -> np.ndarray:
    """For every set, whether it shares at least ``needed`` elements with the query: DivideSkip.

    The inverted lists of the query's elements over ``sets`` are divided by length. The
    short ones are merged in one sort and counted; a set that cannot reach its number even
    if it is on all long lists is out; the others are looked up in the long lists.
    """
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    elements = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    place = np.minimum(np.searchsorted(query, elements), len(query) - 1)
    hit = query[place] == elements
    place, owner = place[hit], owner[hit]
    lengths = np.bincount(place, minlength=len(query))
    least = int(needed.min(initial=len(query)))
    # the share of long lists that balances merging and probing
    longest = int(lengths.max(initial=1))
    number = min(max(0, least - 1), int(least / (0.01 * np.log2(longest + 1) + 1)))
    long = np.argsort(lengths, kind="stable")[len(query) - number :]
    is_long = np.zeros(len(query), bool)
    is_long[long] = True
    short = ~is_long[place]
    counts = np.bincount(owner[short], minlength=len(sets))
    for k in np.flatnonzero(counts + number >= needed):
        own = sets[k]
        wanted = query[long]
        at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
        counts[k] += int((own[at] == wanted).sum())
    return counts >= needed


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: the pairs whose sets are similar enough.

    A query set meets its candidates in groups of about ``GROUP``, so a leader of very
    many sets is copied to as many tasks as its candidates need.
    """
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    many = many.select("a", F.ceil(F.col("n") / GROUP).alias("groups"))
    asked = many.select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"))
    # sets move however few the pairs are, so that the plan is the same at every size
    asked = asked.hint("merge").join(sets, asked["a"] == sets["sig"]).select(
        "a", "part", F.lit(None).cast("bigint").alias("b"), "elements"
    )
    given = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), "groups").alias("part"))
    given = given.hint("merge").join(sets, given["b"] == sets["sig"]).select("a", "part", "b", "elements")
    met = asked.union(given).repartition("a", "part")
    met = met.sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def check(a: int, query: np.ndarray, held: list[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
        total = np.array([len(query) + len(s) for _, s in held], dtype=np.int64)
        needed = (percent * total + 99 + percent) // (100 + percent)
        # 100 * overlap >= percent * (total - overlap)
        ok = overlaps(query, [s for _, s in held], needed)
        return [(a, b) for (b, _), fine in zip(held, ok) if fine]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = query = None
        held: list[tuple[int, np.ndarray]] = []
        for batch in slices(stream):
            links = []
            for a, part, b, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, part) != key or len(held) >= 64:
                    if held:
                        links += check(key[0], query, held)
                    held = []
                values = np.frombuffer(raw, np.uint64)
                if b is None:
                    key, query = (a, part), values
                else:
                    held.append((b, values))
            yield _pairs(links)
        if held:
            yield _pairs(check(key[0], query, held))

    return met.mapInArrow(run, "a bigint, b bigint")


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    columns = zip(*links) if links else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])


def mark(elements: np.ndarray) -> bytes:
    """The parities of the numbers of elements that fall on each of a power of two of places.

    The bits in which the marks of two sets differ are at most as many as the elements that
    only one of the sets has. A mark's halves, one upon the other, are the mark of half the places.
    """
    places = 64
    while places < min(MARK_BITS * len(elements), LONGEST_MARK):
        places *= 2
    at = (elements & np.uint64(places - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=places) & 1).astype(np.uint8)).tobytes()


def near_marks(
    n: np.ndarray, component: np.ndarray, marks: list[bytes], percent: int
) -> Iterator[tuple[int, np.ndarray]]:
    """``(q, others)``: rows of other components that by size and mark may be linked with row ``q``.

    Every pair that links is there, from one of its ends at least: rows of the commonest
    component are not asked for. Marks of different length meet at the shorter one's.
    """
    lengths = np.array([len(m) for m in marks])
    names, often = np.unique(component, return_counts=True)
    common = names[often.argmax()]
    order = np.argsort(n, kind="stable")
    for length in np.unique(lengths):
        most = 100 * n[lengths == length].max() // percent
        rows, words = order[(lengths[order] >= length) & (n[order] <= most)], int(length) // 8
        asked = np.flatnonzero(component[rows] != common)
        if not len(asked):
            continue
        folded = []
        for long in np.unique(lengths[rows]):
            raw = b"".join([marks[k] for k in rows[lengths[rows] == long]])
            folded.append(np.bitwise_xor.reduce(np.frombuffer(raw, np.uint64).reshape(-1, long // length, words), axis=1))
        bits = np.concatenate(folded)
        sizes, group, wide = n[rows], component[rows], lengths[rows] > length
        step = max(1, MARK_CELLS // (len(rows) * words))
        for start in range(0, len(asked), step):
            some = asked[start : start + step]
            low = int(np.searchsorted(sizes, (percent * sizes[some[0]] + 99) // 100))
            high = int(np.searchsorted(sizes, 100 * sizes[some[-1]] // percent, side="right"))
            apart = np.bitwise_count(bits[some][:, None, :] ^ bits[low:high]).sum(axis=2, dtype=np.int64)
            mine, theirs = sizes[some][:, None], sizes[low:high]
            needed = (percent * (mine + theirs) + 99 + percent) // (100 + percent)
            open_ = (apart <= mine + theirs - 2 * needed) & (needed <= np.minimum(mine, theirs))
            open_ &= (group[some][:, None] != group[low:high]) & ~(wide[some][:, None] & wide[low:high])
            for k in np.flatnonzero(open_.any(axis=1)):
                yield int(rows[some[k]]), rows[low + np.flatnonzero(open_[k])]


def near_edges(open_lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: edges that hold together all sets which may be linked by some list.

    ``open_lists`` are ``(element, length, sig, n, component)``, all rows of a list with its
    length. A list is cut into blocks of bounded size, and every pair of blocks is compared
    by one task, which returns no more edges than it has sets.
    """
    dealt = open_lists.withColumn("k", F.ceil(F.col("length") / LIST_ROWS))
    dealt = dealt.withColumn("i", F.pmod(F.xxhash64("sig"), "k")).withColumn(
        "t", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1))
    )
    task = F.xxhash64("element", F.least("i", "t"), F.greatest("i", "t")).alias("task")
    met = dealt.select(task, "sig", "n", "component").hint("merge").join(sets.select("sig", "mark"), "sig")
    met = met.select("task", "sig", "n", "component", "mark").repartition("task").sortWithinPartitions("task")

    def edges(held: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int]]:
        if len(held) < 2:
            return []
        sigs, n, component, marks = zip(*held)
        tree, found = np.arange(len(held)), []
        for q, others in near_marks(np.array(n), np.array(component), list(marks), percent):
            names, first = np.unique(tree[others], return_index=True)
            new = names != tree[q]
            found += [(sigs[q], sigs[d]) for d in others[first[new]]]
            tree[np.isin(tree, names[new])] = tree[q]
        return found

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in slices(stream):
            found = []
            for task, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if task != now:
                    found += edges(held)
                    now, held = task, []
                held.append(row)
            yield _pairs(found)
        yield _pairs(edges(held))

    return met.mapInArrow(run, "a bigint, b bigint")


def search_clusters(open_sets: DataFrame, edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: links between components among sets that hang together by edges.

    ``open_sets`` are ``(sig, n, component)``; ``edges`` are ``(a, b)``, which need not be
    links, but every link is within what they hold together.
    Sets that can link are of one cluster and of the same or the next size class. A cluster's
    class is cut into blocks of bounded size, and every pair of blocks that can hold a link
    is searched by one task: a set travels once per block it may meet, not once per pair.
    """
    clusters = connected_components(edges)
    base = float(np.log(100 / percent * 1.01))
    cells = open_sets.join(clusters.withColumnRenamed("component", "cluster"), F.col("sig") == F.col("node"))
    cells = cells.select(
        "sig", "component", "cluster", "n", F.floor(F.log("n") / base).cast("int").alias("size")
    )
    blocks = cells.groupBy("cluster", "size").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_ELEMENTS)).alias("k")
    )
    own = cells.join(blocks, ["cluster", "size"]).withColumn("i", F.pmod(F.xxhash64("sig"), "k"))

    def other(step: int) -> DataFrame:
        return blocks.select("cluster", (F.col("size") + step).alias("size"), F.col("k").alias("others"))

    def every(last: str):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(last) - 1)).alias("t")

    kept = ["cluster", "size", "sig", "component"]
    same = own.select(*kept, "i", every("k"))
    same = same.select(*kept, F.least("i", "t").alias("i"), F.greatest("i", "t").alias("j"), F.lit(0).alias("next"))
    lower = own.join(other(-1), ["cluster", "size"]).select(*kept, "i", every("others"))
    lower = lower.select(*kept, "i", F.col("t").alias("j"), F.lit(1).alias("next"))
    upper = own.join(other(1), ["cluster", "size"]).select(*kept, "i", every("others"))
    upper = upper.withColumn("size", F.col("size") - 1)
    upper = upper.select(*kept, F.col("t").alias("i"), F.col("i").alias("j"), F.lit(1).alias("next"))
    # a task with one component has nothing to find
    place = ["cluster", "size", "next", "i", "j"]
    dealt = same.union(lower).union(upper)
    worth = dealt.groupBy(*place).agg(F.min("component").alias("low"), F.max("component").alias("high"))
    dealt = dealt.join(worth.where("low < high").drop("low", "high"), place)
    task = F.xxhash64(*place).alias("task")
    met = dealt.select(task, "sig", "component").hint("merge").join(sets, "sig")
    met = met.select("task", "sig", "component", "elements", "mark")
    met = met.repartition("task").sortWithinPartitions("task")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in slices(stream):
            links = []
            for task, sig, component, raw, own in zip(*(c.to_pylist() for c in batch.columns)):
                if task != now:
                    links += block_links(held, percent)
                    now, held = task, []
                held.append((sig, component, np.frombuffer(raw, np.uint64), own))
            yield _pairs(links)
        yield _pairs(block_links(held, percent))

    return met.mapInArrow(run, "a bigint, b bigint")


def block_links(held: list[tuple[int, int, np.ndarray, bytes]], percent: int) -> list[tuple[int, int]]:
    """Links between different components of a block: DivideSkip among the sets that marks leave.

    A few of them are compared with the query, many are counted by the block's inverted lists.
    A found link joins its components, so that later queries skip what is joined already.
    """
    if len(held) < 2:
        return []
    sigs, component, sets, marks = zip(*held)
    sizes = np.array([len(e) for e in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    root = np.array(component)
    dense = None
    links = []
    for q, others in near_marks(sizes, np.array(component), list(marks), percent):
        others = others[root[others] != root[q]]
        needed = (percent * (sizes[q] + sizes) + 99 + percent) // (100 + percent)
        if len(others) > FEW:
            if dense is None:  # the block's inverted lists
                _, dense = np.unique(np.concatenate(sets), return_inverse=True)
                order = np.argsort(dense, kind="stable")
                owner = np.repeat(np.arange(len(held)), sizes)[order]
                ends = np.searchsorted(dense[order], np.arange(dense.max() + 2))
            mine = dense[starts[q] : starts[q + 1]]
            lengths = ends[mine + 1] - ends[mine]
            least = int(needed[others].min())
            number = min(least - 1, int(least / (0.01 * np.log2(lengths.max() + 1) + 1)), len(mine))
            divided = np.argsort(lengths, kind="stable")
            short, long = mine[divided[: len(mine) - number]], np.sort(mine[divided[len(mine) - number :]])
            merged = [owner[ends[e] : ends[e + 1]] for e in short]
            counts = np.bincount(np.concatenate(merged or [np.zeros(0, np.int64)]), minlength=len(held))
            others = others[counts[others] + number >= needed[others]]
            for d in others:
                if root[d] == root[q]:
                    continue
                theirs = dense[starts[d] : starts[d + 1]]
                at = np.minimum(np.searchsorted(theirs, long), len(theirs) - 1)
                if counts[d] + int((theirs[at] == long).sum()) >= needed[d]:
                    links.append((sigs[q], sigs[d]))
                    root[root == root[d]] = root[q]
        elif len(others):
            fine = overlaps(sets[q], [sets[d] for d in others], needed[others])
            for d in others[fine]:
                if root[d] != root[q]:
                    links.append((sigs[q], sigs[d]))
                    root[root == root[d]] = root[q]
    return links


def stored_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``(sig, elements, mark)``: the sorted sets of the wanted documents ``(sig, id, tid)``.

    Only texts that can be wanted are moved, so ``wanted`` should be a written table.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=True)
        for batch in slices(stream):
            made = [(s.tobytes(), mark(s)) for s in _sets(hasher, texts_of(batch.column(1)), width)]
            sets, marks = zip(*made) if made else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sets, pa.binary()), pa.array(marks, pa.binary())],
                names=["sig", "elements", "mark"],
            )

    near, _ = split_by_keys(docs, wanted.select("id", "tid"), ["id", "tid"])
    same = near["id"].eqNullSafe(wanted["id"]) & (near["tid"] == wanted["tid"])
    found = near.join(wanted.hint("merge"), same).select("sig", "text")
    return found.mapInArrow(run, "sig bigint, elements binary, mark binary")


def jaccard_components(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(id, n_shingles, component_id)``, one row per input row; see :func:`jaccard_members`."""
    members = jaccard_members(docs, width, percent, id_col=id_col, text_col=text_col)
    return members.select("id", "n_shingles", "component_id")


def jaccard_members(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(id, tid, n_shingles, component, component_id)``, one row per input row.

    A document's set are its distinct runs of ``width`` words in A-Z lower case, all its
    words as one if there are fewer; two documents link if the overlap is at least
    ``percent`` percent of the union, and a component is named by its smallest id.

    NULL, empty and blank texts have an empty set, link with nothing and are their own
    component, with a NULL ``component``. Repeated rows and equal texts are one set. A NULL id is a member like any
    other but never names a component that has another id. Other columns are not read.

    Every link between different sets is found, up to collisions of 64-bit hashes. Texts
    are read three times and moved once; per set, a quarter of its elements is moved, then
    only lists that meet. Tables that are used again are written to the shared folder.
    """
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("tid"))
    profile = written(shingle_profile(rows, width))
    members = profile.where("n IS NOT NULL").select("id", "tid", "n", "sig")
    one = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tid")).alias("one")
    nodes = members.where("sig IS NOT NULL").groupBy("sig").agg(F.min("id").alias("id"), F.max("n").alias("n"), one)

    postings = first_elements(rows, width, percent, long_lists(profile))
    lists = merge_lists(postings).join(nodes.select("sig", "n"), "sig")
    # keep the rarest lists, so many that linked sets share one of them
    extra = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100) * EXTRA))
    mine = Window.partitionBy("sig")
    lists = (
        lists.withColumn("m", F.count(F.lit(1)).over(mine))
        .where(F.col("m") >= extra)
        .withColumn("place", F.row_number().over(mine.orderBy("length", "element")))
        .where(F.col("place") <= F.col("m") - extra + 1)
    )
    lists = written(lists.select("sig", "element", "leader", "n"))

    wanted = lists.select("sig").union(lists.select("leader")).distinct()
    wanted = written(nodes.join(wanted, "sig", "left_semi").select("sig", "one.id", "one.tid"))
    sets = written(stored_sets(rows, wanted, width))

    leaders = lists.where("leader != sig").groupBy("sig", "leader").agg(F.count(F.lit(1)).alias("k"))
    leaders = leaders.groupBy("sig").agg(F.max_by("leader", F.struct("k", "leader")).alias("a"))
    tried = written(leaders.select("a", F.col("sig").alias("b")))
    links = written(verify(tried, sets, percent))

    joined = connected_components(links)
    placed = lists.join(joined, F.col("sig") == F.col("node"), "left").select(
        "sig", "element", "n", F.coalesce("component", "sig").alias("component")
    )
    mixed = placed.groupBy("element").agg(
        F.min("component").alias("low"),
        F.max("component").alias("high"),
        F.count(F.lit(1)).alias("length"),
        F.min("sig").alias("first"),
        F.max("sig").alias("last"),
        F.bit_xor(F.xxhash64("sig")).alias("members"),
    )
    # of lists with the same sets one is enough
    mixed = mixed.where("low < high").groupBy("length", "first", "last", "members").agg(F.min("element").alias("element"))
    open_lists = placed.join(mixed.select("element", "length").hint("merge"), "element")
    open_lists = written(open_lists.select("element", "length", "sig", "n", "component"))
    edges = written(near_edges(open_lists, sets, percent))
    open_sets = open_lists.select("sig", "n", "component").distinct()
    more = written(search_clusters(open_sets, edges, sets, percent))
    groups = connected_components(links.union(more))

    named = nodes.join(groups, F.col("sig") == F.col("node"), "left")
    named = named.select("sig", "id", F.coalesce("component", "sig").alias("component"))
    smallest = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = named.join(smallest, "component").select("sig", "component", "component_id")
    return members.join(named, "sig", "left").select(
        "id",
        "tid",
        F.col("n").alias("n_shingles"),
        "component",
        F.when(F.col("sig").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )
