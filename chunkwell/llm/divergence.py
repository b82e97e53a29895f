"""Source divergence audit: how far the sources of a language lie apart, term by term.

Tasks fold whole documents into stripes, one per language and term, that hold the number
of documents and the count in every source. Stripes are spilled when there are many,
merged by key, and every merged stripe says at once how it pulls sources apart. All
arithmetic is on integers, so results do not depend on the order of rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkwell.llm.terms import folded, runs
from chunkwell.session import written

#: Runs of letters: A-Z are lower-cased, all beyond ASCII counts as a letter.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: A task spills its stripes beyond so many (term, source) entries.
SPILL_ENTRIES = 400_000
#: Stripes in a batch that a task puts out.
BATCH_STRIPES = 4_000
#: Sources that are compared at a time; a language with more is cut into blocks.
BLOCK_SOURCES = 1_000
#: Cells of a table of counts that a task holds at a time.
CELLS = 1_000_000
#: Sums of block pairs that a task holds before it puts them out.
HELD_PAIRS = 16
#: Shares are whole numbers of this.
UNIT = 1_000_000_000

_STRIPE = "lang string, term binary, n_docs bigint, sources array<string>, counts array<bigint>"
_FOUND = "lang string, source string, part string, item binary, value bigint, n_terms bigint"


def _stripe_batch(langs, terms, n_docs, sizes: np.ndarray, sources, counts) -> pa.RecordBatch:
    """Stripes from flat columns; ``sizes`` says how many sources belong to each."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    columns = [
        pa.array(langs, pa.string()),
        pa.array(terms, pa.binary()),
        pa.array(n_docs, pa.int64()),
        pa.ListArray.from_arrays(offsets, pa.array(sources, pa.string())),
        pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "term", "n_docs", "sources", "counts"])


class _Stripes:
    """Stripes of a task: language to term to ``{source: count}``, with the documents under ``0``."""

    def __init__(self) -> None:
        self.langs: dict[str, dict[bytes, dict]] = {}
        self.entries = 0

    def fold(self, lang: str, source: str, data: bytes) -> None:
        counted: Counter = Counter()
        for found in runs(TERM, data):
            counted.update(found)
        stripes = self.langs.setdefault(lang, {})
        for term, n in counted.items():
            stripe = stripes.get(term)
            if stripe is None:
                stripes[term] = {0: 1, source: n}
                self.entries += 1
                continue
            stripe[0] += 1
            if source in stripe:
                stripe[source] += n
            else:
                stripe[source] = n
                self.entries += 1

    def take(self) -> Iterator[pa.RecordBatch]:
        """All stripes in batches; none are left."""
        while self.langs:
            lang, stripes = self.langs.popitem()
            rows = iter(stripes.items())
            while part := list(islice(rows, BATCH_STRIPES)):
                terms, held = zip(*part)
                n_docs = [stripe.pop(0) for stripe in held]
                sizes = np.fromiter(map(len, held), np.int64, len(held))
                counts = list(chain.from_iterable(stripe.values() for stripe in held))
                yield _stripe_batch([lang] * len(part), terms, n_docs, sizes, list(chain.from_iterable(held)), counts)
        self.entries = 0


def _folded_stripes(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stripes = _Stripes()
    for batch in stream:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang, source, data in zip(langs, sources, folded(batch.column(2))):
            stripes.fold(lang, source, data)
            if stripes.entries >= SPILL_ENTRIES:
                yield from stripes.take()
    yield from stripes.take()


class _Flat:
    """Columns of stripes with their lists flat, so that stripes are merged array by array."""

    def __init__(self, langs, terms, n_docs: np.ndarray, sizes: np.ndarray, sources, counts: np.ndarray):
        self.langs, self.terms, self.n_docs = langs, terms, n_docs
        self.sizes, self.sources, self.counts = sizes, sources, counts

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> _Flat:
        sources = batch.column(3)
        return cls(
            batch.column(0).cast(pa.string()),
            batch.column(1).cast(pa.binary()),
            batch.column(2).to_numpy(zero_copy_only=False),
            pc.list_value_length(sources).to_numpy(zero_copy_only=False).astype(np.int64),
            pc.list_flatten(sources).cast(pa.string()),
            pc.list_flatten(batch.column(4)).to_numpy(zero_copy_only=False),
        )

    def then(self, other: _Flat) -> _Flat:
        return _Flat(
            pa.concat_arrays([self.langs, other.langs]),
            pa.concat_arrays([self.terms, other.terms]),
            np.concatenate([self.n_docs, other.n_docs]),
            np.concatenate([self.sizes, other.sizes]),
            pa.concat_arrays([self.sources, other.sources]),
            np.concatenate([self.counts, other.counts]),
        )

    def merged(self) -> _Flat:
        """One stripe per run of the same language and term."""
        n = len(self.terms)
        other = pc.or_(
            pc.not_equal(self.terms.slice(1), self.terms.slice(0, n - 1)),
            pc.not_equal(self.langs.slice(1), self.langs.slice(0, n - 1)),
        )
        run = np.concatenate([[0], np.cumsum(other.to_numpy(zero_copy_only=False).astype(np.int64))])
        starts = np.flatnonzero(np.diff(run, prepend=-1))
        coded = self.sources.dictionary_encode()
        names = len(coded.dictionary) or 1
        key = np.repeat(run, self.sizes) * names + coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        return _Flat(
            self.langs.take(pa.array(starts)),
            self.terms.take(pa.array(starts)),
            np.add.reduceat(self.n_docs, starts),
            np.bincount(key[first] // names, minlength=len(starts)),
            coded.dictionary.take(pa.array(key[first] % names)),
            np.add.reduceat(self.counts[order], first),
        )

    def split(self, at: int) -> tuple[_Flat, _Flat]:
        """The stripes before a place and from it on."""
        cut = int(self.sizes[:at].sum())
        columns = (self.langs, self.terms, self.n_docs, self.sizes), (self.sources, self.counts)
        parts = []
        for rows, entries in ((slice(None, at), slice(None, cut)), (slice(at, None), slice(cut, None))):
            head, tail = [c[rows] for c in columns[0]], [c[entries] for c in columns[1]]
            parts.append(_Flat(*head, *tail))
        return parts[0], parts[1]

    def batch(self) -> pa.RecordBatch:
        return _stripe_batch(self.langs, self.terms, self.n_docs, self.sizes, self.sources, self.counts)


def _merged(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges rows that are sorted by language and term; of the last stripe more may come."""
    last = None
    for batch in stream:
        if batch.num_rows:
            flat = _Flat.of(batch)
            whole, last = (last.then(flat) if last else flat).merged().split(-1)
            yield whole.batch()
    if last:
        yield last.batch()


def term_stripes(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """``(lang, term, n_docs, sources, counts)`` of every term of every language, whole.

    NULL in any of the three columns is the empty text. Documents are counted by rows, so
    a repeated row is another document. A task holds at most about ``SPILL_ENTRIES``
    entries and the terms of one document; a stripe is as long as its language has
    sources. A term that stands in every document arrives at the merge as one row per
    task and spill, and is folded row by row.
    """
    blank = F.lit("")
    rows = docs.select(*[F.coalesce(F.col(c), blank).alias(c) for c in (lang_col, source_col, text_col)])
    partial = rows.mapInArrow(_folded_stripes, _STRIPE)
    sorted_rows = partial.repartition("lang", "term").sortWithinPartitions("lang", "term")
    return sorted_rows.mapInArrow(_merged, _STRIPE)


def share(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """``1 + UNIT * count // total`` exactly, by long division in thousands."""
    whole, rest = np.divmod(count, total)
    for _ in range(3):
        rest = rest * 1000
        digit, rest = np.divmod(rest, total)
        whole = whole * 1000 + digit
    return whole + 1


class _Block:
    """What a task needs to know of a pair of blocks of sources."""

    def __init__(self, row: dict):
        self.lang = row["lang"]
        self.left, self.right = row["left_sources"], row["right_sources"]
        self.n_left, self.n_right = (np.array(row[k], np.int64) for k in ("left_n", "right_n"))
        self.terms, self.total = row["n_kept"], row["lang_n"]
        self.sums = np.zeros((len(self.left), len(self.right)), np.int64)
        self.seen = np.zeros_like(self.sums)
        self.top: dict[int, list[tuple[int, bytes]]] = {}

    def counts(self, column: pa.Array, sources: list[str], numbers: pa.Array) -> np.ndarray:
        """Rows by sources, zeros where a term does not occur."""
        out = np.zeros((len(column), len(sources)), np.int64)
        rows = pc.list_parent_indices(column).to_numpy(zero_copy_only=False)
        places = pc.index_in(pc.list_flatten(column), value_set=pa.array(sources, pa.string()))
        out[rows, places.to_numpy(zero_copy_only=False)] = pc.list_flatten(numbers).to_numpy(zero_copy_only=False)
        return out

    def add(self, rows: pa.RecordBatch, ranks: int) -> None:
        left = self.counts(rows["left"], self.left, rows["left_counts"])
        right = self.counts(rows["right"], self.right, rows["right_counts"])
        self.pairs(left, right)
        if rows["own"][0].as_py() and ranks:
            overall = share(rows["total"].to_numpy(zero_copy_only=False) + 1, self.total + self.terms)
            self.leaders(left, overall, rows["term"], ranks)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> None:
        """Adds the differences of all terms that occur in one of the two sources.

        Terms that occur in neither differ alike; they are counted, not visited.
        """
        p = share(left + 1, self.n_left + self.terms)
        q = share(right + 1, self.n_right + self.terms)
        has_left, has_right = left > 0, right > 0
        col, row = np.nonzero(has_right.T)
        starts = np.searchsorted(col, np.arange(len(self.right) + 1))
        found = q[row, col]
        for a in range(len(self.left)):
            mine = has_left[:, a]
            theirs = q[mine]
            self.sums[a] += ((p[mine, a][:, None] - theirs) ** 2 // theirs).sum(axis=0)
            none = share(np.ones(1, np.int64), int(self.n_left[a]) + self.terms)[0]
            apart = (none - found) ** 2 // found
            apart[mine[row]] = 0
            upto = np.concatenate([[0], np.cumsum(apart)])
            self.sums[a] += upto[starts[1:]] - upto[starts[:-1]]
        both = has_left.T.astype(np.float64) @ has_right.astype(np.float64)
        self.seen += has_left.sum(axis=0)[:, None] + has_right.sum(axis=0)[None, :] - both.astype(np.int64)

    def leaders(self, counts: np.ndarray, overall: np.ndarray, terms: pa.Array, ranks: int) -> None:
        """Keeps every source's terms of the highest values, ties by the term's bytes."""
        for a in np.flatnonzero(counts.any(axis=0)).tolist():
            rows = np.flatnonzero(counts[:, a])
            p, q = share(counts[rows, a] + 1, int(self.n_left[a]) + self.terms), overall[rows]
            rows, p, q = rows[p > q], p[p > q], q[p > q]
            values = (p - q) ** 2 // q
            if len(values) > ranks:
                enough = np.flatnonzero(values >= np.partition(values, -ranks)[-ranks])
                rows, values = rows[enough], values[enough]
            fresh = zip((-values).tolist(), terms.take(pa.array(rows)).to_pylist())
            self.top[a] = sorted([*self.top.get(a, []), *fresh])[:ranks]

    def rows(self) -> Iterator[tuple]:
        for a, source in enumerate(self.left):
            for b, other in enumerate(self.right):
                if source != other and self.seen[a, b]:
                    item = other.encode("utf-8", "surrogatepass")
                    yield self.lang, source, "pair", item, int(self.sums[a, b]), int(self.seen[a, b])
            for value, term in self.top.get(a, []):
                yield self.lang, source, "term", term, -value, 0


def _found_batch(block: _Block) -> pa.RecordBatch:
    columns = list(zip(*block.rows())) or [[]] * 6
    kinds = (pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
    names = ["lang", "source", "part", "item", "value", "n_terms"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _differences(ranks: int):
    """From stripes with their block pair's sources to sums per pair and leading terms."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, _Block] = {}
        for batch in stream:
            keys = list(zip(*(batch[k].to_pylist() for k in ("lang", "i", "j"))))
            places: dict[tuple, list[int]] = {}
            for at, key in enumerate(keys):
                places.setdefault(key, []).append(at)
            for key, rows in places.items():
                if key not in held:
                    if len(held) >= HELD_PAIRS:
                        for block in held.values():
                            yield _found_batch(block)
                        held = {}
                    held[key] = _Block(batch.slice(rows[0], 1).to_pylist()[0])
                block = held[key]
                step = max(1, CELLS // (len(block.left) + len(block.right)))
                for at in range(0, len(rows), step):
                    block.add(batch.take(pa.array(rows[at : at + step])), ranks)
        for block in held.values():
            yield _found_batch(block)

    return run


def source_divergence(
    docs: DataFrame,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    *,
    least_docs: int = 3,
    ranks: int = 200,
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how sources differ, and by which terms.

    Each language keeps the V terms that stand in at least ``least_docs`` of its documents.
    A source, and the language as a whole, gives a term that it counts c times among N
    the share ``p = 1 + UNIT * (c + 1) // (N + V)``. Terms differ by ``(p - q)^2 // q``.
    Part ``pair`` has for each other source the sum over all kept terms, part ``term`` the
    ``ranks`` leading terms that the source has and gives more than its language does.
    ``rank`` counts from 1 by descending value, ties by the item's bytes.

    NULLs are empty texts; empty texts and repeated rows count as documents; a source
    without terms has pairs, and without kept terms their value is 0; an empty table gives
    an empty result. Only the three named columns are read, so names cannot clash.

    Hot terms and sources are folded before they are shuffled. The numbers of sources
    travel with the stripes in blocks of about ``BLOCK_SOURCES``, dealt over salts, so
    neither a language nor a source gathers in a task. Rows of the part ``pair`` are the
    square of a language's sources by definition.
    """
    spark = docs.sparkSession
    kept = written(term_stripes(docs, lang_col, source_col, text_col).where(F.col("n_docs") >= least_docs))
    blank = F.lit("")
    pairs = docs.select(
        F.coalesce(F.col(lang_col), blank).alias("lang"), F.coalesce(F.col(source_col), blank).alias("source")
    )
    entries = F.arrays_zip(F.col("sources").alias("source"), F.col("counts").alias("n"))
    entry = kept.select("lang", F.inline(entries))
    counted = entry.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = pairs.distinct().join(counted, ["lang", "source"], "left").na.fill(0, ["n"])
    langs = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count(F.lit(1)).alias("n_sources"))
    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_kept"))
    langs = written(langs.join(terms, "lang", "left").na.fill(0, ["n_kept"]))
    most = langs.agg(F.max("n_sources")).head()[0] or 1
    blocks, salts = math.ceil(most / BLOCK_SOURCES), int(spark.conf.get("spark.sql.shuffle.partitions"))

    def block(source):
        return F.pmod(F.xxhash64(source), F.lit(blocks)).cast("int")

    groups = written(groups.join(langs, "lang").withColumn("block", block(F.col("source"))))
    sources = groups.groupBy("lang", "lang_n", "n_kept", "block").agg(
        F.sort_array(F.collect_list(F.struct("source", "n"))).alias("held")
    )

    def side(number: str, name: str) -> DataFrame:
        return sources.select(
            "lang",
            "lang_n",
            "n_kept",
            F.col("block").alias(number),
            F.col("held.source").alias(f"{name}_sources"),
            F.col("held.n").alias(f"{name}_n"),
        )

    sides = side("i", "left").join(side("j", "right").drop("lang_n", "n_kept"), "lang")
    sides = sides.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def part(number: str, name: str) -> list:
        held = F.filter(entries, lambda e: block(e["source"]) == F.col(number))
        return [held["source"].alias(name), held["n"].alias(f"{name}_counts")]

    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    present = F.array_distinct(F.transform("sources", block))
    both = F.flatten(
        F.transform(every, lambda i: F.transform(every, lambda j: F.struct(i.alias("i"), j.alias("j"))))
    )
    touched = F.filter(both, lambda x: F.array_contains("present", x["i"]) | F.array_contains("present", x["j"]))
    total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda s, n: s + n)
    stripes = (
        kept.withColumn("present", present)
        .withColumn("total", total)
        .withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int"))
        .select("lang", "term", "total", "salt", "sources", "counts", F.inline(touched))
        .select(
            "lang", "term", "total", "salt", "i", "j", (F.col("i") == F.col("j")).alias("own"),
            *part("i", "left"), *part("j", "right"),
        )
    )
    found = written(stripes.join(sides, ["lang", "i", "j", "salt"]).mapInArrow(_differences(ranks), _FOUND))

    named = ["lang", "source"]
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(by_value)
    top = found.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= ranks)
    summed = found.where("part = 'pair'").groupBy(*named, "item").agg(
        F.sum("value").alias("value"), F.sum("n_terms").alias("n_terms")
    )
    p, q = (F.expr(f"1 + {UNIT}L div nullif({n} + n_kept, 0)") for n in ("n", "other_n"))
    others = groups.select("lang", F.col("source").alias("other"), F.col("n").alias("other_n"))
    apart = (
        groups.join(others, "lang")
        .where("source != other")
        .withColumn("item", F.col("other").cast("binary"))
        .withColumns({"p": p, "q": q})
        .withColumn("none", F.expr("(p - q) * (p - q) div q"))
        .join(summed, [*named, "item"], "left")
        .withColumn(
            "value",
            F.coalesce("value", F.lit(0))
            + F.coalesce((F.col("n_kept") - F.coalesce("n_terms", F.lit(0))) * F.col("none"), F.lit(0)),
        )
        .select(*named, F.lit("pair").alias("part"), "item", "value")
        .withColumn("rank", rank)
    )
    both_parts = apart.unionByName(top.select(*apart.columns))
    return both_parts.withColumn("item", F.col("item").cast("string"))
