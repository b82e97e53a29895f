"""Passages that repeat across documents, by a sparse suffix array over words.

Suffixes are kept where a minimiser stands: the position with the smallest hash of a few
words in a window. A repeated passage selects the same positions in all its copies, and
the first of them begins within its first ``window`` words. Suffixes are sorted by their next
``least - window + 1`` words, by hash; those whose neighbours under the same key come from
another text are kept and extended: every run of ``least`` words that reaches to the left
and right of the position is compared in the same way. What is found is the union of all
runs of ``least`` words that also stand in another text, no more and no less.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkwell.llm.common import slices, texts_of
from chunkwell.llm.words import WordHasher, mix
from chunkwell.session import written

#: Words hashed for choosing minimisers, and positions of which one is kept.
GRAM, WINDOW = 6, 12
#: Keys known to be on many texts: 8 bytes each, so at most 1 MB travels to each task.
HOT_KEYS = 1 << 17
#: A key on so many of the texts that a task counts together, which have about so many
#: keys, may be hot; a hot key is dealt over so many tasks.
LOCAL_COUNT, COUNTED, SALT = 8, 1_000_000, 64

_ODD = np.uint64(0x9E3779B97F4A7C15)


class Runs:
    """Hashes of runs of words of one text, from running sums: any run in one step."""

    def __init__(self, words: np.ndarray):
        steps = np.full(len(words) + 1, _ODD, dtype=np.uint64)
        steps[0] = 1
        self.power = np.cumprod(steps, dtype=np.uint64)
        back = np.full(len(words) + 1, np.uint64(pow(int(_ODD), -1, 1 << 64)), dtype=np.uint64)
        back[0] = 1
        self.inverse = np.cumprod(back, dtype=np.uint64)
        self.sums = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * self.power[:-1], out=self.sums[1:])

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        return mix((self.sums[starts + length] - self.sums[starts]) * self.inverse[starts] + np.uint64(length))


def minimisers(words: np.ndarray, runs: Runs) -> np.ndarray:
    """Positions chosen by content: the leftmost smallest hash of every window."""
    count = len(words) - GRAM + 1
    if count < WINDOW:
        return np.zeros(0, np.int64)
    values = mix(runs.at(np.arange(count), GRAM))
    low = np.lib.stride_tricks.sliding_window_view(values, WINDOW).argmin(axis=1)
    return np.unique(np.arange(count - WINDOW + 1) + low)


def _batch(names: str, *arrays: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=names.split())


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts_of(batch.column(0))]


def _kept(words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and positions of the kept suffixes with ``length`` words or more."""
    runs = Runs(words)
    at = minimisers(words, runs)
    at = at[at + length <= len(words)]
    return runs.at(at, length).view(np.int64), at


def text_heads(rows: DataFrame, length: int) -> DataFrame:
    """``(id, tid, n_words)`` per row of ``(text, id, tid)``, and ``(key, seen)``.

    ``seen`` counts the different texts, of those a task looks at together, with the key.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=False)
        parts, known, held = [], set(), 0
        kind = None

        def common() -> pa.RecordBatch:
            keys, seen = np.unique(np.concatenate(parts or [np.zeros(0, np.int64)]), return_counts=True)
            often = seen >= LOCAL_COUNT
            n = int(often.sum())
            none = [pa.nulls(n, kind), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())]
            found = [pa.array(keys[often]), pa.array(seen[often].astype(np.int64))]
            return pa.RecordBatch.from_arrays(none + found, names=names)

        for batch in slices(stream):
            counts, kind = [], batch.column(1).type
            tids = batch.column(2).to_pylist()
            for (_, words, _, _), tid in zip(hasher.texts(_texts(batch)), tids):
                counts.append(len(words))
                if tid not in known:
                    known.add(tid)
                    parts.append(np.unique(_kept(words, length)[0]))
                    held += len(parts[-1])
            none = pa.nulls(len(counts), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(counts, pa.int64()), none, none], names=names
            )
            if held > COUNTED:
                yield common()
                parts, known, held = [], set(), 0
        if parts:
            yield common()

    names = ["id", "tid", "n_words", "key", "seen"]
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, tid bigint, n_words bigint, key bigint, seen bigint")


def hot_keys(heads: DataFrame) -> np.ndarray:
    """The keys on most texts, at most ``HOT_KEYS``; each is on several texts for sure."""
    found = heads.where("key IS NOT NULL").groupBy("key").agg(F.sum("seen").alias("seen"))
    found = found.orderBy(F.desc("seen"), "key").limit(HOT_KEYS).select("key")
    return np.sort(found.toArrow().column(0).to_numpy())


def suffixes(rows: DataFrame, length: int, hot: np.ndarray) -> DataFrame:
    """``(key, tid, at, hot)`` of the kept suffixes of all texts; each text of a task once."""
    shared = rows.sparkSession.sparkContext.broadcast(hot)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, known, hot = WordHasher(lower=False), set(), shared.value
        for batch in slices(stream):
            keys, tids, places = ([np.zeros(0, np.int64)] for _ in range(3))
            for (_, words, _, _), tid in zip(hasher.texts(_texts(batch)), batch.column(2).to_pylist()):
                if tid not in known:
                    known.add(tid)
                    key, at = _kept(words, length)
                    keys.append(key)
                    places.append(at)
                    tids.append(np.full(len(at), tid, np.int64))
            key = np.concatenate(keys)
            is_hot = np.zeros(len(key), bool)
            if len(hot):
                is_hot = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
            at = np.concatenate(places).astype(np.int32)
            yield _batch("key tid at hot", key, np.concatenate(tids), at, is_hot)

    return rows.mapInArrow(run, "key bigint, tid bigint, at int, hot boolean")


def repeated_suffixes(kept: DataFrame) -> DataFrame:
    """``(tid, at, hot)`` of the suffixes whose neighbours under the same key are of another text.

    Hot keys are known to repeat; they are only dealt over many tasks.
    """
    salt = F.when(F.col("hot"), F.pmod("tid", F.lit(SALT)) + 1).otherwise(0)
    same = Window.partitionBy("key", "salt")
    met = kept.withColumn("salt", salt).withColumn("several", F.min("tid").over(same) < F.max("tid").over(same))
    return met.where("hot OR several").select("tid", "at", "hot")


def extended_runs(texts: DataFrame, least: int) -> DataFrame:
    """``(key, tid, start, salt)``: every run of ``least`` words around repeated suffixes.

    ``texts`` are ``(text, tid, at array<int>, hot array<boolean>)``.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=False)
        for batch in slices(stream):
            keys, tids, starts, salts = ([np.zeros(0, np.int64)] for _ in range(4))
            rows = zip(hasher.texts(_texts(batch)), *(batch.column(k).to_pylist() for k in (1, 2, 3)))
            for (_, words, _, _), tid, at, hot in rows:
                runs, at, hot = Runs(words), np.array(at), np.array(hot, dtype=bool)
                reach = (at[:, None] - np.arange(WINDOW)).ravel()
                fits = (reach >= 0) & (reach + least <= len(words))
                start, back = np.unique(reach[fits], return_inverse=True)
                near_hot = np.bincount(back, np.repeat(hot, WINDOW)[fits], minlength=len(start)) > 0
                keys.append(runs.at(start, least).view(np.int64))
                tids.append(np.full(len(start), tid, np.int64))
                starts.append(start)
                salts.append(np.where(near_hot, tid % SALT + 1, 0))
            key, tid, start, salt = (np.concatenate(x) for x in (keys, tids, starts, salts))
            yield _batch("key tid start salt", key, tid, start.astype(np.int32), salt.astype(np.int32))

    return texts.mapInArrow(run, "key bigint, tid bigint, start int, salt int")


def repeated_runs(runs: DataFrame) -> DataFrame:
    """``(tid, start)`` of the runs that another text has too.

    A salt depends on the text around a run as well, so a key may be salted in one text and
    not in another. Runs are compared within each task of their key first; what met no
    other text there meets one row of each of the key's other tasks, salted or not.
    """
    same = Window.partitionBy("key", "salt")
    met = runs.withColumn("several", F.min("tid").over(same) < F.max("tid").over(same))
    met = written(met.withColumn("place", F.row_number().over(same.orderBy("tid", "start"))))
    key = Window.partitionBy("key")
    alone = met.where("NOT several OR place = 1")
    # a text may have a run twice, salted and not: a task with several texts has another one for sure
    more = (F.min("tid").over(key) < F.max("tid").over(key)) | F.max("several").over(key)
    alone = alone.withColumn("more", more).where("NOT several AND more")
    return met.where("several").select("tid", "start").union(alone.select("tid", "start"))


def joined_spans(starts: DataFrame, least: int) -> DataFrame:
    """``(tid, n_repeated, spans)``: runs of ``least`` words from ``starts``, overlaps joined.

    A run begins a span if no other begins within ``least`` words before it, so a text of
    any length is joined by one sort of its starts, without holding them.
    """
    mine = Window.partitionBy("tid").orderBy("start")
    marked = starts.distinct().withColumn("before", F.lag("start").over(mine))
    marked = marked.withColumn("new", (F.col("before").isNull() | (F.col("start") > F.col("before") + least)).cast("int"))
    marked = marked.withColumn("span", F.sum("new").over(mine))
    spans = marked.groupBy("tid", "span").agg(F.min("start").alias("a"), (F.max("start") + least).alias("b"))
    struct = F.struct(F.col("a").cast("bigint").alias("start"), F.col("b").cast("bigint").alias("end"))
    return spans.groupBy("tid").agg(
        F.sum(F.col("b") - F.col("a")).cast("bigint").alias("n_repeated"),
        F.array_sort(F.collect_list(struct)).alias("spans"),
    )


def repeated_passages(
    docs: DataFrame, least: int = 50, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, n_words, n_repeated, spans, copies)``, one row per input row.

    ``spans`` are the passages of ``least`` words or more, word for word the same, that
    another row also has, as word positions with exclusive ends; ``n_repeated`` is the
    number of words in them. ``copies`` counts the rows with this very text, itself
    included: a text with copies of ``least`` words or more repeats as a whole.

    A NULL text is the empty text; it and texts under ``least`` words have no spans.
    Repeated rows are copies; NULL ids are kept; other columns are not read. Equality is
    that of 64-bit hashes. Texts are read three times, and only those with a repeated
    suffix are extended; keys on very many texts are dealt over many tasks.
    """
    if least < GRAM + WINDOW + 1:
        raise ValueError(f"least must be at least {GRAM + WINDOW + 1}")
    length = least - WINDOW + 1
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(text.alias("text"), F.col(id_col).alias("id"), F.xxhash64(text).alias("tid"))
    heads = written(text_heads(rows, length))
    members = heads.where("n_words IS NOT NULL").select("id", "tid", "n_words")
    one = F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("one")
    texts = members.groupBy("tid").agg(F.count(F.lit(1)).alias("copies"), F.max("n_words").alias("n"), one)

    found = repeated_suffixes(suffixes(rows, length, hot_keys(heads))).distinct()
    places = found.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("at", "hot"))).alias("p"))
    places = places.select("tid", F.col("p.at").alias("at"), F.col("p.hot").alias("hot"))
    wanted = places.join(texts.select("tid", "one.id"), "tid")
    same = rows["id"].eqNullSafe(wanted["id"]) & (rows["tid"] == wanted["tid"])
    near = rows.join(wanted, same).select("text", wanted["tid"], "at", "hot")
    spans = joined_spans(repeated_runs(extended_runs(near, least)), least)

    whole = (F.col("copies") > 1) & (F.col("n") >= least)
    all_of_it = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n").alias("end")))
    empty = F.array().cast("array<struct<start: bigint, end: bigint>>")
    per_text = texts.join(spans, "tid", "left").select(
        "tid",
        "copies",
        F.when(whole, F.col("n")).otherwise(F.coalesce("n_repeated", F.lit(0))).alias("n_repeated"),
        F.when(whole, all_of_it).otherwise(F.coalesce("spans", empty)).alias("spans"),
    )
    return members.join(per_text, "tid").select("id", "n_words", "n_repeated", "spans", "copies")


def without_spans(text: str, spans: list) -> str:
    """A text without the words of its spans; the white space after a removed word goes with it."""

    words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+\s*", text)]
    parts, at = [], 0
    for start, end in spans:
        parts.append(text[at : words[start][0]])
        at = words[end - 1][1]
    return "".join(parts + [text[at:]])
