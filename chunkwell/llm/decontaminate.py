"""Passages of a benchmark in documents, up to edits, by the q-gram lemma.

The unit is the shortest passage that counts as a leak: ``WORDS`` words in a row. A window
of one word less, at most ``WINDOW`` characters of it, begins at every second word of a
benchmark item, so wherever such a passage is cut it holds a whole window. A window of w
characters that stands in a text with at most k edits shares at least ``w + 1 - q (k + 1)``
of its q-grams with it, on diagonals at most k apart. Shared q-grams are counted once for
the whole item, in bands of diagonals that overlap so far that one of them holds them all;
the windows with enough of them in a band are aligned in full.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwell.llm.common import map_texts, slices
from chunkwell.llm.words import mix
from chunkwell.session import written

Q, EDITS = 8, 0.1
#: Words of the shortest leak, characters of a window at most, and how far apart windows begin
#: within words that are longer than two such steps.
WORDS, WINDOW, STEP = 13, 64, 8
#: Characters of the benchmark that one pass over the documents looks for: 24 bytes each.
SLICE = 1 << 20
_FILTER_BITS = 22
_PIECE = 1 << 18
_SHORT = 4
_WORDS = re.compile(r"[^\W_]+")
#: An item is searched in segments whose windows begin within so many characters.
SEGMENT = 1 << 10
#: Pairs of a place in a text and a place in an item that are held at a time.
ENTRIES = 1 << 17
#: Windows whose short grams a task remembers.
_REMEMBERED = 20_000


def normal(text: str) -> str:
    """Letters and digits in lower case, with one blank where anything else stood."""
    return " ".join(_WORDS.findall(text.lower()))


def grams(text: str) -> np.ndarray:
    """Hashes of all q-grams of a text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    count = len(codes) - Q + 1
    if count < 1:
        return np.zeros(0, np.uint64)
    total = codes[:count].copy()
    for k in range(1, Q):
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += codes[k : k + count]
    return mix(total)


@dataclass(frozen=True)
class Index:
    """Windows, and the q-grams of the texts they are cut from, sorted by hash.

    The texts are segments of items. ``first`` has the number of each text's first window, and of all windows at its end;
    a window's q-grams have the places ``within`` to ``until`` of its text; ``step``, ``fewest`` and ``span`` are the
    most edits and 1, the least q-grams and their farthest places over a text's windows.
    """

    items: list
    windows: list[str]
    edits: np.ndarray
    least: np.ndarray
    within: np.ndarray
    until: np.ndarray
    first: np.ndarray
    step: np.ndarray
    fewest: np.ndarray
    span: np.ndarray
    hashes: np.ndarray
    text_of: np.ndarray
    place_of: np.ndarray
    seen: np.ndarray
    shorts: dict

    @property
    def widest(self) -> int:
        """One more than the last place of any text."""
        return int(self.place_of.max()) + 1


def cuts(text: str) -> list[tuple[int, int]]:
    """Start and end of the windows of a normal text: one at every second word, whole if it is short."""
    spans = [m.span() for m in re.finditer(r"[^ ]+", text)]
    found = []
    for k, (start, end) in enumerate(spans):
        stop = spans[k + WORDS - 2][1] if k + WORDS - 1 <= len(spans) else None
        # writing without blanks has few words: their inside is cut too
        inside = range(start, end, STEP) if end - start > 2 * STEP else (start,) if k % 2 == 0 else ()
        for at in inside:
            if at + WINDOW <= len(text) or stop is not None:
                found.append((at, min(at + WINDOW, stop or len(text))))
    if not found or found[-1][1] < len(text):
        found.append((max(0, len(text) - WINDOW) if found else 0, len(text)))
    return found


def make_index(items: list[tuple[object, str]]) -> Index:
    """The index of ``(item_id, text)``; items under ``Q`` characters are too short to find."""
    ids, windows, within, first, parts = [], [], [], [0], []
    for item, text in items:
        text = normal(text or "")
        if len(text) < Q:
            continue
        found = sorted((a, b) for a, b in cuts(text) if b - a >= Q)
        for _, segment in groupby(found, lambda cut: cut[0] // SEGMENT):
            held = list(segment)
            begin = held[0][0]
            ids += [item] * len(held)
            windows += [text[a:b] for a, b in held]
            within += [a - begin for a, _ in held]
            first.append(len(windows))
            parts.append(grams(text[begin : max(b for _, b in held)]))
    sizes = np.array([len(w) for w in windows], dtype=np.int64)
    # short windows: no more edits than the lemma can still see
    edits = np.minimum((EDITS * sizes).astype(np.int64), sizes // Q - 1).clip(0)
    least = np.maximum(1, sizes + 1 - Q * (edits + 1))
    starts = np.array(first[:-1], dtype=np.int64)
    step, fewest, span = (
        f.reduceat(x, starts) if len(starts) else x
        for f, x in ((np.maximum, edits + 1), (np.minimum, least), (np.maximum, sizes - Q))
    )
    within = np.array(within, dtype=np.int64)
    hashes = np.concatenate(parts or [np.zeros(0, np.uint64)])
    order = np.argsort(hashes, kind="stable")
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    place = np.concatenate([np.arange(len(p)) for p in parts] or [np.zeros(0, np.int64)])
    seen = np.zeros(1 << _FILTER_BITS, bool)
    seen[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
    return Index(
        ids, windows, edits, least, within, within + sizes + 1 - Q, np.array(first), step, fewest, span,
        hashes[order], owner[order], place[order], seen, {},
    )


def short_grams(text: str) -> list[str]:
    return [text[k : k + _SHORT] for k in range(len(text) + 1 - _SHORT)]


def aligned(window: str, region: str, edits: int, shorts: list[str] | None = None) -> int | None:
    """The least edits with which the window stands somewhere in the region, None beyond ``edits``.

    A column of differences per character of the region, held as the bits of two numbers
    (Myers, 1999, as put by Hyyrö); free at both ends of the region. ``shorts`` are the
    window's :func:`short_grams`, if known.
    """
    if window in region:
        return 0
    if not edits:
        return None
    # the lemma again, with shorter grams wherever they stand in the region
    held = set(short_grams(region))
    shared = sum(map(held.__contains__, short_grams(window) if shorts is None else shorts))
    if shared < len(window) + 1 - _SHORT * (edits + 1):
        return None
    places: dict[str, int] = {}
    for k, char in enumerate(window):
        places[char] = places.get(char, 0) | 1 << k
    every, last = (1 << len(window)) - 1, 1 << (len(window) - 1)
    more, less, score = every, 0, len(window)
    best = score
    for char in region:
        same = places.get(char, 0)
        across = (((same & more) + more) ^ more) | same | less
        up, down = less | (every & ~(across | more)), more & across
        if up & last:
            score += 1
        elif down & last:
            score -= 1
            best = min(best, score)
        up, down = up << 1 & every, down << 1 & every
        more, less = down | (every & ~(across | up)), up & across
    return best if best <= edits else None


def leaks(text: str, index: Index) -> dict[object, int]:
    """``{item: edits}`` of the items of which a window stands in the text."""
    found: dict[object, int] = {}
    text = normal(text)
    if not len(index.hashes):
        return found
    # pieces overlap by more than the longest region
    for at in range(0, max(1, len(text) - 2 * WINDOW), _PIECE):
        _look(index, text[at : at + _PIECE + 4 * WINDOW], found)
    return found


def _look(index: Index, part: str, found: dict[object, int]) -> None:
    """Adds the items of which a window stands in a part of a text.

    A part whose q-grams have too many places, as a run of one character has, is halved, and
    if it is short taken segment by segment; items found without edits are done.
    """
    hashes = grams(part)
    near = np.flatnonzero(index.seen[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
    low = np.searchsorted(index.hashes, hashes[near], "left")
    many = np.searchsorted(index.hashes, hashes[near], "right") - low
    total = int(many.sum())
    if total < index.fewest.min():
        return
    if total <= ENTRIES:
        _count(index, part, near, low, many, found)
    elif len(part) > 16 * WINDOW:
        half = len(part) // 2
        _look(index, part[: half + 2 * WINDOW], found)
        _look(index, part[half - 2 * WINDOW :], found)
    else:
        # places of a q-gram are in the order of their texts
        each, at = np.unique(low[many > 0], return_index=True)
        ends = each + many[many > 0][at]
        texts = np.unique(np.concatenate([index.text_of[a:b] for a, b in zip(each, ends)]))
        of = np.minimum(np.searchsorted(each, low), len(each) - 1)
        for text in texts.tolist():
            if found.get(index.items[index.first[text]]) == 0:
                continue
            mine = [a + np.searchsorted(index.text_of[a:b], [text, text + 1]) for a, b in zip(each, ends)]
            mine = np.array(mine)[of]
            mine[many == 0] = 0
            _count(index, part, near, mine[:, 0], mine[:, 1] - mine[:, 0], found)


def _count(
    index: Index, part: str, near: np.ndarray, low: np.ndarray, many: np.ndarray, found: dict[object, int]
) -> None:
    """Aligns windows with enough q-grams in a band of diagonals.

    The q-gram at place ``near`` of the part is the index's entries from ``low``, ``many`` of them.
    """
    total = int(many.sum())
    entry = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(total)
    owner, place, near = index.text_of[entry], index.place_of[entry], np.repeat(near, many)
    if 0 in found.values():
        done = [text for text in np.unique(owner).tolist() if found.get(index.items[index.first[text]]) == 0]
        rest = ~np.isin(owner, done)
        owner, place, near = owner[rest], place[rest], near[rest]
    widest = index.widest
    band = (near - place + widest) // index.step[owner] + 1
    wide = np.int64(len(part) + widest + 2)
    key = owner * wide + band
    # most are chance: pairs of bands with too few, counted with whatever shares their slot, go
    mask = (1 << int(total).bit_length() + 2) - 1
    count = np.bincount(key & mask, minlength=mask + 1)
    beside = np.maximum(count[(key - 1) & mask], count[(key + 1) & mask])
    rest = count[key & mask] + beside >= index.fewest[owner]
    key, place = key[rest], place[rest]
    # a q-gram of an item counts once in a band, however often the text repeats it
    key = np.concatenate([key, key - 1])
    spot = np.concatenate([place, place])
    both = np.unique(key * np.int64(widest + 1) + spot)
    key, spot = np.divmod(both, widest + 1)
    # enough of them as close together as a window is long
    owner = key // wide
    last = np.arange(len(key)) + index.fewest[owner] - 1
    full = last < len(key)
    last = last[full]
    full[full] = (key[last] == key[full]) & (spot[last] - spot[full] <= index.span[owner[full]])
    if not full.any():
        return
    # every window of the texts of those bands: how many of its q-grams stand there
    keys = np.unique(key[full])
    owner = keys // wide
    windows = index.first[owner + 1] - index.first[owner]
    number = np.repeat(index.first[owner] - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows)
    number += np.arange(len(number))
    base = np.repeat(keys, windows) * np.int64(widest + 1)
    held = np.searchsorted(both, base + index.until[number]) - np.searchsorted(both, base + index.within[number])
    enough = np.flatnonzero(held >= index.least[number])
    # those with most q-grams first: after one without edits the others change nothing
    enough = enough[np.argsort(-held[enough], kind="stable")]
    bands = np.repeat(keys % wide, windows)[enough].tolist()
    steps = np.repeat(index.step[owner], windows)[enough].tolist()
    for w, band, step in zip(number[enough].tolist(), bands, steps):
        item = index.items[w]
        if found.get(item) == 0:
            continue
        k, window = int(index.edits[w]), index.windows[w]
        start = (band - 1) * step - widest + int(index.within[w]) - k
        stop = start + k + 2 * step + len(window) + k
        if w not in index.shorts:
            if len(index.shorts) >= _REMEMBERED:
                index.shorts.clear()
            index.shorts[w] = short_grams(window)
        edits = aligned(window, part[max(0, start) : max(0, stop)], k, index.shorts[w])
        if edits is not None:
            found[item] = min(edits, found.get(item, edits))


def _slices(benchmark: DataFrame, item_col: str, item_text_col: str) -> Iterator[list]:
    """The distinct items ``(id, text)`` in parts of about ``SLICE`` characters."""
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item"), F.col(item_text_col).alias("text"))
    items = items.where("item IS NOT NULL AND text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.length("text"))).head()[0] or 0
    number = max(1, -(-int(total) // SLICE))
    for k in range(number):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(number)) == k)
        yield [tuple(r) for r in part.collect()]


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``(id, items array<bigint>, edits)``, one row per input row.

    ``items`` are the benchmark items of which a window (see :func:`cuts`; a shorter item as
    a whole) stands in the text with at most a tenth of its characters edited, after case,
    punctuation and white space are made alike. Any ``WORDS`` words of an item in a row, and
    any ``WINDOW + STEP`` characters of writing without blanks, hold one; ``edits`` is the least number
    found, NULL without items. NULL and empty texts and items match nothing; items under
    ``Q`` characters are too short to tell. Repeated rows stay; repeated items are one.

    Documents are scanned where they are read. The benchmark is looked for in slices of
    about ``SLICE`` characters, a pass over the documents for each, so what travels to the
    tasks has a fixed size; several slices are put together by one grouping of ids.
    """
    spark = docs.sparkSession
    slices = _slices(benchmark, item_col, item_text_col)
    parts = []
    for part in slices:
        held = spark.sparkContext.broadcast(make_index(part))

        def setup(held=held):
            index = held.value

            def look(texts: list[str]) -> dict[str, list]:
                found = [leaks(t, index) for t in texts]
                return {
                    "items": [sorted(f) for f in found],
                    "edits": [min(f.values(), default=None) for f in found],
                }

            return look

        parts.append((id_col, setup))
    rest = "items array<bigint>, edits bigint"
    if len(parts) == 1:
        return map_texts(docs, id_col, text_col, rest, parts[0][1])
    # rows get a number of their own, as ids may be NULL or repeat
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("key"), F.col(text_col).alias("text")))
    found = [map_texts(rows, "row", "text", rest, setup).where("size(items) > 0") for _, setup in parts]
    whole = found[0]
    for f in found[1:]:
        whole = whole.union(f)
    whole = whole.groupBy("id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.min("edits").alias("edits")
    )
    none = F.array().cast("array<bigint>")
    return rows.select("row", "key").join(whole, F.col("row") == F.col("id"), "left").select(
        F.col("key").alias("id"), F.coalesce("items", none).alias("items"), "edits"
    )


def without_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The rows without a benchmark item in their text; all columns stay, NULL texts too.

    Rows are dropped where they are read, slice by slice of the benchmark.
    """
    place = docs.columns.index(text_col)
    for part in _slices(benchmark, item_col, item_text_col):
        held = docs.sparkSession.sparkContext.broadcast(make_index(part))

        def keep(stream: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in slices(stream):
                clean = [not t or not leaks(t, index) for t in batch.column(place).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
