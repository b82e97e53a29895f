"""Leaks with edits against plain edit distance; slices; odd rows."""

from __future__ import annotations

import random
import tracemalloc

from chunkwell.llm import decontaminate as dc
from chunkwell.llm.queries import REGISTRY

SMALL = "/root/testdata/sf0.001"


def distance_in(window, text):
    """Least edits of the window anywhere in the text, by the plain recurrence."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(window, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(last + (a != b), row[j] + 1, row[j - 1] + 1)
    return min(row)


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = "q"
        elif kind == 1:
            out.insert(at, "q")
        else:
            del out[at]
    return "".join(out)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghi") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def test_every_window_within_its_budget_is_found():
    rng = random.Random(2)
    items = [(k, words(rng, rng.choice([4, 12, 25, 60]))) for k in range(12)] + [(90, "ab"), (91, None), (92, "")]
    index = dc.make_index(items)
    for _ in range(150):
        item, text = items[rng.randrange(12)]
        text = edited(rng, text, rng.choice([0, 1, 3, 8, 14, 30]))
        doc = dc.normal(words(rng, 40) + " " + text + " " + words(rng, 20))
        wanted = {}
        for i, w, k in zip(index.items, index.windows, index.edits):
            if (d := distance_in(w, doc)) <= k:
                wanted[i] = min(d, wanted.get(i, d))
        assert dc.leaks(doc, index) == wanted


def test_pieces_slices_and_odd_rows(spark, monkeypatch):
    rng = random.Random(4)
    item = words(rng, 30)
    far = words(rng, 60_000)
    at = dc._PIECE - 40
    docs = [(1, None), (2, ""), (2, ""), (None, item.upper().replace(" ", ", ")), (4, far[:at] + " " + item + " " + far[at:]), (5, "short")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "0 AS items", "0 AS item_id")
    marks = spark.createDataFrame([(7, item), (7, item), (8, None), (None, item), (9, words(rng, 20)), (10, "")], "item_id int, text string")
    wanted = [(None, [7], 0), (1, [], None), (2, [], None), (2, [], None), (4, [7], 0), (5, [], None)]
    for size in (1 << 20, 60):
        monkeypatch.setattr(dc, "SLICE", size)
        got = [(r.id, r.items, r.edits) for r in dc.find_leaks(frame, marks).collect()]
        assert sorted(got, key=lambda r: (r[0] or 0)) == wanted
        left = dc.without_leaks(frame, marks)
        assert left.schema == frame.schema and sorted(r.doc_id for r in left.collect()) == [1, 2, 2, 5]
    assert dc.find_leaks(frame.limit(0), marks).collect() == []
    assert all(r.items == [] for r in dc.find_leaks(frame, marks.limit(0)).collect())


def test_query_catches_whole_items_and_nothing_else(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = {r.doc_id: r.contaminated for r in REGISTRY["op8_decontamination"](spark, SMALL).collect()}
    assert got == {d: any(i in t for i in items) for d, t in docs.items()}


def test_passages_at_any_offset_are_found():
    rng = random.Random(6)
    items = [(k, words(rng, rng.choice([40, 60, 120]))) for k in range(20)]
    items += [(100 + k, "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(300))) for k in range(5)]
    index = dc.make_index(items)
    for _ in range(200):
        item, text = items[rng.randrange(20)]
        tokens = text.split()
        n = rng.choice([13, 14, 17, 25])
        at = rng.randrange(len(tokens) - n + 1)
        doc = f"{words(rng, 30)} {' '.join(tokens[at : at + n])} {words(rng, 30)}"
        assert dc.leaks(doc, index) == {item: 0}
    for k in range(40):
        item, text = items[20 + k % 5]
        at = rng.randrange(300 - 78)
        assert dc.leaks(f"{words(rng, 30)} {text[at : at + 78]}, {words(rng, 30)}", index) == {item: 0}
    # half of the words in a row are no leak
    tokens = items[0][1].split()
    assert dc.leaks(f"{words(rng, 30)} {' '.join(tokens[3:9])} {words(rng, 30)}", index) == {}


def test_long_items_are_cut_into_segments(monkeypatch):
    rng = random.Random(8)
    items = [(k, words(rng, 400)) for k in range(4)]
    docs = []
    for _ in range(60):
        item, text = items[rng.randrange(4)]
        tokens = text.split()
        at = rng.randrange(len(tokens) - 15)
        docs.append((item, f"{words(rng, 30)} {' '.join(tokens[at : at + 15])} {words(rng, 30)}"))
    whole = dc.make_index(items)
    monkeypatch.setattr(dc, "SEGMENT", 150)
    cut = dc.make_index(items)
    assert len(cut.first) > 4 * len(whole.first) and sorted(cut.windows) == sorted(whole.windows)
    for item, doc in docs:
        assert dc.leaks(doc, cut) == dc.leaks(doc, whole) == {item: 0}


def test_few_entries_at_a_time_give_the_same(monkeypatch):
    rng = random.Random(9)
    items = [(k, words(rng, 30)) for k in range(6)] + [(50, "la " * 80), (51, "a" * 300)]
    index = dc.make_index(items)
    docs = [words(rng, 400) + " " + edited(rng, items[k % 6][1], k % 5) + " " + "la " * (k * 7) + words(rng, 300) for k in range(20)]
    wanted = [dc.leaks(d, index) for d in docs]
    monkeypatch.setattr(dc, "ENTRIES", 30)
    assert [dc.leaks(d, index) for d in docs] == wanted


def test_runs_of_one_character_need_little_memory():
    index = dc.make_index([(1, "0 " * 4_000), (2, "0" * 3_000), (3, "1 " * 200 + "0 1 " * 100)])
    tracemalloc.start()
    assert dc.leaks("0 " * 5_000, index) == {1: 0}
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert dc.leaks("0 " * 40_000, index) == {1: 0}
    assert dc.leaks("0" * 1_000_000, index) == {2: 0}
    assert dc.leaks("0 1 " * 20_000, index) == {3: 0}
