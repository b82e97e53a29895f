from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import chunkwell as cw
from tests.test_text import brute_windows

TITLED = (
    "First Part\nSome text here.\nMore text, still going.\n"
    "Second Part\n" + "long " * 60 + "end.\n\fThird Part\n\n   \n- an item\n# heading one.\nlast"
)


def brute_elements(text: str) -> list[tuple[str, str, int]]:
    out = []
    for page, part in enumerate(text.split("\f"), 1):
        for line in part.split("\n"):
            line = line.strip()
            if not line:
                continue
            hashes = len(line) - len(line.lstrip("#"))
            if 1 <= hashes <= 6 and line[hashes : hashes + 1] in (" ", "\t"):
                kind = "Title"
            elif line[:1] in "-*•" and line[1:2] in (" ", "\t") and len(line) > 1:
                kind = "ListItem"
            elif len(line) <= 60 and line[0].isupper() and line[-1] not in ".!?:;,":
                kind = "Title"
            else:
                kind = "NarrativeText"
            out.append((kind, line, page))
    return out


def brute_chunks(text: str, size: int, overlap: int, by_title: bool) -> list[tuple]:
    groups: list[list[tuple]] = []
    length = None
    for e in brute_elements(text):
        n = len(e[1])
        if length is None or length + 2 + n > size or (by_title and e[0] == "Title"):
            groups.append([e])
            length = n
        else:
            groups[-1].append(e)
            length += 2 + n
    out = []
    for g in groups:
        body = "\n\n".join(e[1] for e in g)
        pieces = brute_windows(body, size, overlap) if len(body) > size else [body]
        out += [(p.strip(), g[0][0], g[0][2]) for p in pieces if p.strip()]
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    words = ["Alpha", "beta", "x" * 70, "Gamma.", "- item", "# Head", "é", "\U0001f600", "\f", " "]
    made = [
        "\n".join(
            " ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(rng.randint(0, 40))
        )
        for _ in range(60)
    ]
    return [TITLED, "", " \n\f\n\t", "a" * 3000, "One\n" + "b" * 100, *made]


def test_elements(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    got = cw.element_rows(cw.partition_text(rows)).orderBy("i", "element_index").collect()
    for i, text in enumerate(texts):
        mine = [r for r in got if r.i == i]
        assert [(r.category, r.text, r.page_number) for r in mine] == brute_elements(text)
        assert [r.element_index for r in mine] == list(range(len(mine)))


@pytest.mark.parametrize("size,overlap", [(100, 20), (80, 0), (1000, 200), (5, 4)])
@pytest.mark.parametrize("strategy", ["basic", "by_title", "anything"])
def test_packing(spark, texts, size, overlap, strategy):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    chunks = cw.chunk_documents(cw.partition_text(rows), strategy, size, overlap)
    got = chunks.orderBy("i", "chunk_index").collect()
    for i, text in enumerate(texts):
        mine = [r for r in got if r.i == i]
        wanted = brute_chunks(text, size, overlap, strategy == "by_title")
        assert [(r.content, r.element_type, r.page_number) for r in mine] == wanted
        assert [r.chunk_index for r in mine] == list(range(len(wanted)))
        assert {r.total_chunks for r in mine} <= {len(wanted)}
        assert all(r.chunk_size == len(r.content) for r in mine)
    assert {r.chunking_strategy for r in got} == {strategy}


def test_chunking_needs_no_shuffle(spark, texts, plan_of):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    plan = plan_of(cw.chunk_by_title(cw.partition_text(rows)))
    assert "Exchange" not in plan
    # elements and chunks are computed once, whatever reads them
    assert plan.count("split(") <= 2


def test_one_document_with_most_of_the_elements(spark):
    """No grouping by document: a giant text is one row, a frequent key many."""
    line = "An ordinary sentence of a long document."
    rows = spark.createDataFrame(
        [("big", "\n".join([line] * 50_000))] + [("copy", line)] * 500, "doc_uri string, content string"
    )
    counts = {
        r.doc_uri: r.n
        for r in cw.chunk_basic(cw.partition_text(rows)).groupBy("doc_uri")
        .agg(F.count("*").alias("n")).collect()
    }
    per_chunk = (1000 + 2) // (len(line) + 2)
    assert counts == {"big": -(-50_000 // per_chunk), "copy": 500}


def test_html(spark):
    page = (
        "<html><head><title>no</title><script>var t='</p>';</script></head><body><!-- c -->"
        "<h1>Main &amp; first</h1><p>One <b>bold</b>\n text<p>Two<ul><li>a<li><p>b</p></ul>"
        "<table><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table>tail<style>x</style>"
        "<div></div>&nbsp;<h2> </h2></body></html>"
    )
    rows = spark.createDataFrame([("html", page), ("txt", "Plain <b>text</b>.")], "format string, content string")
    parted = cw.partition_documents(rows)
    got = cw.element_rows(parted).orderBy("format", "element_index").collect()
    assert [(r.category, r.text) for r in got] == [
        ("Title", "Main & first"),
        ("NarrativeText", "One bold text"),
        ("NarrativeText", "Two"),
        ("ListItem", "a"),
        ("ListItem", "b"),
        ("Table", "1 2 3"),
        ("NarrativeText", "tail"),
        ("NarrativeText", "Plain <b>text</b>."),
    ]
    assert cw.partition_html(spark.createDataFrame([(None,)], "content string")).head().elements is None


def test_window_sizes_from_data_must_be_sound(spark):
    rows = spark.createDataFrame([("abc", None, 0), ("abc", 2, 2)], "content string, size int, overlap int")
    for k in (0, 1):
        bad = rows.where(F.col("size").isNull() if k == 0 else F.col("size").isNotNull())
        with pytest.raises(Exception, match="window sizes"):
            cw.chunk_windows(bad, F.col("size"), F.col("overlap")).collect()


def test_pages_with_tags_left_open(spark):
    pages = [
        "<html><head><title>x</title><h1>Hi</h1><p>text</p>",
        "<body><noscript>no<h1>A<br>B</h1><p>one<br>two</p>",
    ]
    df = spark.createDataFrame([(p,) for p in pages], "content string")
    got = [[(e.category, e.text) for e in r.elements] for r in cw.partition_html(df).collect()]
    assert got == [
        [("Title", "Hi"), ("NarrativeText", "text")],
        [("Title", "A B"), ("NarrativeText", "one two")],
    ]


def _parts(*pages):
    from chunkwell.functions.markup import html_parts

    return [html_parts(p) for p in pages]


def test_headings_and_paragraphs_end_tables_and_noscript_hides_nothing():
    [(ended, tables), (shown, _), (inside, _), (nested, _)] = _parts(
        "<table><tr><td>x</td></tr><h1>T</h1><p>para</p>",
        "<p>a</p><noscript><p>b</p><p>c</p>",
        "<table><tr><td><p>in</p><h2>cell</h2></table>after<noscript>gone</noscript>",
        "<p>a<template><noscript>b<p>c",
    )
    assert ended == [("Table", "x"), ("Title", "T"), ("NarrativeText", "para")] and len(tables) == 1
    assert shown == [("NarrativeText", t) for t in "abc"]
    assert inside == [("Table", "in cell"), ("NarrativeText", "after")]
    assert nested == [("NarrativeText", "ab"), ("NarrativeText", "c")]


def test_table_grids(spark):
    page = (
        "<p>x<table><caption>Cap</caption><thead><tr><th>A<th colspan=2>B<tbody>"
        "<tr><td rowspan=2>1</td><td>2<td>3</tr><tr><td colspan=2>4<table><tr><td>in<td>ner</table></table>"
        "<table><tr></table><table><tr><td rowspan=0 colspan=x>y<td rowspan=9>z</table>"
    )
    rows = spark.createDataFrame([(1, page), (2, None), (3, "<p>none")], "id int, content string")
    parted = cw.partition_html(rows, tables=True).orderBy("id").collect()
    first, inner, last = parted[0].tables
    assert [e.text for e in parted[0].elements] == ["x", "Cap A B 1 2 3 4 in ner", "y z"]
    assert (first.element_index, first.depth, first.n_rows, first.n_columns, first.header_rows) == (1, 0, 3, 3, 1)
    got = [(c.row, c.column, c.row_span, c.column_span, c.header, c.text) for c in first.cells]
    assert got == [
        (0, 0, 1, 1, True, "A"), (0, 1, 1, 2, True, "B"), (1, 0, 2, 1, False, "1"), (1, 1, 1, 1, False, "2"),
        (1, 2, 1, 1, False, "3"), (2, 1, 1, 2, False, "4 in ner"),
    ]
    assert (inner.element_index, inner.depth, [c.text for c in inner.cells]) == (1, 1, ["in", "ner"])
    assert [(c.row, c.column, c.row_span, c.column_span) for c in last.cells] == [(0, 0, 1, 1), (0, 1, 1, 1)]
    assert parted[1].tables is None and parted[1].elements is None and parted[2].tables == []
    cells = cw.table_cells(cw.partition_html(rows, tables=True)).where("table_no = 0").collect()
    grid = {(c.row, c.column): c.text for c in cells}
    assert [[grid[r, c] for c in range(3)] for r in range(3)] == [["A", "B", "B"], ["1", "2", "3"], ["1", "4 in ner", "4 in ner"]]


def test_every_place_of_a_random_grid_is_filled_once():
    import random

    rng = random.Random(1)
    for _ in range(200):
        html = "<table>" + "".join(
            "<tr>" + "".join(f"<td rowspan={rng.randrange(4)} colspan={rng.randrange(1, 4)}>c{k}" for k in range(rng.randrange(1, 5)))
            for _ in range(rng.randrange(1, 7))
        )
        [(_, [table])] = _parts(html)
        taken = set()
        for cell in table["cells"]:
            assert cell["row"] + cell["row_span"] <= table["n_rows"]
            assert cell["column"] + cell["column_span"] <= table["n_columns"]
            assert (cell["row"], cell["column"]) not in taken
            taken |= {(cell["row"] + r, cell["column"] + c) for r in range(cell["row_span"]) for c in range(cell["column_span"])}
