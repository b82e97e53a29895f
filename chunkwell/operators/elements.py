"""Partitioning: a document's text becomes typed, ordered elements."""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from chunkwell.functions.markup import html_parts
from chunkwell.functions.rows import with_computed
from chunkwell.functions.text import strip
from chunkwell.schemas import ELEMENT, ELEMENTS, TABLES

HTML_FORMATS = ("html", "htm")

#: A line is a title if it is short, starts with a capital and does not end
#: like a sentence; a line of the form ``# heading`` always is.
TITLE_MAX_CHARS = 60
HEADING = r"^#{1,6}[ \t]+\S"
BULLETS = ("- ", "* ", "• ", "-\t", "*\t", "•\t")
SENTENCE_ENDS = (".", "!", "?", ":", ";", ",")


def _category(text: Column) -> Column:
    # cheap tests guard the regular expressions: most lines never reach one
    titled = (
        (F.length(text) <= TITLE_MAX_CHARS)
        & ~F.right(text, F.lit(1)).isin(*SENTENCE_ENDS)
        & F.left(text, F.lit(1)).rlike(r"\p{Lu}")
    )
    return (
        F.when(text.startswith("#") & text.rlike(HEADING), "Title")
        .when(F.left(text, F.lit(2)).isin(*BULLETS), "ListItem")
        .when(titled, "Title")
        .otherwise("NarrativeText")
    )


def text_elements(content: Column) -> Column:
    """Lines of a text as an array of elements; a form feed starts a page.

    Everything happens inside the row: no explode, no regrouping, no shuffle.
    """
    pages = F.split(content, "\f")
    lines = F.flatten(
        F.transform(
            pages,
            lambda page, i: F.transform(
                F.split(page, "\n"),
                lambda line: F.struct(
                    strip(line).alias("text"), (i + 1).alias("page_number")
                ),
            ),
        )
    )
    kept = F.filter(lines, lambda e: e["text"] != "")
    return F.transform(
        kept,
        lambda e, i: F.struct(
            i.cast("int").alias("element_index"),
            _category(e["text"]).alias("category"),
            e["text"].alias("text"),
            e["page_number"].cast("int").alias("page_number"),
        ),
    )


_HTML = T.StructType([T.StructField("elements", ELEMENTS), T.StructField("tables", TABLES)])
_HTML_TABLES, _NUMBER = to_arrow_type(TABLES), pa.int32()


@F.arrow_udf(_HTML)
def _html_parts(html: pa.Array) -> pa.Array:
    """Elements and tables of a batch of pages, built from flat lists."""
    parsed = [None if page is None else html_parts(page) for page in html.to_pylist()]
    sizes = [0 if p is None else len(p[0]) for p in parsed]
    flat = [element for p in parsed if p is not None for element in p[0]]
    structs = pa.StructArray.from_arrays(
        [
            pa.array([k for size in sizes for k in range(size)], _NUMBER),
            pa.array([category for category, _ in flat], pa.string()),
            pa.array([text for _, text in flat], pa.string()),
            pa.array([1] * len(flat), _NUMBER),
        ],
        ["element_index", "category", "text", "page_number"],
    )
    none = pa.array([p is None for p in parsed], pa.bool_())
    offsets = pa.array(list(accumulate(sizes, initial=0)), _NUMBER)
    elements = pa.ListArray.from_arrays(offsets, structs, mask=none)
    tables = pa.array([None if p is None else p[1] for p in parsed], _HTML_TABLES)
    return pa.StructArray.from_arrays([elements, tables], ["elements", "tables"])


def _html_elements(html: Column) -> Column:
    return _html_parts(html)["elements"]


def partition_text(documents: DataFrame, content_col: str = "content") -> DataFrame:
    """Add ``elements`` to plain-text documents."""
    return with_computed(documents, "elements", text_elements(F.col(content_col)))


def partition_html(
    documents: DataFrame, content_col: str = "content", tables: bool = False
) -> DataFrame:
    """Add ``elements`` to HTML documents (headings, text, list items, tables).

    With ``tables`` also ``tables``, the grid of every table: its element, how deep it is nested
    in another, its size, its leading header rows, and its cells with row, column,
    spans and text. End tags may be missing, and a heading or paragraph outside a cell ends
    a table.
    """
    if not tables:
        return documents.withColumn("elements", _html_elements(F.col(content_col)))
    keep = [c for c in documents.columns if c not in ("elements", "tables")]
    parsed = documents.withColumn("_parts", _html_parts.asNondeterministic()(F.col(content_col)))
    return parsed.select(*keep, "_parts.elements", "_parts.tables")


def table_cells(partitioned: DataFrame) -> DataFrame:
    """A row per place of a table's grid; a cell that spans several fills all of them.

    ``(..., table_no, element_index, row, column, header, text)`` next to the document's
    other columns.
    """
    keep = [c for c in partitioned.columns if c not in ("elements", "tables", "content")]
    tables = partitioned.select(*keep, F.posexplode("tables").alias("table_no", "_t"))
    cells = tables.select(*keep, "table_no", F.col("_t.element_index").alias("element_index"), F.explode("_t.cells").alias("_c"))

    def places(start: str, span: str) -> Column:
        first = F.col(f"_c.{start}")
        return F.explode(F.sequence(first, first + F.col(f"_c.{span}") - 1))

    rows = cells.withColumn("row", places("row", "row_span")).withColumn("column", places("column", "column_span"))
    return rows.select(
        *keep, "table_no", "element_index", "row", "column", F.col("_c.header").alias("header"), F.col("_c.text").alias("text")
    )


def partition_documents(
    documents: DataFrame, content_col: str = "content", format_col: str = "format"
) -> DataFrame:
    """Choose the partitioner by document format.

    Spark evaluates a Python function for every row of a branch expression,
    so text rows hand it NULL and only HTML crosses into Python.
    """
    if format_col not in documents.columns:
        return partition_text(documents, content_col)
    html = F.lower(F.col(format_col)).isin(*HTML_FORMATS)
    parsed = documents.withColumn("_html", _html_elements(F.when(html, F.col(content_col))))
    elements = F.coalesce(F.col("_html"), text_elements(F.col(content_col)))
    return with_computed(parsed, "elements", elements).drop("_html")


def element_rows(partitioned: DataFrame) -> DataFrame:
    """Elements as rows, next to the document's other columns."""
    keep = [c for c in partitioned.columns if c not in ("elements", "content")]
    return partitioned.select(*keep, F.explode("elements").alias("_e")).select(
        *keep, *[F.col("_e")[f.name].alias(f.name) for f in ELEMENT.fields]
    )
