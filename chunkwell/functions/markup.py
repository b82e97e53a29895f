"""HTML to elements and tables, for one document at a time.

A small helper over the standard library's tolerant tokenizer; Spark
distributes the documents.
"""

from __future__ import annotations

from html.parser import HTMLParser

from chunkwell.functions.text import BLANKS

_SILENT = {"script", "style", "head", "template", "noscript"}
#: Silent tags that do not take the rest of a page with them if they are never closed.
_OPTIONAL = {"noscript", "template"}
#: Tags that may stand in a head; any other ends one that was left open.
_HEAD = {"title", "base", "link", "meta", "script", "style", "template", "noscript"}
_TITLES = {"h1", "h2", "h3", "h4", "h5", "h6"}
_ITEMS = {"li", "dt", "dd"}
_BREAKS = {
    "address", "article", "aside", "blockquote", "body", "details", "div",
    "dl", "fieldset", "figure", "figcaption", "footer", "form", "header", "hr",
    "html", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "ul",
}
#: Blocks that cannot stand between the rows of a table: outside a cell they end it.
_NO_ROWS = _TITLES | {
    "article", "aside", "blockquote", "div", "dl", "footer", "header", "main", "nav", "ol",
    "p", "pre", "section", "ul",
}
# The largest spans that count.
MOST_COLUMNS, MOST_ROWS = 1_000, 65_534


def _span(attrs: list, name: str, most: int) -> int:
    value = dict(attrs).get(name) or ""
    return min(most, max(1, int(value))) if value.isascii() and value.isdigit() and len(value) < 10 else 1


class _Table:
    """The rows and cells of one table while it is read; end tags may be missing."""

    def __init__(self, depth: int) -> None:
        self.depth = depth
        self.rows: list[list[dict]] = []
        self.cell: dict | None = None
        self.head = self.row_open = self.caption = False

    @property
    def open(self) -> bool:
        """Whether content can stand here."""
        return self.cell is not None or self.caption

    def end_row(self) -> None:
        self.cell, self.row_open, self.caption = None, False, False

    def start(self, tag: str, attrs: list) -> None:
        if tag in ("td", "th"):
            if not self.row_open:
                self.start("tr", [])
            self.caption = False
            self.cell = {
                "parts": [],
                "header": tag == "th" or self.head,
                "row_span": _span(attrs, "rowspan", MOST_ROWS),
                "column_span": _span(attrs, "colspan", MOST_COLUMNS),
            }
            self.rows[-1].append(self.cell)
        elif tag == "tr":
            self.end_row()
            self.rows.append([])
            self.row_open = True
        elif tag in ("thead", "tbody", "tfoot"):
            self.end_row()
            self.head = tag == "thead"
        elif tag == "caption":
            self.end_row()
            self.caption = True

    def end(self, tag: str) -> None:
        if tag in ("td", "th"):
            self.cell = None
        elif tag == "caption":
            self.caption = False
        elif tag in ("tr", "thead", "tbody", "tfoot"):
            self.end_row()
            self.head = self.head and tag == "tr"

    def grid(self, element_index: int) -> dict:
        """The cells by row and column; a cell stands where those that reach down leave room."""
        cells, taken, columns, header_rows = [], {}, 0, 0
        for r, row in enumerate(self.rows):
            at = 0
            below = {c: n - 1 for c, n in taken.items() if n > 1}
            for cell in row:
                while taken.get(at, 0):
                    at += 1
                wide, deep = cell["column_span"], min(cell["row_span"], len(self.rows) - r)
                text = " ".join("".join(cell["parts"]).split())
                cells.append((r, at, deep, wide, cell["header"], text))
                if deep > 1:
                    below.update(dict.fromkeys(range(at, at + wide), deep - 1))
                at += wide
                columns = max(columns, at)
            header_rows += r == header_rows and bool(row) and all(c["header"] for c in row)
            taken = below
        names = ("row", "column", "row_span", "column_span", "header", "text")
        return {
            "element_index": element_index,
            "depth": self.depth,
            "n_rows": len(self.rows),
            "n_columns": columns,
            "header_rows": header_rows,
            "cells": [dict(zip(names, cell)) for cell in cells],
        }


class _Collector(HTMLParser):
    def __init__(self, loud: set) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        self.tables: list[dict] = []
        self._loud = loud  # places of silent tags that are never closed
        self._parts: list[str] = []
        self._category = "NarrativeText"
        self._silent: list[tuple[str, tuple]] = []
        self._open: list[_Table] = []
        self._begun: list[_Table] = []

    def close_element(self, following: str = "NarrativeText") -> None:
        text = " ".join("".join(self._parts).split())
        if text.strip(BLANKS):
            if self._category == "Table":
                self.tables += [t.grid(len(self.found)) for t in self._begun]
            self.found.append((self._category, text))
        self._parts, self._category, self._begun = [], following, []

    def end_tables(self) -> None:
        self._open = []
        self.close_element()

    def unclosed(self) -> set:
        return {place for tag, place in self._silent if tag in _OPTIONAL}

    def _text(self, data: str) -> None:
        self._parts.append(data)
        for table in self._open:
            if table.cell is not None:
                table.cell["parts"].append(data)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "body" or (self._silent and self._silent[0][0] == "head" and tag not in _HEAD):
            self._silent = []  # a head left open ends here
        if self._silent and self._silent[-1][0] in _OPTIONAL and tag in _TITLES | {"main", "article"}:
            self._silent = []  # one that was not closed does not take the page with it
        if tag in _SILENT:
            if self.getpos() not in self._loud:
                self._silent.append((tag, self.getpos()))
            return
        if self._silent:
            return
        if tag in _NO_ROWS:
            while self._open and not self._open[-1].open:
                self._open.pop()
                if not self._open:
                    self.close_element()
        if tag == "table":
            if not self._open:
                self.close_element("Table")
            else:
                self._text(" ")
            self._open.append(_Table(len(self._open)))
            self._begun.append(self._open[-1])
        elif self._open:
            self._text(" " if tag in _BREAKS | _TITLES | _ITEMS | {"td", "th", "tr", "br"} else "")
            self._open[-1].start(tag, attrs)
        elif tag == "br":
            self._parts.append(" ")
        elif tag in _TITLES:
            self.close_element("Title")
        elif tag in _ITEMS:
            self.close_element("ListItem")
        elif tag in _BREAKS:
            # a block inside a list item still belongs to the item
            self.close_element(
                self._category if self._category == "ListItem" and tag in ("p", "div")
                else "NarrativeText"
            )

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT:
            if any(tag == t for t, _ in self._silent):
                while self._silent.pop()[0] != tag:
                    pass
        elif self._silent:
            return
        elif self._open:
            if tag == "table":
                self._open.pop()
                if not self._open:
                    self.close_element()
                else:
                    self._text(" ")
            else:
                self._open[-1].end(tag)
        elif tag != "table" and (tag in _TITLES or tag in _ITEMS or tag in _BREAKS):
            self.close_element()

    def handle_data(self, data: str) -> None:
        if not self._silent:
            self._text(data)


def html_parts(html: str) -> tuple[list[tuple[str, str]], list[dict]]:
    """Ordered elements ``(category, text)`` of one page, and the grids of its tables.

    Scripts, styles and comments drop out. A ``noscript`` or ``template`` that is never closed
    hides nothing: the page is read again with its content.
    """
    loud: set = set()
    while True:
        collector = _Collector(loud)
        collector.feed(html)
        collector.close()
        if not (missed := collector.unclosed()):
            collector.end_tables()
            return collector.found, collector.tables
        loud = loud | missed
