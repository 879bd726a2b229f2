"""Tables inside stored web pages, as rows."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 16  # characters parsed at once


class _Cells(HTMLParser):
    """Collects (table number, row number, cell texts); text inside <sup> (footnote marks) is dropped."""

    def __init__(self, table: str, row: str, cells: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.table, self.row, self.cells = table, row, cells
        self.rows: list[tuple[int, int, list[str]]] = []
        self.tables_seen, self.row_no, self.open_tables = 0, 0, 0
        self.current: list[str] | None = None
        self.cell: list[str] | None = None
        self.dropped = 0

    def handle_starttag(self, tag, attrs):
        if tag == self.table:
            self.open_tables += 1
            self.tables_seen, self.row_no = self.tables_seen + 1, 0
        elif self.open_tables and tag == self.row:
            self._end_row()
            self.current = []
        elif self.current is not None and tag in self.cells:
            self._end_cell()
            self.cell = []
        elif self.cell is not None and tag == "sup":
            self.dropped += 1

    def handle_endtag(self, tag):
        if tag == "sup" and self.dropped:
            self.dropped -= 1
        elif tag in self.cells:
            self._end_cell()
        elif tag == self.row:
            self._end_row()
        elif tag == self.table and self.open_tables:
            self._end_row()
            self.open_tables -= 1

    def handle_data(self, data):
        if self.cell is not None and not self.dropped and data.strip():
            self.cell.append(data.strip())

    def _end_cell(self):
        if self.cell is not None:
            self.current.append("".join(self.cell))
            self.cell, self.dropped = None, 0

    def _end_row(self):
        self._end_cell()
        if self.current is not None:
            self.rows.append((self.tables_seen - 1, self.row_no, self.current))
            self.row_no += 1
            self.current = None


def table_reader(table_tag: str = "tbody", row_tag: str = "tr", cell_tags: tuple[str, ...] = ("td", "th")):
    """A table function for lateral joins: of a page's text the rows (table_no, row_no, cells) of all its tables.

    A page is fed to the parser in pieces and its rows go out as they are found: memory holds a piece and a row.
    """

    class Reader:
        def eval(self, html: str) -> Iterator[tuple[int, int, list[str]]]:
            if html is None:
                return
            parser = _Cells(table_tag, row_tag, cell_tags)
            for at in range(0, len(html), PIECE):
                parser.feed(html[at : at + PIECE])
                yield from parser.rows
                parser.rows.clear()
            parser.close()
            yield from parser.rows

    return F.udtf(Reader, returnType="table_no int, row_no int, cells array<string>")


def extract_tables(
    pages: DataFrame,
    page: str,
    html: str,
    table_tag: str = "tbody",
    row_tag: str = "tr",
    cell_tags: tuple[str, ...] = ("td", "th"),
) -> DataFrame:
    """(page, table_no, row_no, cells) for every row of every table of every page; numbers start at 0."""
    read = table_reader(table_tag, row_tag, cell_tags)
    kept = pages.select(page, html).where(F.col(html).isNotNull())
    return kept.lateralJoin(read(F.col(html).outer())).select(page, "table_no", "row_no", "cells")
