"""Tables and list links inside HTML pages, one page per row.

The parser sees one page at a time and yields its cells; everything after that
is DataFrame work.
"""

from __future__ import annotations

from html.parser import HTMLParser
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame


class _TableReader(HTMLParser):
    """Rows of the first table inside every nested table with a given id."""

    def __init__(self, wanted: str):
        super().__init__(convert_charrefs=True)
        self.wanted = wanted
        self.stack: list[dict] = []  # open tables
        self.found: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            entry = {"holder": bool(self.stack) and dict(attrs).get("id") == self.wanted}
            waiting = next((t for t in reversed(self.stack) if t["holder"] and not t.get("used")), None)
            if waiting is not None:
                waiting["used"] = True
                entry["rows"] = []
                self.found.append(entry["rows"])
            self.stack.append(entry)
        elif self._rows() is not None:
            if tag == "tr":
                self._rows().append([])
            elif tag in ("td", "th"):
                if not self._rows():
                    self._rows().append([])
                self._close_cell()
                self.cell = []

    def handle_endtag(self, tag):
        if tag == "table" and self.stack:
            self._close_cell()
            self.stack.pop()
        elif tag in ("td", "th", "tr"):
            self._close_cell()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def _rows(self):
        return self.stack[-1].get("rows") if self.stack else None

    def _close_cell(self):
        if self.cell is not None and self._rows():
            self._rows()[-1].append(" ".join("".join(self.cell).split()))
        self.cell = None


def _tables_of(html: str, wanted: str):
    reader = _TableReader(wanted)
    reader.feed(html)
    reader.close()
    for t, rows in enumerate(reader.found):
        rows = [r for r in rows if r]
        if not rows:
            continue
        header = rows[0]
        for i, row in enumerate(rows[1:]):
            for j, value in enumerate(row):
                name = header[j] if j < len(header) else f"X{j + 1}"
                yield t, i, row[0], j, name, value


def _texts(batches, page: str, html: str):
    for pdf in batches:
        for key, text in zip(pdf[page], pdf[html]):
            if text:
                yield key, text


def _frames(rows, names: list[str]):
    """Rows to frames of a bounded size, whatever a batch of pages holds."""
    rows = iter(rows)
    while some := list(islice(rows, FRAME_ROWS)):
        yield pd.DataFrame(some, columns=names)


def table_cells(df: DataFrame, page: str, html: str, table_id: str = "main") -> DataFrame:
    """One row per table cell: page, table_idx, row_idx, label, col_idx, header, value.

    ``label`` is the first cell of the row.
    """
    source = df.select(page, html)
    kind = source.schema[page].dataType.simpleString()

    names = [page, "table_idx", "row_idx", "label", "col_idx", "header", "value"]

    def run(batches):
        yield from _frames(
            ((key, *cell) for key, text in _texts(batches, page, html) for cell in _tables_of(text, table_id)), names
        )

    return source.mapInPandas(
        run,
        f"`{page}` {kind}, table_idx int, row_idx int, label string, col_idx int, "
        "header string, value string",
    )

#: Rows of a frame handed back to Spark.
FRAME_ROWS = 10_000


class _LinkReader(HTMLParser):
    """Links that are the content of a list item."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.in_item = 0
        self.text: list[str] | None = None
        self.href = None

    def handle_starttag(self, tag, attrs):
        if tag == "li":
            self.in_item += 1
        elif tag == "a" and self.in_item:
            self.href, self.text = dict(attrs).get("href"), []

    def handle_endtag(self, tag):
        if tag == "li" and self.in_item:
            self.in_item -= 1
        elif tag == "a" and self.text is not None:
            self.items.append([self.href, "".join(self.text)])
            self.text = None

    def handle_data(self, data):
        if self.text is not None:
            self.text.append(data)


def list_links(df: DataFrame, page: str, html: str) -> DataFrame:
    """One row per link in a list: page, item_idx, href, text."""
    source = df.select(page, html)
    kind = source.schema[page].dataType.simpleString()

    def links(batches):
        for key, text in _texts(batches, page, html):
            reader = _LinkReader()
            reader.feed(text)
            reader.close()
            for i, (href, inside) in enumerate(reader.items):
                yield key, i, href, inside

    def run(batches):
        yield from _frames(links(batches), [page, "item_idx", "href", "text"])

    return source.mapInPandas(run, f"`{page}` {kind}, item_idx int, href string, text string")
