"""HTML tables as Markdown."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _Table(HTMLParser):
    """The rows of all cells, header cells alike; text of nested marks joined."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None
        self.tables = 0

    def _end_cell(self) -> None:
        if self.cell is not None:
            self.rows[-1].append("".join(self.cell).strip().replace("\n", " ").replace("|", "\\|"))
            self.cell = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables += 1
        elif tag == "tr":
            self._end_cell()
            self.rows.append([])
        elif tag in ("td", "th"):
            self._end_cell()
            if not self.rows:
                self.rows.append([])
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self._end_cell()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def table_to_markdown(html: str | None) -> str | None:
    """A table as Markdown, short rows filled up; anything else as it is."""
    if html is None or "<table" not in html.lower():
        return html
    parser = _Table()
    parser.feed(html)
    parser.close()
    parser._end_cell()
    rows = [r for r in parser.rows if r]
    if not rows:
        return html
    width = max(map(len, rows))
    lines = ["| " + " | ".join([*r, *[""] * (width - len(r))]) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def tables_to_markdown(html: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(table_to_markdown)

    return run(html)
