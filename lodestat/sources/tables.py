"""Tables of web pages: every table element as rows of text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readers import unique_names

#: Tables kept of one page.
MOST = 50


class _Tables(HTMLParser):
    """Rows of cells (text, columns spanned, is a heading) of each table; a nested table is a table of its own."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.done: list[list[list[tuple[str, bool]]]] = []
        self.open: list[list] = []
        self.cell: list[list] = []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append([])
            self.cell.append([])
        elif self.open and tag == "tr":
            self._close()
            self.open[-1].append([])
        elif self.open and tag in ("td", "th"):
            self._close()
            if not self.open[-1]:
                self.open[-1].append([])
            span = dict(attrs).get("colspan") or "1"
            self.cell[-1] = [tag == "th", min(1000, int(span)) if span.isdigit() and int(span) else 1, []]

    def _close(self):
        if self.open and self.cell[-1]:
            head, span, text = self.cell[-1]
            self.open[-1][-1].extend([(" ".join("".join(text).split()), head)] * span)
            self.cell[-1] = []

    def handle_endtag(self, tag):
        if self.open and tag in ("td", "th", "tr", "table"):
            self._close()
            if tag == "table":
                self.done.append([r for r in self.open.pop() if r])
                self.cell.pop()

    def handle_data(self, data):
        if self.open and self.cell[-1]:
            self.cell[-1][2].append(data)


def extract_tables(html: str | None) -> list[tuple[list[str], list[list[str | None]]]]:
    """(names, rows) of each table.

    Leading rows of headings only are joined by `` / ``; without any the first
    row names the columns.  Blank names become column_n, repeated ones get
    numbers; columns without a value and tables without a row are left out.
    """
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    while parser.open:
        parser.handle_endtag("table")
    out = []
    for rows in parser.done:
        k = 0
        while k < len(rows) and all(h for _, h in rows[k]):
            k += 1
        k = k or 1
        body = [[t or None for t, _ in r] for r in rows[k:]]
        width = max([len(r) for r in rows], default=0)
        heads = [[t for t, _ in r] + [""] * (width - len(r)) for r in rows[:k]]
        names = [" / ".join(dict.fromkeys(h[i] for h in heads if h[i])) for i in range(width)]
        body = [r + [None] * (width - len(r)) for r in body]
        keep = [i for i in range(width) if any(r[i] is not None for r in body)]
        if body and keep:
            out.append((unique_names([names[i] or f"column_{i + 1}" for i in keep]), [[r[i] for i in keep] for r in body]))
    return out[:MOST]


def page_tables(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, table, row, names, cells) for each row of each table of each page."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, t, i, names, r) for k, html in zip(b[key], b["html"], strict=True) for t, (names, body) in enumerate(extract_tables(html)) for i, r in enumerate(body)]
            yield pd.DataFrame(rows, columns=[key, "table", "row", "names", "cells"])

    return pages.select(key, F.col("html").cast("string")).mapInPandas(run, f"`{key}` {kind}, table int, row int, names array<string>, cells array<string>")
