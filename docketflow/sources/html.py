"""HTML tables and archive pages as rows, by the standard library's parser inside Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CELL = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("header", T.BooleanType()),
        T.StructField("colspan", T.IntegerType()),
        T.StructField("rowspan", T.IntegerType()),
        T.StructField("href", T.StringType()),
        T.StructField("title", T.StringType()),
    ]
)
_ROWS = T.ArrayType(T.ArrayType(_CELL))
TABLES = T.ArrayType(T.StructType([T.StructField("class", T.StringType()), T.StructField("rows", _ROWS)]))


class _Tables(HTMLParser):
    """Tables as lists of rows of cells; nested tables are tables of their own."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables, self.stack, self.cell = [], [], None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "table":
            self.stack.append({"class": a.get("class") or "", "rows": []})
            self.tables.append(self.stack[-1])
        elif self.stack and tag == "tr":
            self.stack[-1]["rows"].append([])
            self.cell = None
        elif self.stack and tag in ("td", "th"):
            if not self.stack[-1]["rows"]:
                self.stack[-1]["rows"].append([])
            number = lambda k: int(a[k]) if (a.get(k) or "").isdigit() else 1
            self.cell = {"text": "", "header": tag == "th", "colspan": number("colspan"), "rowspan": number("rowspan"), "href": None, "title": None}
            self.stack[-1]["rows"][-1].append(self.cell)
        elif self.cell is not None:
            if tag == "a" and self.cell["href"] is None:
                self.cell["href"] = a.get("href")
            elif tag == "img" and a.get("title"):
                self.cell["title"] = f"{self.cell['title']}\n{a['title']}" if self.cell["title"] else a["title"]
            elif tag == "br":
                self.cell["text"] += "\n"

    def handle_endtag(self, tag):
        if tag == "table" and self.stack:
            self.stack.pop()
            self.cell = None
        elif tag in ("td", "th", "tr"):
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell["text"] += data


def parse_tables(page: str | None) -> list[dict]:
    if page is None:
        return []
    parser = _Tables()
    parser.feed(page)
    parser.close()
    for table in parser.tables:
        for row in table["rows"]:
            for cell in row:
                cell["text"] = re.sub(r"[ \t\r\f\v]+", " ", cell["text"]).strip()
    return parser.tables


def spread(rows: list[list[dict]]) -> list[list[dict]]:
    """Rows with every cell repeated over the rows and columns that it spans."""
    out, open_ = [], {}
    for row in rows:
        line, cells, col = [], iter(row), 0
        while True:
            if open_.get(col, (0, None))[0] > 0:
                left, cell = open_[col]
                open_[col] = (left - 1, cell)
                line.append(cell)
                col += 1
                continue
            cell = next(cells, None)
            if cell is None:
                if any(c >= col and n > 0 for c, (n, _) in open_.items()):
                    line.append({"text": "", "header": False, "colspan": 1, "rowspan": 1, "href": None, "title": None})
                    col += 1
                    continue
                break
            for _ in range(max(1, cell["colspan"])):
                line.append(cell)
                open_[col] = (max(1, cell["rowspan"]) - 1, cell)
                col += 1
        out.append(line)
    return out


@F.pandas_udf(TABLES)
def tables(pages: pd.Series) -> pd.Series:
    """All tables of a page with their cells as written."""
    return pages.map(parse_tables)


@F.pandas_udf(TABLES)
def spread_tables(pages: pd.Series) -> pd.Series:
    """All tables of a page with spans spread out."""
    return pages.map(lambda p: [t | {"rows": spread(t["rows"])} for t in parse_tables(p)])


CATEGORIES = T.ArrayType(T.StructType([T.StructField("category", T.StringType()), T.StructField("cells", T.ArrayType(T.StringType()))]))


def category_rows(span: int):
    """Column function: all table rows of a page with spans spread out, each with the text of the last header cell over ``span`` columns before it."""

    @F.pandas_udf(CATEGORIES)
    def run(pages: pd.Series) -> pd.Series:
        def read(page: str | None) -> list[dict]:
            out = []
            for table in parse_tables(page):
                category = None
                for written, row in zip(table["rows"], spread(table["rows"])):
                    if len(written) == 1 and written[0]["header"] and written[0]["colspan"] >= span:
                        category = written[0]["text"]
                    elif row and not all(c["header"] for c in row):
                        out.append({"category": category, "cells": [c["text"] for c in row]})
            return out

        return pages.map(read)

    return run


def image_rows(page: Column) -> Column:
    """ARRAY of (cells, title): one entry per titled image of each table row, with the texts of the row's cells."""
    rows = F.flatten(F.transform(tables(page), lambda t: t["rows"]))
    of_row = lambda r: F.flatten(F.transform(F.filter(r, lambda c: c["title"].isNotNull()), lambda c: F.split(c["title"], "\n")))
    return F.flatten(F.transform(rows, lambda r: F.transform(of_row(r), lambda t: F.struct(F.transform(r, lambda c: c["text"]).alias("cells"), t.alias("title")))))


def table_rows(table: Column, cells: int | None = None, least: int = 1) -> Column:
    """Texts of each row that has exactly ``cells``, or at least ``least``, cells."""
    size = (lambda r: F.size(r) == cells) if cells else (lambda r: F.size(r) >= least)
    return F.transform(F.filter(table["rows"], size), lambda r: F.transform(r, lambda c: c["text"]))


def register_rows(page: Column) -> Column:
    """Rows (doc_num, doc_url, subject, source, date) of the first register table: its header names a document number, subject, source and date."""

    def heads(t: Column) -> Column:
        return F.lower(F.array_join(F.transform(F.get(t["rows"], F.lit(0)), lambda c: c["text"]), "|"))

    fits = lambda t: heads(t).rlike(r"doc (?:\x{2116}|number|num)") & heads(t).contains("subject") & heads(t).contains("source") & heads(t).contains("date")
    first = F.get(F.filter(tables(page), fits), F.lit(0))
    rows = F.filter(F.coalesce(F.slice(first["rows"], 2, F.greatest(F.size(first["rows"]) - 1, F.lit(0))), F.array().cast(_ROWS)), lambda r: F.size(r) >= 4)
    at = lambda r, k: F.get(r, F.lit(k))
    return F.transform(
        rows, lambda r: F.struct(at(r, 0)["text"].alias("doc_num"), at(r, 0)["href"].alias("doc_url"), at(r, 1)["text"].alias("subject"), at(r, 2)["text"].alias("source"), at(r, 3)["text"].alias("date"))
    )


def comment_headers(page: Column) -> Column:
    """MAP of ``name="value"`` in HTML comments, names in lower case, the last one wins."""
    pattern = r'<!--\s*([A-Za-z-]+)="([^"]*)"\s*-->'
    names, values = (F.regexp_extract_all(page, F.lit(pattern), F.lit(k)) for k in (1, 2))
    pairs = F.arrays_zip(F.transform(names, F.lower).alias("n"), values.alias("v"))
    last = F.filter(pairs, lambda p, k: F.coalesce(F.array_position(F.transform(F.slice(pairs, k + 2, F.size(pairs)), lambda q: q["n"]), p["n"]), F.lit(0)) == 0)
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["n"].alias("key"), p["v"].alias("value"))))
