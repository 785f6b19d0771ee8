"""CSV as banks write it: whole files to headers and rows, and header names to columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARSED = T.StructType().add("headers", T.ArrayType(T.StringType())).add("rows", T.ArrayType(T.MapType(T.StringType(), T.StringType())))
BLANK = " \t\n\r\x0b\x0c\xa0﻿  "


def detect_delimiter(line: str) -> str:
    """Semicolon or tab if strictly the most frequent, else comma."""
    n = {d: line.count(d) for d in ";\t,"}
    for d, others in ((";", "\t,"), ("\t", ";,")):
        if all(n[d] > n[o] for o in others):
            return d
    return ","


def parse_csv(content: str, delimiter: str | None = None) -> tuple[list[str], list[dict[str, str]]]:
    """Headers and rows.  Quotes open and close anywhere in a cell, doubled ones inside stand for one; cells are
    trimmed, blank rows dropped, short rows filled up, and of equal headers the last one counts."""
    text = content.replace("\r\n", "\n").replace("\r", "\n")
    delimiter = delimiter or detect_delimiter(next((x for x in text.split("\n") if x.strip(BLANK)), ""))
    mark = re.escape(delimiter)
    # A cell is a run of quoted stretches and plain characters up to a delimiter or line end outside quotes.
    cell = re.compile(rf'((?:"(?:[^"]|"")*(?:"|\Z)|[^"\n{mark}])*)({mark}|\n|\Z)')
    lines, row, at = [], [], 0
    while at <= len(text):
        m = cell.match(text, at)
        row.append(re.sub(r'"((?:[^"]|"")*)(?:"|\Z)', lambda q: q[1].replace('""', '"'), m[1]).strip(BLANK))
        at = m.end()
        if m[2] != delimiter:
            if any(row):
                lines.append(row)
            row = []
            if not m[2]:
                break
    if not lines:
        return [], []
    headers = [re.sub(r"^[\"']|[\"']$", "", h).strip(BLANK) for h in lines[0]]
    return headers, [dict(zip(headers, x + [""] * len(headers))) for x in lines[1:]]


@F.pandas_udf(PARSED)
def csv_file(content: pd.Series) -> pd.DataFrame:
    """Headers and rows of whole files."""
    return pd.DataFrame([parse_csv(c or "") for c in content], columns=["headers", "rows"])


def resolve_header(headers: Column, synonyms: tuple[str, ...], wanted: str | None = None) -> Column:
    """The first header that is ``wanted``, or else that holds a synonym."""
    lower = lambda h: F.lower(F.trim(h))
    first = lambda test: F.get(F.filter(headers, test), F.lit(0))

    def like(h: Column) -> Column:
        out = F.lit(False)
        for s in synonyms:
            out = out | F.contains(lower(h), F.lit(s))
        return out

    found = first(like)
    return found if not wanted else F.coalesce(first(lambda h: (h == wanted) | (lower(h) == wanted.lower())), found)


def cell(row: Column, header: Column) -> Column:
    return F.when(header.isNotNull(), F.try_element_at(row, header))


def first_cell(row: Column, *names: str) -> Column:
    """The first of the named cells that is not empty."""
    return F.coalesce(*[F.nullif(F.try_element_at(row, F.lit(n)), F.lit("")) for n in names])
