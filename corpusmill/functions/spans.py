"""Spans of quotations in a text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = "array<struct<start:int,end:int,label:string>>"


def find_spans(text: str | None, quotes: list[tuple[str, str]]) -> list[dict]:
    """Where quotations stand, whatever their case: all matches, without overlap; the earlier, then the longer, then the first quotation wins."""
    if not text:
        return []
    hits = []
    for rank, (label, q) in enumerate(quotes):
        if q and q.strip():
            hits += [(m.start(), -(m.end() - m.start()), rank, label) for m in re.finditer(re.escape(q.strip()), text, re.IGNORECASE)]
    out, end = [], 0
    for start, length, _, label in sorted(hits):
        if start >= end:
            end = start - length
            out.append({"start": start, "end": end, "label": label})
    return out


def spans(text: Column | str, quotes: dict[str, Column | str]) -> Column:
    """`find_spans` for one quotation a label."""
    names = list(quotes)

    def run(t: pd.Series, *q: pd.Series) -> pd.Series:
        return pd.Series([find_spans(x, list(zip(names, (y if isinstance(y, str) else "" for y in row)))) for x, *row in zip(t, *q)])

    return F.pandas_udf(run, SCHEMA)(text, *quotes.values())
