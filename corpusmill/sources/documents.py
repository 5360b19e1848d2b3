"""Tables inside files: worksheets, archives, links of web pages, lines of extracted text."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def column_number(reference: str) -> int:
    """Number, from 0, of the column of a cell reference like AB12."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def worksheet(data: bytes, sheet: str | None = None) -> tuple[str, list[list[str]]]:
    """Name and rows of one sheet of a workbook: the named one if there is such, else the first. Read from its XML, without other libraries."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si"):
                shared.append("".join(t.text or "" for t in si.iter(f"{_MAIN}t")))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = [(s.get("name"), targets[s.get(f"{_REL}id")]) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]
        name, target = next((s for s in sheets if s[0] == sheet), sheets[0])
        target = target.lstrip("/")
        root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
        rows = []
        for r in root.iter(f"{_MAIN}row"):
            cells: dict[int, str] = {}
            for k, c in enumerate(r.iter(f"{_MAIN}c")):
                at = column_number(c.get("r") or "") if c.get("r") else k
                v = c.find(f"{_MAIN}v")
                if c.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                elif v is None or v.text is None:
                    value = ""
                else:
                    value = shared[int(v.text)] if c.get("t") == "s" else v.text
                cells[at] = value
            rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
        return name, rows


def members(path: str, data: bytes, depth: int = 3) -> Iterator[tuple[str, str, list[list[str]]]]:
    """(path, sheet, rows) of every workbook and CSV file in a file, archives within archives included."""
    low = path.lower()
    try:
        if low.endswith(".xlsx"):
            yield path, *worksheet(data)
        elif low.endswith(".csv"):
            yield path, "", list(csv.reader(io.StringIO(data.decode("utf-8-sig", "replace"))))
        elif low.endswith(".zip") and depth:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for n in sorted(z.namelist()):
                    yield from members(f"{path}!{n}", z.read(n), depth - 1)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, csv.Error):
        yield path, "unreadable", []


def sheets(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row_no, cells) of all rows of all worksheets, CSV files and archives at a path; an unreadable file has one row with sheet 'unreadable' and no cells."""

    def run(batches):
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for name, sheet, rows in members(p, data):
                    rows = rows or [None]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(rows)), pa.array([sheet] * len(rows)), pa.array(list(range(1, len(rows) + 1)), pa.int32()), pa.array(rows, pa.list_(pa.string()))], ["path", "sheet", "row_no", "cells"]
                    )

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, sheet string, row_no int, cells array<string>")


def links(pages: DataFrame, html: str, url: str, wanted: dict[str, int]) -> DataFrame:
    """(url, href, score, rank) of the links of web pages; the score adds the weights of the words that the address has.

    An attribute may be in either kind of quotation marks, its character entities are read, and what follows a # is no
    part of the address.
    """
    either = "(?i)href\\\\s*=\\\\s*(\"[^\"]*\"|\\'[^\\']*\\')"
    x = pages.select(F.col(url).alias("url"), F.explode(F.array_distinct(F.expr(f"regexp_extract_all({html}, '{either}', 1)"))).alias("href"))
    # a numeric entity holds a # of its own: entities are read first
    href = F.substring(F.col("href"), F.lit(2), F.length("href") - 2)
    for entity, char in (("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        href = F.replace(href, F.lit(entity), F.lit(char))
    x = x.select("url", F.trim(F.substring_index(href, "#", 1)).alias("href")).where("href <> ''").distinct()
    low = F.lower("href")
    score = sum((F.when(F.contains(low, F.lit(w.lower())), n).otherwise(0) for w, n in wanted.items()), F.lit(0))
    from pyspark.sql import Window

    return x.withColumn("score", score).withColumn("rank", F.row_number().over(Window.partitionBy("url").orderBy(F.desc("score"), "href")))


def header_labels(sheets: DataFrame, before: int = 8) -> DataFrame:
    """`sheets` with `labels`: for each cell the words above it in its column, in lower case, from at most `before` rows; numbers are no words."""
    from pyspark.sql import Window

    cell = sheets.select("path", "sheet", "row_no", F.posexplode("cells").alias("col", "value"))
    word = F.nullif(F.regexp_replace(F.trim(F.coalesce("value", F.lit(""))), r"\s+", " "), F.lit(""))
    w = Window.partitionBy("path", "sheet", "col").orderBy("row_no").rangeBetween(-before, -1)
    above = F.collect_list(F.when(word.rlike(r"^-?[0-9]+([.][0-9]+)?$"), None).otherwise(word)).over(w)
    labelled = cell.withColumn("label", F.lower(F.array_join(above, " ")))
    row = labelled.groupBy("path", "sheet", "row_no").agg(F.array_sort(F.collect_list(F.struct("col", "label"))).alias("l"))
    return sheets.join(row.select("path", "sheet", "row_no", F.col("l.label").alias("labels")), ["path", "sheet", "row_no"], "left")


def _number(c: Column) -> Column:
    return F.regexp_extract(F.replace(F.coalesce(c, F.lit("")), F.lit(","), F.lit("")), r"-?\d+(?:\.\d+)?", 0).try_cast("double").cast("int")


def labelled_number(cells: Column | str, labels: Column | str, terms: list[str], year: int | None = None) -> Column:
    """The first number of a row under a label with all the terms, those that name the year first; NULL if there is none."""
    pairs = F.arrays_zip(F.col(cells).alias("c") if isinstance(cells, str) else cells.alias("c"), F.col(labels).alias("l") if isinstance(labels, str) else labels.alias("l"))

    def first(words: list[str]) -> Column:
        under = F.filter(pairs, lambda p: reduce(lambda a, b: a & b, [F.contains(p["l"], F.lit(w)) for w in words], F.lit(True)) & _number(p["c"]).isNotNull())
        return _number(F.get(under, F.lit(0))["c"])

    return F.coalesce(*([first([*terms, str(year)])] if year is not None else []), first(terms))


def unlabelled_numbers(cells: Column | str, name_at: Column | str) -> tuple[Column, Column]:
    """(score, rank) of a row without labels: its first number from 0 to 100, and of the others the first from 1 to 220."""
    c = F.col(cells) if isinstance(cells, str) else cells
    at = F.col(name_at) if isinstance(name_at, str) else name_at
    n = F.filter(F.transform(c, lambda x, i: F.when(i != at, _number(x))), lambda x: x.isNotNull())
    place = F.array_position(F.transform(n, lambda x: x.between(0, 100)), True)
    rest = F.filter(n, lambda x, i: (i + 1 != place) & x.between(1, 220))
    return F.when(place > 0, F.get(n, (place - 1).cast("int"))), F.get(rest, F.lit(0))


def file_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of all files at a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def year_of_name(c: Column) -> Column:
    """The year in a file name: four digits on their own first, else any 19.. or 20.. in it."""
    alone = F.regexp_extract(c, r"(?:^|[^0-9])((?:19|20)\d\d)(?:[^0-9]|$)", 1)
    within = F.regexp_extract(c, r"((?:19|20)\d\d)", 1)
    return F.coalesce(F.nullif(alone, F.lit("")), F.nullif(within, F.lit(""))).try_cast("int")


def ranked_line(c: Column) -> tuple[Column, Column, Column]:
    """(name, rank, score) of a line 'Name 12 74' or 'Name 1274' (rank and two-digit score written together); NULLs for another line."""
    pattern = r"^\s*([^0-9]+?)[\s.*]+(\d{1,3})\s+(\d{1,3})\s*$"
    glued = r"^\s*([^0-9]+?)[\s.*]+(\d{1,3})(\d{2})\s*$"
    pick = lambda p, i: F.nullif(F.regexp_extract(c, p, i), F.lit(""))
    both = lambda i: F.coalesce(pick(pattern, i), pick(glued, i))
    return F.trim(both(1)), both(2).try_cast("int"), both(3).try_cast("int")


def best_per_key(df: DataFrame, keys: list[str], priority: str, order: list[str]) -> DataFrame:
    """One row of each key: the best source first, then by the given columns."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(priority, *order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
