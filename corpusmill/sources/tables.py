"""Readers: CSV per country, outlet lists, count files of any layout, JSON lines, manifests."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T


def listed(spark: SparkSession, folder: str) -> list[str]:
    """The paths in a folder of any file system, in order; none if there is no such folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in fs.listStatus(path)) if fs.exists(path) else []


def country_csv(spark: SparkSession, folder: str, countries: list[str] | None = None, suffix: str = "_news.csv", encoding: str = "UTF-8", combined: bool = False) -> DataFrame:
    """All `{country}{suffix}` files of a folder (gzip too) with the country from the file name.

    Columns are matched by name across files. Quotes inside quoted fields are doubled and fields may hold
    line ends. With `combined`, title and body are put together. No file is an error.
    """
    at = re.compile(rf"(.*?){re.escape(suffix)}(\.gz)?")
    found = {m[1]: path for path in listed(spark, folder) if (m := at.fullmatch(path.rpartition("/")[2]))}
    chosen = [c for c in (countries or sorted(found)) if c in found]
    if not chosen:
        raise FileNotFoundError(f"no *{suffix} in {folder}")
    out = None
    for c in chosen:
        x = spark.read.csv(found[c], header=True, multiLine=True, escape='"', encoding=encoding).withColumn("country", F.lit(c))
        if combined:
            x = x.withColumn("combined_text", T.combined("title", "body"))
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return out


def outlet_csv(spark: SparkSession, folder: str, outlets: dict[str, str], column: str = "source.uri", **options) -> DataFrame:
    """The same with one outlet list per country: rows repeated in title and body are dropped, other outlets too; an empty list skips the country."""
    out = None
    for c, path in outlets.items():
        listed = outlet_list(spark, path)
        if not listed.limit(1).count():
            continue
        x = country_csv(spark, folder, [c], **options).dropDuplicates(["title", "body"])
        x = x.withColumn("__o", F.lower(F.trim(F.col(f"`{column}`")))).join(listed.withColumnRenamed("outlet", "__o"), "__o", "left_semi").drop("__o")
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError("no country has an outlet list")
    return out


def outlet_list(spark: SparkSession, path: str) -> DataFrame:
    """One outlet a line, trimmed and in lower case; blank lines skipped."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("outlet")).where("outlet <> ''").distinct()


#: Preferred names of columns in count files, best first.
PERIODS = ["week", "week_start", "month", "date", "period", "year"]
COUNTS = ["total_news_articles", "total_articles", "total", "count", "n", "articles"]


def infer_period(df: DataFrame, least: float = 0.9) -> str | None:
    """The column that holds the period: a known name, else one with such a word in it that parses in 75% of rows, else any that parses in `least`.

    One aggregation over the table looks at all columns.
    """
    low = {c.lower(): c for c in df.columns}
    if known := next((low[c] for c in PERIODS if c in low), None):
        return known
    share = df.agg(*[F.avg(F.try_to_timestamp(F.col(f"`{c}`").cast("string")).isNotNull().cast("int")).alias(c) for c in df.columns]).first()
    fuzzy = [c for c in df.columns if any(p in c.lower() for p in PERIODS) and (share[c] or 0) >= 0.75]
    return next(iter(fuzzy + [c for c in df.columns if (share[c] or 0) >= least]), None)


def infer_count(df: DataFrame, taken: list[str]) -> str | None:
    """The column that holds the count: the only numeric one, else a known name, else one with such a word in it."""
    rest = [c for c in df.columns if c not in taken]
    share = df.agg(*[F.avg(F.col(f"`{c}`").cast("string").try_cast("double").isNotNull().cast("int")).alias(c) for c in rest]).first() if rest else {}
    numeric = [c for c in rest if (share[c] or 0) >= 0.9]
    if len(numeric) == 1:
        return numeric[0]
    return next((c for k in COUNTS for c in numeric if c.lower() == k), None) or next((c for k in COUNTS for c in numeric if k in c.lower()), None)


def coverage_counts(df: DataFrame, country: str | None = None) -> DataFrame:
    """(country, week, total_news_articles) from a count file of any layout; rows that don't parse are left out, weeks summed."""
    period = infer_period(df)
    count = infer_count(df, [c for c in (period, "country") if c])
    if period is None or count is None:
        raise ValueError(f"no period or count column among {df.columns}")
    c: Column = F.lit(country) if country else F.col("country")
    x = df.select(c.alias("country"), F.date_trunc("week", F.try_to_timestamp(F.col(f"`{period}`").cast("string"))).alias("week"), F.col(f"`{count}`").cast("string").try_cast("double").alias("n"))
    return x.where("week is not null and n is not null and country is not null").groupBy("country", "week").agg(F.sum("n").cast("long").alias("total_news_articles"))


#: Names that the column of a country's articles may have, best first, and the tables that may hold it (fixed values).
TOTALS = ["total_articles", "corruption_query_articles", "count", "n"]
LEVELS = ["summary", "total", "year", "month", "week"]


def country_totals(counts: dict[str, DataFrame | None]) -> DataFrame:
    """(country, total_articles) from the first usable table of counts: a summary with input_rows, the total, or one by year, month or week, added up.

    Countries that are NULL are kept; without a usable table it is an error.
    """
    for level in LEVELS:
        df = counts.get(level)
        known = ["input_rows"] if level == "summary" else ["total_articles"] if level == "total" else TOTALS
        found = [c for c in known if df is not None and {c, "country"} <= set(df.columns)]
        if found:
            n = F.col(found[0]).cast("long")
            return df.select("country", n.alias("total_articles")) if level in ("summary", "total") else df.groupBy("country").agg(F.sum(n).alias("total_articles"))
    raise FileNotFoundError(f"no table of counts among {LEVELS} has countries and a count")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An audit log; lines that are no JSON have their text in _corrupt."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def manifest(path: str) -> dict:
    """A manifest, on the driver."""
    return json.loads(Path(path).read_text())


def first_success(readers: list, errors: list[str] | None = None) -> DataFrame:
    """The first reader whose table has rows; what the others said goes to `errors`."""
    for r in readers:
        try:
            df = r()
            if df.limit(1).count():
                return df
        except Exception as e:  # a missing or broken file: the next one is tried
            if errors is not None:
                errors.append(str(e).splitlines()[0])
    raise FileNotFoundError("no reader gave rows: " + "; ".join(errors or []))
