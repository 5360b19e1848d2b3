"""Searching, filtering, joining and reconciling label tables for review."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators.corpus import keep_first


def search(df: DataFrame, columns: list[str], needle: str) -> DataFrame:
    """Rows of which any column has the needle, whatever its case; a blank needle keeps all rows."""
    n = " ".join(needle.split()).lower().replace("ß", "ss")
    return df.where(F.contains(T.fold(F.concat_ws(" ", *[T.collapse(c) for c in columns])), F.lit(n))) if n else df


def facets(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Rows with one of the wanted values in every column; an empty list filters nothing."""
    return reduce(lambda d, kv: d.where(F.coalesce(F.col(kv[0]).cast("string"), F.lit("")).isin(kv[1])) if kv[1] else d, wanted.items(), df)


def progress(df: DataFrame, by: str, done: Column) -> DataFrame:
    """Completed and all rows of each group."""
    return df.groupBy(by).agg(F.count_if(done).alias("completed"), F.count("*").alias("total"), F.round(F.avg(done.cast("double")), 6).alias("share"))


def merge_labels(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Inner join of label tables on a key; columns of each are prefixed with its name. The largest table should come first."""
    out = None
    for name, t in tables.items():
        x = t.select(key, *[F.col(c).alias(f"{name}_{c}") for c in t.columns if c != key])
        out = x if out is None else out.join(x, key)
    return out


def reconcile(tables: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """One row for each key that any table has: the value in each, and whether all have it and agree."""
    parts = [t.groupBy(key).agg(F.sum(value).alias(value)).select(key, F.lit(n).alias("t"), value) for n, t in tables.items()]
    g = reduce(DataFrame.unionByName, parts).groupBy(key).pivot("t", list(tables)).agg(F.first(value))
    same = reduce(lambda a, b: a & b, [F.coalesce(F.col(n) == F.col(next(iter(tables))), F.lit(False)) for n in tables])
    return g.withColumn("agree", same)


def choose_key(a: DataFrame, b: DataFrame, candidates: list[str]) -> str:
    """The first column that is a key of both tables: present, never blank and never repeated. One aggregation a table."""
    both = [c for c in candidates if c in a.columns and c in b.columns]

    def keys(d: DataFrame) -> set[str]:
        r = d.agg(*[F.countDistinct(F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))).alias(c) for c in both], F.count("*").alias("__n")).first()
        return {c for c in both if r[c] == r["__n"]}

    good = keys(a) & keys(b) if both else set()
    for c in both:
        if c in good:
            return c
    raise ValueError(f"none of {candidates} is a key of both tables")


def first_filled(*columns: str) -> Column:
    """The first column with text."""
    return F.coalesce(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in columns])


def long_metrics(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row for each metric."""
    return df.select(*keys, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(keys, values, "metric", "value")


def runs(tables: dict[str, DataFrame]) -> DataFrame:
    """Tables of several runs below each other, tagged; columns that one lacks are NULL."""
    tagged = [t.withColumn("run", F.lit(n)) for n, t in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def append_reviewed(labelled: DataFrame, reviewed: DataFrame, key: str, uri: str, label: str, known: dict[str, int], text: str, fixed: dict[str, str] = {}) -> DataFrame:  # noqa: B006
    """Labelled rows and reviewed ones below them, the first of each uri kept; rows without a uri count as one each.

    A reviewed label becomes its value in `known`; rows with another label are left out. `fixed` columns are set for
    all reviewed rows, title and body are split off their text, and columns that they lack are NULL.
    """
    y = F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.lower(F.trim(F.col(label))))
    title, body = T.title_body(text)
    new = reviewed.withColumns({label: y, "title": title, "body": body} | {c: F.lit(v) for c, v in fixed.items()}).where(F.col(label).isNotNull())
    both = labelled.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return keep_first(both, [uri], ["__new", key], F.coalesce(F.col(uri), F.lit("")) != "").drop("__new")


def exactly_one(df: DataFrame) -> DataFrame:
    """The single row of a selection; another number of rows is an error when it is read."""
    # two rows say as much as all of them
    two = df.limit(2)
    n = F.count("*").over(Window.partitionBy())
    found = two.withColumn("__n", n).where(F.assert_true(F.col("__n") == 1, "the selection must have exactly one row").isNull()).drop("__n")
    if not df.limit(1).count():
        raise ValueError("the selection must have exactly one row")
    return found


def evidence_errors(df: DataFrame, text: str, required: dict[str, tuple[str, str]]) -> Column:
    """Messages for labels whose evidence is missing or is no quotation: label column -> (value that needs evidence, evidence column)."""
    out = []
    for label, (value, evidence) in required.items():
        needs = F.lower(F.trim(F.coalesce(F.col(label), F.lit("")))) == value
        blank = T.collapse(evidence) == ""
        out.append(F.when(needs & blank, F.lit(f"{label}: no evidence")).when(needs & ~T.verbatim(text, evidence), F.lit(f"{label}: evidence is no quotation")))
    return F.array_compact(F.array(*out))
