"""Screening by reviewed source decisions, with an audit of sources that were never reviewed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import names as N


def decisions(df: DataFrame, decision: str = "conventional_journalism", decode: bool = True) -> DataFrame:
    """(country, source, include, decision): one row per pair; any NO excludes, everything else keeps."""
    d = F.upper(F.trim(F.coalesce(F.col(decision), F.lit(""))))
    x = df.select(N.country("country").alias("country"), N.source("source_clean", decode).alias("source"), d.alias("d"))
    return x.groupBy("country", "source").agg(F.bool_and(F.col("d") != "NO").alias("include"), F.array_join(F.array_sort(F.collect_set("d")), ";").alias("decision"))


def screen(df: DataFrame, decided: DataFrame, country: str = "country", source: str = "source_uri", decode: bool = True) -> DataFrame:
    """All rows with source_key, source_include and source_decision; 'MISSING' and kept where there is no decision."""
    x = df.withColumns({"__c": N.country(country), "source_key": N.source(source, decode)})
    d = decided.select(F.col("country").alias("__c"), F.col("source").alias("source_key"), F.col("include").alias("source_include"), F.col("decision").alias("source_decision"))
    j = x.join(d, ["__c", "source_key"], "left")
    return j.withColumns({"source_include": F.coalesce("source_include", F.lit(True)), "source_decision": F.coalesce("source_decision", F.lit("MISSING"))}).drop("__c")


def summary(screened: DataFrame, by: list[str], kinds: list[str]) -> DataFrame:
    """Rows before and after, the share excluded, and a column of counts for each kind of decision."""
    return screened.groupBy(*by).agg(
        F.count("*").alias("rows_before"),
        F.count_if("source_include").alias("rows_after"),
        F.count_if(~F.col("source_include")).alias("rows_excluded"),
        F.round(F.avg((~F.col("source_include")).cast("double")), 6).alias("share_excluded"),
        *[F.count_if(F.col("source_decision") == k).alias(f"decision_{k.lower() or 'blank'}") for k in kinds],
    )


def wide(screened: DataFrame, by: list[str], kinds: list[str] | None = None) -> DataFrame:
    """Rows of each group by decision, a column for each decision that occurs (or for the given ones), 0 where there are none."""
    return screened.groupBy(*by).pivot("source_decision", kinds).count().fillna(0)


def unreviewed(screened: DataFrame) -> DataFrame:
    """Sources without a decision: rows, share of the country's rows and rank within the country."""
    n = screened.groupBy("country", "source_key").agg(F.count("*").alias("n_rows"), F.bool_and(F.col("source_decision") == "MISSING").alias("missing"))
    n = n.withColumn("share_of_country", F.round(F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy("country")), 6))
    w = Window.partitionBy("country").orderBy(F.desc("n_rows"), "source_key")
    return n.where("missing").withColumn("rank", F.row_number().over(w)).drop("missing")
