"""Queries over written timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import timestamps
from corpusmill.session import table


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Articles whose date_parsed is NULL or is not the instant meant, with that instant."""
    t = table(spark, d, "cleaned_articles").select("row_seq", "source_uri", "country", "dateTime", "dateTimePub", "date_parsed")
    n = timestamps.normalise(t)
    wrong = F.col("date_parsed").isNull() | (F.floor(F.unix_micros("date_parsed") / 1e6) != F.col("ts_utc_s"))
    return n.where(F.col("ts_utc_s").isNotNull() & wrong).select("row_seq", F.col("ts_utc_s").alias("utc_s"))


def p6_instants(spark: SparkSession, d: str) -> DataFrame:
    """One instant per article, how it was read and whether that stays ambiguous when the order of day and month must be inferred."""
    t = table(spark, d, "cleaned_articles").select("row_seq", "source_uri", "country", "dateTime", "dateTimePub", "date")
    n = timestamps.normalise(t, ["dateTime", "dateTimePub", "date"], prior=timestamps.DAY_FIRST_PRIOR)
    return n.select("row_seq", "ts_utc_s", F.timestamp_seconds("ts_utc_s").alias("instant"), "ts_column", "ts_format", "ts_explicit_zone", F.round("ts_posterior", 6).alias("posterior"), "ts_ambiguous")


QUERIES = {f.__name__: f for f in (p6_found, p6_instants)}
SQL: dict[str, str] = {}
