"""Logical tables that the queries share, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import names as N
from corpusmill.functions import text as T
from corpusmill.operators import corpus, records
from corpusmill.plans import sqltext as S
from corpusmill.session import table


def articles(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned articles with text hashes, before duplicates are removed."""
    x = table(spark, d, "cleaned_articles").select("row_seq", "country", "uri", "source_uri", "year", "month", "week", "article_text", "word_count")
    return x.withColumns({"uri": T.identifier("uri"), "source": N.source("source_uri"), "text_hash": T.text_hash("article_text"), "near_dup_hash": T.prefix_hash("article_text", 200)})


ARTICLES = f"""
articles AS (
  SELECT row_seq, country, {S.identifier('uri')} AS uri, source_uri, {S.source('source_uri')} AS source, year, month, week, article_text, word_count,
    sha256({S.plain('article_text')}) AS text_hash,
    sha256(array_to_string(string_split({S.plain('article_text')}, ' ')[1:200], ' ')) AS near_dup_hash
  FROM cleaned_articles)"""


def corpus_articles(spark: SparkSession, d: str) -> DataFrame:
    """Articles without duplicates of uri, text or fingerprint within a country."""
    return corpus.deduplicate(articles(spark, d))


CORPUS = (
    ARTICLES
    + """,
by_uri AS (SELECT * FROM articles WHERE uri = '' OR row_seq IN (SELECT min(row_seq) FROM articles WHERE uri <> '' GROUP BY country, uri)),
by_text AS (SELECT * FROM by_uri WHERE row_seq IN (SELECT min(row_seq) FROM by_uri GROUP BY country, text_hash)),
corpus AS (SELECT * FROM by_text WHERE row_seq IN (SELECT min(row_seq) FROM by_text GROUP BY country, near_dup_hash))"""
)


def silver(spark: SparkSession, d: str) -> DataFrame:
    """Model-labelled rows: the last attempt of each, without errors, with a class and a confidence between 0 and 1."""
    s = table(spark, d, "silver").withColumns({"uri": T.identifier("uri"), "y": N.label_class("llm_label_suggestion"), "confidence": T.confidence("llm_confidence"), "text_hash": T.overlap_hash("article_text")})
    # a failed attempt comes before the one that succeeded
    last = records.keep_last(s, ["silver_row_id"], [F.coalesce(F.trim("llm_error"), F.lit("")) == "", "text_hash", "uri", F.coalesce("llm_label_suggestion", F.lit("")), F.coalesce("llm_confidence", F.lit(-1.0))])
    return last.where((F.coalesce(F.trim("llm_error"), F.lit("")) == "") & F.col("y").isNotNull()).select("silver_row_id", "country", "uri", "source_uri", "article_text", "y", "confidence", "text_hash")


SILVER = f"""
silver_all AS (
  SELECT silver_row_id, country, {S.identifier('uri')} AS uri, source_uri, article_text, {S.label_class('llm_label_suggestion')} AS y,
    CASE WHEN llm_confidence IS NOT NULL AND NOT isnan(llm_confidence) THEN greatest(0.0, least(1.0, CASE WHEN llm_confidence > 1 THEN llm_confidence / 100 ELSE llm_confidence END)) END AS confidence,
    CASE WHEN {S.plain(S.identifier('article_text'))} = '' THEN '' ELSE sha256({S.plain(S.identifier('article_text'))}) END AS text_hash,
    coalesce(trim(llm_error), '') = '' AS ok, coalesce(llm_label_suggestion, '') AS l, coalesce(llm_confidence, -1.0) AS c
  FROM silver),
silver_rows AS (
  SELECT silver_row_id, country, uri, source_uri, article_text, y, confidence, text_hash FROM silver_all
  WHERE ok AND y IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY silver_row_id ORDER BY ok DESC, text_hash DESC, uri DESC, l DESC, c DESC) = 1)"""


def bench(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "human_benchmark_split")
    return b.select("bench_row_id", "country", T.identifier("uri").alias("uri"), "source_uri", "article_text", N.label_class("label").alias("y"), "evaluation_split", "human_validation_source", T.overlap_hash("article_text").alias("text_hash"))


BENCH = f"""
bench AS (
  SELECT bench_row_id, country, {S.identifier('uri')} AS uri, source_uri, article_text, {S.label_class('label')} AS y, evaluation_split, human_validation_source,
    CASE WHEN {S.plain(S.identifier('article_text'))} = '' THEN '' ELSE sha256({S.plain(S.identifier('article_text'))}) END AS text_hash
  FROM human_benchmark_split)"""


def classified(spark: SparkSession, d: str) -> DataFrame:
    """Corpus articles with the class that a model gave to the same uri; articles without one have none."""
    s = silver(spark, d).where("uri <> ''").groupBy("uri").agg(F.max("y").alias("y"), F.max("confidence").alias("confidence"))
    return corpus_articles(spark, d).where("uri <> ''").join(s, "uri")


CLASSIFIED = (
    CORPUS
    + ","
    + SILVER
    + """,
classified AS (
  SELECT c.*, s.y, s.confidence FROM corpus c
  JOIN (SELECT uri, max(y) AS y, max(confidence) AS confidence FROM silver_rows WHERE uri <> '' GROUP BY uri) s ON c.uri = s.uri AND c.uri <> '')"""
)


def coverage(spark: SparkSession, d: str) -> DataFrame:
    from corpusmill.operators import attention

    return attention.coverage(table(spark, d, "total_coverage"))


COVERAGE = """
coverage AS (
  SELECT country, week, CAST(sum(total) AS BIGINT) AS total FROM (
    SELECT DISTINCT country, date_trunc('week', week) AS week, CAST(total_news_articles AS BIGINT) AS total FROM total_coverage
    WHERE country IS NOT NULL AND week IS NOT NULL AND CAST(total_news_articles AS BIGINT) > 0)
  GROUP BY country, week)"""


def topic_rows(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a topic (the cluster of the vector of the same number) and their length as weight."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("topic"))
    x = table(spark, d, "documents").where("country is not null and n_chars > 0")
    return x.select("doc_id", "country", "source", "text", F.col("n_chars").cast("double").alias("weight")).join(e, "doc_id")


TOPICS = """
topic_rows AS (
  SELECT d.doc_id, d.country, d.source, d.text, CAST(d.n_chars AS DOUBLE) AS weight, e.label AS topic
  FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id WHERE d.country IS NOT NULL AND d.n_chars > 0)"""
