"""Queries: learning, clustering, streaming, labelling by a client, text spans."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.spans import spans
from corpusmill.operators import grid, labelling, ml, topics
from corpusmill.plans import base as B
from corpusmill.plans import sqltext as S
from corpusmill.session import scratch, table
from corpusmill.sources.tables import listed
from corpusmill.streaming import corpus as stream

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query()
def cross_validated_scores(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold probabilities of the labelled rows from character tf-idf and balanced logistic regression."""
    return ml.cross_validated(B.silver(spark, d), "silver_row_id", "article_text")


@query()
def corpus_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every article with its probability and class, by a model fitted on the labelled rows, stored and read again."""
    path = scratch(spark, "model")
    ml.fit_text(B.silver(spark, d), "article_text").write().save(path)
    articles = table(spark, d, "cleaned_articles").select("row_seq", "country", "article_text")
    return ml.score_text(PipelineModel.load(path), articles, "article_text").select("row_seq", "country", F.round("probability", 6).alias("probability"), "predicted")


@query()
def embedding_clusters(spark: SparkSession, d: str) -> DataFrame:
    """K-means clusters of all vectors."""
    return ml.clusters(table(spark, d, "embeddings"), "embedding", 10)[0].select("vec_id", "label", "cluster")


def _grid(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return grid.stability_grid(x.join(table(spark, d, "documents").select("doc_id", "country"), "doc_id", "left"), "doc_id", "embedding", "country")


@query()
def topic_candidates(spark: SparkSession, d: str) -> DataFrame:
    """90 clusterings of all vectors, how stable each is on five resamples, and whether it is within the bounds."""
    return topics.adequate(_grid(spark, d))


@query()
def topic_choice(spark: SparkSession, d: str) -> DataFrame:
    """The clustering that the selection takes among them (one row, or none if none is within the bounds)."""
    return topics.select_model(_grid(spark, d))


@query()
def embedding_topics(spark: SparkSession, d: str) -> DataFrame:
    """Topics from principal components and divisive clustering."""
    return ml.reduced_clusters(table(spark, d, "embeddings"), "embedding", 12).select("vec_id", "topic")


@query("""
WITH c AS (SELECT * FROM (VALUES (1, 8, 0.10, 0.20, 0.10, 0.50), (2, 3, 0.10, 0.20, 0.10, 0.50), (3, 8, 0.50, 0.20, 0.10, 0.50), (4, 8, 0.10, 0.20, 0.10, 0.20), (5, 8, NULL, 0.20, 0.10, 0.50)) AS t(id, topics, o, l, n, c))
SELECT id, coalesce(topics BETWEEN 4 AND 12 AND o <= 0.45 AND l <= 0.40 AND n <= 0.25 AND c >= 0.35, false) AS adequate FROM c""")
def model_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Which candidate models are within the bounds."""
    rows = [(1, 8, 0.10, 0.20, 0.10, 0.50), (2, 3, 0.10, 0.20, 0.10, 0.50), (3, 8, 0.50, 0.20, 0.10, 0.50), (4, 8, 0.10, 0.20, 0.10, 0.20), (5, 8, None, 0.20, 0.10, 0.50)]
    x = spark.createDataFrame(rows, "id int, topics int, outlier_share double, largest_share double, country_nmi double, common_share double")
    return topics.adequate(x).select("id", "adequate")


def _run(df: DataFrame, spark: SparkSession, path: str, mode: str = "append") -> None:
    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    q.format("parquet").option("path", f"{path}/out").start().awaitTermination()


@query("""
WITH g AS (SELECT event_type, date_trunc('week', ts) AS week, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, week, n FROM g WHERE week + INTERVAL 7 DAY <= (SELECT max(ts) - INTERVAL 7 DAY FROM events)""")
def stream_weekly_counts(spark: SparkSession, d: str) -> DataFrame:
    """Weekly counts from the stream: the weeks that the watermark has passed."""
    path = scratch(spark, "stream")
    x = stream.read(spark, f"{d}/events*.parquet", table(spark, d, "events").schema)
    _run(stream.weekly_counts(x.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"]), spark, path)
    return spark.read.parquet(f"{path}/out").select("event_type", F.col("week").cast("timestamp_ntz").alias("week"), "n")


@query("""
WITH e AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e),
g AS (SELECT user_id, min(ts) AS began, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS n FROM s GROUP BY user_id, k)
SELECT user_id, began, ended, n FROM g WHERE ended <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user from the stream: those that the watermark has passed."""
    path = scratch(spark, "stream")
    x = stream.read(spark, f"{d}/events*.parquet", table(spark, d, "events").schema)
    _run(stream.sessions(x.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id"), spark, path)
    return spark.read.parquet(f"{path}/out").select("user_id", F.col("began").cast("timestamp_ntz").alias("began"), F.col("ended").cast("timestamp_ntz").alias("ended"), "n")


@query()
def stream_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    """Articles of the stream without copies within the watermark."""
    path = scratch(spark, "stream")
    whole = any(p.endswith(".parquet") for p in listed(spark, f"{d}/cleaned_articles.parquet") if not p.endswith("/cleaned_articles.parquet"))
    x = stream.read(spark, f"{d}/cleaned_articles.parquet" if whole else f"{d}/cleaned_articles*.parquet", table(spark, d, "cleaned_articles").schema)
    # arrival order stands for time: rows arrive long after their date
    x = x.select("country", "uri", "article_text", "row_seq", F.timestamp_seconds("row_seq").alias("arrived"))
    _run(stream.deduplicated(x, "arrived", "3650 days"), spark, path)
    return spark.read.parquet(f"{path}/out").select("row_seq", "country")


@query("""
SELECT user_id, max_by(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id""")
def stream_keep_last(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each user, merged batch by batch."""
    path = scratch(spark, "stream")
    x = stream.read(spark, f"{d}/events*.parquet", table(spark, d, "events").schema).select("user_id", "event_type", "event_id")
    x.writeStream.foreachBatch(stream.keep_last_sink(spark, f"{path}/out", "user_id", "event_id")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.current(spark, f"{path}/out").select("user_id", "event_type", "event_id")


def _stub():
    """A client without a network: says whether the text has a word."""
    import json

    return lambda p: json.dumps({"label": "yes" if "tender" in p.lower() else "no"})


@query("""
SELECT doc_id, CASE WHEN contains(lower(substr(trim(regexp_replace(coalesce(text, ''), '[\\s\\p{Z}]+', ' ', 'g')), 1, 6000)), 'tender') THEN 'yes' ELSE 'no' END AS label, '' AS error, 1 AS attempts FROM documents""")
def client_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of every document by a client (a stub without a network)."""
    x = table(spark, d, "documents").select("doc_id", labelling.prompt("Text: {text}", "text").alias("prompt"))
    return labelling.label(x, "doc_id", "prompt", _stub, lambda g: {"label": g["label"]}, ["label"]).select("doc_id", "label", "error", "attempts")


@query(f"""
WITH t AS (SELECT row_seq, lower(article_text) AS x, lower({S.strip('string_split(article_text, chr(10))[1]')}) AS q FROM cleaned_articles),
p AS (SELECT row_seq, q, string_split(x, q) AS p FROM t WHERE q <> ''),
k AS (SELECT row_seq, len(q) AS n, list_sum(list_transform(p[1:i], lambda y: len(y))) + (i - 1) * len(q) AS start FROM p, unnest(range(1, len(p))) AS r(i))
SELECT row_seq, CAST(start AS INTEGER) AS start, CAST(start + n AS INTEGER) AS end, 'title' AS label FROM k
""")
def quotation_spans(spark: SparkSession, d: str) -> DataFrame:
    """Where the first line of every article stands in it."""
    t = table(spark, d, "cleaned_articles").withColumn("title", F.get(F.split("article_text", "\n"), F.lit(0)))
    return t.select("row_seq", F.explode(spans("article_text", {"title": "title"})).alias("s")).select("row_seq", "s.start", "s.end", "s.label")
