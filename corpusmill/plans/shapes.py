"""Queries: exclusions, quotas within groups, wide tables, round trips through files, parsed lines, model choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import names as N
from corpusmill.functions import text as T
from corpusmill.operators import ml, records
from corpusmill.operators import sampling as P
from corpusmill.operators import topics as K
from corpusmill.plans import base as B
from corpusmill.plans import sqltext as S
from corpusmill.plans.analysis import _h
from corpusmill.session import scratch, table
from corpusmill.sources import documents, sinks, tables

#: Countries that have a file of their own, at most.
MOST_FILES = 1000

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {B.ARTICLES}, x AS (SELECT country, {S.identifier('uri')} AS uri FROM silver)
SELECT row_seq, country, uri FROM articles a WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.uri <> '' AND x.uri = a.uri AND x.country = a.country)""")
def unseen_articles(spark: SparkSession, d: str) -> DataFrame:
    """Articles that no labelled row stands for, by country and uri."""
    x = table(spark, d, "silver").select("country", T.identifier("uri").alias("uri"), F.lit(-1).cast("long").alias("row_seq"))
    return P.without(B.articles(spark, d).select("row_seq", "country", "uri"), x, "country", "uri", "row_seq").select("row_seq", "country", "uri")


@query(f"""WITH {B.CORPUS}, sizes AS (SELECT country, year, count(*) AS n FROM corpus WHERE year IS NOT NULL GROUP BY 1, 2),
levels AS (SELECT country, max(l) AS base FROM (SELECT country, l, sum(least(n, l)) AS s FROM sizes, unnest(range(0, 26)) AS t(l) GROUP BY 1, 2) WHERE s <= 25 GROUP BY country),
over AS (SELECT s.*, base, n > base AS open, sum(least(n, base)) OVER (PARTITION BY country) AS used FROM sizes s JOIN levels USING (country)),
quota AS (SELECT country, year, n, CASE WHEN open THEN base + CASE WHEN row_number() OVER (PARTITION BY country, open ORDER BY country, year) <= 25 - used THEN 1 ELSE 0 END ELSE n END AS quota FROM over),
s AS (SELECT row_seq, country, year, row_number() OVER (PARTITION BY country, year ORDER BY {_h('s', 'row_seq')}, row_seq) AS p FROM corpus WHERE year IS NOT NULL)
SELECT s.row_seq, s.country, s.year, q.n AS stratum_size, CAST(q.quota AS BIGINT) AS stratum_sample, q.n / q.quota AS design_weight FROM s JOIN quota q USING (country, year) WHERE p <= q.quota""")
def sample_per_country(spark: SparkSession, d: str) -> DataFrame:
    """25 articles of each country spread evenly over its years (a sampling operator)."""
    x = B.corpus_articles(spark, d).where("year is not null").select("row_seq", "country", "year")
    return P.allocated(x, ["country", "year"], 25, "row_seq", within=["country"])


@query(f"""WITH {B.BENCH}, q AS (SELECT country, y, 30 // count(*) OVER () + CASE WHEN row_number() OVER (ORDER BY country, y) <= 30 % count(*) OVER () THEN 1 ELSE 0 END AS quota FROM (SELECT DISTINCT country, y FROM bench)),
s AS (SELECT bench_row_id, country, y, row_number() OVER (PARTITION BY country, y ORDER BY {_h('s', 'bench_row_id')}, bench_row_id) AS p FROM bench)
SELECT bench_row_id, country, y FROM s JOIN q USING (country, y) WHERE p <= quota""")
def sample_total_even(spark: SparkSession, d: str) -> DataFrame:
    """30 benchmark rows, as many of each country and class (a sampling operator)."""
    return P.total_even(B.bench(spark, d).select("bench_row_id", "country", "y"), ["country", "y"], 30, "bench_row_id").select("bench_row_id", "country", "y")


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {_h('s', 'doc_id')}, doc_id) AS place FROM documents")
def shuffled_documents(spark: SparkSession, d: str) -> DataFrame:
    """All documents in the order of the draw."""
    return P.placed(table(spark, d, "documents").select("doc_id"), "doc_id")


@query(f"""WITH {B.TOPICS}, g AS (SELECT country, topic, sum(weight) AS w FROM topic_rows GROUP BY 1, 2), s AS (SELECT *, round(w / sum(w) OVER (PARTITION BY country), 9) AS share FROM g)
SELECT country, {', '.join(f"coalesce(max(share) FILTER (topic = {i}), 0.0) AS share_{i}" for i in range(10))} FROM s GROUP BY country""")
def topic_heatmap(spark: SparkSession, d: str) -> DataFrame:
    """Topic shares by country, wide."""
    return K.heatmap(K.shares(B.topic_rows(spark, d), ["country"], "topic", "weight"), "country", "topic", list(range(10)))


_WIDE = ", ".join(f"count(*) FILTER (country = '{c}') AS {c}" for c in N.COUNTRY_ORDER)


@query(f"SELECT month, {_WIDE} FROM cleaned_articles WHERE month <> 'NaT' GROUP BY month")
def month_by_country(spark: SparkSession, d: str) -> DataFrame:
    """Articles by month, a column for each country, zeros included."""
    return table(spark, d, "cleaned_articles").where("month <> 'NaT'").groupBy("month").pivot("country", N.COUNTRY_ORDER).count().fillna(0)


@query(f"SELECT row_seq, country, {S.collapse('article_text')} AS article_text FROM cleaned_articles")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """All articles written as one CSV file a country and read back with their country from the file name."""
    path = scratch(spark, "csv")
    x = table(spark, d, "cleaned_articles").withColumn("article_text", T.collapse("article_text"))
    sinks.guarded(x, path, partition_by=["country"], columns=["row_seq", "country", "article_text"], format="csv", header="true", escape='"', quoteAll="true", compression="gzip")
    return spark.read.option("basePath", path).csv(f"{path}/country=*", header=True, multiLine=True, escape='"').select(F.col("row_seq").cast("long").alias("row_seq"), "country", F.coalesce("article_text", F.lit("")).alias("article_text"))


@query("SELECT row_seq, country, article_text, title || chr(10) || body AS combined_text FROM (SELECT row_seq, country, article_text, string_split(article_text, chr(10))[1] AS title, array_to_string(string_split(article_text, chr(10))[2:], chr(10)) AS body FROM cleaned_articles)")
def country_files(spark: SparkSession, d: str) -> DataFrame:
    """All articles from a file of each country, whose name says which it is, with title and body put together."""
    path = scratch(spark, "countries")
    lines = F.split("article_text", "\n")
    x = table(spark, d, "cleaned_articles").select("row_seq", "country", "article_text", F.get(lines, F.lit(0)).alias("title"), F.array_join(F.slice(lines, 2, F.size(lines)), "\n").alias("body"))
    for r in x.select("country").distinct().limit(MOST_FILES + 1).collect():
        sinks.guarded(x.where(F.col("country") == r.country), f"{path}/{r.country}_news.csv", columns=["row_seq", "article_text", "title", "body"], format="csv", header="true", escape='"', quoteAll="true")
    y = tables.country_csv(spark, path, combined=True)
    return y.select(F.col("row_seq").cast("long").alias("row_seq"), "country", "article_text", "combined_text")


@query("SELECT event_id, user_id, event_type, value FROM events")
def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """All events written as JSON lines and read back with a schema."""
    path = scratch(spark, "json")
    table(spark, d, "events").select("event_id", "event_type", "user_id", "value").write.mode("append").json(path)
    return tables.json_lines(spark, path, "event_id long, user_id long, event_type string, value double").where("_corrupt is null").drop("_corrupt")


@query("""SELECT country, date_trunc('week', week) AS week, CAST(sum(total_news_articles) AS BIGINT) AS total_news_articles FROM total_coverage WHERE total_news_articles IS NOT NULL AND country IS NOT NULL AND week IS NOT NULL GROUP BY 1, 2""")
def coverage_of_any_layout(spark: SparkSession, d: str) -> DataFrame:
    """The coverage table read as a file of unknown layout: period and count columns are inferred."""
    return tables.coverage_counts(table(spark, d, "total_coverage"))


@query("SELECT row_seq, country AS name, CAST(row_seq % 90 + 1 AS INTEGER) AS rank, CAST(row_seq % 50 + 40 AS INTEGER) AS score FROM cleaned_articles")
def ranked_lines(spark: SparkSession, d: str) -> DataFrame:
    """Name, rank and score of extracted lines, half of them with rank and score written together."""
    k = F.col("row_seq")
    line = F.concat(F.col("country"), F.lit(" "), (k % 90 + 1).cast("string"), F.when(k % 2 == 0, " ").otherwise(""), (k % 50 + 40).cast("string"))
    n, r, s = documents.ranked_line(line)
    return table(spark, d, "cleaned_articles").select("row_seq", n.alias("name"), r.alias("rank"), s.alias("score"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders")
def years_in_names(spark: SparkSession, d: str) -> DataFrame:
    """The year in file names."""
    name = F.concat(F.lit("report_"), F.date_format("o_orderdate", "yyyy"), F.lit("_v"), F.col("o_orderkey").cast("string"), F.lit(".pdf"))
    return table(spark, d, "orders").select("o_orderkey", documents.year_of_name(name).alias("year"))


@query("""
WITH r AS (SELECT row_seq, regexp_replace(lower(trim(coalesce("source.uri", ''))), '#.*', '') AS o FROM raw_news),
l AS (SELECT row_seq, CASE WHEN contains("source.uri", '#') THEN trim('https://' || o) ELSE 'https://' || o || '/data.csv' END AS href FROM raw_news JOIN r USING (row_seq)),
s AS (SELECT row_seq, href, CASE WHEN contains(href, 'data') THEN 2 ELSE 0 END + CASE WHEN contains(href, '.csv') THEN 1 ELSE 0 END AS score FROM (SELECT * FROM l UNION ALL SELECT row_seq, '/about' FROM raw_news))
SELECT row_seq AS url, href, score FROM s QUALIFY row_number() OVER (PARTITION BY row_seq ORDER BY score DESC, href) = 1""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    """The best link of each page; the pages are made of every row's outlet, as its attribute must be written."""
    r = table(spark, d, "raw_news")
    o = F.lower(F.trim(F.coalesce(F.col("`source.uri`"), F.lit(""))))
    for char, entity in (("&", "&amp;"), ('"', "&quot;"), ("'", "&#39;")):
        o = F.replace(o, F.lit(char), F.lit(entity))
    html = F.concat(F.lit("<p><a href='/about'>a</a> <A HREF = \"https://"), o, F.lit("/data.csv\">b</A></p>"))
    return documents.links(r.select(F.col("row_seq").alias("page"), html.alias("html")), "html", "page", {"data": 2, ".csv": 1}).where("rank = 1").select("url", "href", "score")


@query(f"""WITH t AS (SELECT user_id, event_type, event_id, CASE WHEN ts >= (SELECT min(ts) + INTERVAL 15 DAY FROM events) THEN 1 ELSE 0 END AS new FROM events)
SELECT user_id, event_type, event_id FROM t QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY new DESC, event_id DESC) = 1""")
def checkpoint_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Events of the first half of the month updated by those of the second, last row of each user."""
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts")
    cut = e.agg((F.min("ts") + F.expr("INTERVAL 15 DAYS")).alias("cut"))
    x = e.withColumn("k", F.lit(1)).join(cut.withColumn("k", F.lit(1)), "k").drop("k")
    return records.upsert(x.where("ts < cut"), x.where("ts >= cut"), "user_id", "event_id").select("user_id", "event_type", "event_id")


@query("""WITH v AS (SELECT vec_id, label, embedding FROM embeddings), p AS (SELECT a.vec_id, a.label, b.label AS other, a.vec_id = b.vec_id AS own, 1 - list_cosine_similarity(a.embedding, b.embedding) AS dist FROM v a, v b),
m AS (SELECT vec_id, label, other, sum(dist) FILTER (NOT own) / count(*) FILTER (NOT own) AS d FROM p GROUP BY 1, 2, 3),
s AS (SELECT vec_id, max(d) FILTER (label = other) AS a, min(d) FILTER (label <> other) AS b FROM m GROUP BY 1)
SELECT count(*) AS n_rows, round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s""")
def embedding_silhouette(spark: SparkSession, d: str) -> DataFrame:
    """Mean cosine silhouette of the vectors' labels."""
    return ml.silhouette(table(spark, d, "embeddings"), "embedding", "label")


@query()
def clustering_stability(spark: SparkSession, d: str) -> DataFrame:
    """How stable k-means is on resamples, by number of clusters."""
    return ml.stability(table(spark, d, "embeddings"), "vec_id", "embedding", [5, 10], repeats=5)


_CANDIDATES = [(1, 8, 0.10, 0.20, 0.10, 0.50, 0.70, 0.2, 0.3), (2, 3, 0.10, 0.20, 0.10, 0.50, 0.99, 0.9, 0.9), (3, 9, 0.20, 0.20, 0.10, 0.50, 0.80, 0.2, 0.3), (4, 9, 0.10, 0.20, 0.10, 0.50, 0.80, 0.2, 0.3), (5, 9, 0.10, 0.20, 0.10, 0.50, 0.80, 0.2, 0.3)]


@query(f"""WITH c AS (SELECT * FROM (VALUES {', '.join(map(str, _CANDIDATES))}) AS t(candidate, topics, outlier_share, largest_share, country_nmi, common_share, mean_ari, persistence, validity))
SELECT candidate, CAST(mean_ari AS DOUBLE) AS mean_ari FROM c WHERE topics BETWEEN 4 AND 12 AND outlier_share <= 0.45 AND largest_share <= 0.4 AND country_nmi <= 0.25 AND common_share >= 0.35
ORDER BY mean_ari DESC, persistence DESC, validity DESC, outlier_share, candidate LIMIT 1""")
def model_choice(spark: SparkSession, d: str) -> DataFrame:
    """The candidate model that the selection takes."""
    c = spark.createDataFrame(_CANDIDATES, "candidate int, topics int, outlier_share double, largest_share double, country_nmi double, common_share double, mean_ari double, persistence double, validity double")
    return K.select_model(c).select("candidate", "mean_ari")


@query(f"""WITH {B.TOPICS}, l AS (SELECT DISTINCT topic, 'topic ' || topic AS label FROM topic_rows) SELECT topic, label AS model_label, CASE WHEN topic = 1 THEN 'Courts' ELSE label END AS label FROM l""")
def label_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Topic labels with one of them corrected by review."""
    l = B.topic_rows(spark, d).select("topic").distinct().withColumn("label", F.concat(F.lit("topic "), F.col("topic").cast("string")))
    c = l.select("topic", F.col("label").alias("expected"), F.when(F.col("topic") == 1, "Courts").otherwise("").alias("corrected"))
    return K.override(l, c, "topic")


@query("""SELECT country, min(row_seq) AS first_row, min_by(source_uri, row_seq) AS first_source, count(DISTINCT country) = 1 AS one_value FROM cleaned_articles GROUP BY country""")
def first_rows(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each country in arrival order."""
    return table(spark, d, "cleaned_articles").groupBy("country").agg(F.min("row_seq").alias("first_row"), F.min_by("source_uri", "row_seq").alias("first_source"), (F.countDistinct("country") == 1).alias("one_value"))


@query("""WITH c AS (SELECT country, count(*) AS n FROM cleaned_articles GROUP BY country) SELECT country, n, row_number() OVER (ORDER BY country) AS place FROM c""")
def report_order(spark: SparkSession, d: str) -> DataFrame:
    """Countries in the fixed order of reports."""
    c = table(spark, d, "cleaned_articles").groupBy("country").agg(F.count("*").alias("n"))
    return c.select("country", "n", N.country_rank("country").cast("long").alias("place")).orderBy("place")
