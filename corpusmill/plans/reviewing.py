"""Queries: searching, joining and reconciling tables, sets, shapes and star-schema forms of the same operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import names as N
from corpusmill.functions import text as T
from corpusmill.operators import attention as A
from corpusmill.operators import metrics as M
from corpusmill.operators import records, review
from corpusmill.plans import analysis
from corpusmill.plans import base as B
from corpusmill.plans import sqltext as S
from corpusmill.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"SELECT row_seq, country FROM cleaned_articles WHERE contains({S.fold(S.collapse('article_text'))} || ' ' || {S.fold(S.collapse('source_uri'))}, 'mayor')")
def search_articles(spark: SparkSession, d: str) -> DataFrame:
    """Articles with a word in their text or outlet."""
    return review.search(table(spark, d, "cleaned_articles"), ["article_text", "source_uri"], " MAYOR ").select("row_seq", "country")


@query("SELECT bench_row_id, country, evaluation_split FROM human_benchmark_split WHERE country IN ('Italy', 'France') AND evaluation_split = 'test'")
def facet_filter(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark rows by facets."""
    return review.facets(table(spark, d, "human_benchmark_split"), {"country": ["Italy", "France"], "evaluation_split": ["test"], "label": []}).select("bench_row_id", "country", "evaluation_split")


@query("""SELECT country, count(*) FILTER (coalesce(trim(translated_text), '') <> '') AS completed, count(*) AS total,
  round(avg(CASE WHEN coalesce(trim(translated_text), '') <> '' THEN 1.0 ELSE 0.0 END), 6) AS share FROM silver GROUP BY country""")
def translation_progress(spark: SparkSession, d: str) -> DataFrame:
    """How much of each country is translated."""
    return review.progress(table(spark, d, "silver"), "country", F.coalesce(F.trim("translated_text"), F.lit("")) != "")


@query("""SELECT evaluation_split, lower(trim(label)) AS label, human_validation_source, count(*) AS n_rows FROM human_benchmark_split GROUP BY 1, 2, 3""")
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    """Label counts by part and sample."""
    return table(spark, d, "human_benchmark_split").groupBy("evaluation_split", F.lower(F.trim("label")).alias("label"), "human_validation_source").agg(F.count("*").alias("n_rows"))


@query("""WITH a AS (SELECT row_seq, word_count FROM cleaned_articles), b AS (SELECT row_seq, length(body) AS chars FROM raw_news), c AS (SELECT row_seq, text_hash FROM cleaned_articles)
SELECT row_seq, word_count AS words_word_count, CAST(chars AS INTEGER) AS raw_chars, text_hash AS hash_text_hash FROM a JOIN b USING (row_seq) JOIN c USING (row_seq)""")
def merged_tables(spark: SparkSession, d: str) -> DataFrame:
    """Three tables of the same rows joined on their key."""
    c = table(spark, d, "cleaned_articles")
    raw = table(spark, d, "raw_news").select("row_seq", F.length("body").alias("chars"))
    return review.merge_labels({"raw": raw, "words": c.select("row_seq", "word_count"), "hash": c.select("row_seq", "text_hash")}, "row_seq")


@query(f"""WITH k AS (SELECT country AS country, count(*) AS n FROM cleaned_articles GROUP BY 1), r AS (SELECT {S.country('country')} AS country, count(*) AS n FROM raw_news GROUP BY 1), s AS (SELECT country, count(*) AS n FROM silver GROUP BY 1)
SELECT country, r.n AS raw, k.n AS cleaned, s.n AS silver, coalesce(r.n = k.n AND r.n = s.n, false) AS agree FROM r FULL JOIN k USING (country) FULL JOIN s USING (country)""")
def reconciled_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each country in three tables side by side."""
    one = lambda x: x.select(N.country("country").alias("country"), F.lit(1).alias("n"))
    return review.reconcile({"raw": one(table(spark, d, "raw_news")), "cleaned": one(table(spark, d, "cleaned_articles")), "silver": one(table(spark, d, "silver"))}, "country", "n")


@query("""SELECT c.row_seq, c.country, r.title FROM cleaned_articles c JOIN raw_news r USING (row_seq)""")
def joined_on_key(spark: SparkSession, d: str) -> DataFrame:
    """Articles with their title, joined on the column that turns out to be a key of both."""
    c, r = table(spark, d, "cleaned_articles").select("uri", "row_seq", "country"), table(spark, d, "raw_news").select("uri", "row_seq", "title")
    key = review.choose_key(c, r, ["uri", "row_seq"])
    return records.one_to_one(c.drop("uri"), key, "articles").join(records.one_to_one(r.drop("uri"), key, "raw rows"), key)


@query("""SELECT silver_row_id, coalesce(nullif(trim(translated_text), ''), nullif(trim(article_text), ''), 'none') AS model_text FROM silver""")
def model_text(spark: SparkSession, d: str) -> DataFrame:
    """The text that a model gets: the translation, else the article."""
    return table(spark, d, "silver").select("silver_row_id", F.coalesce(review.first_filled("translated_text", "article_text"), F.lit("none")).alias("model_text"))


@query(f"""WITH {analysis._PAIRS}, n AS (SELECT country, {analysis._COUNTS.format(p='predicted = 1')} FROM pairs GROUP BY country), s AS (SELECT country, {analysis._SCORES} FROM n)
SELECT country, 'accuracy' AS metric, CAST(accuracy AS DOUBLE) AS value FROM s UNION ALL SELECT country, 'macro_f1', macro_f1 FROM s UNION ALL SELECT country, 'support', support FROM s""")
def long_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Quality by country, one row for each metric."""
    return review.long_metrics(M.binary(analysis._pairs(spark, d), "truth", "predicted", ["country"]), ["country"], ["accuracy", "macro_f1", "support"])


@query(f"""WITH {analysis._PAIRS}, n AS (SELECT evaluation_split AS run, {analysis._COUNTS.format(p='predicted = 1')} FROM pairs JOIN human_benchmark_split USING (bench_row_id) GROUP BY 1)
SELECT run, tp, tn, fp, fn, {analysis._SCORES} FROM n""")
def tagged_runs(spark: SparkSession, d: str) -> DataFrame:
    """Quality of two runs below each other."""
    p = analysis._pairs(spark, d).join(table(spark, d, "human_benchmark_split").select("bench_row_id", "evaluation_split"), "bench_row_id")
    return review.runs({k: M.binary(p.where(F.col("evaluation_split") == k), "truth", "predicted") for k in ("calibration", "test")})


@query("""SELECT DISTINCT country FROM silver INTERSECT SELECT DISTINCT country FROM human_benchmark_split""")
def common_countries(spark: SparkSession, d: str) -> DataFrame:
    """Countries of both labelled tables."""
    return table(spark, d, "silver").select("country").intersect(table(spark, d, "human_benchmark_split").select("country"))


@query("""SELECT DISTINCT source FROM documents WHERE source IS NOT NULL EXCEPT SELECT source FROM mix_targets""")
def sources_without_target(spark: SparkSession, d: str) -> DataFrame:
    """Sources of documents that have no target."""
    return table(spark, d, "documents").select("source").where("source is not null").subtract(table(spark, d, "mix_targets").select("source"))


@query(f"""WITH b AS (SELECT bench_row_id, {S.identifier('uri')} AS uri, {S.identifier('country')} AS country, {S.collapse('article_text')} AS t FROM human_benchmark_split)
SELECT bench_row_id, CASE WHEN uri <> '' THEN country || '::' || uri ELSE country || '::text::' || sha256(t) END AS article_id, sha256(t) AS input_sha256 FROM b""")
def article_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids that hold across files: country and uri, else country and the hash of the text."""
    b = table(spark, d, "human_benchmark_split").select("bench_row_id", T.identifier("uri").alias("uri"), T.identifier("country").alias("country"), T.content_hash("article_text").alias("input_sha256"))
    key = F.when(F.col("uri") != "", F.concat_ws("::", "country", "uri")).otherwise(F.concat_ws("::", F.col("country"), F.lit("text"), F.col("input_sha256")))
    return b.select("bench_row_id", key.alias("article_id"), "input_sha256")


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY country, week ORDER BY total_news_articles DESC NULLS LAST) AS n FROM total_coverage)
SELECT country, week, CAST(total_news_articles AS BIGINT) AS total FROM k WHERE n = 1""")
def coverage_by_priority(spark: SparkSession, d: str) -> DataFrame:
    """One count for each country and week: the largest where several are given."""
    from corpusmill.sources.documents import best_per_key

    t = table(spark, d, "total_coverage").withColumn("p", F.coalesce(-F.col("total_news_articles"), F.lit(1)))
    return best_per_key(t, ["country", "week"], "p", []).select("country", "week", F.col("total_news_articles").cast("long").alias("total"))


@query("""WITH a AS (SELECT country, coalesce(nullif(count(*), 0), 0) AS n FROM cleaned_articles GROUP BY country)
SELECT a.country, a.n, coalesce(d.n, 0) AS documents, round(a.n / nullif(d.n, 0), 6) AS ratio FROM a LEFT JOIN (SELECT country, count(*) AS n FROM documents GROUP BY country) d USING (country)""")
def table_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Articles over documents of each country; no ratio where there are none."""
    a = table(spark, d, "cleaned_articles").groupBy("country").agg(F.count("*").alias("n"))
    x = table(spark, d, "documents").groupBy("country").agg(F.count("*").alias("documents"))
    return a.join(x, "country", "left").fillna(0, ["documents"]).select("country", "n", "documents", F.round(F.try_divide("n", F.nullif("documents", F.lit(0))), 6).alias("ratio"))


@query("""WITH r AS (SELECT row_seq, country, count(*) OVER (PARTITION BY country) AS of_country, row_number() OVER (PARTITION BY country ORDER BY row_seq) AS place FROM cleaned_articles)
SELECT row_seq, country, of_country, CAST(place AS INTEGER) AS place FROM r""")
def places_in_country(spark: SparkSession, d: str) -> DataFrame:
    """Running number of each article in its country beside the country's total."""
    from pyspark.sql import Window

    w = Window.partitionBy("country")
    return table(spark, d, "cleaned_articles").select("row_seq", "country", F.count("*").over(w).alias("of_country"), F.row_number().over(w.orderBy("row_seq")).alias("place"))


@query("""WITH p AS (SELECT p_size AS size, c_mktsegment AS segment, sum(l_quantity) AS w FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
s AS (SELECT *, w / sum(w) OVER (PARTITION BY segment) AS s, sum(w) OVER (PARTITION BY size) / sum(w) OVER () AS o FROM p)
SELECT segment, size, round(s, 9) AS share, round(o, 9) AS overall, round(s / o, 9) AS lift, round(log2(nullif(s / o, 0)), 9) AS log2_lift FROM s WHERE o >= 0.005""")
def lift_star(spark: SparkSession, d: str) -> DataFrame:
    """Lift of part sizes by customer segment over all order lines."""
    from corpusmill.operators import topics

    l = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("size"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment")), F.col("o_custkey") == F.col("c_custkey"))
    return topics.lift(l.join(p, F.col("l_partkey") == F.col("p_partkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")), "segment", "size", "l_quantity")


@query("""WITH y AS (SELECT o_orderpriority AS priority, year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT priority, CAST(sum(n) FILTER (year = 1995) AS BIGINT) AS y1995, CAST(sum(n) FILTER (year = 1996) AS BIGINT) AS y1996, CAST(sum(n) FILTER (year = 1997) AS BIGINT) AS y1997 FROM y GROUP BY priority""")
def orders_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Orders by priority and year, wide."""
    x = table(spark, d, "orders").select(F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").alias("year"))
    g = x.groupBy("priority").pivot("year", [1995, 1996, 1997]).count()
    return g.select("priority", *[F.col(str(y)).alias(f"y{y}") for y in (1995, 1996, 1997)])


@query(f"""WITH {B.COVERAGE} SELECT country, count(*) AS weeks, min(week) AS first_week, max(week) AS last_week, CAST(sum(total) AS BIGINT) AS total FROM coverage GROUP BY country ORDER BY total DESC, country""")
def coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    """Weeks and totals of each country, largest first."""
    c = A.coverage(table(spark, d, "total_coverage"))
    return c.groupBy("country").agg(F.count("*").alias("weeks"), F.min("week").alias("first_week"), F.max("week").alias("last_week"), F.sum("total").alias("total")).orderBy(F.desc("total"), "country")
