"""Queries: attention over time, sources, samples and splits, quality and agreement, topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import names as N
from corpusmill.functions import text as T
from corpusmill.operators import attention as A
from corpusmill.operators import metrics as M
from corpusmill.operators import sampling as P
from corpusmill.operators import topics as K
from corpusmill.plans import base as B
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


# attention

def _weekly(spark: SparkSession, d: str) -> DataFrame:
    return A.weekly(B.classified(spark, d).where("y = 1"))


_WEEKLY = f"""
{B.CLASSIFIED}, {B.COVERAGE},
pos AS (SELECT country, week, count(*) AS positives FROM classified WHERE y = 1 AND week IS NOT NULL GROUP BY 1, 2)"""


def _rolled(unit: str) -> str:
    return f"""{_WEEKLY},
t AS (SELECT country, date_trunc('{unit}', week) AS {unit}, CAST(sum(total) AS BIGINT) AS total FROM coverage GROUP BY 1, 2),
p AS (SELECT country, date_trunc('{unit}', week) AS {unit}, CAST(sum(positives) AS BIGINT) AS positives FROM pos GROUP BY 1, 2),
att AS (SELECT country, {unit}, total, coalesce(positives, 0) AS positives, round(coalesce(positives, 0) / total, 9) AS attention FROM t LEFT JOIN p USING (country, {unit}))"""


def _by(spark: SparkSession, d: str, unit: str) -> DataFrame:
    return A.relative(A.roll_up(B.coverage(spark, d), unit, "total"), A.roll_up(_weekly(spark, d), unit, "positives"), unit)


@query(f"""WITH {_WEEKLY}
SELECT country, week, total, coalesce(positives, 0) AS positives, round(coalesce(positives, 0) / total, 9) AS attention FROM coverage LEFT JOIN pos USING (country, week)""")
def attention_week(spark: SparkSession, d: str) -> DataFrame:
    """Share of positive articles in all news by country and week."""
    return A.relative(B.coverage(spark, d), _weekly(spark, d), "week")


@query(f"WITH {_rolled('month')} SELECT * FROM att")
def attention_month(spark: SparkSession, d: str) -> DataFrame:
    """The same by month of the week's Monday."""
    return _by(spark, d, "month")


@query(f"WITH {_rolled('year')} SELECT * FROM att")
def attention_year(spark: SparkSession, d: str) -> DataFrame:
    return _by(spark, d, "year")


@query(f"""WITH {_rolled('year')} SELECT year, sum(total)::BIGINT AS total, sum(positives)::BIGINT AS positives, count(DISTINCT country) AS countries, round(sum(positives) * 100 / sum(total), 9) AS attention_pct FROM att GROUP BY year""")
def attention_overall(spark: SparkSession, d: str) -> DataFrame:
    """All countries together, by year."""
    return A.overall(_by(spark, d, "year"), "year")


@query(f"""WITH {_rolled('month')},
r AS (SELECT *, avg(positives / total) OVER (PARTITION BY country ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS r, avg(positives / total) OVER (PARTITION BY country) AS m FROM att)
SELECT country, month, positives, total, attention, round(r, 9) AS rolling, round(CASE WHEN m <> 0 THEN r / m * 100 END, 6) AS index FROM r""")
def attention_series(spark: SparkSession, d: str) -> DataFrame:
    """Three-month rolling means and their index."""
    return A.series(_by(spark, d, "month"), "month")


@query(f"""WITH {_rolled('month')},
g AS (SELECT coalesce(country, 'ALL') AS country, grouping(country) AS g, CAST(sum(total) AS BIGINT) AS total, CAST(sum(positives) AS BIGINT) AS positives FROM att GROUP BY ROLLUP (country))
SELECT country, total, positives, round(positives / total, 9) AS attention, round(positives / nullif((SELECT positives FROM g WHERE g = 1), 0), 9) AS share_of_positives FROM g""")
def attention_country(spark: SparkSession, d: str) -> DataFrame:
    """Totals by country with a grand total."""
    return A.by_country(_by(spark, d, "month"))


@query(f"""WITH {_rolled('month')}
SELECT country, CAST(row_number() OVER (PARTITION BY country ORDER BY attention DESC, month) AS INTEGER) AS rank, month, positives, total, attention FROM att QUALIFY rank <= 3""")
def attention_peaks(spark: SparkSession, d: str) -> DataFrame:
    """The three months of most attention in each country."""
    return A.peaks(_by(spark, d, "month"), "month")


_YEARS = range(2019, 2025)


@query(f"""WITH {_rolled('year')},
o AS (SELECT unnest([{', '.join(f"'{c}'" for c in N.COUNTRY_ORDER)}]) AS country, unnest(range(1, {len(N.COUNTRY_ORDER) + 1})) AS place)
SELECT o.country, CAST(any_value(place) AS INTEGER) AS place, {', '.join(f"coalesce(max(attention) FILTER (year(year) = {y}), 0.0) AS p_{y}" for y in _YEARS)}
FROM o LEFT JOIN att USING (country) GROUP BY o.country""")
def attention_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Countries by years."""
    return A.matrix(_by(spark, d, "year").withColumn("year", F.year("year")), "year", list(_YEARS))


_NEEDED = ", ".join(f"'{c}'" for c in N.COUNTRY_ORDER)


@query(f"""WITH {B.COVERAGE}, g AS (SELECT year(week) AS year, list(DISTINCT country) AS have FROM coverage GROUP BY 1)
SELECT CAST(year AS INTEGER) AS year, CAST(len(have) AS INTEGER) AS countries, array_to_string(list_sort(list_filter([{_NEEDED}], lambda x: NOT list_contains(have, x))), ',') AS missing,
  len(list_filter([{_NEEDED}], lambda x: NOT list_contains(have, x))) = 0 AS complete FROM g""")
def complete_years(spark: SparkSession, d: str) -> DataFrame:
    """Years for which every country has a denominator."""
    return A.complete_periods(B.coverage(spark, d).select("country", F.year("week").alias("year")), "year", N.COUNTRY_ORDER)


@query(f"""WITH {_rolled('year')}, y AS (SELECT country, CAST(year(year) AS INTEGER) AS year, attention FROM att)
SELECT a.country, a.year, a.attention, b.attention AS attention_lag1 FROM y a LEFT JOIN y b ON a.country = b.country AND a.year = b.year + 1""")
def attention_lag(spark: SparkSession, d: str) -> DataFrame:
    """Attention and that of the year before; a gap is no lag."""
    return A.lagged(_by(spark, d, "year").select("country", F.year("year").alias("year"), "attention"), "attention")


@query(f"""WITH {B.ARTICLES}, c AS (SELECT source, year, count(*) AS n FROM articles WHERE year IS NOT NULL GROUP BY 1, 2)
SELECT s.source, y.year, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT source FROM c) s CROSS JOIN (SELECT DISTINCT year FROM c) y LEFT JOIN c ON c.source = s.source AND c.year = y.year""")
def dense_source_years(spark: SparkSession, d: str) -> DataFrame:
    """Articles of every source in every year, zeros included."""
    return A.dense(B.articles(spark, d).where("year is not null").groupBy("source", "year").agg(F.count("*").alias("n")), "source", "year", "n")


@query(f"""WITH {B.CORPUS}
SELECT source, count(*) AS articles, count(DISTINCT country) AS countries, min(year) AS first_year, max(year) AS last_year, round(count(*) / (SELECT count(*) FROM corpus), 9) AS share FROM corpus GROUP BY source""")
def source_summary(spark: SparkSession, d: str) -> DataFrame:
    """Articles, countries and years of each source."""
    return A.sources(B.corpus_articles(spark, d))


_RANKED = f"""{B.CORPUS}, g AS (SELECT country, source, count(*) AS articles FROM corpus GROUP BY 1, 2),
ranked AS (SELECT *, round(articles / sum(articles) OVER (PARTITION BY country), 9) AS share, CAST(row_number() OVER (PARTITION BY country ORDER BY articles DESC, source) AS INTEGER) AS rank FROM g)"""


@query(f"WITH {_RANKED} SELECT * FROM ranked")
def source_country(spark: SparkSession, d: str) -> DataFrame:
    """Sources ranked within each country."""
    return A.country_sources(B.corpus_articles(spark, d))


@query(f"WITH {_RANKED} SELECT * FROM ranked WHERE rank <= 5")
def top_sources(spark: SparkSession, d: str) -> DataFrame:
    """The five largest sources of each country."""
    return A.country_sources(B.corpus_articles(spark, d)).where("rank <= 5")


@query(f"""WITH {_RANKED}
SELECT country, CAST(sum(articles) AS BIGINT) AS articles, count(*) AS sources, {', '.join(f"round(sum(articles) FILTER (rank <= {k}) / sum(articles), 9) AS top{k}_share" for k in (1, 5, 10))}
FROM ranked GROUP BY country""")
def source_concentration(spark: SparkSession, d: str) -> DataFrame:
    """Share of the largest sources of each country."""
    return A.concentration(A.country_sources(B.corpus_articles(spark, d)))


@query(f"""WITH {B.CORPUS} SELECT source, count(*) AS articles FROM corpus GROUP BY source ORDER BY articles DESC, source LIMIT 20""")
def largest_sources(spark: SparkSession, d: str) -> DataFrame:
    """The 20 largest sources (a top-k report)."""
    return B.corpus_articles(spark, d).groupBy("source").agg(F.count("*").alias("articles")).orderBy(F.desc("articles"), "source").limit(20)


# the same operators over the star schema, at its full size

@query("""
WITH g AS (SELECT n.n_name AS nation, year(o.o_orderdate) AS year, sum(l.l_quantity) AS w, count(*) AS n_rows
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1, 2)
SELECT year, nation, n_rows, w, round(w / sum(w) OVER (PARTITION BY year), 9) AS share FROM g""")
def weighted_shares_star(spark: SparkSession, d: str) -> DataFrame:
    """Weighted share of each nation by year over all order lines."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_quantity")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").cast("long").alias("year"))
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("nation"))
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return K.shares(j, ["year"], "nation", "l_quantity").select("year", "nation", "n_rows", "w", "share")


@query("""
WITH g AS (SELECT l_returnflag AS country, l_suppkey AS source, count(*) AS articles FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY articles DESC, source) AS rank FROM g)
SELECT country, CAST(sum(articles) AS BIGINT) AS articles, count(*) AS sources, round(sum(articles) FILTER (rank <= 1) / sum(articles), 9) AS top1_share,
  round(sum(articles) FILTER (rank <= 5) / sum(articles), 9) AS top5_share, round(sum(articles) FILTER (rank <= 10) / sum(articles), 9) AS top10_share FROM r GROUP BY country""")
def concentration_star(spark: SparkSession, d: str) -> DataFrame:
    """Concentration of suppliers over all order lines."""
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("country"), F.col("l_suppkey").alias("source"))
    return A.concentration(A.country_sources(x))


@query("""
SELECT user_id, date_trunc('week', ts) AS week, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2""")
def weekly_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of each user by week; the batch form of the streaming count."""
    return table(spark, d, "events").groupBy("user_id", F.date_trunc("week", "ts").cast("timestamp_ntz").alias("week")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


# samples and splits

def _h(seed: str, c: str) -> str:
    return f"sha256('{seed}#' || CAST({c} AS VARCHAR))"


@query(f"""WITH {B.CORPUS},
s AS (SELECT row_seq, country, year, count(*) OVER w AS stratum_size, row_number() OVER (PARTITION BY country, year ORDER BY {_h('s', 'row_seq')}, row_seq) AS p FROM corpus WHERE year IS NOT NULL WINDOW w AS (PARTITION BY country, year))
SELECT row_seq, country, year, stratum_size, least(stratum_size, 10) AS stratum_sample, stratum_size / least(stratum_size, 10) AS design_weight FROM s WHERE p <= 10""")
def sample_fixed(spark: SparkSession, d: str) -> DataFrame:
    """Ten articles of each country and year with design weights (a sampling operator)."""
    x = B.corpus_articles(spark, d).where("year is not null").select("row_seq", "country", "year")
    return P.fixed(x, ["country", "year"], 10, "row_seq").withColumn("stratum_sample", F.col("stratum_sample").cast("long"))


def _even(sql_sizes: str, by: str, target: int) -> str:
    # the quotas as the smallest level of water that reaches the target, then one more for the first strata in order
    return f"""
levels AS (SELECT max(l) AS base FROM unnest(range(0, {target} + 1)) AS t(l) WHERE (SELECT sum(least(n, l)) FROM {sql_sizes}) <= {target}),
over AS (SELECT *, n > base AS open FROM {sql_sizes}, levels),
quota AS (SELECT {by}, n, CASE WHEN open THEN base + CASE WHEN row_number() OVER (PARTITION BY open ORDER BY {by}) <= {target} - (SELECT sum(least(n, base)) FROM over) THEN 1 ELSE 0 END ELSE n END AS quota FROM over)"""


@query(f"""WITH {B.CORPUS}, sizes AS (SELECT country, year, count(*) AS n FROM corpus WHERE year IS NOT NULL GROUP BY 1, 2), {_even('sizes', 'country, year', 200)},
s AS (SELECT row_seq, country, year, row_number() OVER (PARTITION BY country, year ORDER BY {_h('s', 'row_seq')}, row_seq) AS p FROM corpus WHERE year IS NOT NULL)
SELECT s.row_seq, s.country, s.year, q.n AS stratum_size, CAST(q.quota AS BIGINT) AS stratum_sample, q.n / q.quota AS design_weight FROM s JOIN quota q USING (country, year) WHERE p <= q.quota""")
def sample_allocated(spark: SparkSession, d: str) -> DataFrame:
    """200 articles spread evenly over countries and years (a sampling operator)."""
    x = B.corpus_articles(spark, d).where("year is not null").select("row_seq", "country", "year")
    return P.allocated(x, ["country", "year"], 200, "row_seq")


@query(f"""WITH {B.CORPUS},
s AS (SELECT row_seq, country, year, month, count(*) OVER (PARTITION BY country) AS ng, count(*) OVER (PARTITION BY country, year, month) AS ns,
  row_number() OVER (PARTITION BY country, year, month ORDER BY {_h('s', 'row_seq')}, row_seq) AS p FROM corpus WHERE year IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY year, month, p) AS i FROM s WHERE p <= least(ns, greatest(1, CAST(round_even(20 * ns / ng, 0) AS BIGINT))))
SELECT row_seq, country, year, month FROM k WHERE i <= 20""")
def sample_proportional(spark: SparkSession, d: str) -> DataFrame:
    """20 articles of each country in proportion to its months (a sampling operator)."""
    x = B.corpus_articles(spark, d).where("year is not null").select("row_seq", "country", "year", "month")
    return P.proportional(x, ["country"], ["year", "month"], 20, "row_seq")


@query(f"""WITH {B.CORPUS},
s AS (SELECT row_seq, country, source, year, count(*) OVER (PARTITION BY country, source) AS nsrc, count(*) OVER (PARTITION BY country, source, year) AS nc,
  row_number() OVER (PARTITION BY country, source, year ORDER BY {_h('s', 'row_seq')}, row_seq) AS p FROM corpus WHERE year IS NOT NULL),
c AS (SELECT *, p <= greatest(1, CAST(round_even(least(8, nsrc) * nc / nsrc, 0) AS BIGINT)) AS in_cell FROM s),
f AS (SELECT *, in_cell AND row_number() OVER (PARTITION BY country, source, in_cell ORDER BY year, p) <= least(8, nsrc) AS first FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY first DESC, {_h('s+', 'row_seq')}, row_seq) AS n FROM f)
SELECT row_seq, country, source, year, NOT first AS topped_up FROM n WHERE n <= 30""")
def sample_source_capped(spark: SparkSession, d: str) -> DataFrame:
    """30 articles of each country, at most 8 of a source before topping up (a sampling operator)."""
    x = B.corpus_articles(spark, d).where("year is not null").select("row_seq", "country", "source", "year")
    return P.source_capped(x, "country", "source", "year", 30, 8, "row_seq")


@query(f"""WITH {B.SILVER}
SELECT silver_row_id, 'S-' || substr(sha256(silver_row_id), 1, 12) AS sample_id,
  CASE WHEN confidence < 0.6 THEN NULL WHEN confidence < 0.7 THEN 'near_threshold' WHEN confidence < 0.85 THEN 'medium' WHEN confidence IS NOT NULL THEN 'high' END AS band FROM silver_rows""")
def sample_bands(spark: SparkSession, d: str) -> DataFrame:
    """Sample ids and probability bands."""
    c = F.col("confidence")
    return B.silver(spark, d).select("silver_row_id", P.sample_id("S-", "silver_row_id").alias("sample_id"), F.when(c.isNotNull(), P.band(c, 0.6)).alias("band"))


@query(f"""WITH {B.BENCH}, s AS (SELECT bench_row_id, country, y, count(*) OVER (PARTITION BY country, y) AS n, row_number() OVER (PARTITION BY country, y ORDER BY {_h('s', 'bench_row_id')}, bench_row_id) AS p FROM bench WHERE y IS NOT NULL)
SELECT bench_row_id, country, y, CASE WHEN p <= least(n - 1, greatest(1, CAST(round_even(n * 0.4, 0) AS BIGINT))) THEN 'calibration' ELSE 'test' END AS part FROM s""")
def split_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Calibration and test parts of the benchmark, stratified by country and class."""
    x = B.bench(spark, d).where("y is not null").select("bench_row_id", "country", "y")
    return P.calibration_split(x, ["country", "y"], 0.4, "bench_row_id")


@query(f"""WITH {B.SILVER} SELECT silver_row_id, y, CAST((row_number() OVER (PARTITION BY y ORDER BY {_h('s', 'silver_row_id')}, silver_row_id) - 1) % 5 AS INTEGER) AS fold FROM silver_rows""")
def split_folds(spark: SparkSession, d: str) -> DataFrame:
    """Five stratified folds of the labelled rows."""
    return P.folds(B.silver(spark, d).select("silver_row_id", "y"), ["y"], 5, "silver_row_id")


@query("""WITH x AS (SELECT doc_id, r AS repeat, sha256('s#' || r || '#' || doc_id) AS k FROM documents, unnest(range(1, 6)) AS t(r)),
n AS (SELECT doc_id, repeat, count(*) OVER (PARTITION BY repeat) AS n, row_number() OVER (PARTITION BY repeat ORDER BY k, doc_id) AS p FROM x)
SELECT doc_id, CAST(repeat AS INTEGER) AS repeat FROM n WHERE p <= round_even(n * 0.8, 0)""")
def resamples(spark: SparkSession, d: str) -> DataFrame:
    """Five samples of exactly 80% of the documents (a sampling operator)."""
    return P.resamples(table(spark, d, "documents").select("doc_id"), 5, 0.8, "doc_id")


_OVER = f"""{B.SILVER}, {B.BENCH},
o AS (SELECT s.silver_row_id, s.country, s.uri <> '' AND s.uri IN (SELECT uri FROM bench WHERE uri <> '') AS by_uri, s.text_hash <> '' AND s.text_hash IN (SELECT text_hash FROM bench WHERE text_hash <> '') AS by_text FROM silver_rows s)"""


@query(f"WITH {_OVER} SELECT * FROM o WHERE by_uri OR by_text")
def overlap_rows(spark: SparkSession, d: str) -> DataFrame:
    """Labelled rows that stand in the benchmark, by uri or by text."""
    return P.overlap(B.silver(spark, d), B.bench(spark, d), "uri", "text_hash").select("silver_row_id", "country", "by_uri", "by_text")


@query(f"WITH {_OVER} SELECT silver_row_id, country FROM o WHERE NOT by_uri AND NOT by_text")
def training_rows(spark: SparkSession, d: str) -> DataFrame:
    """Labelled rows without those."""
    return P.without_overlap(B.silver(spark, d), B.bench(spark, d), "uri", "text_hash").select("silver_row_id", "country")


# quality and agreement

def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark rows with their class and a stand-in score (the relative length of the text) with its prediction."""
    b = B.bench(spark, d).where("y is not null and country is not null").select("bench_row_id", "country", "uri", F.col("y").alias("truth"), F.length("article_text").alias("chars"))
    return b.withColumn("probability", F.round(F.col("chars") / 3000.0, 6)).withColumn("probability", F.least(F.col("probability"), F.lit(1.0))).withColumn("predicted", (F.col("probability") >= 0.45).cast("int"))


_PAIRS = f"""{B.BENCH},
pairs AS (SELECT bench_row_id, country, y AS truth, least(round(length(article_text) / 3000.0, 6), 1.0) AS probability, CAST(least(round(length(article_text) / 3000.0, 6), 1.0) >= 0.45 AS INTEGER) AS predicted FROM bench WHERE y IS NOT NULL AND country IS NOT NULL)"""
_SCORES = """
  round(coalesce((tp + tn) / (tp + tn + fp + fn), 0.0), 9) AS accuracy, round(coalesce(tn / nullif(tn + fn, 0), 0.0), 9) AS no_precision, round(coalesce(tn / nullif(tn + fp, 0), 0.0), 9) AS no_recall,
  round(coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0.0), 9) AS no_f1, round(coalesce(tp / nullif(tp + fp, 0), 0.0), 9) AS yes_precision, round(coalesce(tp / nullif(tp + fn, 0), 0.0), 9) AS yes_recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 9) AS yes_f1,
  round((coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0.0) + coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0)) / 2, 9) AS macro_f1,
  round((coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0.0) * (tn + fp) + coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) * (tp + fn)) / (tp + tn + fp + fn), 9) AS weighted_f1,
  round((tp + fp) / (tp + tn + fp + fn), 9) AS predicted_positive_rate, tp + fn AS support"""
_COUNTS = """count(*) FILTER (truth = 1 AND {p}) AS tp, count(*) FILTER (truth = 0 AND NOT {p}) AS tn, count(*) FILTER (truth = 0 AND {p}) AS fp, count(*) FILTER (truth = 1 AND NOT {p}) AS fn"""


@query(f"WITH {_PAIRS}, n AS (SELECT {_COUNTS.format(p='predicted = 1')} FROM pairs) SELECT tp, tn, fp, fn, {_SCORES} FROM n")
def binary_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Classification quality over the benchmark."""
    return M.binary(_pairs(spark, d), "truth", "predicted")


@query(f"WITH {_PAIRS}, n AS (SELECT country, {_COUNTS.format(p='predicted = 1')} FROM pairs GROUP BY country) SELECT country, tp, tn, fp, fn, {_SCORES} FROM n")
def country_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The same by country."""
    return M.binary(_pairs(spark, d), "truth", "predicted", ["country"])


#: Thresholds of the sweep.
THRESHOLDS = [0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.7]
_SWEEP = f"{_PAIRS}, n AS (SELECT t AS threshold, {_COUNTS.format(p='probability >= t')} FROM pairs, unnest([{', '.join(f'{t}::DOUBLE' for t in THRESHOLDS)}]) AS x(t) GROUP BY t), sw AS (SELECT threshold, tp, tn, fp, fn, {_SCORES} FROM n)"


@query(f"WITH {_SWEEP} SELECT * FROM sw")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Quality at eleven thresholds in one pass."""
    return M.sweep(_pairs(spark, d), "truth", "probability", THRESHOLDS)


@query(f"WITH {_SWEEP} SELECT * FROM sw ORDER BY yes_f1 DESC, yes_recall DESC, yes_precision DESC, accuracy DESC, threshold LIMIT 1")
def best_threshold(spark: SparkSession, d: str) -> DataFrame:
    """The threshold that a calibration would choose."""
    return M.best_threshold(M.sweep(_pairs(spark, d), "truth", "probability", THRESHOLDS))


_LEVELS = "(SELECT doc_id, min(reading_level) AS x, max(reading_level) AS z FROM reading_labels GROUP BY doc_id HAVING count(*) > 1)"


def _raters(spark: SparkSession, d: str) -> DataFrame:
    """The two ratings of each document that has several, and the document's length as weight."""
    r = table(spark, d, "reading_labels").groupBy("doc_id").agg(F.min("reading_level").alias("x"), F.max("reading_level").alias("z"), F.count("*").alias("n")).where("n > 1").drop("n")
    return r.join(table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("weight")), "doc_id")


def _kappa(n: str) -> str:
    return f"""
c AS (SELECT CAST(x AS VARCHAR) AS a, CAST(z AS VARCHAR) AS b, {n} AS n FROM r GROUP BY 1, 2),
ra AS (SELECT a AS label, sum(n) AS ra, coalesce(sum(n) FILTER (a = b), 0) AS hit FROM c GROUP BY 1), cb AS (SELECT b AS label, sum(n) AS cb FROM c GROUP BY 1),
l AS (SELECT label, coalesce(ra, 0.0) AS ra, coalesce(hit, 0.0) AS hit, coalesce(cb, 0.0) AS cb FROM ra FULL JOIN cb USING (label)),
g AS (SELECT count(*) AS labels, sum(ra) AS total, sum(hit) AS hits, sum(ra * cb) AS chance, avg(coalesce(2 * hit / nullif(ra + cb, 0), 0.0)) AS macro, sum(coalesce(2 * hit / nullif(ra + cb, 0), 0.0) * ra) AS w FROM l)
SELECT labels, round(total, 6) AS total, round(hits / total, 9) AS agreement, round((hits / total - chance / (total * total)) / nullif(1 - chance / (total * total), 0), 9) AS kappa, round(macro, 9) AS macro_f1, round(w / total, 9) AS weighted_f1 FROM g"""


_R = f"r AS (SELECT l.x, l.z, CAST(d.n_chars AS DOUBLE) AS weight, l.doc_id FROM {_LEVELS} l JOIN documents d USING (doc_id))"


@query(f"WITH {_R}, {_kappa('CAST(count(*) AS DOUBLE)')}")
def rater_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Agreement and kappa of two raters."""
    return M.agreement(M.confusion(_raters(spark, d), "x", "z"))


@query(f"WITH {_R}, {_kappa('sum(weight)')}")
def rater_agreement_weighted(spark: SparkSession, d: str) -> DataFrame:
    """The same with design weights."""
    return M.agreement(M.confusion(_raters(spark, d), "x", "z", "weight"))


@query(f"WITH {_R} SELECT CAST(x AS VARCHAR) AS a, CAST(z AS VARCHAR) AS b, CAST(count(*) AS DOUBLE) AS n FROM r GROUP BY 1, 2")
def rater_confusion(spark: SparkSession, d: str) -> DataFrame:
    return M.confusion(_raters(spark, d), "x", "z")


@query(f"WITH {_R} SELECT doc_id, x AS first, z AS second, x || '->' || z AS kind, '' AS adjudicated, '' AS comment FROM r WHERE x <> z")
def rater_disagreements(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose raters differ, ready for adjudication."""
    return M.disagreements(_raters(spark, d), "doc_id", "x", "z")


# topics

@query(f"""WITH {B.TOPICS}, n AS (SELECT country AS a, topic AS b, CAST(count(*) AS DOUBLE) AS n FROM topic_rows GROUP BY 1, 2),
t AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM n)
SELECT CAST(sum(n) AS BIGINT) AS rows, round(2 * sum(n / t * ln(n * t / (na * nb))) / (-sum(n / t * ln(na / t)) - sum(n / t * ln(nb / t))), 8) AS nmi FROM t""")
def topic_country_nmi(spark: SparkSession, d: str) -> DataFrame:
    """Mutual information of topic and country."""
    return M.mutual_information(B.topic_rows(spark, d), "country", "topic")


@query(f"""WITH {B.TOPICS}, n AS (SELECT country AS a, topic AS b, CAST(count(*) AS DOUBLE) AS n FROM topic_rows GROUP BY 1, 2),
x AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS t FROM n), a AS (SELECT sum(n * (n - 1) / 2) AS sa FROM (SELECT sum(n) AS n FROM n GROUP BY a)), b AS (SELECT sum(n * (n - 1) / 2) AS sb FROM (SELECT sum(n) AS n FROM n GROUP BY b))
SELECT CAST(t AS BIGINT) AS rows, round((s - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 8) AS ari FROM x, a, b""")
def topic_country_ari(spark: SparkSession, d: str) -> DataFrame:
    """Adjusted Rand index of topic and country."""
    return M.rand_index(B.topic_rows(spark, d), "country", "topic")


@query(f"""WITH {B.TOPICS}, g AS (SELECT country, topic, count(*) AS n_rows, sum(weight) AS w FROM topic_rows GROUP BY 1, 2) SELECT *, round(w / sum(w) OVER (PARTITION BY country), 9) AS share FROM g""")
def topic_shares(spark: SparkSession, d: str) -> DataFrame:
    """Weighted share of each topic by country."""
    return K.shares(B.topic_rows(spark, d), ["country"], "topic", "weight")


@query(f"""WITH {B.TOPICS}, g AS (SELECT country, topic, sum(weight) AS w FROM topic_rows GROUP BY 1, 2),
s AS (SELECT *, w / sum(w) OVER (PARTITION BY country) AS s, sum(w) OVER (PARTITION BY topic) / sum(w) OVER () AS o FROM g)
SELECT country, topic, round(s, 9) AS share, round(o, 9) AS overall, round(s / o, 9) AS lift, round(log2(nullif(s / o, 0)), 9) AS log2_lift FROM s WHERE o >= 0.005""")
def topic_lift(spark: SparkSession, d: str) -> DataFrame:
    """Over- and under-representation of topics by country."""
    return K.lift(B.topic_rows(spark, d), "country", "topic", "weight")


@query(f"""WITH {B.TOPICS}, g AS (SELECT country, topic, sum(weight) AS w FROM topic_rows GROUP BY 1, 2), p AS (SELECT *, w / sum(w) OVER (PARTITION BY topic) AS p FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY p DESC, country) AS rank FROM p)
SELECT topic, string_agg(country || ' (' || format('{{:.1f}}', round(p * 100, 1)) || '%)', '; ' ORDER BY rank) AS leaders FROM k WHERE rank <= 3 GROUP BY topic""")
def topic_leaders(spark: SparkSession, d: str) -> DataFrame:
    """The three countries of most weight of each topic as text."""
    return K.leaders(K.shares(B.topic_rows(spark, d), ["country"], "topic", "weight"), "topic", "country")


@query(f"""WITH {B.TOPICS}, g AS (SELECT country, topic, sum(weight) AS w FROM topic_rows GROUP BY 1, 2), s AS (SELECT *, round(w / sum(w) OVER (PARTITION BY country), 9) AS share FROM g)
SELECT topic, max(share) AS max_share, count(*) FILTER (share >= 0.05) AS groups_common, count(*) AS groups FROM s GROUP BY topic""")
def topic_specificity(spark: SparkSession, d: str) -> DataFrame:
    return K.specificity(K.shares(B.topic_rows(spark, d), ["country"], "topic", "weight"), "topic")


@query(f"""WITH {B.TOPICS}, g AS (SELECT topic, source, count(*) AS c FROM topic_rows WHERE source IS NOT NULL GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY c DESC, source) AS rank FROM g)
SELECT topic, string_agg(source, '; ' ORDER BY rank) AS frequent FROM k WHERE rank <= 3 GROUP BY topic""")
def topic_sources(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent sources of each topic."""
    return K.frequent_values(B.topic_rows(spark, d), "topic", "source")


@query(f"""WITH {B.TOPICS}, t AS (SELECT *, row_number() OVER (PARTITION BY topic, country ORDER BY doc_id) AS turn FROM topic_rows), p AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY turn, country) AS place FROM t)
SELECT topic, country, doc_id, CAST(turn AS INTEGER) AS turn, CAST(place AS INTEGER) AS place FROM p WHERE place <= 5 AND turn <= 5""")
def topic_examples(spark: SparkSession, d: str) -> DataFrame:
    """Five examples of each topic, countries in turn (a top-k report)."""
    return K.round_robin(B.topic_rows(spark, d), "topic", "country", 5, "doc_id").select("topic", "country", "doc_id", "turn", "place")


@query(f"""WITH {B.TOPICS}, w AS (SELECT topic, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM topic_rows),
t AS (SELECT topic, unnest(w) AS term FROM w UNION ALL SELECT topic, w[i] || ' ' || w[i + 1] FROM w, unnest(range(1, len(w))) AS x(i)),
n AS (SELECT topic, term, count(*) AS tf FROM t GROUP BY 1, 2), f AS (SELECT *, sum(tf) OVER (PARTITION BY term) AS f FROM n), m AS (SELECT avg(s) AS mean FROM (SELECT sum(tf) AS s FROM n GROUP BY topic)),
s AS (SELECT topic, term, tf, round(tf * ln(1 + mean / f), 6) AS score FROM f, m), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, term) AS rank FROM s)
SELECT topic, CAST(rank AS INTEGER) AS rank, term, tf, score FROM r WHERE rank <= 10""")
def topic_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of the highest class-based tf-idf of each topic (a top-k report)."""
    x = B.topic_rows(spark, d).select("topic", F.expr(r"regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+', 0)").alias("tokens"))
    return K.class_tfidf(x, "topic", "tokens")


@query(f"""WITH {B.TOPICS}, n AS (SELECT topic, count(*) AS n FROM topic_rows GROUP BY 1)
SELECT count(*) FILTER (topic <> 0) AS topics, round(coalesce(sum(n) FILTER (topic = 0), 0) / sum(n), 9) AS outlier_share, round(max(n) FILTER (topic <> 0) / sum(n) FILTER (topic <> 0), 9) AS largest_share FROM n""")
def topic_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Number of topics, outliers and largest topic, topic 0 standing for outliers."""
    return K.diagnostics(B.topic_rows(spark, d), "topic", 0)


@query(f"""WITH {B.ARTICLES} SELECT row_seq, contains({B.S.fold(B.S.collapse('article_text'))}, {B.S.fold(B.S.collapse("string_split(article_text, chr(10))[1]"))}) AND {B.S.collapse("string_split(article_text, chr(10))[1]")} <> '' AS title_verbatim,
  contains({B.S.fold(B.S.collapse('article_text'))}, 'tender') AS has_tender FROM articles""")
def evidence_checks(spark: SparkSession, d: str) -> DataFrame:
    """Whether quotations stand in the text."""
    x = table(spark, d, "cleaned_articles").withColumn("title", F.get(F.split("article_text", "\n"), F.lit(0)))
    folded = T.fold(T.collapse("article_text"))
    title = T.fold(T.collapse("title"))
    return x.select("row_seq", (F.contains(folded, title) & (title != "")).alias("title_verbatim"), T.verbatim("article_text", F.lit("tender")).alias("has_tender"))
