"""Queries: corpus building, normal forms, screening, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import names as N
from corpusmill.functions import text as T
from corpusmill.operators import corpus, records, review, screening
from corpusmill.plans import base as B
from corpusmill.plans import sqltext as S
from corpusmill.session import table
from corpusmill.sources import tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_LINES = r"list_filter(list_transform(string_split(coalesce(article_text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')"


@query(f"""
WITH r AS (SELECT row_seq, country, {S.strip('uri')} AS uri, lower(trim(coalesce("source.uri", ''))) AS source_uri,
    {S.collapse(f"{S.strip('title')} || chr(10) || {S.strip('body')}")} AS t, lower(trim(coalesce(isDuplicate, ''))) AS f FROM raw_news),
k AS (SELECT *, {S.word_count('t')} AS n FROM r WHERE f NOT IN ('true', '1', 'yes') AND t <> '')
SELECT row_seq, country, trim(uri) AS uri, source_uri, CAST(n AS INTEGER) AS word_count, sha256(t) AS text_sha, sha256({S.plain('t')}) AS text_hash FROM k WHERE n >= 80
""")
def clean_articles(spark: SparkSession, d: str) -> DataFrame:
    """Cleaning of downloaded rows: flags, text, least length, hashes (without re-reading wrong encodings, which SQL lacks)."""
    raw = table(spark, d, "raw_news").withColumn("uri", F.regexp_replace(F.coalesce("uri", F.lit("")), f"^[{T.SPACE}]+|[{T.SPACE}]+$", ""))
    return corpus.clean(raw, 80, 0, repair=False).select("row_seq", "country", "uri", "source_uri", "word_count", F.sha2("article_text", 256).alias("text_sha"), "text_hash")


@query()
def clean_articles_repaired(spark: SparkSession, d: str) -> DataFrame:
    """The same with whole texts of UTF-8 read as Latin-1 read again."""
    return corpus.clean(table(spark, d, "raw_news"), 80, 200).select("row_seq", "country", "uri", "source_uri", "date_parsed", "year", "month", "week", "article_text", "word_count", "text_hash", "near_dup_hash")


@query(f"""
WITH r AS (SELECT row_seq, body AS x, {S.read_again('body')} AS y FROM raw_news),
m AS (SELECT row_seq, x, y, {S.markers('y')} < {S.markers('x')} AS again FROM r)
SELECT row_seq, sha256(CASE WHEN again THEN y ELSE x END) AS text_sha, coalesce(again, false) AS changed FROM m
""")
def repaired_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every body, read again where it is UTF-8 shown as Latin-1 or cp1252 as a whole."""
    x = table(spark, d, "raw_news").select("row_seq", "body", T.repair_marked("body").alias("again"))
    return x.select("row_seq", F.sha2("again", 256).alias("text_sha"), F.coalesce(F.col("again") != F.col("body"), F.lit(False)).alias("changed"))


@query(f"WITH {B.CORPUS} SELECT row_seq, country, uri, text_hash FROM corpus")
def dedupe_articles(spark: SparkSession, d: str) -> DataFrame:
    """Keep-first by uri, then text, then fingerprint, within a country."""
    return B.corpus_articles(spark, d).select("row_seq", "country", "uri", "text_hash")


@query(f"""
WITH {B.CORPUS}
SELECT CASE WHEN grouping(year) = 1 AND grouping(month) = 1 AND grouping(week) = 1 THEN 'country' WHEN grouping(source) = 0 THEN 'year_source'
    WHEN grouping(month) = 0 THEN 'month' WHEN grouping(week) = 0 THEN 'week' ELSE 'year' END AS level,
  country, year, month, week, source AS source_uri, count(*) AS total_articles
FROM corpus GROUP BY GROUPING SETS ((country), (country, year), (country, month), (country, week), (country, year, source))
""")
def denominators(spark: SparkSession, d: str) -> DataFrame:
    """Article counts at five levels in one pass."""
    x = B.corpus_articles(spark, d).drop("source_uri").withColumnRenamed("source", "source_uri")
    return corpus.denominators(x)


@query(f"WITH {B.CORPUS} SELECT country, count(*) AS total_articles FROM corpus WHERE month IS NOT NULL GROUP BY country")
def country_totals(spark: SparkSession, d: str) -> DataFrame:
    """Articles of each country, from whichever table of counts there is: here only that by month."""
    x = B.corpus_articles(spark, d).groupBy("country", "month").agg(F.count("*").alias("n"))
    return tables.country_totals({"summary": None, "month": x})


@query(f"""
WITH {B.CORPUS},
r AS (SELECT {S.country('country')} AS country, count(*) AS raw_rows FROM raw_news GROUP BY 1),
e AS (SELECT country, count(*) AS n FROM articles GROUP BY 1), k AS (SELECT country, count(*) AS n FROM corpus GROUP BY 1)
SELECT country, raw_rows, coalesce(e.n, 0) AS eligible_rows, coalesce(k.n, 0) AS kept_rows,
  raw_rows - coalesce(e.n, 0) AS removed_ineligible, coalesce(e.n, 0) - coalesce(k.n, 0) AS removed_duplicates
FROM r LEFT JOIN e USING (country) LEFT JOIN k USING (country)
""")
def corpus_audit(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each country at each step of building the corpus."""
    raw = table(spark, d, "raw_news").select(N.country("country").alias("country"))
    a = B.articles(spark, d)
    return corpus.audit(raw, a, corpus.deduplicate(a))


@query("""
SELECT lower(trim(coalesce(isDuplicate, ''))) AS flag, lower(trim(coalesce(isDuplicate, ''))) IN ('true', '1', 'yes') AS flagged, count(*) AS n_rows
FROM raw_news GROUP BY 1, 2
""")
def duplicate_flags(spark: SparkSession, d: str) -> DataFrame:
    """Spellings of the duplicate flag and what they mean."""
    x = table(spark, d, "raw_news").select(F.lower(F.trim(F.coalesce("isDuplicate", F.lit("")))).alias("flag"), corpus.flagged(F.col("isDuplicate")).alias("flagged"))
    return x.groupBy("flag", "flagged").agg(F.count("*").alias("n_rows"))


@query(f"""
SELECT doc_id, sha256({S.collapse('text')}) AS content_hash, sha256({S.plain('text')}) AS text_hash,
  CASE WHEN {S.plain(S.identifier('text'))} = '' THEN '' ELSE sha256({S.plain(S.identifier('text'))}) END AS overlap_hash,
  sha256({S.strip('text')}) AS stripped_hash, CAST({S.word_count('text')} AS INTEGER) AS word_count,
  sha256(array_to_string(string_split({S.plain('text')}, ' ')[1:20], ' ')) AS prefix_hash
FROM documents
""")
def normal_forms(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of the normal forms of every document."""
    return table(spark, d, "documents").select(
        "doc_id", T.content_hash("text").alias("content_hash"), T.text_hash("text").alias("text_hash"), T.overlap_hash("text").alias("overlap_hash"),
        T.stripped_hash("text").alias("stripped_hash"), T.word_count("text").alias("word_count"), T.prefix_hash("text", 20).alias("prefix_hash"),
    )


@query()
def compatible_text(spark: SparkSession, d: str) -> DataFrame:
    """Compatibility form and full case folding of every document."""
    return table(spark, d, "documents").select("doc_id", T.compatible("text").alias("clean"), F.sha2(T.casefold(T.collapse("text")), 256).alias("folded_hash"))


@query(f"SELECT row_seq, {S.country('country')} AS country, {S.source(chr(34) + 'source.uri' + chr(34))} AS source, {S.identifier('uri')} AS uri FROM raw_news")
def normal_names(spark: SparkSession, d: str) -> DataFrame:
    """Countries, outlets and uris in one spelling (hosts in the form they are written in)."""
    return table(spark, d, "raw_news").select("row_seq", N.country("country").alias("country"), N.source(corpus.col("source.uri")).alias("source"), T.identifier("uri").alias("uri"))


@query()
def normal_names_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The same with punycode decoded."""
    return table(spark, d, "raw_news").select("row_seq", N.source(corpus.col("source.uri"), decode=True).alias("source"))


@query(f"""
SELECT row_seq, substr(coalesce({_LINES}[1], ''), 1, 300) AS title,
  CASE WHEN len({_LINES}) > 1 THEN array_to_string({_LINES}[2:], chr(10)) ELSE trim(coalesce(article_text, '')) END AS body,
  array_to_string(list_filter(string_split({S.collapse('article_text')}, ' '), lambda x: x <> '')[1:12], ' ') AS summary,
  CASE WHEN length({S.collapse('article_text')}) > 80 THEN rtrim(substr({S.collapse('article_text')}, 1, 79)) || '…' ELSE {S.collapse('article_text')} END AS excerpt,
  'passage: ' || {S.collapse('article_text')} AS passage
FROM cleaned_articles
""")
def title_and_body(spark: SparkSession, d: str) -> DataFrame:
    """Title, body, summary, excerpt and model input of every article."""
    title, body = T.title_body("article_text")
    return table(spark, d, "cleaned_articles").select(
        "row_seq", title.alias("title"), body.alias("body"), T.first_words("article_text", 12).alias("summary"), T.excerpt("article_text", 80).alias("excerpt"),
        F.concat(F.lit("passage: "), T.collapse("article_text")).alias("passage"),
    )


_DECIDED = f"""
decided AS (
  SELECT {S.country('country')} AS country, {S.source('source_clean')} AS source, bool_and(upper(trim(coalesce(conventional_journalism, ''))) <> 'NO') AS include,
    array_to_string(list_sort(list(DISTINCT upper(trim(coalesce(conventional_journalism, ''))))), ';') AS decision
  FROM source_decisions GROUP BY 1, 2)"""
_SCREENED = f"""{B.CORPUS},{_DECIDED},
screened AS (
  SELECT c.row_seq, c.country, c.source AS source_key, coalesce(d.include, true) AS source_include, coalesce(d.decision, 'MISSING') AS source_decision
  FROM corpus c LEFT JOIN decided d ON d.country = {S.country('c.country')} AND d.source = c.source)"""


def _screened(spark: SparkSession, d: str) -> DataFrame:
    dec = screening.decisions(table(spark, d, "source_decisions"), decode=False)
    return screening.screen(B.corpus_articles(spark, d), dec, decode=False)


@query(f"WITH {_DECIDED} SELECT * FROM decided")
def source_decisions(spark: SparkSession, d: str) -> DataFrame:
    """One decision for each country and source; any NO excludes."""
    return screening.decisions(table(spark, d, "source_decisions"), decode=False)


@query(f"WITH {_SCREENED} SELECT * FROM screened")
def screen_articles(spark: SparkSession, d: str) -> DataFrame:
    """Every article with the decision on its source; missing ones are kept and marked."""
    return _screened(spark, d).select("row_seq", "country", "source_key", "source_include", "source_decision")


@query(f"""
WITH {_SCREENED}
SELECT country, count(*) AS rows_before, count(*) FILTER (source_include) AS rows_after, count(*) FILTER (NOT source_include) AS rows_excluded,
  round(avg(CASE WHEN source_include THEN 0.0 ELSE 1.0 END), 6) AS share_excluded, count(*) FILTER (source_decision = 'YES') AS decision_yes,
  count(*) FILTER (source_decision = 'NO') AS decision_no, count(*) FILTER (source_decision = 'MISSING') AS decision_missing
FROM screened GROUP BY country
""")
def screen_summary(spark: SparkSession, d: str) -> DataFrame:
    """What the screen removes in each country."""
    return screening.summary(_screened(spark, d), ["country"], ["YES", "NO", "MISSING"])


_KINDS = ["YES", "NO", "NO;YES", "REVIEW", "MISSING"]


@query(f"""
WITH {_SCREENED}
SELECT country, {', '.join(f"count(*) FILTER (source_decision = '{k}') AS \"{k}\"" for k in _KINDS)} FROM screened GROUP BY country
""")
def screen_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Articles of each country by the decision on their source, wide."""
    return screening.wide(_screened(spark, d), ["country"], _KINDS)


@query(f"""
WITH {_SCREENED},
n AS (SELECT country, source_key, count(*) AS n_rows, bool_and(source_decision = 'MISSING') AS m FROM screened GROUP BY 1, 2),
s AS (SELECT *, round(n_rows / sum(n_rows) OVER (PARTITION BY country), 6) AS share_of_country FROM n)
SELECT country, source_key, n_rows, share_of_country, CAST(row_number() OVER (PARTITION BY country ORDER BY n_rows DESC, source_key) AS INTEGER) AS rank FROM s WHERE m
""")
def unreviewed_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources without a decision by country."""
    return screening.unreviewed(_screened(spark, d))


@query(f"WITH {B.SILVER} SELECT silver_row_id, country, uri, y, round(confidence, 6) AS confidence, text_hash FROM silver_rows")
def silver_labels(spark: SparkSession, d: str) -> DataFrame:
    """Model labels: last good attempt of each row, mapped to classes."""
    return B.silver(spark, d).select("silver_row_id", "country", "uri", "y", F.round("confidence", 6).alias("confidence"), "text_hash")


@query(f"""
WITH {B.SILVER}, k AS (SELECT *, row_number() OVER (PARTITION BY text_hash ORDER BY silver_row_id DESC) AS n FROM silver_rows WHERE text_hash <> '')
SELECT silver_row_id, country, y, text_hash FROM k WHERE n = 1
""")
def silver_pool(spark: SparkSession, d: str) -> DataFrame:
    """Labelled rows pooled, keep-last by text."""
    return records.keep_last(B.silver(spark, d).where("text_hash <> ''"), ["text_hash"], ["silver_row_id"]).select("silver_row_id", "country", "y", "text_hash")


@query(f"""
WITH {B.BENCH},
r AS (SELECT silver_row_id AS row_id, 'United_Kingdom' AS country, {S.identifier('uri')} AS uri, {S.label_class('llm_label_suggestion')} AS y, article_text FROM silver),
x AS (SELECT bench_row_id AS row_id, country, uri, y, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS body, 0 AS new FROM bench UNION ALL
  SELECT row_id, country, uri, y, substr(coalesce({_LINES}[1], ''), 1, 300), CASE WHEN len({_LINES}) > 1 THEN array_to_string({_LINES}[2:], chr(10)) ELSE trim(coalesce(article_text, '')) END, 1 FROM r WHERE y IS NOT NULL)
SELECT row_id, country, uri, y, title, sha256(body) AS body_sha FROM x QUALIFY uri = '' OR row_number() OVER (PARTITION BY uri ORDER BY new, row_id) = 1
""")
def benchmark_appended(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark rows with the labelled rows of a review below them, the first of each uri."""
    b = B.bench(spark, d).select(F.col("bench_row_id").alias("row_id"), "country", "uri", "y")
    # of a row that was tried twice both attempts have the same text and uri
    r = table(spark, d, "silver").select(F.col("silver_row_id").alias("row_id"), T.identifier("uri").alias("uri"), F.col("llm_label_suggestion").alias("y"), "article_text")
    x = review.append_reviewed(b, r, "row_id", "uri", "y", N.LABELS, "article_text", {"country": "United_Kingdom"})
    return x.select("row_id", "country", "uri", "y", "title", F.sha2("body", 256).alias("body_sha"))


@query(f"""
WITH p AS (SELECT row_seq, regexp_replace(regexp_replace(replace({S.collapse('country')}, '_', ' '), '(?:[ ]*(?:\\([^)]*\\)|\\[[^\\]]*\\]|[0-9]+|[*†]))+[ ]*$', ''), '^[ *†:–—-]+|[ *†:–—-]+$', '', 'g') AS p FROM raw_news),
q AS (SELECT row_seq, CASE p {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in N.PLACES.items())} ELSE p END AS place FROM p)
SELECT row_seq, place, length(place) >= 3 AND NOT regexp_matches(place, '(?i)[:@<>]|www[.]|http|fax|phone') AND regexp_matches(place, '[A-Za-z]') AS is_place FROM q
""")
def place_names(spark: SparkSession, d: str) -> DataFrame:
    """Countries as a count table would name them, and whether a cell can be one."""
    return table(spark, d, "raw_news").select("row_seq", N.place("country").alias("place"), N.is_place("country").alias("is_place"))


@query(f"""
WITH {B.BENCH}, k AS (SELECT *, row_number() OVER (PARTITION BY nullif(uri, '') ORDER BY CASE human_validation_source WHEN 'original_human_validation' THEN 0 ELSE 1 END, bench_row_id) AS n FROM bench WHERE y IS NOT NULL AND text_hash <> '')
SELECT bench_row_id, country, uri, y FROM k WHERE n = 1
""")
def benchmark_union(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark rows keep-first by uri, the original sample before the supplements; rows without a uri count as one."""
    b = B.bench(spark, d).where("y is not null and text_hash <> ''").withColumns({"k": F.nullif("uri", F.lit("")), "p": (F.col("human_validation_source") != "original_human_validation").cast("int")})
    return corpus.keep_first(b, ["k"], ["p", "bench_row_id"]).select("bench_row_id", "country", "uri", "y")


@query("""
WITH a AS (SELECT *, row_number() OVER (PARTITION BY silver_row_id ORDER BY CASE WHEN coalesce(trim(llm_error), '') = '' THEN 1 ELSE 0 END DESC, coalesce(llm_label_suggestion, '') DESC, coalesce(llm_confidence, -1.0) DESC) AS n FROM silver)
SELECT silver_row_id, coalesce(llm_label_suggestion, '') AS label, coalesce(trim(llm_error), '') AS error FROM a WHERE n = 1
""")
def checkpoint_last(spark: SparkSession, d: str) -> DataFrame:
    """The attempt of each row that a checkpoint keeps."""
    s = table(spark, d, "silver").withColumns({"label": F.coalesce("llm_label_suggestion", F.lit("")), "error": F.coalesce(F.trim("llm_error"), F.lit("")), "ok": (F.coalesce(F.trim("llm_error"), F.lit("")) == "").cast("int"), "c": F.coalesce("llm_confidence", F.lit(-1.0))})
    return records.keep_last(s, ["silver_row_id"], ["ok", "label", "c"]).select("silver_row_id", "label", "error")


@query("""
WITH done AS (SELECT DISTINCT silver_row_id, input_text_sha256 FROM silver WHERE coalesce(trim(llm_error), '') = '')
SELECT DISTINCT s.silver_row_id, s.input_text_sha256 FROM silver s ANTI JOIN done d ON s.silver_row_id = d.silver_row_id AND s.input_text_sha256 = d.input_text_sha256
""")
def pending_labels(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a resumed run still has to label."""
    s = table(spark, d, "silver")
    return records.pending(s.select("silver_row_id", "input_text_sha256"), s, ["silver_row_id", "input_text_sha256"], "llm_error").distinct()


@query("""
SELECT row_seq, 'first' AS only_in FROM raw_news WHERE row_seq NOT IN (SELECT row_seq FROM cleaned_articles)
UNION ALL SELECT row_seq, 'second' FROM cleaned_articles WHERE row_seq NOT IN (SELECT row_seq FROM raw_news)
""")
def key_difference(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the raw table that cleaning left out, and the other way round."""
    return records.difference(table(spark, d, "raw_news"), table(spark, d, "cleaned_articles"), "row_seq")


@query(f"""
WITH k AS (SELECT country, {S.identifier('uri')} AS uri FROM human_benchmark_split)
SELECT country, count(DISTINCT uri) AS n_ids, sha256(array_to_string(list_sort(list(DISTINCT uri)), chr(10))) AS ids_sha256 FROM k GROUP BY country
""")
def id_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Hash of the sorted distinct uris of the benchmark by country."""
    return records.id_fingerprint(table(spark, d, "human_benchmark_split").select("country", T.identifier("uri").alias("uri")), "uri", ["country"])


@query(f"""
WITH r AS (SELECT sha256(concat_ws(chr(31), {', '.join(f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in ("row_seq", "uri", "country", "article_text"))})) AS h FROM cleaned_articles)
SELECT count(*) AS n_rows, sha256(concat_ws(',', {', '.join(f"coalesce(CAST(sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT)) AS VARCHAR), '0')" for i in range(4))})) AS fingerprint FROM r
""")
def table_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """A fingerprint of all articles that doesn't depend on their order."""
    return records.fingerprint(table(spark, d, "cleaned_articles"), ["row_seq", "uri", "country", "article_text"])


@query(f"""
WITH k AS (SELECT {S.strip('uri')} AS k, count(*) AS n FROM cleaned_articles GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(coalesce(sum(n) FILTER (k = ''), 0) AS BIGINT) AS blank, count(*) FILTER (k <> '') AS distinct_keys, CAST(coalesce(sum(n - 1) FILTER (k <> ''), 0) AS BIGINT) AS repeated FROM k
""")
def key_checks(spark: SparkSession, d: str) -> DataFrame:
    """Whether uris could serve as a key."""
    x = table(spark, d, "cleaned_articles").select(F.regexp_replace(F.coalesce("uri", F.lit("")), f"^[{T.SPACE}]+|[{T.SPACE}]+$", "").alias("uri"))
    return records.key_checks(x, "uri")


@query(f"""
WITH {B.SILVER}
SELECT country, count(*) AS n_rows, count(*) FILTER (y = 1) AS positives, count(*) FILTER (confidence IS NULL OR confidence < 0 OR confidence > 1) AS bad_probability,
  0::BIGINT AS bad_prediction, count(*) FILTER (CASE WHEN confidence >= 0.6 THEN 1 ELSE 0 END <> y AND confidence IS NOT NULL) AS off_threshold
FROM silver_rows GROUP BY country
""")
def verify_scores(spark: SparkSession, d: str) -> DataFrame:
    """Checks of a scored table by country."""
    return records.verify_scores(B.silver(spark, d), "confidence", "y", 0.6, "country")


@query(f"""
WITH {B.CORPUS}, {B.SILVER}
SELECT (SELECT count(*) FROM raw_news) AS raw_rows, (SELECT count(*) FROM articles) AS cleaned_rows, (SELECT count(*) FROM corpus) AS corpus_rows,
  (SELECT count(*) FROM silver_rows) AS labelled_rows, (SELECT count(*) FROM silver_rows WHERE y = 1) AS positive_rows
""")
def pipeline_funnel(spark: SparkSession, d: str) -> DataFrame:
    """Rows at each stage of the pipeline, as one row; steps are counted apart and joined on a constant."""
    one = lambda df, *c: df.agg(*c).withColumn("__k", F.lit(1))
    n = lambda x: F.count("*").alias(x)
    a = B.articles(spark, d)
    j = one(table(spark, d, "raw_news"), n("raw_rows")).join(one(a, n("cleaned_rows")), "__k").join(one(corpus.deduplicate(a), n("corpus_rows")), "__k")
    return j.join(one(B.silver(spark, d), n("labelled_rows"), F.count_if(F.col("y") == 1).alias("positive_rows")), "__k").drop("__k")


@query("""
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) IS NOT NULL AS valid FROM events
""")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    """A field of JSON text, read leniently: from the first brace to the last, control characters allowed."""
    x = F.from_json(F.regexp_extract("props", r"(?s)\{.*\}", 0), "k bigint", {"allowUnquotedControlChars": "true"})
    return table(spark, d, "events").select("event_id", x["k"].alias("k"), x["k"].isNotNull().alias("valid"))
