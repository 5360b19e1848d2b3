"""Relative attention: counts of positive articles over all news, by country and period, and what is derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.names import COUNTRY_ORDER

DIGITS = 9
#: Periods of a report, at most.
MOST_PERIODS = 10_000


def coverage(df: DataFrame) -> DataFrame:
    """(country, week, total): one row per country and week; rows without a country, week or a positive total are left out, repeated rows count once."""
    x = df.select("country", F.date_trunc("week", "week").alias("week"), F.col("total_news_articles").cast("long").alias("total")).where("country is not null and week is not null and total > 0")
    return x.distinct().groupBy("country", "week").agg(F.sum("total").alias("total"))


def weekly(articles: DataFrame) -> DataFrame:
    return articles.where("week is not null").groupBy("country", "week").agg(F.count("*").alias("positives"))


def roll_up(weeks: DataFrame, unit: str, value: str) -> DataFrame:
    """Weeks to the month or year that their Monday is in, so that both sides bin alike."""
    return weeks.groupBy("country", F.date_trunc(unit, "week").alias(unit)).agg(F.sum(value).alias(value))


def relative(totals: DataFrame, positives: DataFrame, period: str) -> DataFrame:
    """Left join from the totals: periods without positives are 0, positives without a total are dropped."""
    j = totals.join(positives, ["country", period], "left").fillna(0, ["positives"])
    return j.withColumn("attention", F.round(F.try_divide("positives", "total"), DIGITS))


def series(attention: DataFrame, period: str, window: int = 3) -> DataFrame:
    """Rolling mean over `window` periods and its index, 100 being the country's mean."""
    w = Window.partitionBy("country").orderBy(period).rowsBetween(1 - window, 0)
    a = F.try_divide(F.col("positives").cast("double"), F.col("total"))
    rolled = attention.withColumn("r", F.avg(a).over(w)).withColumn("m", F.avg(a).over(Window.partitionBy("country")))
    return rolled.select("country", period, "positives", "total", "attention", F.round("r", DIGITS).alias("rolling"), F.round(F.try_divide("r", "m") * 100, 6).alias("index"))


def overall(attention: DataFrame, period: str) -> DataFrame:
    """All countries together, by period."""
    g = attention.groupBy(period).agg(F.sum("total").alias("total"), F.sum("positives").alias("positives"), F.countDistinct("country").alias("countries"))
    return g.withColumn("attention_pct", F.round(F.try_divide(F.col("positives") * 100, F.col("total")), DIGITS))


def by_country(attention: DataFrame) -> DataFrame:
    """Totals by country, its share of all positives, and a row 'ALL'."""
    g = attention.rollup("country").agg(F.sum("total").alias("total"), F.sum("positives").alias("positives"), F.grouping("country").alias("g"))
    g = g.withColumn("country", F.when(F.col("g") == 1, "ALL").otherwise(F.col("country")))
    share = F.try_divide("positives", F.sum(F.when(F.col("g") == 0, F.col("positives"))).over(Window.partitionBy()))
    return g.select("country", "total", "positives", F.round(F.try_divide("positives", "total"), DIGITS).alias("attention"), F.round(share, DIGITS).alias("share_of_positives"))


def peaks(attention: DataFrame, period: str, k: int = 3) -> DataFrame:
    """The k periods of most attention in each country; the earlier period wins a tie."""
    w = Window.partitionBy("country").orderBy(F.desc("attention"), period)
    return attention.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("country", "rank", period, "positives", "total", "attention")


def matrix(attention: DataFrame, period: str, periods: list) -> DataFrame:
    """Countries by periods; every country of the report has a row and every period a column, 0 where there is nothing."""
    spark = attention.sparkSession
    order = spark.createDataFrame([(c, i) for i, c in enumerate(COUNTRY_ORDER, 1)], "country string, place int")
    p = attention.groupBy("country").pivot(period, periods).agg(F.first("attention"))
    return order.join(p, "country", "left").select("country", "place", *[F.coalesce(F.col(f"`{x}`"), F.lit(0.0)).alias(f"p_{x}") for x in periods])


def complete_periods(attention: DataFrame, period: str, required: list[str]) -> DataFrame:
    """Whether each period has all required countries, and which it lacks."""
    g = attention.groupBy(period).agg(F.collect_set("country").alias("have"))
    lack = F.array_sort(F.array_except(F.array(*map(F.lit, required)), "have"))
    return g.select(period, F.size("have").alias("countries"), F.array_join(lack, ",").alias("missing"), (F.size(lack) == 0).alias("complete"))


def dense(counts: DataFrame, label: str, period: str, value: str) -> DataFrame:
    """Every label at every period that any label has; 0 where there is nothing. Periods are a report dimension, at most MOST_PERIODS; labels may be many."""
    periods = [r[0] for r in counts.select(period).distinct().limit(MOST_PERIODS + 1).collect()]
    if len(periods) > MOST_PERIODS:
        raise ValueError(f"more than {MOST_PERIODS} different values of {period}")
    kind = counts.schema[period].dataType.simpleString()
    # a few periods are exploded onto each label where it stands
    grid = counts.select(label).distinct().withColumn(period, F.explode(F.array(*[F.lit(p).cast(kind) for p in periods]) if periods else F.array().cast(f"array<{kind}>")))
    return grid.join(counts, [label, period], "left").fillna(0, [value])


def lagged(yearly: DataFrame, value: str) -> DataFrame:
    """A value and that of the year before; NULL where that year is absent (a gap is no lag)."""
    before = yearly.select("country", (F.col("year") + 1).alias("year"), F.col(value).alias(f"{value}_lag1"))
    return yearly.join(before, ["country", "year"], "left")


def sources(articles: DataFrame, source: str = "source") -> DataFrame:
    """Articles, countries, first and last year of each source, and its share of the corpus."""
    g = articles.groupBy(source).agg(F.count("*").alias("articles"), F.countDistinct("country").alias("countries"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    # the total goes to the sources, not these to one task
    return g.withColumn("share", F.round(F.col("articles") / articles.agg(F.count("*")).scalar(), DIGITS))


def country_sources(articles: DataFrame, source: str = "source") -> DataFrame:
    """Articles of each source in each country, share and rank within the country; the name breaks ties."""
    g = articles.groupBy("country", source).agg(F.count("*").alias("articles"))
    w = Window.partitionBy("country")
    return g.withColumns(
        {"share": F.round(F.col("articles") / F.sum("articles").over(w), DIGITS), "rank": F.row_number().over(w.orderBy(F.desc("articles"), source))}
    )


def concentration(ranked: DataFrame, source: str = "source") -> DataFrame:
    """Number of sources and the share of the 1, 5 and 10 largest in each country."""
    top = lambda k: F.round(F.sum(F.when(F.col("rank") <= k, F.col("articles")).otherwise(0)) / F.sum("articles"), DIGITS).alias(f"top{k}_share")
    return ranked.groupBy("country").agg(F.sum("articles").alias("articles"), F.count("*").alias("sources"), top(1), top(5), top(10))
