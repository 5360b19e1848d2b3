"""Weighted topic shares, lift, specificity, term weights and example rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 9


def shares(df: DataFrame, parent: list[str], label: str, weight: str) -> DataFrame:
    """Weighted share of each label within its parent group (all rows if there is none)."""
    g = df.groupBy(*parent, label).agg(F.count("*").alias("n_rows"), F.sum(weight).alias("w"))
    return g.withColumn("share", F.round(F.try_divide(F.col("w"), F.sum("w").over(Window.partitionBy(*parent))), DIGITS))


def lift(df: DataFrame, group: str, label: str, weight: str, floor: float = 0.005) -> DataFrame:
    """Share of a label in a group over its overall share, and log2 of that; labels below `floor` overall are left out."""
    g = df.groupBy(group, label).agg(F.sum(weight).alias("w"))
    total = F.sum("w").over(Window.partitionBy())
    g = g.withColumns({"s": F.try_divide(F.col("w"), F.sum("w").over(Window.partitionBy(group))), "o": F.sum("w").over(Window.partitionBy(label)) / total})
    g = g.where(F.col("o") >= floor).withColumn("l", F.try_divide("s", "o"))
    return g.select(group, label, F.round("s", DIGITS).alias("share"), F.round("o", DIGITS).alias("overall"), F.round("l", DIGITS).alias("lift"), F.round(F.log2(F.nullif("l", F.lit(0.0))), DIGITS).alias("log2_lift"))


def leaders(shared: DataFrame, label: str, member: str, k: int = 3) -> DataFrame:
    """The k members of largest weight of each label as one text: 'FR (40.0%); IT (30.0%)'."""
    of = F.try_divide(F.col("w"), F.sum("w").over(Window.partitionBy(label)))
    x = shared.withColumn("p", of).withColumn("rank", F.row_number().over(Window.partitionBy(label).orderBy(F.desc("p"), member))).where(F.col("rank") <= k)
    part = F.struct("rank", F.concat(F.col(member), F.lit(" ("), F.format_string("%.1f", F.round(F.col("p") * 100, 1)), F.lit("%)")).alias("t"))
    return x.groupBy(label).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda y: y["t"]), "; ").alias("leaders"))


def specificity(shared: DataFrame, label: str, least: float = 0.05) -> DataFrame:
    """Largest share of a label over the groups and the number of groups with a share of at least `least`."""
    return shared.groupBy(label).agg(F.max("share").alias("max_share"), F.count_if(F.col("share") >= least).alias("groups_common"), F.count("*").alias("groups"))


def frequent_values(df: DataFrame, group: str, value: str, n: int = 3) -> DataFrame:
    """The n most frequent values of each group, joined; the smaller value wins a tie."""
    g = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    g = g.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("c"), value))).where(F.col("rank") <= n)
    return g.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(value).cast("string").alias("v")))), lambda y: y["v"]), "; ").alias("frequent"))


def round_robin(df: DataFrame, label: str, member: str, k: int, order: str) -> DataFrame:
    """k example rows of each label, taking the members in turn."""
    turn = F.row_number().over(Window.partitionBy(label, member).orderBy(order))
    x = df.withColumn("turn", turn).where(F.col("turn") <= k)
    x = x.withColumn("place", F.row_number().over(Window.partitionBy(label).orderBy("turn", member)))
    return x.where(F.col("place") <= k)


def class_tfidf(df: DataFrame, label: str, tokens: str, k: int = 10) -> DataFrame:
    """The k terms (words and word pairs) of the highest class-based tf-idf of each label: tf * ln(1 + A / f), A the mean number of terms of a label."""
    two = F.zip_with(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    t = df.select(label, F.explode(F.concat(F.col(tokens), F.when(F.size(tokens) > 1, two).otherwise(F.array().cast("array<string>")))).alias("term"))
    n = t.groupBy(label, "term").agg(F.count("*").alias("tf"))
    n = n.withColumn("f", F.sum("tf").over(Window.partitionBy("term")))
    mean = t.groupBy(label).agg(F.count("*").alias("size")).agg(F.avg("size")).scalar()
    s = n.withColumn("score", F.round(F.col("tf") * F.log1p(mean / F.col("f")), 6))
    s = s.withColumn("rank", F.row_number().over(Window.partitionBy(label).orderBy(F.desc("score"), "term")))
    return s.where(F.col("rank") <= k).select(label, "rank", "term", "tf", "score")


#: Bounds of an adequate model.
BOUNDS = {"topics": (4, 12), "outlier_share": (None, 0.45), "largest_share": (None, 0.40), "country_nmi": (None, 0.25), "common_share": (0.35, None)}


def adequate(candidates: DataFrame) -> DataFrame:
    """Whether each candidate model is within all bounds; a NULL or NaN is not."""
    ok = F.lit(True)
    for c, (low, high) in BOUNDS.items():
        x = F.col(c).cast("double")
        ok = ok & x.isNotNull() & ~F.isnan(x)
        ok = ok & (x >= low) if low is not None else ok
        ok = ok & (x <= high) if high is not None else ok
    return candidates.withColumn("adequate", F.coalesce(ok, F.lit(False)))


def diagnostics(df: DataFrame, topic: str, outlier: int = -1) -> DataFrame:
    """Number of topics, share of outliers and share of the largest topic among the others."""
    n = df.groupBy(topic).agg(F.count("*").alias("n"))
    t = F.col(topic)
    inl = F.sum(F.when(t != outlier, F.col("n")).otherwise(0))
    return n.agg(
        F.count_if(t != outlier).alias("topics"),
        F.round(F.sum(F.when(t == outlier, F.col("n")).otherwise(0)) / F.sum("n"), DIGITS).alias("outlier_share"),
        F.round(F.try_divide(F.max(F.when(t != outlier, F.col("n")).otherwise(0)), inl), DIGITS).alias("largest_share"),
    )


def select_model(candidates: DataFrame) -> DataFrame:
    """The best adequate candidate: most stable, then most persistent, then most valid, then fewest outliers, then the smallest number."""
    a = adequate(candidates).where("adequate")
    return a.orderBy(F.desc("mean_ari"), F.desc("persistence"), F.desc("validity"), "outlier_share", "candidate").limit(1)


def override(labels: DataFrame, corrected: DataFrame, key: str) -> DataFrame:
    """Labels replaced by reviewed ones. The reviewed table must name exactly the keys of the other and the label that it found there; else the result is an error when it is read."""
    j = labels.withColumn("__l", F.lit(True)).join(corrected.withColumn("__c", F.lit(True)), key, "full")
    whole = F.assert_true(F.col("__l") & F.col("__c"), "the reviewed keys are not those of the labels")
    same = F.assert_true(F.col("expected") == F.col("label"), "a label is not the one that was reviewed")
    return j.where(whole.isNull() & same.isNull()).select(key, F.col("label").alias("model_label"), F.coalesce(F.nullif(F.trim("corrected"), F.lit("")), F.col("label")).alias("label"))


def heatmap(shared: DataFrame, group: str, label: str, labels: list) -> DataFrame:
    """Shares wide: a row for each group, a column for each label, 0 where there is none."""
    p = shared.groupBy(group).pivot(label, labels).agg(F.first("share"))
    return p.select(group, *[F.coalesce(F.col(f"`{x}`"), F.lit(0.0)).alias(f"share_{x}") for x in labels])
