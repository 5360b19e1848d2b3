"""Agreement and classification quality, from counts: one aggregation over the rows, arithmetic on the counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 9


def _r(c: Column, name: str) -> Column:
    return F.round(F.coalesce(c, F.lit(0.0)), DIGITS).alias(name)


def binary(df: DataFrame, truth: str, predicted: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Counts, accuracy, precision, recall and F1 of either class, macro and weighted F1, by group; 0 where a ratio has no denominator. Rows with a NULL on either side are left out."""
    t, p = F.col(truth), F.col(predicted)
    n = df.where(t.isNotNull() & p.isNotNull()).groupBy(*by).agg(
        F.count_if((t == 1) & (p == 1)).alias("tp"),
        F.count_if((t == 0) & (p == 0)).alias("tn"),
        F.count_if((t == 0) & (p == 1)).alias("fp"),
        F.count_if((t == 1) & (p == 0)).alias("fn"),
    )
    return scores(n, by)


def scores(n: DataFrame, by: list[str]) -> DataFrame:
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    total = tp + tn + fp + fn
    div = F.try_divide
    f1 = F.coalesce(div(2 * tp, 2 * tp + fp + fn), F.lit(0.0))
    f0 = F.coalesce(div(2 * tn, 2 * tn + fp + fn), F.lit(0.0))
    return n.select(
        *by, "tp", "tn", "fp", "fn",
        _r(div(tp + tn, total), "accuracy"),
        _r(div(tn, tn + fn), "no_precision"), _r(div(tn, tn + fp), "no_recall"), _r(f0, "no_f1"),
        _r(div(tp, tp + fp), "yes_precision"), _r(div(tp, tp + fn), "yes_recall"), _r(f1, "yes_f1"),
        _r((f0 + f1) / 2, "macro_f1"),
        _r(div(f0 * (tn + fp) + f1 * (tp + fn), total), "weighted_f1"),
        _r(div(tp + fp, total), "predicted_positive_rate"),
        (F.col("tp") + F.col("fn")).alias("support"),
    )


def sweep(df: DataFrame, truth: str, probability: str, thresholds: list[float]) -> DataFrame:
    """`binary` at each threshold in one pass: rows are counted by the number of thresholds that they reach, then counts are expanded."""
    steps = sorted(thresholds)
    reached = F.array_size(F.filter(F.array(*map(F.lit, steps)), lambda t: F.col(probability) >= t))
    n = df.where(F.col(truth).isNotNull() & F.col(probability).isNotNull()).groupBy(F.col(truth).alias("t"), reached.alias("k")).agg(F.count("*").alias("n"))
    e = n.select("t", "k", "n", F.posexplode(F.array(*map(F.lit, steps))).alias("i", "threshold"))
    pos = F.col("k") > F.col("i")
    at = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    g = e.groupBy("threshold").agg(at((F.col("t") == 1) & pos).alias("tp"), at((F.col("t") == 0) & ~pos).alias("tn"), at((F.col("t") == 0) & pos).alias("fp"), at((F.col("t") == 1) & ~pos).alias("fn"))
    return scores(g, ["threshold"])


def best_threshold(swept: DataFrame, order: list[str] = ["yes_f1", "yes_recall", "yes_precision", "accuracy"]) -> DataFrame:  # noqa: B006
    """The one threshold of the best scores in order; the lower threshold wins a tie."""
    return swept.orderBy(*[F.desc(c) for c in order], "threshold").limit(1)


def confusion(df: DataFrame, a: str, b: str, weight: str | None = None, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Number of rows, or sum of weights, for each pair of labels; rows with a NULL label are left out."""
    n = F.sum(weight) if weight else F.count("*").cast("double")
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(n.alias("n"))


def agreement(table: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Agreement, Cohen's kappa, macro and weighted F1 from a confusion table (a is the truth); kappa is NULL where chance agreement is 1."""
    w = Window.partitionBy(*by)
    t = table.withColumns({"ra": F.sum("n").over(Window.partitionBy(*by, "a")), "total": F.sum("n").over(w)})
    rows = t.groupBy(*by, F.col("a").alias("label")).agg(F.sum("n").alias("ra"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0.0)).alias("hit"))
    cols = table.groupBy(*by, F.col("b").alias("label")).agg(F.sum("n").alias("cb"))
    labels = rows.join(cols, [*by, "label"], "full").fillna(0.0, ["ra", "hit", "cb"])
    f = F.coalesce(F.try_divide(2 * F.col("hit"), F.col("ra") + F.col("cb")), F.lit(0.0))
    g = labels.groupBy(*by).agg(
        F.sum("ra").alias("total"), F.sum("hit").alias("hits"), F.sum(F.col("ra") * F.col("cb")).alias("chance"), F.avg(f).alias("macro"), F.sum(f * F.col("ra")).alias("weighted"), F.count("*").alias("labels")
    )
    po, pe = F.col("hits") / F.col("total"), F.col("chance") / (F.col("total") * F.col("total"))
    return g.select(
        *by, "labels", F.round("total", 6).alias("total"), F.round(po, DIGITS).alias("agreement"), F.round(F.when(pe < 1, (po - pe) / (1 - pe)), DIGITS).alias("kappa"),
        F.round("macro", DIGITS).alias("macro_f1"), F.round(F.col("weighted") / F.col("total"), DIGITS).alias("weighted_f1"),
    )


def disagreements(df: DataFrame, id_col: str, a: str, b: str) -> DataFrame:
    """Rows whose labels differ, the kind of difference, and empty columns for adjudication."""
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    return x.select(id_col, F.col(a).alias("first"), F.col(b).alias("second"), F.concat_ws("->", F.col(a).cast("string"), F.col(b).cast("string")).alias("kind"), F.lit("").alias("adjudicated"), F.lit("").alias("comment"))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """Normalised mutual information (arithmetic mean of the entropies) of two labelings; 0 if both are constant."""
    n = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    w = Window.partitionBy()
    t = n.withColumns({"na": F.sum("n").over(Window.partitionBy("a")), "nb": F.sum("n").over(Window.partitionBy("b")), "t": F.sum("n").over(w)})
    mi = F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb"))))
    ha, hb = -F.sum(F.col("n") / F.col("t") * F.log(F.col("na") / F.col("t"))), -F.sum(F.col("n") / F.col("t") * F.log(F.col("nb") / F.col("t")))
    g = t.agg(mi.alias("mi"), ha.alias("ha"), hb.alias("hb"), F.sum("n").cast("long").alias("rows"))
    return g.select("rows", F.round(F.coalesce(F.try_divide(2 * F.col("mi"), F.col("ha") + F.col("hb")), F.lit(0.0)), 8).alias("nmi"))


def rand_index(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings; 1 if both put every row alike."""
    n = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    two = lambda c: c * (c - 1) / 2
    cells = n.agg(F.sum(two(F.col("n"))).alias("s"), F.sum("n").alias("t"))
    ra = n.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("sa"))
    rb = n.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("sb"))
    one = lambda d: d.withColumn("__k", F.lit(1))
    j = one(cells).join(one(ra), "__k").join(one(rb), "__k")
    expected = F.try_divide(F.col("sa") * F.col("sb"), two(F.col("t")))
    top = (F.col("sa") + F.col("sb")) / 2
    return j.select(F.col("t").cast("long").alias("rows"), F.round(F.coalesce(F.try_divide(F.col("s") - expected, top - expected), F.lit(1.0)), 8).alias("ari"))
