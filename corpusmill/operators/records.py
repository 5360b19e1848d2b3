"""Checkpoints, resuming, fingerprints and set comparisons of record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.sampling import join_groups


def upsert(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Both tables with the last row of each key: new rows after existing ones, then by `order`."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.desc("__new"), F.desc(order))
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__new")


def keep_last(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The last row of each key in an explicit order (ascending columns)."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def pending(wanted: DataFrame, done: DataFrame, keys: list[str], error: str) -> DataFrame:
    """Rows still to do: no row of the same keys (id and input hash) without an error."""
    ok = done.where(F.trim(F.coalesce(F.col(error), F.lit(""))) == "").select(*keys).distinct()
    return wanted.join(ok, keys, "left_anti")


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of one table that the other lacks, with the side that has them."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("only_in", F.lit("first")).union(y.join(x, key, "left_anti").withColumn("only_in", F.lit("second")))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Number of rows and a fingerprint of a table that doesn't depend on the order of its rows.

    Rows are hashed with SHA-256 and the hashes are added up in four parts of 60 bits, so nothing is
    gathered; equal rows count as often as they stand.
    """
    row = F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]), 256)
    part = lambda i: F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return df.agg(F.count("*").alias("n_rows"), F.sha2(F.concat_ws(",", *[F.coalesce(part(i), F.lit("0")) for i in range(4)]), 256).alias("fingerprint"))


#: Ids of a group whose joined list is hashed, at most.
MOST_IDS = 1_000_000


def id_fingerprint(df: DataFrame, key: str, by: list[str] = [], most: int = MOST_IDS) -> DataFrame:  # noqa: B006
    """SHA-256 of the sorted distinct ids of each group, joined by line ends: the hash that a manifest of a sample states.

    For sample-sized groups: one of more than `most` ids is an error when the result is read, before its ids are
    gathered. `fingerprint` has no such bound.
    """
    ids = df.where(F.col(key).isNotNull()).select(*by, F.col(key).cast("string").alias("__id")).distinct()
    n = ids.groupBy(*by).agg(F.count("*").alias("n_ids"))
    n = n.where(F.assert_true(F.col("n_ids") <= most, f"a group has more than {most} ids").isNull())
    joined = F.sha2(F.array_join(F.array_sort(F.collect_list("__id")), "\n"), 256).alias("ids_sha256")
    if not by:
        return ids.where(F.assert_true(n.select("n_ids").scalar() > 0).isNull()).agg(F.count("*").alias("n_ids"), joined)
    return join_groups(ids, n, by).groupBy(*by).agg(F.first("n_ids").alias("n_ids"), joined)


def verify_scores(df: DataFrame, probability: str, predicted: str, threshold: float, by: str) -> DataFrame:
    """Checks of a scored table by group: rows, positives, values out of range, predictions that don't follow the threshold."""
    p, y = F.col(probability), F.col(predicted)
    return df.groupBy(by).agg(
        F.count("*").alias("n_rows"),
        F.count_if(y == 1).alias("positives"),
        F.count_if(p.isNull() | F.isnan(p) | ~p.between(0, 1)).alias("bad_probability"),
        F.count_if(y.isNull() | ~y.isin(0, 1)).alias("bad_prediction"),
        F.count_if((p >= threshold).cast("int") != y).alias("off_threshold"),
    )


def key_checks(df: DataFrame, key: str) -> DataFrame:
    """Rows, blank keys, distinct keys and rows beyond the first of a key: what a one-to-one join requires to be 0."""
    x = df.select(F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    blank = F.col("k") == ""
    return x.agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(blank, F.col("n"))), F.lit(0)).alias("blank"), F.count_if(~blank).alias("distinct_keys"), F.coalesce(F.sum(F.when(~blank, F.col("n") - 1)), F.lit(0)).alias("repeated")
    )


def one_to_one(df: DataFrame, key: str, name: str) -> DataFrame:
    """The table, with an error when it is read and a key stands twice."""
    n = F.count("*").over(Window.partitionBy(key))
    ok = F.assert_true(F.col("__n") == 1, f"{name}: a key stands twice")
    return df.withColumn("__n", n).where(ok.isNull()).drop("__n")


def standard(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly the given columns, in order; those that are absent are NULL."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])
