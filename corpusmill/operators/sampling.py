"""Stratified samples, quotas, design weights and stratified splits.

Rows are drawn in the order of a hash of seed and id, so a draw is the same on any partitioning and in any
engine. Quotas are computed on tables of strata with windows; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import materialise


def draw(seed: str, id_col: str) -> Column:
    """The place of a row in the draw."""
    return F.sha2(F.concat_ws("#", F.lit(seed), F.col(id_col).cast("string")), 256)


def _order(seed: str, id_col: str) -> list[Column]:
    return [draw(seed, id_col), F.col(id_col)]


def in_place(df: DataFrame, by: list[str], id_col: str, seed: str = "s", upto: int | None = None) -> DataFrame:
    """The rows with the `__size` of their group and their `__place` in its draw, from 1; with `upto`, only those places.

    The rows of a group fall into 65,536 cells by the head of their key. A cell is ranked by itself and begins after
    the rows of those before it, so a hot group is no task's alone, and with `upto` cells that begin beyond it are
    left before anything is sorted. Groups of NULL are groups.
    """
    x = df.withColumn("__key", draw(seed, id_col))
    x = x.withColumn("__cell", F.conv(F.substring("__key", 1, 4), 16, 10).cast("int"))
    g = Window.partitionBy(*by)
    before = g.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = x.groupBy(*by, "__cell").agg(F.count("*").alias("__m"))
    cells = cells.withColumns({"__size": F.sum("__m").over(g), "__before": F.coalesce(F.sum("__m").over(before), F.lit(0))})
    if upto is not None:
        cells = cells.where(F.col("__before") < upto)
    j = join_groups(x, cells.drop("__m"), [*by, "__cell"])
    place = F.col("__before") + F.row_number().over(Window.partitionBy(*by, "__cell").orderBy("__key", id_col))
    j = j.withColumn("__place", place.cast("long")).drop("__key", "__cell", "__before")
    return j if upto is None else j.where(F.col("__place") <= upto)


def join_groups(df: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """Inner join on columns of which NULL is a value like any other."""
    right = groups.withColumnsRenamed({c: f"__r_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in by]
    return df.join(right, same).drop(*[f"__r_{c}" for c in by])


def fixed(df: DataFrame, strata: list[str], k: int, id_col: str, seed: str = "s") -> DataFrame:
    """At most k rows of each stratum, with its size, the number drawn and the design weight size / drawn."""
    n = F.least(F.col("__size"), F.lit(k).cast("long"))
    x = in_place(df, strata, id_col, seed, k).drop("__place")
    return x.withColumns({"stratum_size": F.col("__size"), "stratum_sample": n, "design_weight": F.col("__size") / n}).drop("__size")


def even_quotas(sizes: DataFrame, target: int, by: list[str], within: list[str] = []) -> DataFrame:  # noqa: B006
    """Quota of each stratum: an even base, clipped at its size; what is left over goes round in order of the strata. With `within`, `target` holds for each of those groups.

    Water filling in closed form: with strata in order of size, the level is the even share of what the
    smaller ones leave. The table of strata is far smaller than that of rows.
    """
    one = Window.partitionBy(*within)
    up = one.orderBy("n", *by)
    below = F.coalesce(F.sum("n").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = sizes.withColumns({"__rank": F.row_number().over(up), "__all": F.count("*").over(one), "__below": below})
    # this stratum is full if its size is within the even share of what is left for it and the larger ones
    share = F.floor((F.lit(target) - F.col("__below")) / (F.col("__all") - F.col("__rank") + 1))
    s = s.withColumn("__full", F.col("n") <= share)
    left = F.lit(target) - F.coalesce(F.sum(F.when(F.col("__full"), F.col("n"))).over(one), F.lit(0))
    s = s.withColumns({"__left": left, "__open": F.count_if(~F.col("__full")).over(one), "__i": F.row_number().over(Window.partitionBy(*within, "__full").orderBy(*by))})
    base = F.floor(F.col("__left") / F.greatest("__open", F.lit(1)))
    extra = (F.col("__i") <= F.col("__left") - base * F.col("__open")).cast("long")
    return s.select(*by, "n", F.when(F.col("__full"), F.col("n")).otherwise(base + extra).cast("long").alias("quota"))


def allocated(df: DataFrame, strata: list[str], target: int, id_col: str, seed: str = "s", within: list[str] = []) -> DataFrame:  # noqa: B006
    """A sample of `target` rows (of each group of `within`, some of the strata columns) spread evenly over the strata, with design weights."""
    q = even_quotas(df.groupBy(*strata).agg(F.count("*").alias("n")), target, strata, within)
    # no quota is above the target
    j = join_groups(in_place(df, strata, id_col, seed, target), q, strata).where(F.col("__place") <= F.col("quota"))
    return j.withColumn("design_weight", F.col("n") / F.col("quota")).drop("__place", "__size").withColumnsRenamed({"n": "stratum_size", "quota": "stratum_sample"})


def total_even(df: DataFrame, strata: list[str], target: int, id_col: str, seed: str = "s") -> DataFrame:
    """`target` rows, the same number of each stratum and one more of the first ones; strata that are too small are refused when the result is read."""
    n = df.groupBy(*strata).agg(F.count("*").alias("__n"))
    one = Window.partitionBy()
    k = F.count("*").over(one)
    q = n.withColumn("__quota", F.floor(F.lit(target) / k) + (F.row_number().over(one.orderBy(*strata)) <= F.lit(target) % k).cast("long"))
    ok = F.assert_true(F.col("__n") >= F.col("__quota"), "a stratum has too few rows")
    x = join_groups(in_place(df, strata, id_col, seed, target), q.where(ok.isNull()), strata)
    return x.where(F.col("__place") <= F.col("__quota")).drop("__place", "__size", "__n", "__quota")


def shuffled(df: DataFrame, id_col: str, seed: str = "s") -> DataFrame:
    """The rows in the order of the draw: a global sort by a key, not one task."""
    return df.orderBy(*_order(seed, id_col))


def placed(df: DataFrame, id_col: str, seed: str = "s") -> DataFrame:
    """The rows with their `place` in the order of the draw, from 1; only the sizes of cells meet in one task."""
    return in_place(df, [], id_col, seed).withColumnRenamed("__place", "place").drop("__size")


def without(df: DataFrame, excluded: DataFrame, country: str, uri: str, id_col: str) -> DataFrame:
    """Rows that an exclusion list doesn't name: by country and uri, or by id where the listed row has no uri."""
    by_uri = excluded.where(F.col(uri) != "").select(country, uri).distinct()
    by_id = excluded.where(F.col(uri) == "").select(id_col).distinct()
    return df.join(by_uri, [country, uri], "left_anti").join(by_id, id_col, "left_anti")


def proportional(df: DataFrame, group: list[str], strata: list[str], size: int, id_col: str, seed: str = "s") -> DataFrame:
    """For each group `size` rows, proportionally to its strata (half-even rounding, at least one each), cut at `size`."""
    g = Window.partitionBy(*group)
    n = df.groupBy(*group, *strata).agg(F.count("*").alias("__n")).withColumn("__group", F.sum("__n").over(g))
    quota = F.greatest(F.lit(1), F.bround(F.lit(size) * F.col("__n") / F.col("__group")).cast("long"))
    x = join_groups(in_place(df, [*group, *strata], id_col, seed, size), n.withColumn("__quota", quota), [*group, *strata])
    # what is left of a group are its quotas
    x = x.where(F.col("__place") <= F.col("__quota")).withColumn("__i", F.row_number().over(g.orderBy(*strata, "__place")))
    return x.where(F.col("__i") <= size).drop("__n", "__group", "__quota", "__place", "__size", "__i")


def source_capped(df: DataFrame, group: str, source: str, stratum: str, target: int, cap: int, id_col: str, seed: str = "s") -> DataFrame:
    """For each group `target` rows of which at most `cap` come from one source, spread over the strata of the source; topped up from the rest if short. `id_col` is a key."""
    by = list(dict.fromkeys([group, source, stratum]))
    # the keys alone are read again and again
    keys = materialise(df.select(id_col, *by), "keys")
    n = keys.groupBy(*by).agg(F.count("*").alias("__cell_n")).withColumn("__source_n", F.sum("__cell_n").over(Window.partitionBy(group, source)))
    take = F.least(F.lit(cap), F.col("__source_n"))
    n = n.withColumns({"__take": take, "__quota": F.greatest(F.lit(1), F.bround(take * F.col("__cell_n") / F.col("__source_n")).cast("long"))})
    x = join_groups(in_place(keys, by, id_col, seed, cap), n, by).where(F.col("__place") <= F.col("__quota"))
    i = F.row_number().over(Window.partitionBy(group, source).orderBy(stratum, "__place"))
    first = x.withColumn("__i", i).where(F.col("__i") <= F.col("__take")).select(id_col, group)
    # first choice before the rest, each in the order of the draw
    had = in_place(first, [group], id_col, seed + "+", target)
    short = first.groupBy(group).agg(F.count("*").alias("__had")).where(F.col("__had") < target)
    others = join_groups(keys.select(id_col, group).join(first.select(id_col), id_col, "left_anti"), short, [group])
    rest = in_place(others, [group], id_col, seed + "+", target).where(F.col("__place") + F.col("__had") <= target)
    chosen = had.select(id_col, F.lit(False).alias("topped_up")).union(rest.select(id_col, F.lit(True).alias("topped_up")))
    return df.join(chosen, id_col).select(*df.columns, "topped_up")


def band(probability: Column | str, threshold: float) -> Column:
    """How far a probability is above a threshold: near_threshold, medium, high; NULL below it."""
    p = F.col(probability) if isinstance(probability, str) else probability
    return F.when(p < threshold, None).when(p < threshold + 0.10, "near_threshold").when(p < threshold + 0.25, "medium").otherwise("high")


def sample_id(prefix: str, id_col: str, length: int = 12) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.col(id_col).cast("string"), 256), 1, length))


def calibration_split(df: DataFrame, strata: list[str], fraction: float, id_col: str, seed: str = "s") -> DataFrame:
    """'calibration' or 'test' for every row, stratified; each stratum has both. Strata of one row are refused when the result is read."""
    if not 0.1 <= fraction <= 0.8:
        raise ValueError("the fraction must be between 0.1 and 0.8")
    quota = F.least(F.col("__size") - 1, F.greatest(F.lit(1), F.bround(F.col("__size") * F.lit(fraction)).cast("long")))
    ok = F.assert_true(F.col("__size") > 1, "a stratum has fewer than two rows")
    part = F.when(ok.isNull() & (F.col("__place") <= quota), "calibration").otherwise("test")
    return in_place(df, strata, id_col, seed).withColumn("part", part).drop("__size", "__place")


def folds(df: DataFrame, strata: list[str], k: int, id_col: str, seed: str = "s") -> DataFrame:
    """Stratified fold numbers 0 .. k - 1."""
    return in_place(df, strata, id_col, seed).withColumn("fold", F.pmod(F.col("__place") - 1, F.lit(k)).cast("int")).drop("__size", "__place")


def resamples(df: DataFrame, repeats: int, share: float, id_col: str, seed: str = "s") -> DataFrame:
    """`repeats` samples of exactly a share of the rows, without replacement, each in an order of its own.

    Rows fall into 65,536 cells by the head of their key. Cells before the one that the cut falls into are
    taken whole, later ones not at all, and only that one is ranked, so no repeat is gathered in one task.
    """
    key = F.sha2(F.concat_ws("#", F.lit(seed), F.col("repeat"), F.col(id_col)), 256)
    x = df.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).withColumn("__key", key)
    x = x.withColumn("__cell", F.conv(F.substring("__key", 1, 4), 16, 10).cast("int"))
    w = Window.partitionBy("repeat")
    cells = x.groupBy("repeat", "__cell").agg(F.count("*").alias("__m"))
    cells = cells.withColumns({"__upto": F.sum("__m").over(w.orderBy("__cell")), "__want": F.bround(F.sum("__m").over(w) * F.lit(share))})
    cells = cells.select("repeat", "__cell", F.least(F.col("__m"), F.greatest(F.lit(0), F.col("__want") - F.col("__upto") + F.col("__m"))).alias("__take"), "__m").where("__take > 0")
    j = x.join(cells, ["repeat", "__cell"])
    cut = j.where("__take < __m").withColumn("__n", F.row_number().over(Window.partitionBy("repeat", "__cell").orderBy("__key", id_col))).where("__n <= __take").drop("__n")
    return j.where("__take = __m").union(cut).drop("__key", "__cell", "__take", "__m")


def overlap(train: DataFrame, held: DataFrame, uri: str, text_hash: str) -> DataFrame:
    """Training rows whose uri or text hash a held-out row has, with the reasons; two keyed joins instead of one OR."""
    u = held.where(F.col(uri) != "").select(uri).distinct().withColumn("by_uri", F.lit(True))
    t = held.where(F.col(text_hash) != "").select(text_hash).distinct().withColumn("by_text", F.lit(True))
    j = train.join(u, uri, "left").join(t, text_hash, "left").fillna(False, ["by_uri", "by_text"])
    return j.where("by_uri or by_text")


def without_overlap(train: DataFrame, held: DataFrame, uri: str, text_hash: str) -> DataFrame:
    u = held.where(F.col(uri) != "").select(uri).distinct()
    t = held.where(F.col(text_hash) != "").select(text_hash).distinct()
    return train.join(u, uri, "left_anti").join(t, text_hash, "left_anti")
