"""Splits that keep related records together: outlets as components, balanced by largest differencing.

The components are the outlets: all spellings of one web host. They are worked out once for each different spelling;
`same_outlet` lists the spellings that a component joins, and `split` balances the components.
"""

from __future__ import annotations

import heapq
import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.web import outlet_of
from corpusmill.session import materialise

#: Small outlets share this many hashed cells; an outlet above 1 / CELLS of all rows is an item of its own,
#: so the driver balances at most twice as many items, whatever the number of outlets.
CELLS = 4096
#: Bins that the items are balanced into before whole bins go to splits.
BINS = 64


def components(df: DataFrame, column: str) -> DataFrame:
    """(spelling, outlet): the component of each different value of a column; values that name no outlet are in none."""
    return df.select(F.col(column).cast("string").alias("spelling")).where("spelling is not null").distinct().withColumn("outlet", outlet_of("spelling")).where("outlet is not null")


def same_outlet(df: DataFrame, column: str) -> DataFrame:
    """(source_a, source_b), source_a < source_b: different spellings in one component."""
    c = components(df, column)
    return c.toDF("source_a", "o").join(c.toDF("source_b", "o"), "o").where("source_a < source_b").select("source_a", "source_b")


def largest_differencing(weights: dict, bins: int) -> list[list]:
    """Items in `bins` bins of nearly equal weight: the two partial solutions of the widest spread are merged, heaviest bin with lightest."""
    tick = itertools.count()
    heap = []
    for item, w in sorted(weights.items(), key=lambda x: (-x[1], str(x[0]))):
        heapq.heappush(heap, (-w, next(tick), [(0, [])] * (bins - 1) + [(w, [item])]))
    if not heap:
        return [[] for _ in range(bins)]
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        merged = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))), key=lambda x: x[0])
        heapq.heappush(heap, (-(merged[-1][0] - merged[0][0]), next(tick), merged))
    return [x[1] for x in heap[0][2]]


def allocate(weights: dict, shares: dict[str, float], bins: int = BINS) -> dict:
    """item -> split: whole bins, heaviest first, to the split that lacks most of its share."""
    made = [(sum(weights[i] for i in b), b) for b in largest_differencing(weights, bins)]
    total = sum(weights.values())
    lack = {s: p * total / sum(shares.values()) for s, p in shares.items()}
    out = {}
    for w, items in sorted(made, key=lambda x: -x[0]):
        s = max(lack, key=lambda k: (lack[k], shares[k]))
        lack[s] -= w
        out.update(dict.fromkeys(items, s))
    return out


def split(df: DataFrame, id_col: str, source: str, shares: dict[str, float], bins: int = BINS, seed: str = "split") -> DataFrame:
    """(id_col, outlet, split) for every row: rows of one outlet are in the same split, in about the given proportions.

    A row without an outlet (NULL, blank, unknown, nan and the like) stands for itself. Outlets are counted
    with partial aggregation; only the counts of the heavy outlets and of the hashed cells of the light
    ones reach the driver. An outlet larger than a split's share goes to the split that lacks most, so
    proportions are then as near as whole outlets allow. Repeated rows all come out; an empty table gives
    an empty result.
    """
    rows = df.select(F.col(id_col), F.col(source).cast("string").alias("spelling")).join(components(df, source), "spelling", "left").drop("spelling")
    unit = F.coalesce(F.concat(F.lit("o:"), F.col("outlet")), F.concat(F.lit("r:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    keyed = materialise(rows.select(id_col, "outlet", F.pmod(F.xxhash64(F.lit(seed), unit), F.lit(CELLS)).cast("int").alias("cell")), "components")
    named = keyed.where("outlet is not null").groupBy("outlet", "cell").agg(F.count("*").alias("n"))
    total = keyed.agg(F.count("*")).first()[0]
    heavy = {r.outlet: r.n for r in named.where(F.col("n") * CELLS > total).select("outlet", "n").collect()}
    light = keyed.where(~F.coalesce(F.col("outlet").isin(list(heavy)), F.lit(False)) if heavy else F.lit(True)).groupBy("cell").agg(F.count("*").alias("n"))
    weights = {("o", k): n for k, n in heavy.items()} | {("c", r.cell): r.n for r in light.collect()}
    given = allocate(weights, shares, bins)
    spark = df.sparkSession
    by_outlet = spark.createDataFrame([(k[1], s) for k, s in given.items() if k[0] == "o"], "outlet string, by_outlet string")
    by_cell = spark.createDataFrame([(k[1], s) for k, s in given.items() if k[0] == "c"], "cell int, by_cell string")
    # both sides are bounded: at most CELLS rows each
    j = keyed.join(F.broadcast(by_outlet), "outlet", "left").join(F.broadcast(by_cell), "cell", "left")
    return j.select(id_col, "outlet", F.coalesce("by_outlet", "by_cell").alias("split"))


def proportions(assigned: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(split, rows, outlets, share, target): the proportions reached."""
    target = assigned.sparkSession.createDataFrame(list(shares.items()), "split string, target double")
    n = assigned.groupBy("split").agg(F.count("*").alias("rows"), F.countDistinct("outlet").alias("outlets"))
    share = F.try_divide("rows", F.sum("rows").over(Window.partitionBy()))
    return target.join(n, "split", "left").fillna(0, ["rows", "outlets"]).select("split", "rows", "outlets", F.round(F.coalesce(share, F.lit(0.0)), 6).alias("share"), "target")
