"""Connected components of an undirected graph, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import materialise


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the component of a node is its smallest member.

    Large-star and small-star rounds take O(log^2 n) shuffles of the edge list; a hub's neighbours are
    rewired by joins with per-node minima, which are aggregated map-side, so no neighbourhood is gathered
    in one task. Each round is written to the shared folder. Edges with a NULL end or equal ends are
    ignored; an empty edge list gives an empty result.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e = materialise(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
    previous = None
    while True:
        both = e.union(e.select("v", "u"))
        # large star: every larger neighbour of a node points to the least of the node and its neighbours
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour, and the node, points to the least smaller neighbour
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = materialise(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(),
            "edges",
        )
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == previous:
            break
        previous = state
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
