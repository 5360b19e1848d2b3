"""A grid of clusterings and how stable each is on resamples, all fitted at once.

Every candidate is a k-means clustering of the first few principal components of unit vectors; clusters below a least
size are outliers. All candidates, on all rows and on each resample, are moved together: a round is one scan in
which each task adds up the rows nearest to every centre of every model, so the number of jobs doesn't depend on
the number of candidates, and rows never leave their tasks. Only centres and tables of counts reach the driver.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.ml import vectors
from corpusmill.session import materialise

#: (dimensions, clusters, least size of a cluster as a share of the rows, number of the start).
GRID = list(product((3, 5, 8), (4, 6, 8, 10, 12), (0.01, 0.02, 0.04), (1, 2)))
#: Rows that the starts are drawn from: those of the smallest hashed ids. All rows move the centres.
START_ROWS = 2000
#: Values of the group, at most.
MOST_GROUPS = 1000


def stability_grid(df: DataFrame, id_col: str, column: str, group: str, grid: list[tuple] = GRID, repeats: int = 5, share: float = 0.8, rounds: int = 25) -> DataFrame:
    """One row a candidate, with what a choice among them looks at.

    `topics` clusters that are large enough, `outlier_share` of the rows in others, `largest_share` of the largest
    among the rest, `country_nmi` of cluster and group, `mean_ari` and `persistence` (the least) of the adjusted Rand
    indices of the resamples, each about a share of the rows, with the clustering of all rows, over rows that both
    have in a cluster, `common_share` their mean share, and `validity` the share of the variance that the clusters
    explain. NULL vectors are left out, a NULL group is one of its own; without rows there are no candidates.
    """
    spark = df.sparkSession
    most = max(d for d, *_ in grid)
    x = vectors(df.select(F.col(id_col).alias("id"), F.col(group).cast("string").alias("g"), F.col(column).alias("__c")).where("id is not null and __c is not null"), "__c")
    if not x.limit(1).count():
        return spark.createDataFrame([], SCHEMA)
    # the same hash decides for every candidate whether a row is in a resample
    member = F.array(F.lit(True), *[F.pmod(F.xxhash64(F.lit(f"resample {r}"), "id"), F.lit(1_000_000)) < int(share * 1e6) for r in range(repeats)])
    p = PCA(k=most, inputCol="__features", outputCol="__p").fit(x).transform(x)
    p = materialise(p.select("id", F.coalesce("g", F.lit("")).alias("g"), vector_to_array("__p", "float32").alias("p"), member.alias("m")), "components")
    groups = sorted(r.g for r in p.select("g").distinct().limit(MOST_GROUPS + 1).collect())
    if len(groups) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    first = np.array([r.p for r in p.orderBy(F.xxhash64("id"), "id").limit(START_ROWS).collect()], np.float64)
    bases = sorted({(d, k, s) for d, k, _, s in grid})
    centres = [np.repeat(_start(first[:, :d], k, s)[None], repeats + 1, axis=0) for d, k, s in bases]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(centres)
        total = _summed(p, _moves(shared), sum(c.shape[0] * c.shape[1] * (c.shape[2] + 1) for c in centres))
        moved, at = 0.0, 0
        for i, c in enumerate(centres):
            r, k, d = c.shape
            part = total[at : at + r * k * (d + 1)].reshape(r, k, d + 1)
            at += r * k * (d + 1)
            n = part[:, :, d:]
            new = np.where(n > 0, part[:, :, :d] / np.maximum(n, 1), c)
            moved = max(moved, float(np.abs(new - c).max()))
            centres[i] = new
        if moved < 1e-4:
            break
    tables = _tables(p, spark.sparkContext.broadcast(centres), centres, groups)
    out = []
    for number, (d, k, least, s) in enumerate(sorted(grid), 1):
        out.append((number, d, k, float(least), s, *_judged(tables[bases.index((d, k, s))], least)))
    return spark.createDataFrame(out, SCHEMA)


SCHEMA = (
    "candidate int, dimensions int, k int, least double, start int, topics int, outlier_share double, largest_share double, "
    "country_nmi double, common_share double, mean_ari double, persistence double, validity double"
)


def _start(rows: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centres drawn far from each other: each with a chance that grows with the squared distance from those before."""
    rng = np.random.default_rng(seed)
    out = [rows[rng.integers(len(rows))]]
    while len(out) < k:
        far = ((rows[:, None] - np.array(out)) ** 2).sum(axis=2).min(axis=1)
        out.append(rows[rng.choice(len(rows), p=far / far.sum())] if far.sum() > 0 else out[0])
    return np.array(out)


def _nearest(p: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * p[:, : centres.shape[1]] @ centres.T).argmin(axis=1)


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    n = batch.num_rows
    p = batch.column(batch.schema.get_field_index("p")).flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64)
    return p, batch.column(batch.schema.get_field_index("m")).flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(bool)


def _summed(p: DataFrame, scan, size: int) -> np.ndarray:
    """What the tasks add up, slot by slot."""
    out = np.zeros(size)
    for r in p.mapInArrow(scan, "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value")).collect():
        out[r.slot] = r.value
    return out


def _slots(total: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["slot", "value"])


def _moves(shared):
    def run(batches):
        centres, total = shared.value, None
        for b in batches:
            if not b.num_rows:
                continue
            p, m = _read(b)
            parts = []
            for c in centres:
                r, k, d = c.shape
                for i in range(r):
                    mine = p[m[:, i], :d]
                    own = np.zeros((len(mine), k))
                    own[np.arange(len(mine)), _nearest(mine, c[i])] = 1.0
                    parts.append(np.column_stack([own.T @ mine, own.sum(axis=0)]).ravel())
            here = np.concatenate(parts)
            total = here if total is None else total + here
        if total is not None:
            yield _slots(total)

    return run


def _tables(p: DataFrame, shared, centres: list[np.ndarray], groups: list[str]) -> list[dict]:
    """For each clustering: rows by cluster and group, by cluster on all rows and on each resample, and the squares within and in all."""
    sizes = [c.shape[1] * len(groups) + (c.shape[0] - 1) * c.shape[1] ** 2 + 2 + c.shape[2] for c in centres]
    number = {g: i for i, g in enumerate(groups)}

    def run(batches):
        total = np.zeros(sum(sizes))
        for b in batches:
            if not b.num_rows:
                continue
            x, m = _read(b)
            g = np.array([number[v] for v in b.column(b.schema.get_field_index("g")).to_pylist()])
            parts = []
            for c in shared.value:
                r, k, d = c.shape
                full = _nearest(x, c[0])
                parts.append(np.bincount(full * len(groups) + g, minlength=k * len(groups)))
                parts += [np.bincount(full[m[:, i]] * k + _nearest(x[m[:, i]], c[i]), minlength=k * k) for i in range(1, r)]
                parts += [np.array([((x[:, :d] - c[0][full]) ** 2).sum(), (x[:, :d] ** 2).sum()]), x[:, :d].sum(axis=0)]
            total += np.concatenate(parts)
        yield _slots(total)

    total, out, at = _summed(p, run, sum(sizes)), [], 0
    for c, n in zip(centres, sizes):
        r, k, d = c.shape
        t = total[at : at + n]
        at += n
        e = k * len(groups)
        out.append({"groups": t[:e].reshape(k, -1), "resamples": t[e : e + (r - 1) * k * k].reshape(r - 1, k, k), "within": t[-2 - d], "squares": t[-1 - d], "sum": t[-d:]})
    return out


def _judged(t: dict, least: float) -> tuple:
    size = t["groups"].sum(axis=1)
    rows = size.sum()
    large = size >= max(1.0, least * rows)
    inside = size[large].sum()
    aris, common = [], []
    for table in t["resamples"]:
        n = table.sum()
        both = table[large][:, table.sum(axis=0) >= max(1.0, least * n)]
        aris.append(_rand(both))
        common.append(both.sum() / n if n else 0.0)
    spread = t["squares"] - (t["sum"] ** 2).sum() / rows
    r = lambda v: round(float(v), 6)
    return (
        int(large.sum()), r(1 - inside / rows), r(size[large].max() / inside if inside else 1.0), r(_mutual(t["groups"][large])),
        r(np.mean(common) if common else 0.0), r(np.mean(aris) if aris else 0.0), r(min(aris, default=0.0)), r(1 - t["within"] / spread if spread > 0 else 0.0),
    )


def _rand(table: np.ndarray) -> float:
    """Adjusted Rand index of a table of counts; 0 for an empty one."""
    two = lambda n: (n * (n - 1) / 2).sum()
    if table.sum() < 2:
        return 0.0
    a, b, every = two(table.sum(axis=1)), two(table.sum(axis=0)), two(np.array([table.sum()]))
    top, expected = (a + b) / 2, a * b / every
    return 1.0 if top == expected else float((two(table) - expected) / (top - expected))


def _mutual(table: np.ndarray) -> float:
    """Normalised mutual information of a table of counts, by the mean of the entropies; 0 if either side is constant."""
    n = table.sum()
    if not n:
        return 0.0
    a, b = table.sum(axis=1) / n, table.sum(axis=0) / n
    entropy = lambda q: -(q[q > 0] * np.log(q[q > 0])).sum()
    both = table[table > 0] / n
    top = entropy(a) + entropy(b)
    return float(2 * (entropy(a) + entropy(b) + (both * np.log(both)).sum()) / top) if top > 0 else 0.0
