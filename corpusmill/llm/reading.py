"""Reading level of each document: interpolated n-gram models by level, surprisal distributions, isotonic regression.

Two kinds of interpolated n-gram models are trained for each level on labelled documents: trigrams of token classes
(length of a word, number, stop, comma, dash, line end), conditioned besides on how far the sentence has run, which serve
all languages alike, and trigrams of the letters of words. A document's surprisals over all of its tokens give its
features: the mean under each level's models, the levels that these speak for, and mean, spread and quantiles of the
surprisal under the model of all levels. Ridge regression on the labels makes one index of difficulty of them, fitted on
documents that the models had not seen, and isotonic regression maps the index to the scale.
The models, the regression and the isotonic fit are those of all labelled documents; only counts and sums of fixed size leave
the tasks. Every document is scored as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import kernels as K
from corpusmill.llm.kernels import SLICE
from corpusmill.llm.neardup import needed_rows
from corpusmill.session import materialise

LEVELS = 5
#: Chance that a rater is one level off, on either side together.
SLIP = 0.1
#: Fitted levels from here on count as the level above.
HALF = 0.5
#: Tokens for which the mean surprisals speak when levels are weighed against each other.
EVIDENCE = 20.0
#: Quantiles of the surprisals of a document's tokens.
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
#: Weight of the prior of the ridge regression.
RIDGE = 1.0
#: Characters that are taken at once.
CHARACTERS = 1 << 20
#: Letter triples that a task counts before it hands them on.
TRIPLES = 1 << 18
_TRIPLES, _PAIRS = 18, 15
_WEIGHTS = [f"w{i}" for i in range(2 * LEVELS)]
_U = np.uint64

_TOKEN = re.compile(r"(?<![^\W_])[^\W\d_]\.(?=\s?[^\W\d_])|[^\W\d_]+|\d+|[.!?…;/|•·]+|[,:]|[–—]|\n")
_LONGEST = 16
_INITIAL, _NUMBER, _STOP, _COMMA, _DASH, _LINE, _START = range(_LONGEST, _LONGEST + 7)
CLASSES = _LONGEST + 7
RUNS = 10
CELLS = RUNS * CLASSES * CLASSES


class _Classes(dict):
    def __missing__(self, t: str) -> int:
        if t[0].isalpha():
            c = _INITIAL if t[-1] == "." else min(len(t), _LONGEST) - 1
        elif t[0].isdigit() or t[0].isnumeric():
            c = _NUMBER
        else:
            c = {",": _COMMA, ":": _COMMA, "\n": _LINE, "–": _DASH, "—": _DASH}.get(t, _STOP)
        if len(self) > 200_000:
            self.clear()
        self[t] = c
        return c


def cells(texts, cache: _Classes) -> tuple[np.ndarray, np.ndarray]:
    """Trigram cells (sentence run, token before, token) of some texts, flat, and their number in each text."""
    flat: list[int] = []
    n = np.zeros(len(texts), np.int64)
    at = cache.__getitem__
    for i, t in enumerate(texts):
        if t and not t.isspace():
            k = len(flat)
            flat.extend(map(at, _TOKEN.findall(t)))
            n[i] = len(flat) - k
    c = np.array(flat, np.int64)
    if not len(c):
        return c, n
    first = (np.concatenate([[0], np.cumsum(n)[:-1]]))[n > 0]
    before = np.concatenate([[_START], c[:-1]])
    before[first] = _START
    # tokens since the last stop, line end or beginning
    place = np.arange(len(c))
    reset = (before == _STOP) | (before == _LINE) | (before == _START)
    run = place - np.maximum.accumulate(np.where(reset, place, 0))
    return (np.minimum(run // 3, RUNS - 1) * CLASSES + before) * CLASSES + c, n


def _letter_table() -> np.ndarray:
    table = np.zeros(1 << 16, bool)
    table[[i for i in range(1 << 16) if chr(i).isalpha()]] = True
    return table


def triples(texts, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Three letters in a row (21 bits each, 0 beside a word) of some texts, flat, and their number in each text."""
    parts = [np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    size = np.array([len(p) + 2 for p in parts], np.int64)
    x = np.zeros(int(size.sum()), np.uint64)
    at = 0
    for p, n in zip(parts, size):
        x[at + 2 : at + n] = p
        at += n
    # letters beyond the first plane are taken as they are
    x[(x < 1 << 16) & ~table[np.minimum(x, 65535).astype(np.int64)]] = 0
    before = np.concatenate([np.zeros(1, np.uint64), x[:-1]])[: len(x)]
    first = np.concatenate([np.zeros(2, np.uint64), x[:-2]])[: len(x)]
    first[before == 0] = 0
    keep = (x != 0) | (before != 0)
    doc = np.repeat(np.arange(len(parts)), size)[keep]
    return ((first << _U(42)) | (before << _U(21)) | x)[keep], np.bincount(doc, minlength=len(parts))


def _triple(t: np.ndarray) -> np.ndarray:
    return (K.mix(t) >> _U(64 - _TRIPLES)).astype(np.int64)


def _pair(t: np.ndarray) -> np.ndarray:
    """The cell of two letters in a row."""
    return (K.mix(t & _U((1 << 42) - 1)) >> _U(64 - _PAIRS)).astype(np.int64)


def _one(t: np.ndarray) -> np.ndarray:
    """The cell of the letter before the last."""
    return (K.mix(((t >> _U(21)) & _U((1 << 21) - 1)) + _U(1 << 60)) >> _U(64 - _PAIRS)).astype(np.int64)


class Letters:
    """Surprisals in bits of letter triples under each level's interpolated model."""

    def __init__(self, triple: np.ndarray, weight: np.ndarray):
        with np.errstate(over="ignore"):
            add = lambda at, bits: np.stack([np.bincount(at, weights=w, minlength=1 << bits) for w in weight])
            self.pairs, self.ones = add(_pair(triple), _PAIRS).astype(np.float32), add(_one(triple), _PAIRS).astype(np.float32)
            cell = _triple(triple)
            seen = add(cell, _TRIPLES)
            self.seen = seen.sum(axis=0) > 0
            self.bits = np.zeros(seen.shape, np.float32)
            self.bits[:, cell] = -np.log2((seen[:, cell] + 5 * self._two(triple)) / (self.pairs[:, _pair(triple >> _U(21))] + 5))

    def _two(self, t: np.ndarray) -> np.ndarray:
        return (self.pairs[:, _pair(t)] + 2 / 500) / (self.ones[:, _one(t)] + 2)

    def surprisals(self, t: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            cell = _triple(t)
            out = self.bits[:, cell]
            new = np.flatnonzero(~self.seen[cell])
            out[:, new] = -np.log2(5 * self._two(t[new]) / (self.pairs[:, _pair(t[new] >> _U(21))] + 5))
        return out


def _portions(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list]]:
    """A batch in portions of at most SLICE / 4 texts (its second column) and about CHARACTERS characters, a longer text by itself."""
    at = size = 0
    texts = b.column(1).to_pylist()
    for i, t in enumerate(texts):
        if i > at and (i - at >= SLICE // 4 or size + len(t or "") > CHARACTERS):
            yield b.slice(at, i - at), texts[at:i]
            at, size = i, 0
        size += len(t or "")
    if at < len(texts):
        yield b.slice(at), texts[at:]


def _means(bits: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Mean of each text's columns; NaN for a text without any."""
    out = np.full((len(n), len(bits)), np.nan)
    has = np.flatnonzero(n)
    if len(has):
        begin = K.starts(n)[has]
        out[has] = (np.add.reduceat(bits, begin, axis=1) / n[has]).T
    return out


def _spoken(mean: np.ndarray) -> np.ndarray:
    """The level that mean surprisals speak for, were they those of EVIDENCE tokens."""
    p = np.exp2((np.nanmin(mean, axis=1, keepdims=True, initial=np.inf) - mean) * EVIDENCE)
    return (p / p.sum(axis=1, keepdims=True)) @ np.arange(1, LEVELS + 1)


@dataclass
class Models:
    """The n-gram models of all levels, from counts by level."""

    bits: np.ndarray
    pooled: np.ndarray
    letters: Letters

    def features(self, cell: np.ndarray, n: np.ndarray, triple: np.ndarray, m: np.ndarray) -> np.ndarray:
        """A row for each text; NaN for one without a token, and in the columns of letters for one without a letter."""
        a = _means(self.bits[:, cell], n)
        letters = np.concatenate([self.letters.surprisals(triple[i : i + CHARACTERS]) for i in range(0, max(len(triple), 1), CHARACTERS)], axis=1)
        b = _means(letters, m)
        x = self.pooled[cell]
        mean = _means(x[None], n)[:, 0]
        spread = np.sqrt(np.maximum(_means(x[None] ** 2, n)[:, 0] - mean**2, 0))
        doc = np.repeat(np.arange(len(n)), n)
        x = x[np.lexsort((x, doc))]
        begin = K.starts(n)
        quantiles = [np.where(n > 0, x[np.minimum(begin + np.floor(q * np.maximum(n - 1, 0)).astype(np.int64), max(len(x) - 1, 0))] if len(x) else np.nan, np.nan) for q in QUANTILES]
        with np.errstate(invalid="ignore"):
            return np.column_stack([_spoken(a), _spoken(b), a, b, mean, spread, *quantiles])


def models(counts: np.ndarray, triple: np.ndarray, weight: np.ndarray) -> Models:
    """Models from the counts of the cells and of the letter triples, each by level."""
    return Models(np.stack([_surprisal(t) for t in counts]), _surprisal(counts.sum(axis=0)), Letters(triple, weight))


@dataclass
class Model:
    """The models, the regression on their features, and the isotonic steps from index to level."""

    models: Models
    middle: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    x: np.ndarray
    y: np.ndarray

    def index(self, features: np.ndarray) -> np.ndarray:
        z = (features - self.middle) / self.scale
        return np.round(np.where(np.isnan(z), 0, z) @ self.weight[:-1] + self.weight[-1], 3)

    def level(self, index: np.ndarray) -> np.ndarray:
        return np.interp(index, self.x, self.y)


def regression(features: DataFrame, m: Models) -> Model:
    """Ridge regression of the labels on standardised features and the isotonic fit of its index; a feature that is missing is as usual.

    `features` has a row (x, y, w) for each labelled document: features, label and weight.
    """

    def sums(f):
        def run(batches):
            total = 0
            for b in batches:
                if b.num_rows:
                    x = np.array(b.column(0).to_pylist(), np.float64)
                    total = total + f(x, b.column(1).to_numpy(), b.column(2).to_numpy())
            if not np.isscalar(total):
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

        parts = [np.frombuffer(r.s) for r in features.mapInArrow(run, "s binary").toLocalIterator()]
        return np.sum(parts, axis=0)

    n, total = sums(lambda x, y, w: np.stack([(~np.isnan(x)).sum(axis=0), np.nansum(x, axis=0)]).astype(np.float64)).reshape(2, -1)
    middle = np.where(n > 0, total / np.maximum(n, 1), 0)
    # one more row that is as usual
    scale = np.sqrt(sums(lambda x, y, w: np.nansum((x - middle) ** 2, axis=0)) / (n + 1)) + 1e-9

    def products(x, y, w):
        z = (x - middle) / scale
        z = np.column_stack([np.where(np.isnan(z), 0, z), np.ones(len(z))])
        return np.column_stack([(z * w[:, None]).T @ z, (z * w[:, None]).T @ y])

    both = sums(products).reshape(len(middle) + 1, -1)
    prior = np.diag([RIDGE] * len(middle) + [1e-9])
    out = Model(m, middle, scale, np.linalg.solve(both[:, :-1] + prior, both[:, -1]), np.zeros(1), np.zeros(1))

    def steps(batches):
        for b in batches:
            if b.num_rows:
                at, group = np.unique(out.index(np.array(b.column(0).to_pylist(), np.float64)), return_inverse=True)
                w = b.column(2).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.bincount(group, weights=b.column(1).to_numpy() * w)), pa.array(np.bincount(group, weights=w))], ["i", "yw", "w"])

    # the index has three places, so the rows are few
    rows = features.mapInArrow(steps, "i double, yw double, w double").groupBy("i").agg(F.sum("yw"), F.sum("w")).collect()
    i, yw, w = np.array([tuple(r) for r in rows]).T
    out.x, out.y = isotonic(i, yw / w, w)
    return out


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the non-decreasing fit, as knots for interpolation. Equal x have one value."""
    at, group = np.unique(x, return_inverse=True)
    weight = np.bincount(group, weights=w)
    blocks: list[list[float]] = []  # sum, weight, first x, last x
    for a, b, c in zip(at, np.bincount(group, weights=y * w), weight):
        blocks.append([b, c, a, a])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, t, _, last = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += t
            blocks[-1][3] = last
    knots = [(b[k], b[0] / b[1]) for b in blocks for k in ((2, 3) if b[3] > b[2] else (2,))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


def _surprisal(counts: np.ndarray) -> np.ndarray:
    """Interpolated trigram surprisals from counts of one level."""
    n3 = counts.reshape(RUNS, CLASSES, CLASSES)
    n2 = n3.sum(axis=0)
    n1 = n2.sum(axis=0) + 0.5
    p1 = n1 / n1.sum()
    p2 = (n2 + 5 * p1) / (n2.sum(axis=1, keepdims=True) + 5)
    p3 = (n3 + 5 * p2) / (n3.sum(axis=2, keepdims=True) + 5)
    return -np.log2(p3).ravel()


def beliefs(ratings: np.ndarray) -> np.ndarray:
    """Chances of the levels of documents from the number of ratings at each; raters err by one level at times."""
    raters = np.full((LEVELS, LEVELS), 1e-3)
    for l in range(LEVELS):
        near = [k for k in (l - 1, l + 1) if 0 <= k < LEVELS]
        raters[l, l] += 1 - SLIP
        raters[l, near] += SLIP / len(near)
    x = ratings @ np.log(raters).T
    p = np.exp(x - x.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _read(batches):
    """Slices of labelled documents: (fold, ratings, cells, their number, triples, their number)."""
    cache, table = _Classes(), _letter_table()
    for b in batches:
        for s, texts in _portions(b):
            c, n = cells(texts, cache)
            t, m = triples([x if k else None for x, k in zip(texts, n)], table)
            yield s.column(0).to_numpy(), np.array(s.column(2).to_pylist(), np.float64).reshape(-1, LEVELS), c, n, t, m


def _added(batches):
    """Counts of the cells and triples by fold and level, weighted by the chance of the level: one row a task for the cells, one for each triple."""
    dense, triple, weight, size = np.zeros((2, LEVELS, CELLS)), [], [], 0

    def counted():
        names, inverse = np.unique(np.concatenate(triple), return_inverse=True)
        return names, np.stack([np.bincount(inverse, weights=x, minlength=len(names)) for x in np.concatenate(weight, axis=1)])

    def rows(names, total):
        return pa.RecordBatch.from_arrays([pa.nulls(len(names), pa.binary()), pa.array(names.view(np.int64)), *map(pa.array, total)], ["cells", "triple", *_WEIGHTS])

    for fold, ratings, c, n, t, m in _read(batches):
        w = beliefs(ratings)
        of, at = np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)
        for f in (0, 1):
            for l in range(LEVELS):
                dense[f, l] += np.bincount(c, weights=(w[:, l] * (fold == f))[of], minlength=CELLS)
        names, inverse = np.unique(t, return_inverse=True)
        triple.append(names)
        weight.append(np.stack([np.bincount(inverse, weights=(w[:, l] * (fold == f))[at], minlength=len(names)) for f in (0, 1) for l in range(LEVELS)]))
        size += len(names)
        if size > TRIPLES:
            names, total = counted()
            triple, weight, size = [names], [total], len(names)
            if size > TRIPLES // 2:
                yield rows(names, total)
                triple, weight, size = [], [], 0
    if triple:
        yield rows(*counted())
    if dense.any():
        yield pa.RecordBatch.from_arrays([pa.array([dense.tobytes()], pa.binary()), pa.nulls(1, pa.int64()), *[pa.nulls(1, pa.float64())] * (2 * LEVELS)], ["cells", "triple", *_WEIGHTS])


def fit_model(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", level: str = "reading_level") -> Model | None:
    """A model from all labelled documents; None if none of them has a token. The driver gets counts and sums, no texts."""
    rated = (
        labels.select(F.col(doc_id).alias("d"), F.col(level).cast("int").alias("l"))
        .where(f"d is not null and l between 1 and {LEVELS}")
        .groupBy("d")
        # one count per level, so that many raters of one document stay small
        .agg(*[F.count_if(F.col("l") == k).alias(f"l{k}") for k in range(1, LEVELS + 1)])
    )
    rated = materialise(rated, "rated")
    t = docs.select(F.col(doc_id).alias("d"), F.col(text).cast("string").alias("t")).where("t is not null")
    # only texts that may have a label are shuffled
    t = needed_rows(t.withColumn("h", F.xxhash64("d")), rated.select(F.xxhash64("d").alias("h")), "h").drop("h").join(rated, "d")
    # rows repeated with the same id count once
    t = t.groupBy("d").agg(F.min("t").alias("t"), *[F.first(f"l{k}").alias(f"l{k}") for k in range(1, LEVELS + 1)])
    t = t.select(F.pmod(F.xxhash64("d"), F.lit(2)).cast("int").alias("fold"), "t", F.array(*[f"l{k}" for k in range(1, LEVELS + 1)]).cast("array<double>").alias("l"))
    labelled = materialise(t, "labelled")
    added = materialise(labelled.mapInArrow(_added, "cells binary, triple long, " + ", ".join(f"{w} double" for w in _WEIGHTS)), "counts")
    dense = np.zeros((2, LEVELS, CELLS))
    for r in added.where("cells is not null").select("cells").toLocalIterator():
        dense += np.frombuffer(r.cells).reshape(dense.shape)
    if not dense.any():
        return None
    table = added.where("cells is null").groupBy("triple").agg(*[F.sum(w).alias(w) for w in _WEIGHTS]).toArrow()
    names = table.column("triple").to_numpy().view(np.uint64)
    order = np.argsort(names)
    names, weights = names[order], np.stack([table.column(w).to_numpy()[order] for w in _WEIGHTS])
    by_fold = weights.reshape(2, LEVELS, -1)
    full = models(dense.sum(axis=0), names, by_fold.sum(axis=0))
    # features from models that haven't seen the document, as far as there are any
    unseen = [models(dense[1 - f], names, by_fold[1 - f]) if dense[1 - f].any() else full for f in (0, 1)]
    shared = docs.sparkSession.sparkContext.broadcast(unseen)

    def score(batches):
        for fold, ratings, c, n, t, m in _read(batches):
            x = [u.features(c, n, t, m) for u in shared.value]
            x = np.where((fold == 0)[:, None], x[0], x[1])
            ok = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(list(x[ok]), pa.list_(pa.float64())), pa.array((beliefs(ratings) @ np.arange(1, LEVELS + 1))[ok]), pa.array(ratings.sum(axis=1)[ok])], ["x", "y", "w"])

    return regression(materialise(labelled.mapInArrow(score, "x array<double>, y double, w double"), "features"), full)


def levels(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] = []) -> DataFrame:  # noqa: B006
    """(doc_id, *keep, difficulty, level, surprisal, tokens) for every row.

    `difficulty` is the isotonic fit on the scale of the labels, `level` its nearest whole level and
    `surprisal` the mean bits per token under that level's model. A NULL or blank text has NULLs, as has
    every text if there is no usable label. Repeated rows all come out; labels of unknown documents or
    outside the scale are ignored; an empty table gives an empty result.
    """
    model = fit_model(docs, labels, doc_id, text)
    rows = docs.select(F.struct(doc_id, *keep).alias("r"), F.col(text).cast("string").alias("t"))
    if model is None:
        null = [F.lit(None).cast(t).alias(c) for c, t in (("difficulty", "double"), ("level", "int"), ("surprisal", "double"), ("tokens", "int"))]
        return rows.select("r.*", *null)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        cache, table, m = _Classes(), _letter_table(), shared.value
        for b in batches:
            for s, texts in _portions(b):
                c, n = cells(texts, cache)
                found = m.models.features(c, n, *triples([x if k else None for x, k in zip(texts, n)], table))
                d, bits = m.level(m.index(found)), found[:, 2 : 2 + LEVELS]
                none = n == 0
                l = np.clip(np.floor(np.where(none, 1, d) + HALF), 1, LEVELS).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [s.column(0), pa.array(d, mask=none), pa.array(l, mask=none), pa.array(bits[np.arange(len(l)), l - 1], mask=none), pa.array(n.astype(np.int32))],
                    ["r", "difficulty", "level", "surprisal", "tokens"],
                )

    kind = rows.schema["r"].dataType.simpleString()
    return rows.mapInArrow(score, f"r {kind}, difficulty double, level int, surprisal double, tokens int").select("r.*", "difficulty", "level", "surprisal", "tokens")


def profile(scored: DataFrame, by: list[str]) -> DataFrame:
    """Documents, mean difficulty, its quartiles and the number at each level, by the given columns; documents without a level are counted apart."""
    q = F.percentile_approx("difficulty", [0.25, 0.5, 0.75])
    return scored.groupBy(*by).agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("level").isNull()).alias("without_level"),
        F.round(F.avg("difficulty"), 4).alias("mean_difficulty"),
        *[F.round(q[i], 4).alias(n) for i, n in enumerate(("q1", "median", "q3"))],
        *[F.count_if(F.col("level") == k).alias(f"level_{k}") for k in range(1, LEVELS + 1)],
    )
