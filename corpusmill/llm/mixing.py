"""Mixing sources to target weights: cube-method balanced sampling of documents by token and document totals.

A source that must give more than it has repeats whole documents; what remains is a fractional inclusion
probability, the same for all documents of a source. The flight phase moves these probabilities through the
null space of the balancing constraints until they are 0 or 1 but for a few: it runs in blocks of each
source, at most LANDING documents a block stay undecided, and those of all blocks are decided in rounds that
end in one small landing problem per source.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import materialise

#: Where the vocabulary of the public tokenizer stands.
TOKENIZER = os.environ.get("CORPUSMILL_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: The pretokenization pattern of the byte-level vocabularies (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents in a block of the flight phase on average.
BLOCK = 2000
#: Targets that the driver plans.
MOST_TARGETS = 100_000
#: Tasks of the first flight; each takes the blocks that fall to it one after the other.
MOST_TASKS = 4000
#: Documents of a source that the landing phase decides by trying every choice.
LANDING = 12
#: Probabilities this near to 0 or 1 are decided.
_EPS = 1e-9


@lru_cache(maxsize=4)
def _encoding(path: str):
    import base64

    import regex
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return regex.compile(PATTERN), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class TokenCounts(dict):
    """Pretoken -> number of tokens; merges never cross pretokens, so counts add up exactly."""

    def __init__(self, path: str):
        super().__init__()
        self.pattern, self.encoding = _encoding(path)

    def __missing__(self, piece: str) -> int:
        if len(self) > 500_000:
            self.clear()
        n = self[piece] = len(self.encoding.encode_ordinary(piece))
        return n

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, self.pattern.findall(text)))


def token_counts(df: DataFrame, id_col: str, source: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, source, tokens) of every row whose id is not NULL; a NULL or blank text has 0 tokens."""
    rows = df.select(F.col(id_col).alias("id"), F.trim(F.col(source).cast("string")).alias("source"), F.col(text).cast("string").alias("t")).where("id is not null")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        c = TokenCounts(tokenizer)
        for b in batches:
            n = [c.count(t) if t and not t.isspace() else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["id", "source", "tokens"])

    return rows.mapInArrow(run, f"id {kind}, source string, tokens long")


def flight(p: np.ndarray, tokens: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves inclusion probabilities to 0 or 1, keeping the sums of p and of p * tokens, until at most LANDING are left between."""
    p = p.astype(np.float64).copy()
    a = np.stack([np.ones(len(p)), tokens / max(tokens.mean(), 1.0)]) if len(p) else np.ones((2, 0))
    # roughly from long to short, so that the few that stay undecided are short
    order = np.argsort(-np.log1p(tokens) + rng.normal(0, 0.1, len(p)), kind="stable")
    open_ = [int(i) for i in order if _EPS < p[i] < 1 - _EPS]
    pool, rest = open_[:3], open_[3:]
    rest.reverse()
    while len(pool) == 3 and len(pool) + len(rest) > LANDING:
        m = a[:, pool]
        # the null space of two constraints on three units
        u = np.cross(m[0], m[1])
        if np.abs(u).max() < 1e-12:
            u = np.array([1.0, -1.0, 0.0])
        x = p[pool]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.min(np.where(u > 1e-12, (1 - x) / u, np.where(u < -1e-12, -x / u, np.inf)))
            down = np.min(np.where(u > 1e-12, x / u, np.where(u < -1e-12, (x - 1) / u, np.inf)))
        x = x + up * u if rng.random() < down / (up + down) else x - down * u
        p[pool] = np.clip(x, 0, 1)
        keep = []
        for i in pool:
            if _EPS < p[i] < 1 - _EPS:
                keep.append(i)
            else:
                p[i] = round(p[i])
        pool = keep
        while len(pool) < 3 and rest:
            pool.append(rest.pop())
    return p


def landing(p: np.ndarray, tokens: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decides the last few: the choice whose token total, then whose number of documents, is nearest to the one wanted."""
    p = p.copy()
    left = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    if len(left):
        taken = np.arange(1 << len(left))[:, None] >> np.arange(len(left)) & 1
        off = np.abs(taken @ tokens[left] - (p[left] * tokens[left]).sum())
        number = np.abs(taken.sum(axis=1) - p[left].sum())
        p[left] = taken[np.lexsort((number, off))[0]]
    return np.round(p)


def plan(totals: list[tuple[str, int, int]], targets: list[tuple[str, float, int]], size: int | None = None) -> dict[str, tuple[float, int]]:
    """source -> (tokens wanted, largest number of repeats).

    Shares of targets without a token are spread over the others in proportion. Without `size` the mixture
    is the largest in which every source reaches its share within its repeats; with it, a source that can't
    reach its share gives all it may.
    """
    have = {s: n for s, n, _ in totals}
    usable = [(s, w, r) for s, w, r in targets if w and w > 0 and r and r > 0 and have.get(s, 0) > 0]
    total = sum(w for _, w, _ in usable)
    if not usable:
        return {}
    if size is None:
        size = min(have[s] * r / (w / total) for s, w, r in usable)
    return {s: (min(size * w / total, have[s] * r), r) for s, w, r in usable}


def mix(
    docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", size: int | None = None, seed: int = 7, tokenizer: str = TOKENIZER
) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares): chosen documents as (id_col, source, tokens, repeats), and the shares reached.

    shares has (source, target_share, max_repeats, documents, tokens, documents_used, repeats_used, tokens_used, share), a
    row for every target and for every source that has none (its share is 0). Targets are repeated rows of
    a source at most once: the first by share. Documents with NULL ids, without tokens or of a source
    without a target are never chosen, rows repeated with the same id count once (the first by source and
    size), and no document is used more than max_repeats times. More than
    MOST_TARGETS targets are refused: they are planned on the driver and broadcast. Documents never reach it.
    """
    spark = docs.sparkSession
    counted = token_counts(docs, id_col, source, text, tokenizer).groupBy("id").agg(F.min(F.struct("source", "tokens")).alias("x"))
    counted = materialise(counted.select("id", "x.source", "x.tokens"), "tokens")
    t = (
        targets.select(F.trim(F.col("source").cast("string")).alias("source"), F.col("target_share").cast("double"), F.col("max_repeats").cast("int"))
        .where("source is not null")
        .groupBy("source")
        .agg(F.max_by(F.struct("target_share", "max_repeats"), F.struct("target_share", "max_repeats")).alias("x"))
        .select("source", "x.target_share", "x.max_repeats")
    )
    wanted = [(r.source, r.target_share, r.max_repeats) for r in t.limit(MOST_TARGETS + 1).collect()]
    if len(wanted) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    # only sources with a target are asked for
    by = counted.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))
    totals = [(r.source, r.tokens, r.documents) for r in by.join(F.broadcast(t), "source", "left_semi").collect()]
    given = plan(totals, wanted, size)
    have = {s: (n, k) for s, n, k in totals}
    rates = [(s, min(w / have[s][0], r), r, max(1, -(-have[s][1] // BLOCK))) for s, (w, r) in given.items()]
    rate = spark.createDataFrame(rates, "source string, rate double, max_repeats int, blocks int")
    units = counted.where("tokens > 0").join(F.broadcast(rate), "source").withColumn("whole", F.floor(F.col("rate") + _EPS).cast("int"))
    units = units.select("id", "source", "tokens", "whole", (F.col("rate") - F.col("whole")).alias("p"), F.pmod(F.xxhash64("id", F.lit(seed)), F.col("blocks")).cast("int").alias("block"))
    kind = units.schema["id"].dataType.simpleString()
    schema = f"id {kind}, source string, tokens long, whole int, p double, block int"

    def decide(last: bool):
        def run(key, table):
            # the order of rows in a group is not fixed: sort, so that lost tasks give the same result again
            table = table.sort_by([("id", "ascending")])
            rng = np.random.default_rng([seed, table.num_rows, int(table.column("tokens").to_numpy().sum())])
            p, tokens = table.column("p").to_numpy(), table.column("tokens").to_numpy().astype(np.float64)
            p = flight(np.clip(p, 0, 1), tokens, rng)
            if last:
                p = landing(p, tokens, rng)
            return table.set_column(table.schema.get_field_index("p"), "p", pa.array(p))

        return run

    blocks = sum(b for *_, b in rates)
    flown = materialise(units.repartition(max(1, min(blocks, MOST_TASKS)), "source", "block").groupBy("source", "block").applyInArrow(decide(False), schema), "flown")
    undecided = (F.col("p") > _EPS) & (F.col("p") < 1 - _EPS)
    done = flown.where(~undecided)
    most = max((b for *_, b in rates), default=1)
    open_ = flown.where(undecided)
    while most > BLOCK // 4:  # blocks of blocks, each leaving a few: the last group stays small
        most = -(-most // (BLOCK // 4))
        step = materialise(open_.withColumn("block", F.pmod("block", F.lit(most))).groupBy("source", "block").applyInArrow(decide(False), schema), "flown")
        done, open_ = done.union(step.where(~undecided)), step.where(undecided)
    landed = open_.groupBy("source").applyInArrow(decide(True), schema)
    chosen = done.union(landed).select(F.col("id").alias(id_col), "source", "tokens", (F.col("whole") + F.round("p").cast("int")).alias("repeats")).where("repeats > 0")
    chosen = materialise(chosen, "chosen")
    used = chosen.groupBy("source").agg(F.count("*").alias("documents_used"), F.max("repeats").alias("repeats_used"), F.sum(F.col("repeats") * F.col("tokens")).alias("tokens_used"))
    all_used = chosen.agg(F.sum(F.col("repeats") * F.col("tokens"))).first()[0] or 0
    shares = (
        t.join(by, "source", "full")
        .join(used, "source", "left")
        .fillna(0, ["documents", "tokens", "documents_used", "repeats_used", "tokens_used"])
        .select("source", "target_share", "max_repeats", "documents", "tokens", "documents_used", "repeats_used", "tokens_used", F.round(F.col("tokens_used") / F.lit(float(max(all_used, 1))), 6).alias("share"))
    )
    return chosen, shares
