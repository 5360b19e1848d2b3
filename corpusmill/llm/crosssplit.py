"""Same or near-same records across splits: a bipartite prefix join of evaluation and training records."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.web import identifier
from corpusmill.llm import kernels as K
from corpusmill.llm.neardup import SHARED, _counts, _ranks, needed_rows
from corpusmill.session import materialise


def overlap(
    evaluation: DataFrame, training: DataFrame, eval_id: str, train_id: str, text: str = "article_text", uri: str | None = "uri", threshold: float = 0.8, width: int = 5
) -> DataFrame:
    """(eval_id, train_id, same_uri, similarity) of every evaluation and training record that overlap.

    Two records overlap if their uris are the same (ignoring case and outer white space; a blank or
    placeholder uri is none) or their shingle sets have a Jaccard similarity of at least `threshold`;
    similarity is NULL where only the uri says so. Shingles are ranked by how rare they are among the
    evaluation records; prefixes of those are the index, and training prefixes probe it under length and
    position filters. A shingle that no evaluation record has comes first in the order and probes nothing.
    Rows with a NULL id are ignored, a NULL text or one of fewer than `width` words has no similarity, and
    rows repeated with the same id give one row per pair (the largest similarity).
    """
    e = evaluation.select(F.col(eval_id).cast("string").alias("id"), F.col(text).cast("string").alias("text"), (identifier(uri) if uri else F.lit(None).cast("string")).alias("uri")).where("id is not null")
    t = training.select(F.col(train_id).cast("string").alias("id"), F.col(text).cast("string").alias("text"), (identifier(uri) if uri else F.lit(None).cast("string")).alias("uri")).where("id is not null")
    by_uri = e.where("uri is not null").select(F.col("id").alias("eid"), "uri").join(t.where("uri is not null").select(F.col("id").alias("tid"), "uri"), "uri").select("eid", "tid").distinct()
    numbered = e.select(F.xxhash64("id").alias("k"), "text").where("text is not null")
    rank, _, _ = _ranks(numbered.mapInArrow(_counts(width), "kind int, key long, value long, data binary"), threshold)
    shared = e.sparkSession.sparkContext.broadcast(rank)
    index = _entries(e, shared, width, threshold).toDF("token", "eid", "en", "ep")
    probe = _entries(t, shared, width, threshold).toDF("token", "tid", "tn", "tp")
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("en") + F.col("tn")) - 1e-9)
    met = (
        index.join(probe, "token")
        .where((F.col("en") >= threshold * F.col("tn") - 1e-9) & (F.col("tn") >= threshold * F.col("en") - 1e-9))
        .where((F.col("ep") < F.col("en") - need + SHARED) & (F.col("tp") < F.col("tn") - need + SHARED))
        .groupBy("eid", "tid", "en", "tn")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= F.least(F.lit(SHARED), need))
        .select("eid", "tid")
        .distinct()
    )
    met = materialise(met, "met")
    # only texts that may be compared are shuffled
    hashed = t.where("text is not null").select(F.xxhash64("id").alias("h"), F.col("id").alias("tid"), F.col("text").alias("tt"))
    few = needed_rows(hashed, met.select(F.xxhash64("tid").alias("h")), "h").drop("h")
    texts = e.select(F.col("id").alias("eid"), F.col("text").alias("et")), few

    def verify(batches):
        for b in batches:
            s = np.array([K.similarity(K.shingles(x.as_py(), width), K.shingles(y.as_py(), width)) for x, y in zip(b.column(2), b.column(3))], np.float64)
            ok = pa.array(s >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok), pa.array(s).filter(ok)], ["eid", "tid", "similarity"])

    by_text = met.join(texts[0], "eid").join(texts[1], "tid").select("eid", "tid", "et", "tt").mapInArrow(verify, "eid string, tid string, similarity double")
    both = by_uri.withColumns({"same_uri": F.lit(True), "similarity": F.lit(None).cast("double")}).union(by_text.select("eid", "tid", F.lit(False), "similarity"))
    return both.groupBy("eid", "tid").agg(F.max("same_uri").alias("same_uri"), F.max("similarity").alias("similarity")).withColumnsRenamed({"eid": "eval_id", "tid": "train_id"})


def _entries(rows: DataFrame, shared, width: int, t: float) -> DataFrame:
    """(token, id, n, place) for the prefix of each record, without tokens that no evaluation record has."""

    def run(batches):
        cache, rank = K.WordHashes(), shared.value
        for b in batches:
            for at in range(0, b.num_rows, K.SLICE):
                s = b.slice(at, K.SLICE)
                flat, words = K.word_hashes(s.column(1).to_pylist(), cache)
                key, n = K.shingle_sets(flat, words, width)
                token = K.by_rarity(key, rank)
                i, run_, place = K.heads(n, np.where(n > 0, K.probe_length(n, t, SHARED), 0))
                ok = rank[K.bucket_of(token[i])] > 0
                i, run_, place = i[ok], run_[ok], place[ok]
                yield pa.RecordBatch.from_arrays([pa.array(token[i].astype(np.int64)), s.column(0).take(pa.array(run_)), pa.array(n[run_].astype(np.int32)), pa.array(place.astype(np.int32))], ["token", "id", "n", "place"])

    return rows.where("text is not null").select("id", "text").mapInArrow(run, "token long, id string, n int, place int")


def report(pairs: DataFrame, evaluation: DataFrame, training: DataFrame, eval_id: str, train_id: str, split: str, source: str) -> DataFrame:
    """Overlaps by evaluation split and source of the evaluation record."""
    e = evaluation.select(F.col(eval_id).cast("string").alias("eval_id"), F.col(split).alias("split"), F.col(source).alias("source")).where("eval_id is not null").dropDuplicates(["eval_id"])
    return (
        pairs.join(e, "eval_id")
        .groupBy("split", "source")
        .agg(
            F.count("*").alias("pairs"),
            F.countDistinct("eval_id").alias("eval_records"),
            F.countDistinct("train_id").alias("train_records"),
            F.count_if("same_uri").alias("same_uri"),
            F.count_if(F.col("similarity") == 1.0).alias("same_text"),
            F.count_if(F.col("similarity") < 1.0).alias("near_text"),
        )
    )
