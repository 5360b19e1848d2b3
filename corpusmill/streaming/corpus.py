"""Streaming forms: deduplication with bounded state, weekly counts, a checkpoint that keeps the last row, late arrivals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators.records import keep_last


def read(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicated(stream: DataFrame, time: str, delay: str = "30 days") -> DataFrame:
    """Rows without those whose uri, or then whose text, came before within `delay` in the same country.

    State is bounded by the watermark: a copy that arrives later than that is a new row. Blank uris never collapse.
    """
    x = stream.withWatermark(time, delay).withColumns({"__uri": T.identifier("uri"), "__text": T.text_hash("article_text")})
    # a blank uri is told apart by its text, so that blanks don't collapse
    x = x.withColumn("__key", F.when(F.col("__uri") != "", F.col("__uri")).otherwise(F.concat(F.lit("#"), F.col("__text"))))
    return x.dropDuplicatesWithinWatermark(["country", "__key"]).dropDuplicatesWithinWatermark(["country", "__text"]).drop("__uri", "__key", "__text")


def weekly_counts(stream: DataFrame, time: str, by: list[str], delay: str = "7 days") -> DataFrame:
    """Rows by week, weeks beginning on Monday; a week is given once the watermark has passed it."""
    w = F.window(time, "1 week", "1 week", "4 days")
    return stream.withWatermark(time, delay).groupBy(*by, w).agg(F.count("*").alias("n")).select(*by, F.col("window.start").alias("week"), "n")


def sessions(stream: DataFrame, time: str, by: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Runs of rows that are no further apart than a gap."""
    g = stream.withWatermark(time, delay).groupBy(by, F.session_window(time, gap).alias("s")).agg(F.count("*").alias("n"))
    return g.select(by, F.col("s.start").alias("began"), F.col("s.end").alias("ended"), "n")


#: Buckets of a merged table; a batch rewrites those that its keys are in.
BUCKETS = 256


def keep_last_sink(spark: SparkSession, path: str, key: str, order: str, buckets: int = BUCKETS):
    """A foreachBatch function: each batch is merged into a table of buckets by key.

    A batch writes a new version of the buckets that its keys fall into, beside the older ones; `current` reads the
    last version of each. The number of buckets belongs to the table and must not change.
    """

    def write(batch: DataFrame, number: int) -> None:
        b = batch.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = sorted(r[0] for r in b.select("__bucket").distinct().collect())
        now = current(spark, path, number, touched)
        if now is not None:
            b = now.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).unionByName(b, allowMissingColumns=True)
        # a batch that is run again starts from the same versions and writes the same one
        keep_last(b, [key], [order]).repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{path}/v{number:012d}")

    return write


def current(spark: SparkSession, path: str, before: int | None = None, only: list[int] | None = None) -> DataFrame | None:
    """The rows of such a table: the last whole version of each bucket (or of some), or the last before a batch; None if there is none."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at(path)):
        return None
    versions = sorted((s.getPath().toString() for s in fs.listStatus(at(path)) if fs.exists(at(s.getPath(), "_SUCCESS"))), reverse=True)
    last: dict[int, str] = {}
    for v in versions:
        if before is None or int(v.rpartition("/v")[2]) < before:
            for s in fs.listStatus(at(v)):
                name = s.getPath().getName()
                if name.startswith("__bucket=") and (only is None or int(name[9:]) in only):
                    last.setdefault(int(name[9:]), s.getPath().toString())
    return spark.read.option("mergeSchema", "true").parquet(*last.values()) if last else None
