"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Tables this process wrote into the shared folder; removed when it ends.
_WRITTEN: list[tuple[SparkSession, str]] = []


def session(app: str = "corpusmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; `conf` overrides single settings."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    return b.config(map=settings | conf).getOrCreate()


def setting(spark: SparkSession, name: str, default: str | None = None) -> str | None:
    """A setting of the application: spark.corpusmill.NAME of the session, else CORPUSMILL_NAME of the environment, else the default; blank ones count as absent."""
    key = name.replace(".", "_").upper()
    return spark.conf.get(f"spark.corpusmill.{name}", None) or os.environ.get(f"CORPUSMILL_{key}") or default


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="corpusmill-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", "file://" + own)
    return "file://" + own


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes with `release`, or when the process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_clean)
    _WRITTEN.append((spark, path))
    return path


def materialise(df: DataFrame, name: str = "table", partition_by: list[str] | None = None) -> DataFrame:
    """Writes a table into the shared folder and reads it back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes the intermediate tables written so far; results that still read them are lost. For long sessions, where the end of the process is far."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop()[1])
        path.getFileSystem(conf).delete(path, True)


def _clean() -> None:
    for spark, path in _WRITTEN:
        if path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
        elif spark.getActiveSession() is not None:
            # another file system, as long as there is someone to ask
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the Parquet tables of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Applications whose workers have the package.
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the Python workers, once for each application, so that they need no installation."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(root):
        folder = tempfile.mkdtemp(prefix="corpusmill-code-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.join(folder, "corpusmill_code.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for at, _, files in os.walk(root):
                for f in files:
                    if f.endswith(".py"):
                        p = os.path.join(at, f)
                        z.write(p, os.path.join("corpusmill", os.path.relpath(p, root)))
        sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
