"""Every registered query against its SQL on the smallest tables, and the core without the subpackage that may be left out."""

import datetime as dt
import glob
import math
import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from corpusmill.plans import registry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SLOW = {"cross_validated_scores"}


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 8)
    return v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


def table(arrow):
    names = sorted(arrow.column_names)
    return names, sorted(repr([value(r[c]) for c in names]) for r in arrow.to_pylist())


@pytest.fixture(scope="module")
def duck(small):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{small}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - SLOW))
def test_query(spark, small, duck, name):
    got = entry.queries()[name](spark, small).toArrow()
    sql = entry.oracle_sql().get(name)
    if sql:
        assert table(got) == table(duck.sql(sql).to_arrow_table())


def test_entry_has_rows(spark, small):
    assert entry.entry(spark).count() > 0


def test_sql_names_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_stands_alone():
    """Nothing outside the subpackage imports it."""
    code = "import sys; sys.modules['corpusmill.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and 'p6_found' in q and 'p3_found' not in q"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)
    for folder, _, files in os.walk(os.path.join(ROOT, "corpusmill")):
        if not folder.endswith("llm"):
            for f in files:
                if f.endswith(".py"):
                    assert "corpusmill.llm" not in open(os.path.join(folder, f)).read()


def test_order_does_not_matter(spark, small, tmp_path):
    """Shuffled input gives the same rows."""
    for n in ("cleaned_articles", "source_decisions", "silver", "human_benchmark_split", "raw_news", "total_coverage"):
        spark.read.parquet(f"{small}/{n}.parquet").repartition(5).write.parquet(f"{tmp_path}/{n}.parquet")
    for q in ("dedupe_articles", "screen_articles", "silver_labels", "silver_pool", "benchmark_union", "sample_allocated", "sample_source_capped", "split_calibration", "p6_found"):
        assert table(registry.QUERIES[q](spark, str(tmp_path)).toArrow()) == table(registry.QUERIES[q](spark, small).toArrow())
