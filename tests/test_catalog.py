"""The registered queries: names, SQL, and equality with DuckDB for a spread of them at the smallest scale."""

import json
import math
import os

import pytest

import __spark_entry__ as entry
from lumenlog.plans import catalog

SF_DIR = os.environ.get("LUMENLOG_TEST_SF", "/root/testdata/sf0.001")
COMPARED = sorted(k for k in catalog.ORACLES)
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF_DIR):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_DIR}/{t}.parquet')")
    return con


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "summary" in entry.queries()


@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    ran = duck.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in ran.description]
    assert sorted(df.columns) == sorted(cols)
    want = sorted(tuple(cell(r[cols.index(c)]) for c in sorted(cols)) for r in ran.fetchall())
    assert sorted(tuple(cell(r[c]) for c in sorted(cols)) for r in df.collect()) == want
    spark.catalog.clearCache()


def test_entry(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables")
    report = json.loads(entry.entry(spark).first()["report"])
    assert report["total_events"] > 0 and report["likely_causes"][0]["fixes"] and report["splunk_queries"] and report["hung_thread_drilldown"]
