"""Every registered query equals its DuckDB oracle on the smallest shared tables."""

import importlib.util
import os

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


def _load(name, path):
    spec = importlib.util.spec_from_file_location(name, path)
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


entry = _load("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
check = _load("oracle_check", os.path.join(ROOT, "scripts", "oracle_check.py"))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in check.TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_every_query_has_an_oracle():
    assert set(entry.QUERIES) == set(entry.SQL)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert [r["statistic"] for r in rows] == ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]


@pytest.mark.parametrize("key", sorted(entry.QUERIES))
def test_query_matches_oracle(spark, duck, key):
    got = entry.queries()[key](spark, SF).toPandas()
    want = duck.execute(entry.oracle_sql()[key]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert check.digest(got) == check.digest(want)
