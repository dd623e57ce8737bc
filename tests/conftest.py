"""One local session for all tests; tables of the smallest scale and their DuckDB views."""

from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from papyrine.shipping import ship

    root = tmp_path_factory.mktemp("shared")
    s = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{root}/checkpoints").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return ship(s)


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        if f.endswith(".parquet"):
            con.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


def canon(v):
    """A value as text: floats to nine digits, nested values in order."""
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, list | tuple):
        return str([canon(x) for x in v])
    return str(v)


@pytest.fixture(scope="session")
def agrees(spark, sf, duck):
    """Whether a query's rows equal its SQL's, whatever their order."""

    def check(run, sql: str) -> int:
        df = run(spark, sf)
        cols = sorted(df.columns)
        got = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
        rel = duck.sql(sql)
        assert sorted(rel.columns) == cols
        want = sorted(tuple(canon(dict(zip(rel.columns, r, strict=True))[c]) for c in cols) for r in rel.fetchall())
        assert got == want
        return len(got)

    return check
