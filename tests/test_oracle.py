"""Every registered query against its DuckDB oracle (row count, columns, values)."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as E
from tools.compare import TABLES, digest, rows_of

from conftest import SF_SMALL

KEYS = sorted(k for k in E.oracle_sql() if not k.startswith("op"))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    got = E.queries()[key](spark, SF_SMALL).toPandas()
    want = con.execute(E.oracle_sql()[key]).fetchdf()
    gc, gr = rows_of(got)
    wc, wr = rows_of(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert digest(gr) == digest(wr)


def test_every_query_has_an_oracle():
    library = {k for k in E.queries() if not k.startswith("op") and k != "pipeline"}
    assert library <= set(E.oracle_sql())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["postTimeRaw", "tag", "count"]
    assert df.count() > 0
