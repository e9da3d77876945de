"""Every registered query equals its DuckDB oracle (rows, columns, values)."""

import decimal
import math
from datetime import date, datetime

import duckdb
import pytest

from creditline.plans.registry import all_oracle_sql, all_queries
from tests.conftest import SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        if math.isnan(f) or math.isinf(f):
            return str(f)
        return float(f"{f:.9g}")
    if isinstance(v, datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, date):
        return v.isoformat()
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(all_oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = all_queries()[name](spark, SMALL)
    got = [tuple(r) for r in df.collect()]
    res = duck.execute(all_oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    want = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(got) == len(want)
    assert _rows(df.columns, got) == _rows(ocols, want)


def test_every_query_has_oracle():
    assert set(all_queries()) == set(all_oracle_sql())
