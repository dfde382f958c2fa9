"""Every registered query against its SQL oracle in DuckDB (sf0.001, whole tables)."""
import math

import duckdb
import pytest

from __spark_entry__ import entry
from montevar.plans.catalog import queries
from montevar.plans.oracle import oracle_sql
from tests.conftest import SF_SMALL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    return repr(v)


def _rows(records, cols):
    return sorted(tuple(_norm(r[c]) for c in cols) for r in records)


def test_every_query_has_an_oracle():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_oracle(built_queries, duck, name):
    df = built_queries(name)
    cols = sorted(df.columns)
    got = _rows([r.asDict() for r in df.collect()], cols)
    res = duck.execute(oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(dcols) == cols
    want = _rows([dict(zip(dcols, r)) for r in res.fetchall()], cols)
    assert got == want


def test_entry_smoke(spark):
    rows = entry(spark).collect()
    assert len(rows) == 1 and rows[0].trials == 10_000
    assert rows[0].conditional_var <= rows[0].value_at_risk
