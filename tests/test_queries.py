"""Every registered query of the core against its SQL, on the smallest driver tables."""

import math
import os

import duckdb
import pytest

from fluxpanel.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def cell(v):
    v = v.item() if hasattr(v, "item") else v
    return f"{v:.5g}" if isinstance(v, float) and not math.isnan(v) else repr(v)


def rows(names, columns, values):
    order = [columns.index(n) for n in names]
    return sorted(tuple(cell(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    found = duck.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    names = sorted(df.columns)
    assert names == sorted(columns)
    assert rows(names, df.columns, df.collect()) == rows(names, columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_others_give_rows(spark, name):
    assert not registry.QUERIES[name](spark, DATA).isEmpty()


def test_entry_and_names():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_balances_go_below_zero_as_in_sql(spark, tmp_path):
    name = "balance_recursion"
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (o_totalprice * 10000 AS o_totalprice) FROM '{DATA}/orders.parquet') TO '{tmp_path}/orders.parquet'")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet')")
    df = registry.QUERIES[name](spark, str(tmp_path))
    found = con.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    got, want = df.collect(), found.fetchall()
    assert min(r[columns.index("closing")] for r in want) < 0
    assert rows(sorted(columns), df.columns, got) == rows(sorted(columns), columns, want)
