"""Every registered query against its independent DuckDB SQL on the smallest
driver tables (the same gate the driver applies at sf0.01)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from platewise.plans.queries import REGISTRY  # noqa: E402
from tools.check_oracle import TABLES, rows_of
from tools.check_types import type_mismatches

# the optional training-data queries have tests of their own (tests/llm)
QUERIES = {name: fn for name, fn in E.queries().items() if name in REGISTRY}
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    yield c
    c.close()


def test_every_query_has_oracle_sql():
    assert set(QUERIES) <= set(E.oracle_sql())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["res_id", "sort_score", "res_name", "res_score", "res_cuisines", "dish_names"]
    assert df.count() >= 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    rel = con.sql(E.oracle_sql()[name])
    assert type_mismatches(df.schema, rel.columns, rel.types) == {}
    res = con.execute(E.oracle_sql()[name])
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    assert sorted(s_cols) == sorted(d_cols)
    assert rows_of(s_cols, s_rows) == rows_of(d_cols, d_rows)


def test_readme_names_every_registered_query():
    readme = open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "README.md")).read()
    assert [q for q in sorted(QUERIES) if f"`{q}`" not in readme] == []
