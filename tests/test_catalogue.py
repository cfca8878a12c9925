"""Every registered query against its SQL in DuckDB."""

import duckdb
import pytest

from spectral_lake.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    number = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(repr(tuple(map(number, r))) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows_as_sql(spark, con, name):
    assert rows(catalogue.QUERIES[name](spark, SF).toPandas()) == rows(con.execute(catalogue.ORACLES[name]).df())


def test_wide_equality_is_planned_as_a_join(spark):
    plan = catalogue.map_tolerance(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
