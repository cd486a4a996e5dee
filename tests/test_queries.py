"""Every query with SQL against DuckDB on the smallest tables, by value."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from gristmill.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def canonical(df):
    def text(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, (float, np.floating)):
            return repr(round(float(v), 9))
        return str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(text(v) for v in row) for row in df.astype(object).itertuples(index=False)), list(df.columns)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    ours, names = canonical(registry.QUERIES[name](spark, SF).toPandas())
    theirs, sql_names = canonical(duck.sql(registry.ORACLES[name]).df())
    assert names == sql_names
    whole = lambda rows: [tuple(x.removesuffix(".0") for x in r) for r in rows]  # noqa: E731  integers beside nulls come as floats
    assert whole(ours) == whole(theirs)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_resampling_has_the_draws_of_the_reference(spark, monkeypatch):
    assert registry.QUERIES["sign_flip_p"](spark, SF).first().draws == 100_000
    from gristmill.operators import stats

    drawn, bootstrap = [], stats.bootstrap
    monkeypatch.setattr(stats, "bootstrap", lambda *a: drawn.append(bootstrap(*a)) or drawn[-1])
    registry.QUERIES["cluster_bootstrap_ci"](spark, SF)
    assert drawn[0].count() == 20_000
