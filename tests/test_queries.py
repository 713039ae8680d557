"""Every registered query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from lexloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    found = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        found.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return found


def rows_of(columns, rows, order):
    clean = lambda v: (round(v, 9) if math.isfinite(v) else str(v)) if isinstance(v, float) else v
    return sorted((tuple(clean(r[columns.index(c)]) for c in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    result = db.sql(catalog.oracle_sql()[name])
    order = sorted(df.columns)
    assert sorted(result.columns) == order
    assert rows_of(df.columns, df.collect(), order) == rows_of(result.columns, result.fetchall(), order)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
