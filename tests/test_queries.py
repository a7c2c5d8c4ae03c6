"""Every registered core query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from factloom.plans import queries

SF = "/root/testdata/sf0.001"
CON = duckdb.connect()
for path in glob.glob(f"{SF}/*.parquet"):
    CON.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")


def norm(v):
    return round(v, 9) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in queries.ORACLE_SQL:
        assert got
        return
    found = CON.execute(queries.ORACLE_SQL[name])
    columns = [x[0] for x in found.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    rows = sorted(([norm(r[columns.index(c)]) for c in order] for r in found.fetchall()), key=repr)
    assert sorted(([norm(r[c]) for c in order] for r in got), key=repr) == rows
