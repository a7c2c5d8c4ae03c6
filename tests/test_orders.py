"""Lists whose order matters, in the order in which they come."""

import duckdb

from factloom.operators import reports
from factloom.plans import queries, relations

SF = "/root/testdata/sf0.001"


def in_order(spark, name, order):
    con = duckdb.connect()
    for t in ("events", "supplier", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL[name]}) ORDER BY {order}").fetchall()
    assert len(want) > 1 and [tuple(r) for r in got.collect()] == want


def test_tasks_and_layers(spark):
    in_order(spark, "op_t5_layer_members", "layer, in_degree DESC, module")
    failed = queries.tasks.listed(queries._states(spark, SF)).collect()
    assert len(failed) > 5 and failed == sorted(failed, key=lambda r: (r["layer"], -r["in_degree"], r["module"]))
    assert relations.tasks(spark, SF).count() == len(failed)


def test_recommendations(spark):
    in_order(spark, "op_t4_recommendations", "high_impact DESC, affected DESC, package")


def test_directions_by_their_text(spark):
    rows = [("L2", "b", "p", "s"), ("L10", "z", "p", "s"), ("L2", "a", "q", "t"), ("L2", "a", "p", "u"), ("L2", "a", "p", "t")]
    uncut = spark.createDataFrame(rows, "direction string, consumer string, provider string, symbol string")
    assert [tuple(r) for r in reports.by_direction(uncut).collect()] == sorted(rows)
    assert [tuple(r) for r in reports.by_direction(uncut, 2).collect()] == sorted(rows)[:2]
