"""What the rounds that look for cycles carry, and how often their edges are read."""

from factloom.operators import graph
from factloom.plans import queries


def test_rounds_carry_numbers_in_the_order_of_ids(spark, monkeypatch):
    types, real = set(), graph._least
    monkeypatch.setattr(graph, "_least", lambda ids, edges, of, by: types.update(t for _, t in edges.dtypes) or real(ids, edges, of, by))
    pairs = [("b", "a10"), ("a10", "a9"), ("a9", "b"), ("é", "z"), ("z", "é"), ("z", "a9"), ("in", "b"), ("b", "out"), ("b", "b")]
    got = {r["id"]: r["component"] for r in graph.cyclic_components(spark.createDataFrame(pairs, "src string, dst string")).collect()}
    assert got == {"a10": "a10", "a9": "a10", "b": "a10", "z": "z", "é": "z"}
    assert types and "string" not in types


def test_the_graph_query_builds_its_edges_once(spark, monkeypatch):
    seen, flows = spark.sparkContext.accumulator(0), queries.R.flows(spark, "/root/testdata/sf0.001").limit(40).collect()

    def tell(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(queries.R, "flows", lambda s, _: s.createDataFrame(flows, "src string, dst string").mapInArrow(tell, "src string, dst string"))
    assert queries.op_g1_build_graph(spark, "").count() == len({x for r in flows for x in r})
    assert seen.value == len(flows) == 40
