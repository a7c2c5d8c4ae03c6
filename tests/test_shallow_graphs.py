"""Layers of shallow graphs: what they sort, and what is left to the rounds for deep graphs."""

from factloom.operators import boundaries, graph


def test_shallow_graphs_are_peeled_without_rounds(spark, monkeypatch):
    """Leaves hold nearly all edges here: none of them may reach the rounds, which sort and write all that they get."""
    monkeypatch.setattr(graph, "settled", lambda df: (_ for _ in ()).throw(AssertionError("a round for deep graphs")))
    leaves = [(f"leaf{i}", f"mid{(i + j) % 20}") for i in range(300) for j in range(3)]
    pairs = leaves + leaves[:50] + [(f"mid{i}", f"top{i % 2}") for i in range(20)] + [("mid0", "mid0")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    nodes = graph.node_set(edges).unionByName(spark.createDataFrame([("alone",)], "id string"))
    got = {r["id"]: r["layer"] for r in graph.layers_topdown(edges, nodes).collect()}
    want = {"alone": 0} | {f"leaf{i}": 0 for i in range(300)} | {f"mid{i}": 1 for i in range(20)} | {"top0": 2, "top1": 2}
    assert got == want
    assert {r["id"]: r["layer"] for r in graph.layers_bottomup(edges, nodes).collect()} == {k: 2 - v for k, v in want.items()}


def test_what_is_left_after_peeling_keeps_its_layers(spark):
    """Two layers are peeled, then a chain, a shorter way in beside it and a cycle are left to the rounds."""
    chain = [(f"c{i:02}", f"c{i + 1:02}") for i in range(12)]
    pairs = [(f"leaf{i}", f"mid{i % 9}") for i in range(200)] + [(f"mid{i}", f"c{(i * 5) % 4:02}") for i in range(9)] + [("mid1", "c07")] + chain + [("c12", "x"), ("x", "y"), ("y", "x")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    got = {r["id"]: r["layer"] for r in graph.layers_topdown(edges, graph.node_set(edges)).collect()}
    assert got == {f"leaf{i}": 0 for i in range(200)} | {f"mid{i}": 1 for i in range(9)} | {f"c{i:02}": i + 2 for i in range(13)} | {"x": 15, "y": 15}


def test_uncut_surfaces_sort_references_once(spark):
    refs = spark.createDataFrame([("a", "b", "s", "Call")], "consumer string, provider string, symbol string, kind string").repartition(4)
    layers = spark.createDataFrame([("a", 2), ("b", 1)], "id string, layer int").repartition(4)
    plan = boundaries.uncut(refs, layers)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("ShuffledHashJoin") == 2
