"""Layers of deep graphs against a plain longest path, and the rounds that they take."""

import random

from factloom.operators import graph


def plain(pairs, nodes):
    """Layers by repeatedly taking what nothing left depends on."""
    links = {(a, b) for a, b in pairs if a != b}
    left, layers = set(nodes), {}
    layer = 0
    while True:
        free = {n for n in left if not any(b == n and a in left for a, b in links)}
        if not free:
            return layers | dict.fromkeys(left, layer)
        layers |= dict.fromkeys(free, layer)
        left -= free
        layer += 1


def layers(spark, pairs, extra=()):
    edges = spark.createDataFrame(pairs, "src string, dst string")
    nodes = graph.node_set(edges).unionByName(spark.createDataFrame([(n,) for n in extra], "id string"))
    got = graph.layers_topdown(edges, nodes).collect()
    assert len(got) == len({r["id"] for r in got})
    return {r["id"]: r["layer"] for r in got}


def check(spark, pairs, extra=()):
    assert layers(spark, pairs, extra) == plain(pairs, {x for p in pairs for x in p} | set(extra))


def test_layers_of_random_graphs(spark):
    rng = random.Random(3)
    for n, m, forward in ((9, 12, True), (14, 15, True), (12, 14, False), (10, 22, False), (25, 26, True)):
        pairs = [(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if not forward or a < b]
        check(spark, [(f"n{a:02}", f"n{b:02}") for a, b in pairs])


def test_layers_of_chains_diamonds_and_what_cycles_hold(spark):
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(40)]
    comb = [(f"leaf{i}", f"c{i:03}") for i in range(0, 40, 3)]
    late = [("x0", "x1"), ("x1", "x2"), ("x2", "x3"), ("x3", "c001")]  # a longer way in beside the chain
    diamonds = [e for i in range(12) for e in ((f"d{i:02}", f"l{i}"), (f"d{i:02}", f"r{i}"), (f"l{i}", f"d{i + 1:02}"), (f"r{i}", f"d{i + 1:02}"))]
    check(spark, chain + comb + late + diamonds + chain[:3], extra=["alone"])
    ring = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "tail1"), ("tail1", "tail2"), ("free", "tail2"), ("s", "e"), ("e", "v"), ("v", "e")]
    check(spark, ring + chain[:4] + [("own", "own")])
    check(spark, [("a", "b"), ("b", "a")])
    check(spark, [("a", "a")])


def test_a_chain_of_100000_ids_takes_few_rounds(spark, monkeypatch):
    calls = []
    real = graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: calls.append(1) or real(df))
    n = 100_000
    edges = spark.range(n).selectExpr("lpad(id, 7, '0') AS src", "lpad(id + 1, 7, '0') AS dst")
    got = graph.layers_topdown(edges, graph.node_set(edges))
    assert got.count() == n + 1 and got.filter("layer <> cast(id AS long)").isEmpty()
    assert len(calls) <= 40
