"""Graph operators on small graphs."""

import random

from factloom.operators import boundaries, compat, diff, graph, tasks


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


CALCULATOR = [("utils", "types"), ("index", "types"), ("index", "utils")]


def test_layers_and_degrees_of_the_calculator(spark):
    e = edges(spark, CALCULATOR)
    n = graph.node_set(e)
    assert {r["id"]: r["layer"] for r in graph.layers_topdown(e, n).collect()} == {"index": 0, "utils": 1, "types": 2}
    assert {r["id"]: r["layer"] for r in graph.layers_bottomup(e, n).collect()} == {"index": 2, "utils": 1, "types": 0}
    assert {r["id"]: (r["in_degree"], r["out_degree"]) for r in graph.degrees(e).collect()} == {"types": (2, 0), "utils": (1, 1), "index": (0, 2)}


def test_cycles_hold_layers_back(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "b"), ("a", "a")])
    assert {r["id"]: r["layer"] for r in graph.layers_topdown(e, graph.node_set(e)).collect()} == {"a": 0, "b": 1, "c": 1}
    assert [r["id"] for r in graph.self_loops(e).collect()] == ["a"]
    empty = edges(spark, [])
    assert graph.layers_topdown(empty, graph.node_set(empty)).collect() == []
    assert graph.cyclic_components(empty).collect() == []


def test_cyclic_components_against_reachability(spark):
    rng = random.Random(7)
    for n in (6, 14):
        pairs = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(int(n * 1.6))]
        reach = {(a, b) for a, b in pairs if a != b}
        while True:
            more = reach | {(a, d) for a, b in reach for c, d in reach if b == c}
            if more == reach:
                break
            reach = more
        ids = {x for p in pairs for x in p}
        want = {a: min(b for b in ids if a == b or ((a, b) in reach and (b, a) in reach)) for a in ids if any(b != a and (a, b) in reach and (b, a) in reach for b in ids)}
        assert {r["id"]: r["component"] for r in graph.cyclic_components(edges(spark, pairs)).collect()} == want


def test_impact(spark):
    refs = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("x", "y")], "target string, source string")
    got = graph.impact(refs, spark.createDataFrame([("a",)], "id string")).collect()
    assert sorted((r["id"], r["depth"], r["via"]) for r in got) == [("a", 0, None), ("b", 1, "a"), ("c", 1, "a")]


SYMBOL = "module string, name string, kind string, ordinal long, line_start long, line_end long, params array<struct<name:string,type:string,optional:boolean>>, return_type string, is_async boolean, value string, doc string, attributes array<string>, children array<struct<kind:string,name:string>>"


def symbol(name, ordinal, params=(), children=(), kind="function", returns=None, is_async=False, lines=10, value=None):
    return ("m", name, kind, ordinal, 0, lines, [tuple(p) for p in params], returns, is_async, value, None, [], [tuple(c) for c in children])


def test_symbol_changes(spark):
    old = spark.createDataFrame([symbol("f", 1, [("a", "string", False), ("b", "number", False)], returns="void"), symbol("gone", 2, kind="enum", lines=40), symbol("before", 3, children=[("method", "x"), ("method", "y")]), symbol("C", 4, kind="const", value="1")], SYMBOL)
    new = spark.createDataFrame([symbol("f", 1, [("z", "string", False), ("b", "string", True), ("c", "number", False)], returns="number", is_async=True), symbol("after", 3, children=[("method", "x"), ("method", "w")]), symbol("C", 4, kind="const")], SYMBOL)
    mapping = {(r["old_name"], r["new_name"]): r["status"] for r in diff.symbol_mapping(old, new).collect()}
    assert mapping == {("f", "f"): "stable", ("C", "C"): "stable", ("before", "after"): "renamed", ("gone", None): "removed"}
    got = {(r["name"], r["aspect"], r["detail"]): r["severity"] for r in diff.symbol_changes(old, new).collect()}
    assert got == {
        ("f", "param_renamed", "a->z"): "compatible",
        ("f", "param_added", "c"): "compatible",
        ("f", "param_type", "number->string"): "breaking",
        ("f", "param_optional", "b"): "compatible",
        ("f", "return_type", "void->number"): "breaking",
        ("f", "async", "false->true"): "breaking",
        ("after", "name", "before->after"): "compatible",
        ("after", "method", "+w"): "compatible",
        ("after", "method", "-y"): "breaking",
        ("C", "value", "1->"): "compatible",
        ("gone", "symbol", "gone"): "breaking",
    }
    assert diff.symbol_changes(old, old).collect() == []


def test_best_matches_and_ties(spark):
    a = spark.createDataFrame([("chalk", "library", ["color", "terminal"]), ("lone", "framework", ["z"]), ("odd", "other", ["q"])], "name string, lib_type string, tags array<string>")
    b = spark.createDataFrame([("colored", "library", ["terminal", "color"]), ("colors", "library", ["color", "terminal"]), ("web", "framework", ["http"])], "name string, lib_type string, tags array<string>")
    got = {r["name"]: (r["equivalent"], round(r["similarity"], 6), r["level"]) for r in compat.best_matches(a, b).collect()}
    assert got == {"chalk": ("colored", 1.0, "full"), "lone": ("web", 0.2, "none"), "odd": (None, 0.0, "unknown")}


def test_queue_and_verification(spark):
    modules = spark.createDataFrame([("src/high.ts", 0, 2), ("src/low.ts", 0, 0)], "module string, layer int, in_degree long")
    assert tasks.next_task(tasks.queue(modules)).first()["module"] == "src/high.ts"
    spec = spark.createDataFrame([("f.rs", "get_user", "function", 1, "User", False), ("f.rs", "UserKind", "interface", 0, None, False), ("f.rs", "missing", "function", 0, None, False)], "file string, target_name string, kind string, n_params long, return_type string, is_async boolean")
    made = spark.createDataFrame([("f.rs", "getUser", "function", 1, "User", False, 3), ("f.rs", "get_user", "struct", 9, "X", True, 9), ("f.rs", "user_kind", "enum", 0, None, False, 1)], "file string, name string, kind string, n_params long, return_type string, is_async boolean, line long")
    checks = {r["target_name"]: (r["found"], r["structural"]) for r in tasks.verification(spec, made).collect()}
    assert checks == {"get_user": (True, 1.0), "UserKind": (True, 1.0), "missing": (False, 0.0)}
    v = tasks.verdicts(tasks.verification(spec, made)).first()
    assert abs(v["similarity"] - 2 / 3) < 1e-9 and not v["passed"]


def test_uncut_counts_a_missing_layer_as_zero(spark):
    refs = spark.createDataFrame([("a", "b", "s", "Call"), ("a", "b", "s", "Access"), ("b", "a", "t", "Call"), ("a", "new", "u", "Call")], "consumer string, provider string, symbol string, kind string")
    layers = spark.createDataFrame([("a", 2), ("b", 1)], "id string, layer int")
    got = sorted((r["consumer"], r["provider"], r["kind"], r["direction"]) for r in boundaries.uncut(refs, layers).collect())
    assert got == [("a", "b", "Access", "L2->L1"), ("a", "new", "Call", "L2->L0")]


def test_queue_is_numbered_in_parts(spark):
    rows = [(f"m{i * 37 % 500:03}", i % 3 if i % 50 else None, i % 7 if i % 41 else None) for i in range(500)]
    modules = spark.createDataFrame(rows, "module string, layer int, in_degree int")
    queue = tasks.queue(modules)
    assert "SinglePartition" not in queue._jdf.queryExecution().executedPlan().toString()
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is None, -(r[2] or 0), r[0]))
    assert [(r["task"], r["module"]) for r in sorted(queue.collect(), key=lambda r: r["task"])] == [(i + 1, r[0]) for i, r in enumerate(want)]
    assert tasks.queue(modules.filter("false")).collect() == []
