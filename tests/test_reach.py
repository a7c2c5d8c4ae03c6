"""Impact with its links, affected files, bounded top lists, declarators."""

import random

import pytest

from factloom.operators import compat, extract_facts, graph, reports

REFS = "target_symbol string, source_symbol string, kind string, file string"


def test_links_of_first_discovery(spark):
    refs = [
        ("a.ts:x", "b.ts:x", "Usage", "b.ts"), ("a.ts:x", "b.ts:x", "Call", "b.ts"), ("a.ts:y", "b.ts:x", "Call", "b.ts"), ("b.ts:x", "c.ts:x", "New", "c.ts"), ("a.ts:x", "c.ts:z", "Call", "c.ts"), ("c.ts:x", "a.ts:x", "Call", "a.ts"), ("c.ts:x", "bare", "Call", "d.ts"),
        ("other:x", "e.ts:x", "Call", "e.ts"),
    ]
    links = graph.impact_links(spark.createDataFrame(refs, REFS), spark.createDataFrame([("a.ts:x",), ("a.ts:y",), ("z.ts:lone",), ("word",)], "symbol string"))
    got = sorted(tuple(r) for r in links.select("depth", "from_symbol", "to_symbol", "kind", "file").collect())
    assert got == [(1, "a.ts:x", "b.ts:x", "Call", "b.ts"), (1, "a.ts:x", "c.ts:z", "Call", "c.ts"), (2, "b.ts:x", "c.ts:x", "New", "c.ts"), (3, "c.ts:x", "bare", "Call", "d.ts")]
    seeds = spark.createDataFrame([("a.ts:x",), ("z.ts:lone",), ("word",)], "symbol string")
    assert [tuple(r) for r in graph.affected_files(links, seeds).orderBy("place").collect()] == [("a.ts", 1), ("b.ts", 2), ("c.ts", 3), ("d.ts", 4), ("z.ts", 5)]
    none = graph.impact_links(spark.createDataFrame(refs, REFS), seeds.limit(0))
    assert none.collect() == [] and graph.affected_files(none, seeds.limit(0)).collect() == []


def test_api_surface(spark):
    rows = [(f"m{m}", f"s{i}", "function", i) for m in range(30) for i in range(m * 3)]
    got = reports.api_surface(spark.createDataFrame(rows, "module string, name string, kind string, at int"), 4, 5).collect()
    assert sorted((r["module_place"], r["place"], r["module"], r["name"], r["n_symbols"]) for r in got) == [(k + 1, i + 1, f"m{29 - k}", f"s{i}", (29 - k) * 3) for k in range(4) for i in range(5)]


def test_package_modules_shows_the_first(spark):
    rows = [("p", f"m{i:03}") for i in range(50)] * 2 + [("q", "m1")]
    got = {r["package"]: (r["affected"], r["modules"]) for r in compat.package_modules(spark.createDataFrame(rows, "package string, module string")).collect()}
    assert got == {"p": (50, [f"m{i:03}" for i in range(20)]), "q": (1, ["m1"])}


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("const a = 1, b = 2;", [("a", "variable", ""), ("b", "variable", "")]),
        ("let a, b: Map<x, y> = z, c;", [("a", "variable", ""), ("b", "variable", ""), ("c", "variable", "")]),
        ("const { p, q } = f(1, 2), r = (u, v) => u;", [("r", "function", "u, v")]),
        ("export const f = async (n: number) => n, g = function (m) { return m; };", [("f", "function", "n: number"), ("g", "function", "m")]),
        ("var a = [1, 2], b = { c: 1, d: 2 };", [("a", "variable", ""), ("b", "variable", "")]),
        ("export default class { m() {} }", [("default", "class", "")]),
        ("export default async function (x) { const y = 1, z = 2; }", [("default", "function", "x")]),
        ("for (const i of [1, 2]) { let j = 1, k = 2; }", []),
    ],
)
def test_declarators(spark, line, want):
    f = spark.createDataFrame([("m.ts", line, "typescript")], "path string, source string, language string")
    assert [(r["name"], r["kind"], r["params"]) for r in extract_facts.symbols(f).orderBy("ordinal").collect()] == want


def test_witness_cycles(spark):
    draw = random.Random(5)
    edges = {(draw.randrange(40), draw.randrange(40)) for _ in range(60)} | {(100 + i, 100 + (i + 1) % 12) for i in range(12)} | {(200, 201), (201, 200), (200, 200), (300, 300), (301, 302)}
    df = spark.createDataFrame([(f"{a:03}", f"{b:03}") for a, b in edges], "src string, dst string")
    members = graph.cyclic_components(df)
    of = {r["id"]: r["component"] for r in members.collect()}
    paths = {}
    for r in graph.witness_cycles(df, members).orderBy("component", "place").collect():
        paths.setdefault(r["component"], []).append((r["place"], r["id"]))
    assert set(paths) == set(of.values()) and "100" in paths and "200" in paths
    out = {}
    for a, b in edges:
        if a != b:
            out.setdefault(f"{a:03}", set()).add(f"{b:03}")
    for component, rows in paths.items():
        ids = [x for _, x in rows]
        assert [p for p, _ in rows] == list(range(1, len(rows) + 1)) and ids[0] == ids[-1] == component and len(set(ids[:-1])) == len(ids) - 1
        assert all(b in out[a] for a, b in zip(ids, ids[1:], strict=False))
        level, depth, reached = {component}, 0, set()
        while component not in reached:
            level = {b for a in level for b in out.get(a, ()) if of.get(b) == component} - reached
            reached |= level
            depth += 1
        assert len(ids) - 1 == depth
    assert graph.witness_cycles(df.filter("src > '300'"), members.limit(0)).collect() == []
