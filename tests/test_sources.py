"""Source trees, manifests, registries, fact extraction and streaming states on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from factloom.functions import naming
from factloom.operators import align, extract_facts, tokens
from factloom.sources import registry, trees
from factloom.streaming import progress

FILES = [
    ("src/types.ts", "export interface CalcOptions {\n  precision: number;\n}\nexport type Operation = 'add';\n"),
    ("src/utils.ts", "import type { CalcOptions, Operation as Op } from './types';\n// import { no } from './none';\nexport function calculate(op: Op): number {\n  return 1;\n}\nfunction format(x: string) { return x; }\n"),
    ("src/index.ts", "import { calculate } from './utils';\nimport * as all from './types';\nimport def, { x } from 'pkg/sub';\nimport '@scope/side/effect';\nexport { Operation } from './types';\nconst s = 'calculate';\nconst r = calculate(s);\nclass A extends calculate {}\n"),
    ("src/lib.rs", "use crate::a::B;\nuse std::fmt;\nmod inner;\npub async fn run(x: i32) {}\nconst N: i32 = 1;\npub struct S;\n"),
    ("node_modules/x/a.ts", "export const no = 1;"),
    ("README.md", "text"),
]


def files(spark):
    return trees.selected(spark.createDataFrame(FILES, "path string, source string"))


def test_selection_and_globs(spark):
    assert {(r["path"], r["language"]) for r in files(spark).collect()} == {("src/types.ts", "typescript"), ("src/utils.ts", "typescript"), ("src/index.ts", "typescript"), ("src/lib.rs", "rust")}
    kept = trees.selected(spark.createDataFrame(FILES, "path string, source string"), "typescript", ("src/u*.ts", "**/index.ts"))
    assert [r["path"] for r in kept.collect()] == ["src/types.ts"]


def test_scan_reads_a_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.ts").write_text("const é = 1;")
    (tmp_path / "dist").mkdir()
    (tmp_path / "dist" / "b.ts").write_text("no")
    assert [(r["path"], r["source"]) for r in trees.scan(spark, f"file://{tmp_path}").collect()] == [("src/a.ts", "const é = 1;")]
    (tmp_path / "src" / "bad.ts").write_bytes(b"const \xff\xfe = 1;")
    good, bad = trees.unreadable(trees.scan(spark, f"file://{tmp_path}"))
    assert [r["path"] for r in good.collect()] == ["src/a.ts"] and [r["path"] for r in bad.collect()] == ["src/bad.ts"]


def test_facts(spark):
    f = files(spark)
    got = {(r["module"], r["name"], r["kind"], r["is_public"]) for r in extract_facts.symbols(f).collect()}
    assert ("src/utils.ts", "calculate", "function", True) in got and ("src/utils.ts", "format", "function", False) in got
    assert ("src/types.ts", "CalcOptions", "interface", True) in got and ("src/types.ts", "Operation", "type_alias", True) in got
    assert ("src/lib.rs", "run", "function", True) in got and ("src/lib.rs", "N", "const", False) in got and ("src/lib.rs", "S", "struct", True) in got
    found = extract_facts.imports(f)
    assert {(r["module"], r["specifier"], r["is_external"]) for r in found.collect()} == {
        ("src/utils.ts", "./types", False), ("src/index.ts", "./utils", False), ("src/index.ts", "./types", False), ("src/index.ts", "pkg/sub", True), ("src/index.ts", "@scope/side/effect", True),
        ("src/lib.rs", "crate::a::B", False), ("src/lib.rs", "std::fmt", True), ("src/lib.rs", "self::inner", False),
    }
    assert {(r["module"], r["package"]) for r in extract_facts.module_packages(found).collect()} == {("src/index.ts", "pkg"), ("src/index.ts", "@scope/side"), ("src/lib.rs", "std")}
    targets = extract_facts.resolved(found, f)
    assert {(r["module"], r["target"]) for r in targets.collect()} == {("src/utils.ts", "src/types.ts"), ("src/index.ts", "src/utils.ts"), ("src/index.ts", "src/types.ts")}
    bound = extract_facts.bindings(f)
    assert {(r["module"], r["local_name"], r["exported_name"], r["specifier"]) for r in bound.collect()} == {("src/utils.ts", "CalcOptions", "CalcOptions", "./types"), ("src/utils.ts", "Op", "Operation", "./types"), ("src/index.ts", "calculate", "calculate", "./utils"), ("src/index.ts", "def", "default", "pkg/sub"), ("src/index.ts", "x", "x", "pkg/sub"), ("src/lib.rs", "B", "B", "crate::a")}
    uses = {(r["file"], r["target_symbol"], r["line"], r["kind"]) for r in extract_facts.references(f, bound, targets).collect()}
    assert uses == {("src/index.ts", "src/utils.ts:calculate", 7, "Call"), ("src/index.ts", "src/utils.ts:calculate", 8, "Extends"), ("src/utils.ts", "src/types.ts:Operation", 3, "TypeReference")}


def test_manifests_and_snapshots(spark):
    rows = [("package.json", json.dumps({"dependencies": {"a": "^1.0.0"}, "devDependencies": {"b": "2"}})), ("x/Cargo.toml", '[dependencies]\nserde = { version = "1.0", features = [] }\nrand = "0.8"\n'), ("y/package.json", "broken")]
    got = trees.packages(spark, spark.createDataFrame(rows, "path string, source string")).collect()
    assert {(r["package"], r["version"], r["section"]) for r in got} == {("a", "^1.0.0", "dependencies"), ("b", "2", "devDependencies"), ("serde", "1.0", "dependencies"), ("rand", "0.8", "dependencies")}
    old = spark.createDataFrame([("a", "1\n2"), ("b", "x"), ("c", "same")], "path string, source string")
    new = spark.createDataFrame([("a", "1\n3\n4"), ("c", "same"), ("d", "y")], "path string, source string")
    assert sorted(tuple(r) for r in trees.changed_files(old, new).collect()) == [("a", "M", 2, 1), ("b", "D", 0, 1), ("d", "A", 1, 0)]
    assert trees.latest_tag(spark.createDataFrame([("v1.9.0",), ("v1.10.0",), ("v1.10",)], "tag string")).first()["tag"] == "v1.10.0"


def test_registry(spark, tmp_path):
    (tmp_path / "web.toml").write_text('[library.one]\ntype = "framework"\ndescription = "d"\ntags = ["a", "b"]\n[library.two]\ntags = "odd"\n')
    assert [tuple(r) for r in registry.libraries(spark, str(tmp_path), "ts").collect()] == [("ts", "one", "framework", "d", ["a", "b"])]
    over = tmp_path / "over.toml"
    over.write_text('[axios]\ncompatibility = " Full "\npackages = { rust = "reqwest" }\nguidance = { rust = "use it" }\n[left]\nguidance = "no"\n')
    assert sorted(tuple(r) for r in registry.overrides(spark, str(over), "rust").collect()) == [("axios", "reqwest", "full", [], "use it"), ("left", None, "unknown", [], "no")]


def test_streamed_states(spark, tmp_path):
    spark.createDataFrame([("m", 1, "pending"), ("m", 2, "in_progress"), ("m", 3, "verified"), ("m", 4, "failed"), ("n", 1, "in_progress"), ("n", 2, "failed")], "module string, at long, status string").write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema("module string, at long, status string").parquet(f"{tmp_path}/e")
    query = progress.latest_states(stream).writeStream.outputMode("complete").format("memory").queryName("states").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(tuple(r) for r in spark.sql("SELECT * FROM states").collect()) == [("m", "verified", 1), ("n", "failed", 1)]


SCRIPT = """/* head
 export function hidden() {}
*/
import def, { a, b as c } from './lib';
import type { Q } from '@/q/types';
export { z as y } from './z';
export class Foo extends a implements Q {
  private name: string = "x(1)";
  constructor(readonly k: number) { super(); }
  run(x: c, y?: Map<string, number>): boolean {
    return a(x) || this.run(c.b, y) || new c(a);
  }
}
export const go = async (n: number) => {
  const u = 'http://x'; a(1); a(2);
};
export default function main(p: string, q) : Promise<void> { go(1); /* b() */ helper({ a: 1 }); }
type U = { k: a } | string;
const last = 1
"""


def test_facts_over_lines_and_strings(spark):
    f = spark.createDataFrame([("src/a.ts", SCRIPT, "typescript")], "path string, source string, language string")
    got = [(r["name"], r["kind"], r["line"], r["line_end"], r["is_public"], r["params"]) for r in extract_facts.symbols(f).orderBy("ordinal").collect()]
    assert got == [("Foo", "class", 7, 13, True, ""), ("go", "function", 14, 16, True, "n: number"), ("main", "function", 17, 17, True, "p: string, q"), ("U", "type_alias", 18, 18, False, ""), ("last", "variable", 19, 19, False, "")]
    stmts = tokens.statements(tokens.tokens(f))
    declared = tokens.declarations(stmts)
    within = tokens.members(stmts, declared)
    assert [(r["name"], r["kind"], r["line"]) for r in within.orderBy("i").collect()] == [("name", "property", 8), ("constructor", "constructor", 9), ("run", "method", 10)]
    assert {(r["caller"], r["callee"]) for r in tokens.calls(stmts, declared, within).collect()} == {("Foo", "a"), ("Foo", "run"), ("go", "a"), ("main", "go"), ("main", "helper")}
    assert [r["signature"] for r in tokens.signatures(f, stmts, declared).collect()] == ["export function main(p: string, q: unknown) -> Promise<void>"]
    assert [tuple(r) for r in extract_facts.reexports(f).collect()] == [("src/a.ts", "y", "z", "./z")]
    targets = spark.createDataFrame([("src/a.ts", "./lib", "L"), ("src/a.ts", "@/q/types", "Q")], "module string, specifier string, target string")
    uses = [(r["line"], r["col"], r["target_symbol"], r["kind"]) for r in extract_facts.references(f, extract_facts.bindings(f), targets).collect()]
    assert sorted(uses) == [
        (7, 25, "L:a", "Extends"), (7, 38, "Q:Q", "Implements"), (10, 9, "L:b", "Extends"), (11, 11, "L:a", "Call"), (11, 28, "L:b", "Call"),
        (11, 43, "L:b", "New"), (11, 45, "L:a", "New"), (15, 24, "L:a", "Call"), (15, 30, "L:a", "Call"), (18, 14, "L:a", "TypeReference"),
    ]


def test_aliases(spark):
    rows = [("package.json", json.dumps({"imports": {"#x/*": "./lib/*", "#y": {"default": "./d.ts", "source": "./s.ts"}}})), ("tsconfig.json", '{ // a comment\n "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*", "no/*"]}}}'), ("p/package.json", "broken"), ("p/q/tsconfig.json", "{}")]
    got = trees.aliases(spark.createDataFrame(rows, "path string, source string"))
    assert [(r["prefix"], r["target"]) for r in got.orderBy("at").collect()] == [("#x/", "./lib/"), ("#y", "./s.ts"), ("@/", "./src/")]
    found = spark.createDataFrame([("src/a.ts", "@/b"), ("src/a.ts", "#x/c"), ("src/a.ts", "#y"), ("src/a.ts", "none")], "module string, specifier string")
    files_ = spark.createDataFrame([("src/b.ts",), ("lib/c/index.ts",), ("s.ts",)], "path string")
    assert {(r["specifier"], r["target"]) for r in extract_facts.resolved(found, files_, got).collect()} == {("@/b", "src/b.ts"), ("#x/c", "lib/c/index.ts"), ("#y", "s.ts")}


def test_generics_are_those_of_the_pair(spark, tmp_path):
    (tmp_path / "type_map.toml").write_text('[type_mapping]\n"String" = "string"\n"Option<{T}>" = "{T} | null"\n"HashMap<{K}, {V}>" = "Map<{K}, {V}>"\n')
    rules = registry.conventions(str(tmp_path))
    names = spark.createDataFrame([("Option<String>",), ("HashMap<String, u8>",), ("Promise<string>",)], "t string")
    assert [r[0] for r in names.select(naming.translate_type(F.col("t"), rules)).collect()] == ["string | null", "Map<string, u8>", "Promise<string>"]
    assert [r[0] for r in names.select(naming.translate_type(F.col("t"))).collect()] == ["Option<String>", "HashMap<String, u8>", "Result<String>"]


def test_projects(tmp_path):
    (tmp_path / "a.toml").write_text('[project]\nsource_lang = "typescript"\ntarget_lang = "rust"\n[ignore]\npatterns = ["x/**"]\n')
    assert registry.project(str(tmp_path / "a.toml")) == registry.Project("rust", "typescript", ("x/**",))
    with pytest.raises(ValueError, match="cobol"):
        registry.Project("cobol")


def test_matches_by_signature_and_children(spark):
    kind = "file string, name string, types array<string>, returns string"
    source = spark.createDataFrame([("a.ts", "getItem", ["string", "number"], "boolean"), ("a.ts", "lone", [], None)], kind)
    target = spark.createDataFrame([("a.rs", "get_item", ["String"], "bool"), ("a.rs", "get_items", ["String", "i32"], "bool"), ("b.rs", "get_item", ["String", "i32"], "bool")], kind)
    got = [tuple(r) for r in align.match_by_signature(source, target).collect()]
    assert [(r[:4], round(r[4], 6)) for r in got] == [(("a.ts", "getItem", "a.rs", "get_item"), 0.75)]
    matched = align.match_by_signature(source, target)
    changes = spark.createDataFrame([("a.ts", "getItem", 2, "method", "theSize", None), ("a.ts", "getItem", 1, "value", "x", None), ("a.ts", "getItem", 3, "member", "late", None)], "file string, name string, at int, aspect string, new_value string, old_value string")
    children = spark.createDataFrame([("a.rs", "get_item", "the_size", 5, 6, 1, 9)], "file string, parent string, name string, line int, line_end int, parent_line int, parent_line_end int")
    assert [tuple(r) for r in align.child_context(matched, changes, children).collect()] == [("a.ts", "getItem", "the_size", 5, 6)]
    none = children.withColumn("name", F.lit("other"))
    assert [tuple(r) for r in align.child_context(matched, changes, none).collect()] == [("a.ts", "getItem", "the_size", 1, 9)]
