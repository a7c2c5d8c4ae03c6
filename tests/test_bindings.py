"""Bindings of scripts, signatures of methods, notes in documentation."""

from factloom.operators import diff, extract_facts, tokens

FILES = "path string, source string, language string"


def test_bindings_by_language(spark):
    source = "import def, { a as b } from './lib';\nimport * as all from './lib';\nimport type { T } from '#alias';\nimport { ext } from 'pkg';\nimport { sub } from 'pkg/sub';\nexport { x as y, default as z } from './x';\nexport { gone } from 'pkg';\nexport * from './q';\nexport * as ns from './q';\n"
    f = spark.createDataFrame([("m.ts", source, "typescript"), ("m.js", source, "javascript")], FILES)
    got = {(r["module"], r["local_name"], r["exported_name"], r["specifier"]) for r in extract_facts.bindings(f, reexported=True).collect()}
    both = [("def", "default", "./lib"), ("b", "a", "./lib"), ("T", "T", "#alias"), ("sub", "sub", "pkg/sub")]
    script = [*both, ("ext", "ext", "pkg"), ("all", "*", "./lib")]
    assert got == {("m.ts", *x) for x in [*both, ("y", "x", "./x"), ("z", "default", "./x")]} | {("m.js", *x) for x in script}


METHODS = """export class A<T> extends B {
  private items: Map<string, T> = new Map();
  constructor(private readonly x: number, y = 2) { super(x); }
  // one(a)
  plain() { return this.other(1, 2); }
  typed<K extends string>(a: Map<K, T>, b?: (p: K, q: T) => void, ...rest: T[]): Promise<{ a: K; b: T }> { if (a) { f(a, b); } }
  object(at: { p: number, q: string } = { p: 1, q: ',' }): { left: T } {
    return g(at);
  }
  static async * each(a, b) { yield (a); }
  get size(): number { return 1; }
  abstract later(z: [number, string]): void;
}
interface I { m(a: number): void }
class Empty {}
export function after(a: string, b = 3, ...c: number[]) {}
"""


def test_signatures_of_methods(spark):
    f = spark.createDataFrame([("m.ts", METHODS, "typescript"), ("e.ts", "", "typescript"), ("o.ts", "class O { m(", "typescript")], FILES)
    stmts = tokens.statements(tokens.tokens(f))
    declared = tokens.declarations(stmts)
    got = tokens.method_signatures(f, stmts, declared, tokens.members(stmts, declared)).collect()
    assert {(r["owner"], r["name"], r["signature"], r["line"]) for r in got} == {
        ("A", "constructor", "A::constructor(x: number, y: unknown) -> void", 3),
        ("A", "plain", "A::plain() -> void", 5),
        ("A", "typed", "A::typed(a: Map<K, T>, b: (p: K, q: T) => void) -> Promise<{ a: K; b: T }>", 6),
        ("A", "object", "A::object(at: { p: number, q: string }) -> { left: T }", 7),
        ("A", "each", "A::each(a: unknown, b: unknown) -> void", 10),
        ("A", "size", "A::size() -> number", 11),
        ("A", "later", "A::later(z: [number, string]) -> void", 12),
    }
    assert [r["signature"] for r in tokens.signatures(f, stmts, declared).collect()] == ["export function after(a: string, b: unknown) -> void"]


def test_notes_in_documentation(spark):
    side = "struct<doc:string,attributes:array<string>>"
    rows = [("same", ("d", []), ("d", [])), ("none", (None, None), (None, [])), ("new", (None, []), ("TODO later", [])), ("gone", ("unsafe", []), (None, [])), ("text", ("a", []), ("SAFETY: b", [])), ("old", ("d", []), ("d", ["@deprecated"])), ("rust", ("d", ["#[deprecated]"]), ("d", ["x"]))]
    pairs = spark.createDataFrame([("m", *r) for r in rows], f"module string, name string, o {side}, n {side}")
    got = {r["name"]: (r["change"], r["is_deprecated"], r["has_todo"], r["has_safety_note"], r["old_doc"], r["new_doc"]) for r in diff.doc_changes(pairs).collect()}
    assert got == {
        "new": ("added", False, True, False, None, "TODO later"), "gone": ("removed", False, False, False, "unsafe", None), "text": ("changed", False, False, True, "a", "SAFETY: b"),
        "old": ("changed", True, False, False, "d", "d"), "rust": ("changed", False, False, False, "d", "d"),
    }
