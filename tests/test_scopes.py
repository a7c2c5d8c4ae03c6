"""Uses by scope and their kinds, against what the ancestors of each use are; the lexer's modes."""

import pytest

from factloom.operators import extract_facts, lexer

#: Each line of code, and the uses of a, B and c in it as (name, kind), in order.
LINES = [
    ("`it's ${a(1)} and ${`in ${B.x}`}`;", "a Call, B PropertyAccess"),
    ("const t = `${a}`;", "a Usage"),
    ("function f1(a) { return a(B); }", "B Call"),
    ("function f2({ a, k: c = B }, ...d) { a(); c(); d(B); }", "B Usage, B Call"),
    ("const f3 = (a, b = c) => a(b);", "c Usage"),
    ("const f4 = a => a + B;", "B Usage"),
    ("{ const a = 1, B = 2; a; B(); c; }", "c Usage"),
    ("{ let { a, z: [B] } = c; a(B); }", "c Usage"),
    ("for (const a of c) { a(); }", "c Usage"),
    ("try { a(); } catch (a) { a(B); }", "a Call, B Call"),
    ("{ function a() {} a(); class B {} new B(c); }", "c New"),
    ("a(B, { c }, [c]);", "a Call, B Call, c Call, c Call"),
    ("x.a(); y.B; ({ a: 1, B() { return c; } });", "c Usage"),
    ("new a.k(B);", "a New, B New"),
    ("new a(B).c(c);", "a New, B New, c Call"),
    ("foo(() => a); foo(function () { return a; }); foo(function g() { return a; });", "a Usage, a Call, a Usage"),
    ("a[B].x; (a || c).d; [a].map(c);", "a PropertyAccess, B PropertyAccess, a PropertyAccess, c PropertyAccess, a Call, c Call"),
    ("let v: a = B as c;", "a TypeReference, B Usage, c TypeReference"),
    ("type U = { k: a } | c;", "a TypeReference, c TypeReference"),
    ("interface I extends a { m(x: B): c; }", "a ExtendsType, B TypeReference, c TypeReference"),
    ("class D1 extends a implements B { c = 1; m(x: c) { return c; } n() { c(); } }", "a Extends, B Implements, c Extends, c Extends, c Call"),
    ("class D2 { m(x: c) { const q = B; return a; } }", "c TypeReference, B Usage, a Usage"),
    ("const z = q ? a : B;", "a Usage, B Usage"),
    ("foo({ ...a, [B]: c });", "a Call, B Call, c Call"),
    ("if (a < B && c > 1) { }", "a Usage, B Usage, c Usage"),
    ("s.replace(/['`a]/g, B);", "B Call"),
    ("export { a as k };", "a Usage"),
    ("export { a } from './other';", ""),
    ("// a(B)\n/* c */ 'a' + \"B\";", ""),
    ("enum E { a, B = 1 }", ""),
    ("import('./x').then(a);", "a Call"),
]
TAGS = [
    ("const e1 = <a k='B' c={c}>it's a {B} <c/></a>;", "a Usage, c Usage, B Usage, c Usage, a Usage"),
    ("const e2 = (c) => <c.x on={() => a(c)}>B</c.x>;", "a Call"),
]


def found(spark, lines, path):
    head = "import { a, c } from './lib';\nimport B from './b';\n"
    source = head + "".join(line + "\n" for line, _ in lines)
    f = spark.createDataFrame([(path, source, "typescript")], "path string, source string, language string")
    targets = spark.createDataFrame([(path, "./lib", "lib.ts"), (path, "./b", "b.ts")], "module string, specifier string, target string")
    rows = extract_facts.references(f, extract_facts.bindings(f), targets).collect()
    at, out = 3, []
    for line, want in lines:
        here = sorted((r["line"], r["col"], r["source_symbol"].split(":")[1], r["kind"]) for r in rows if at <= r["line"] < at + 1 + line.count("\n"))
        out.append((line, want, ", ".join(f"{name} {kind}" for _, _, name, kind in here)))
        at += 1 + line.count("\n")
    return out


@pytest.mark.parametrize(("lines", "path"), [(LINES, "m.ts"), (TAGS, "m.tsx")])
def test_uses_and_kinds(spark, lines, path):
    wrong = [(line, want, got) for line, want, got in found(spark, lines, path) if want != got]
    assert not wrong, "\n".join(f"{line}\n  want {want}\n  got  {got}" for line, want, got in wrong)


def test_modes_of_the_lexer():
    texts = lambda source, path="m.tsx", language="typescript": [(r[3], r[4]) for r in lexer.rows(path, source, language)]
    assert texts("`a${`b${c}`}d`") == [("`", "template"), ("a", "string"), ("${", "template"), ("`", "template"), ("b", "string"), ("${", "template"), ("c", "name"), ("}", "template"), ("`", "string"), ("}", "template"), ("d`", "string")]
    assert ("it's", "name") not in texts("<p>it's</p>") and ("p", "name") in texts("<p>it's</p>")
    assert texts("a / b / c", "m.ts")[1] == ("/", "sign") and texts("x = /b/g", "m.ts")[2] == ("/b/g", "string")
    assert texts("/* /* */ fn no() {} */ fn f() {}", "m.rs", "rust")[1:3] == [("fn", "name"), ("f", "name")]
    assert texts('r#"a"b"# \'x\' \'a', "m.rs", "rust") == [('r#"a"b"#', "string"), ("'x'", "string"), ("'a", "sign")]
    assert texts("") == [] and texts("`open ${") and texts("<a", "m.tsx") and texts("/* open", "m.rs", "rust") == [("/* open", "comment")]


def test_brackets_know_their_partners():
    rows = lexer.rows("m.ts", "f({ a: [1] }, `${g(2)}`); } (", "typescript")
    by = {r[2]: r for r in rows}
    for r in rows:
        if r[12] >= 0:
            assert by[r[12]][12] == r[2] and by[r[12]][11] == r[11] and by[r[12]][9:11] == r[9:11]
    assert [r[3] for r in rows if r[3] in "()[]{}" and r[12] < 0] == ["}", "("]
    assert all(list(r[13]) == sorted(r[13]) and (r[13][-1:] or [-1]) == [r[11]] for r in rows)
