"""Rust items from tokens, their signatures and docs, and deep verification against a specification, place by place."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import rust_items, tasks

SOURCE = """//! module
use a::B;
/// Adds.
/// Twice.
#[inline]
pub async fn add<T: Fn(i32) -> i32, 'a>(mut x: Vec<(A, B<C, D>)>, _: &'a str, (p, q): (u8, u8)) -> Result<HashMap<String, i32>, E> where T: Copy { let y = |a, b| a; /* /* x */ fn no() {} */ }
fn unit() {}
pub struct P<T> { pub a: Vec<T>, #[serde(rename = "x, y")] b: Map<K, V>, pub(crate) c: u8 }
pub struct Q(u8);
struct Z;
pub enum E { A, B(u8, u8), C { x: u8 }, }
enum N {}
pub trait Tr: Sized { fn req(&self); }
impl<T> crate::Tr<T> for m::P<T> where T: X {
    /// Runs.
    pub fn run(&mut self, n: usize) -> Self { Self { a: n } }
    fn hidden(self: Box<Self>) {}
}
pub const K: [u8; 3] = [1, 2, 3];
pub static S: &str = "fn x() {";
pub type Al<T> = Result<T, E>;
pub(crate) fn inner() -> impl Fn(u8) -> u8 { |x| x }
"""


@pytest.fixture(scope="module")
def found(spark):
    f = spark.createDataFrame([("a.rs", SOURCE, "rust"), ("b.ts", "fn no() {}", "typescript"), ("c.rs", "", "rust"), ("d.rs", None, "rust")], "path string, source string, language string")
    return rust_items.items(f).cache()


def test_items(found):
    rows = found.orderBy("at").collect()
    assert [(r["kind"], r["name"], r["line"], r["owner"], r["is_public"]) for r in rows] == [
        ("function", "add", 6, None, True), ("function", "unit", 7, None, False), ("struct", "P", 8, None, True), ("struct", "Q", 9, None, True), ("struct", "Z", 10, None, False), ("enum", "E", 11, None, True), ("enum", "N", 12, None, False), ("trait", "Tr", 13, None, True),
        ("impl", "P", 14, None, False), ("function", "run", 16, "P", True), ("function", "hidden", 17, "P", False), ("const", "K", 19, None, True), ("static", "S", 20, None, True), ("type", "Al", 21, None, True), ("function", "inner", 22, None, False),
    ]
    add, unit, p, q, z, e, n, _, _, run, hidden = rows[:11]
    assert [tuple(x) for x in add["params"]] == [("x", "Vec < ( A , B < C , D > ) >"), ("_", "& 'a str"), (None, "( u8 , u8 )")]
    assert (add["result"], add["generics"], add["is_async"], add["receiver"], add["doc"]) == ("Result < HashMap < String , i32 > , E >", "T : Fn ( i32 ) -> i32 , 'a", True, False, "Adds. Twice.")
    assert (unit["params"], unit["result"], unit["is_async"], unit["doc"]) == ([], None, False, None)
    assert (p["fields"], q["fields"], z["fields"], e["variants"], n["variants"]) == (["a", "b", "c"], None, None, ["A", "B", "C"], [])
    assert ([tuple(x) for x in run["params"]], run["receiver"], run["result"], run["doc"], hidden["params"], hidden["receiver"]) == ([("n", "usize")], True, "Self", "Runs.", [], True)
    assert rows[14]["result"] == "impl Fn ( u8 ) -> u8"


def test_signatures(found):
    got = {r["name"]: (r["kind"], r["signature"]) for r in rust_items.signatures(found).collect()}
    assert got == {
        "add": ("function", "pub fn add<T : Fn ( i32 ) -> i32, 'a>(x: Vec < ( A , B < C , D > ) >, _: & 'a str, _: ( u8 , u8 )) -> Result < HashMap < String , i32 > , E >"),
        "P": ("struct", "pub struct P<T> { ... }"), "Q": ("struct", "pub struct Q { ... }"), "E": ("enum", "pub enum E { ... }"), "Tr": ("trait", "pub trait Tr { ... }"), "run": ("method", "pub fn run(self, n: usize) -> Self"),
        "K": ("const", "pub const K: [ u8 ; 3 ]"), "S": ("static", "pub static S: & str"), "Al": ("type_alias", "pub type Al<T> = Result < T , E >"),
    }


SPEC = "file string, at int, name string, target_name string, kind string, params array<struct<name:string,type:string>>, return_type string, is_async boolean, target_signature string"


def test_deep_verification(spark, found):
    spec = [
        ("a.rs", 1, "unit", "unit", "function", [], None, False, None),
        ("a.rs", 2, "add", "ADD", "function", [("X", "Vec<(A,B<C,D>)>"), ("_", "")], "", None, None),
        ("a.rs", 3, "IP", "P", "interface", None, None, None, "a, b"),
        ("a.rs", 4, "P", "p", "struct", None, None, None, "a, b"),
        ("a.rs", 5, "N", "n", "enum", None, None, None, None),
        ("a.rs", 6, "gone", "go_ne", "function", [], None, None, None),
        ("a.rs", 7, "run", "run", "function", [], None, None, None),
        ("a.rs", 8, "inner", "inner", "function", [("a", "u8")], None, True, None),
        ("ok.rs", 1, "f", "f", "function", [], None, False, None),
        ("bad.rs", 1, "f", "f", "function", [], None, False, None),
    ]
    more = spark.createDataFrame([("ok.rs", "fn f() {} fn f(x: u8) {}", "rust"), ("bad.rs", "fn f() {} fn g( {", "rust")], "path string, source string, language string")
    broken = rust_items.unbalanced(more).withColumnRenamed("path", "file")
    made = found.unionByName(rust_items.items(more)).withColumnRenamed("path", "file")
    checks = tasks.deep_checks(spark.createDataFrame(spec, SPEC), made, broken).cache()
    got = {(r["file"], r["at"]): (r["severity"], (r["message"] or "").split(": ", 2)[-1], r["actual"]) for r in checks.collect()}
    assert got[("a.rs", 1)] == (None, "", None) and got[("ok.rs", 1)] == (None, "", None)
    assert got[("a.rs", 2)][0] == "warning" and "parameter count: expected 2, got 3" in got[("a.rs", 2)][1] and "param[" not in got[("a.rs", 2)][1]
    assert got[("a.rs", 3)] == (None, "", None)
    assert "field count: expected 2, got 3" in got[("a.rs", 4)][1] and got[("a.rs", 4)][2] == "struct at line 8"
    assert got[("a.rs", 5)][1].endswith("enum has no variants")
    assert got[("a.rs", 6)][0] == got[("a.rs", 7)][0] == got[("bad.rs", 1)][0] == "error"  # methods are no items of the file
    message = checks.filter("at = 8").first()["message"]
    assert message == "Symbol 'inner' (target: 'inner') has structural mismatches: parameter count: expected 1, got 0; unexpected return type (spec has none); async: expected true, got false"
    verdicts = {r["file"]: r for r in tasks.deep_verdicts(checks, broken).collect()}
    a = verdicts["a.rs"]
    assert (a["n_symbols"], a["matched"], a["correct"], a["status"]) == (8, 6, 2, "needs_revision") and a["similarity"] == pytest.approx(6 / 8 * 0.6 + 2 / 6 * 0.4)
    assert a["instruction"].startswith("File 'a.rs' needs revision — 6/8 symbols found, 2/6 structurally correct. Issues: Symbol 'add'")
    assert (verdicts["ok.rs"]["status"], verdicts["ok.rs"]["instruction"]) == ("verified", "File 'ok.rs' deep-verified — 1/1 symbols match structurally.")
    assert (verdicts["bad.rs"]["status"], verdicts["bad.rs"]["similarity"], verdicts["bad.rs"]["instruction"]) == ("needs_revision", 0.0, "Fix the Rust syntax errors and try again.")


def test_no_files(spark):
    empty = spark.createDataFrame([], "path string, source string, language string")
    assert rust_items.items(empty).filter(F.lit(True)).collect() == [] and rust_items.unbalanced(empty).collect() == []
