"""Large files: what a task, a Python worker and the driver hold doesn't follow a file's size."""

import tracemalloc

import pyarrow as pa
from test_rust_items import SOURCE
from test_scopes import LINES

from factloom.operators import extract_facts, lexer, rust_items, scopes


def _files(spark, *rows):
    return spark.createDataFrame(rows, "path string, source string, language string")


def test_the_lexer_holds_a_part_of_a_file():
    batch = pa.RecordBatch.from_pydict({"path": ["a.rs"], "source": ["fn f(x: u8) { g(h[1]) }\n" * 6000], "language": ["rust"]})
    tracemalloc.start()
    n = sum(b.num_rows for b in lexer._lexed(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 6000 * 16 and peak < 40e6  # rows of the whole file take more than 70 MB


def test_few_files_are_dealt_out(spark):
    files = _files(spark, *((f"f{k}.rs", "fn f() {}", "rust") for k in range(4))).coalesce(1)
    assert lexer.lexed(files).rdd.getNumPartitions() == 4


def test_items_by_chunks(spark, monkeypatch):
    files = _files(spark, ("a.rs", SOURCE, "rust"), ("b.rs", "/// D.\nstruct S;\nimpl S { /// M.\n fn m(&self, a: u8) {} }", "rust"))
    whole = sorted(map(repr, rust_items.items(files).collect()))
    monkeypatch.setattr(rust_items, "CHUNK", 7)
    assert sorted(map(repr, rust_items.items(files).collect())) == whole and len(whole) == 18


def test_items_send_nothing_to_all(spark):
    plan = rust_items.items(_files(spark, ("a.rs", SOURCE, "rust")))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_uses_by_parts(spark):
    bodiless = [("declare function h1(a: B): c;", ""), ("const g1 = x => a", ""), ("if (a) B(); else c();", ""), ("`${function a() {}}`;", ""), ("a(c);", "")]
    source = "import { a, c } from './lib';\nimport B from './b';\n" + "".join(f"{line}\n" for line, _ in [*LINES, *bodiless, *LINES[:9]])
    bound = spark.createDataFrame([("m.ts", x) for x in "aBc"], "module string, local_name string")
    got = []
    for least in (1, 1 << 30):
        found = lexer.rows("m.ts", source, "typescript", least)
        got.append(sorted(scopes.script_uses(spark.createDataFrame(found, lexer.SCHEMA).filter("type <> 'comment'"), bound).collect()))
        assert (len({r[14] for r in found}) > 10) == (least == 1)
    assert got[0] == got[1] and len(got[0]) > 70


def test_spans_meet_no_use_one_by_one(spark):
    found = spark.createDataFrame([("m", k // 50, "a", k) for k in range(200)], "path string, part int, text string, i int")
    spans = [("m", 0, "a", 3, 9), ("m", 0, "a", 5, 20), ("m", 0, "a", 30, 20), ("m", 1, "a", 60, 60), ("m", 1, "b", 50, 99), ("m", 3, "a", 180, 1 << 30)]
    out = scopes._visible(found, spark.createDataFrame(spans, "path string, part int, text string, since int, until int"))
    assert sorted(r["i"] for r in out.collect()) == [k for k in range(180) if not 3 <= k <= 20 and k != 60]


def test_symbols_read_the_tokens_once(spark):
    files = _files(spark, ("m.ts", "export function f(a: string) { g(); }\nconst b = 1;", "typescript"))
    plan = extract_facts.symbols(files)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan
