"""Goldens of the scalar rules and similarity."""

from pyspark.sql import functions as F

from factloom.functions import levels, naming, texts
from factloom.operators import align, compat, diff


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_snake_case(spark):
    names = {"formatPrice": "format_price", "getUserById": "get_user_by_id", "simple": "simple", "XMLParser": "xml_parser", "APP_NAME": "app_name", "API_PREFIX": "api_prefix", "HTTP_STATUS": "http_status", "DBConnection": "db_connection", "parseXML": "parse_xml", "parseXMLDocument": "parse_xml_document"}
    got = values(spark, [(n,) for n in names], "n string", naming.snake_case(F.col("n")))
    assert [g for (g,) in got] == list(names.values())


def test_names_types_calls_paths(spark):
    got = values(spark, [("IUser",), ("displayName",), ("login",)], "n string", naming.translate_name(F.col("n")))
    assert got == [("user",), ("display_name",), ("login",)]
    assert values(spark, [("display_name",), ("_x",), ("a",)], "n string", naming.camel_case(F.col("n"))) == [("displayName",), ("X",), ("a",)]
    got = values(spark, [("Promise<User>",), ("Array<string>",), ("CustomType",), ("string",), ("Promise<Array<string>>",)], "t string", naming.translate_type(F.col("t")))
    assert [g for (g,) in got] == ["Result<User>", "Vec<String>", "CustomType", "String", "Promise<Array<string>>"]
    rules = naming.Conventions(calls={"db.findOne": "db.find_one", "fetch": "reqwest::get"})
    assert values(spark, [(["db.findOne", "foo.bar", "fetch"],)], "c array<string>", naming.translate_calls(F.col("c"), rules)) == [(["db.find_one", "foo.bar", "reqwest::get"],)]
    assert values(spark, [("src/utils/format.ts",), ("src/utils/format.tsx",), ("lib.rs",)], "p string", naming.target_path(F.col("p"))) == [("src/utils/format.rs",), ("src/utils/format.rs",), ("lib.rs",)]
    assert values(spark, [("IUser",)], "n string", naming.candidates(F.col("n"))) == [(["IUser", "User", "i_user", "user"],)]


def test_levels(spark):
    assert [x for (x,) in values(spark, [(85.0,), (60.0,), (40.0,), (20.0,)], "s double", levels.effort_label(F.col("s")))] == ["trivial", "moderate", "heavy", "rewrite"]
    assert [x for (x,) in values(spark, [(0.6,), (0.3,), (0.1,), (0.0,)], "s double", levels.level_of(F.col("s")))] == ["full", "partial", "none", "unknown"]
    assert values(spark, [(1.005,)], "x double", levels.round2(F.col("x"))) == [(1.0,)]
    got = values(spark, [("1.2.3", "v1.10.0"), ("9.0.0", "10.0.0"), ("2.1.5", "2.1.0"), ("x", "v0.0")], "a string, b string", levels.version_change(F.col("a"), F.col("b")))
    assert [x for (x,) in got] == ["upgraded", "upgraded", "patch", "patch"]
    got = values(spark, [("heavy", "none", ["Async", "x", "async"], "No direct way"), ("trivial", "full", None, None)], "e string, l string, t array<string>, g string", levels.risk_tags(F.col("e"), F.col("l"), F.col("t"), F.col("g")))
    assert got == [(["heavy", "no-equivalent", "async", "ffi"],), ([],)]


def test_paths_and_snippets(spark):
    rows = [("a/./b/../c",), ("../x",), ("a/../../b",), ("a\\b",)]
    assert [x for (x,) in values(spark, rows, "p string", texts.normalised(F.col("p")))] == ["a/c", "../x", "../b", "a/b"]
    assert [x for (x,) in values(spark, rows, "p string", texts.normalised(F.col("p"), False))] == ["a/c", "x", "b", "a/b"]
    assert values(spark, [("a\nb\nc", 2, 3), ("a", 2, 3), ("a", 0, 1)], "s string, f int, l int", texts.snippet(F.col("s"), F.col("f"), F.col("l"))) == [("b\nc",), ("",), ("",)]
    assert values(spark, [("src/a/index.ts",), ("src/u.ts",)], "p string", F.size(texts.test_candidates(F.col("p")))) == [(7,), (3,)]


def test_jaccard(spark):
    rows = [(["a", "b"], ["b", "a"]), (["a"], ["b"]), (["a", "b"], ["b", "c"]), ([], ["a"]), ([], [])]
    got = [x for (x,) in values(spark, rows, "a array<string>, b array<string>", compat.jaccard(F.col("a"), F.col("b")))]
    assert got == [1.0, 0.0, 1 / 3, 0.0, 0.0]


def test_longest_common_subsequence(spark):
    import random

    rng = random.Random(1)
    rows = [([rng.choice("abc") for _ in range(rng.randint(0, 8))], [rng.choice("abc") for _ in range(rng.randint(0, 8))]) for _ in range(60)]

    def brute(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    got = values(spark, rows, "a array<string>, b array<string>", diff.lcs(F.col("a"), F.col("b")))
    assert [x for (x,) in got] == [brute(a, b) for a, b in rows]


def test_signatures(spark):
    c = F.col
    score = align.signature_similarity({"name": c("n"), "types": c("t"), "returns": c("r")}, {"name": c("m"), "types": c("u"), "returns": c("q")})
    got = values(spark, [("login", ["string", "string"], "void", "login", ["String", "String"], "()")], "n string, t array<string>, r string, m string, u array<string>, q string", score)
    assert abs(got[0][0] - 1.0) < 0.01
    assert values(spark, [(["a", "bC"], ["a", "b_c"]), (["a", "b", "c"], ["a", "b"])], "s array<string>, t array<string>", align.children_similarity(c("s"), c("t"))) == [(1.0,), (2 / 3,)]
