"""Alignment of source symbols with target symbols against all pairs: by name, by signature (default file or all files), or not at all."""

import random

from pyspark.sql import functions as F

from factloom.operators import align

SYMBOLS = "file string, name string, ordinal int, types array<string>, returns string"


def plain(spark, source, target):
    """All pairs, scored by the same formula."""
    a = source.select("file", "name", "types", "returns")
    b = target.select(F.col("file").alias("tf"), F.col("name").alias("tn"), F.col("types").alias("tt"), F.col("returns").alias("tr"))
    s = align.signature_similarity({c: F.col(c) for c in ("name", "types", "returns")}, {"name": F.col("tn"), "types": F.col("tt"), "returns": F.col("tr")})
    rows = a.crossJoin(b).select("file", "name", "tf", "tn", s.alias("s")).collect()
    files, best = {r["tf"] for r in rows}, {}
    for r in rows:
        default = r["file"].replace(".ts", ".rs")
        if r["s"] > 0.5 and (default not in files or r["tf"] == default):
            key = (-r["s"], r["tn"], r["tf"])
            best[r["file"], r["name"]] = min(best.get((r["file"], r["name"]), key), key)
    return {k: (f, n, -s) for k, (s, n, f) in best.items()}


def test_against_all_pairs(spark):
    draw = random.Random(7)
    ts, rs = ["string", "number", "boolean", "Foo", "Promise<User>"], ["String", "f64", "bool", "Foo", "Result<User>", "i32"]
    source = [(f"s{draw.randint(0, 5)}.ts", f"getThing{i}", i, [draw.choice(ts) for _ in range(draw.randint(0, 4))], draw.choice([*ts, None])) for i in range(80)]
    target = [(f"s{draw.randint(3, 9)}.rs", f"get_thing{draw.randint(40, 200)}", i, [draw.choice(rs) for _ in range(draw.randint(0, 4))], draw.choice([*rs, None])) for i in range(150)]
    target = list({(t[0], t[1]): t for t in target}.values())
    a, b = spark.createDataFrame(source, SYMBOLS), spark.createDataFrame(target, SYMBOLS)
    want = plain(spark, a, b)
    found = align.match_by_signature(a.drop("ordinal"), b.drop("ordinal"))
    got = {(r["file"], r["name"]): (r["target_file"], r["target_name"], r["confidence"]) for r in found.collect()}
    assert len(want) > 10 and got == want
    assert "CartesianProduct" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan
    rows = {(r["file"], r["name"]): r for r in align.aligned(a.drop("ordinal"), b).collect()}
    named = {(r["file"], r["name"]) for r in align.match_by_name(a.drop("ordinal"), b).filter("target_name is not null").collect()}
    assert set(rows) == {(s[0], s[1]) for s in source} and named and {r["match_level"] for r in rows.values()} == {"name", "signature", "none"}
    for key, r in rows.items():
        if key in named:
            assert (r["match_level"], r["confidence"]) == ("name", 0.85)
        elif key in want:
            assert (r["match_level"], r["target_file"], r["target_name"], r["confidence"]) == ("signature", *want[key])
        else:
            assert (r["match_level"], r["target_file"], r["target_name"], r["confidence"]) == ("none", key[0].replace(".ts", ".rs"), None, 0.0)


def test_nothing_to_align(spark):
    none = spark.createDataFrame([], SYMBOLS)
    one = spark.createDataFrame([("a.ts", "f", 0, [], None)], SYMBOLS)
    assert align.aligned(none, one).collect() == []
    assert [tuple(r) for r in align.aligned(one, none).collect()] == [("a.ts", "f", "a.rs", None, 0.0, "none")]
