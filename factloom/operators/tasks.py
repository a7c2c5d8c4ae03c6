"""The work queue and the verification of generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.levels import acceptable
from factloom.functions.naming import loose
from factloom.operators.rounds import numbered


def queue(modules: DataFrame) -> DataFrame:
    """modules(module, layer, in_degree) as pending tasks, numbered in the order of work."""
    return numbered(modules, (F.col("layer"), F.desc("in_degree"), F.col("module")), "task").withColumn("status", F.lit("pending"))


def next_task(tasks: DataFrame) -> DataFrame:
    return tasks.filter("status = 'pending'").orderBy("layer", F.desc("in_degree"), "module").limit(1)


def listed(tasks: DataFrame, status: str | None = None) -> DataFrame:
    return (tasks if status is None else tasks.filter(F.col("status") == status)).orderBy("layer", F.desc("in_degree"), "module")


def folded(tasks: DataFrame, events: DataFrame) -> DataFrame:
    """tasks(module, ...) with the state that events(module, at, status) leave: verified stays; attempts are counted."""
    last = events.groupBy("module").agg(F.max_by("status", F.struct("at", "status")).alias("last"), F.bool_or(F.col("status") == "verified").alias("ok"), F.count_if(F.col("status") == "in_progress").alias("attempts"))
    state = last.select("module", F.when(F.col("ok"), "verified").otherwise(F.col("last")).alias("new"), "attempts")
    return tasks.drop("attempts").join(state, "module", "left").select(*[c for c in tasks.columns if c not in ("status", "attempts")], F.coalesce("new", "status").alias("status"), F.coalesce("attempts", F.lit(0).cast("long")).alias("attempts"))


def progress(tasks: DataFrame) -> DataFrame:
    """One row: tasks by status; done counts verified and failed ones, manifest_percent verified ones alone."""
    kinds = ("pending", "in_progress", "done", "verified", "failed")
    out = tasks.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == k).alias(k) for k in kinds])
    share = lambda part: F.when(F.col("total") > 0, part * 100.0 / F.col("total")).otherwise(0.0)
    return out.withColumn("percent", share(F.col("verified") + F.col("failed"))).withColumn("manifest_percent", share(F.col("verified")))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those with their key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def verification(spec: DataFrame, made: DataFrame) -> DataFrame:
    """spec(file, target_name, kind, n_params, return_type, is_async) against made(file, name, kind, n_params, return_type, is_async, line).

    Names meet without case and underscores, the first definition wins. A row for each symbol of the spec: found,
    the checks, and structural, the part of the checks that hold."""
    first = made.groupBy("file", loose(F.col("name")).alias("key")).agg(F.min_by(F.struct("kind", "n_params", "return_type", "is_async"), F.struct("line", "name")).alias("m"))
    out = spec.withColumn("key", loose(F.col("target_name"))).join(first, ["file", "key"], "left")
    kind_ok = F.coalesce(acceptable(F.col("kind"), F.col("m.kind")), F.lit(False))
    params_ok = F.coalesce(F.col("n_params") == F.col("m.n_params"), F.lit(False))
    return_ok = F.col("m").isNotNull() & F.col("return_type").eqNullSafe(F.col("m.return_type"))
    async_ok = F.col("m").isNotNull() & F.col("is_async").eqNullSafe(F.col("m.is_async"))
    out = out.select("file", "target_name", F.col("m").isNotNull().alias("found"), kind_ok.alias("kind_ok"), params_ok.alias("params_ok"), return_ok.alias("return_ok"), async_ok.alias("async_ok"))
    return out.withColumn("structural", (F.col("kind_ok").cast("int") + F.col("params_ok").cast("int") + F.col("return_ok").cast("int") + F.col("async_ok").cast("int")) / 4.0)


def verdicts(checks: DataFrame, threshold: float = 0.85, deep: bool = True) -> DataFrame:
    """file, similarity, passed: by names alone, or .6 by names and .4 by structure; a missing symbol or wrong kind fails a deep one."""
    names = F.sum(F.col("found").cast("int")) / F.count("*")
    score = names * 0.6 + F.sum("structural") / F.count("*") * 0.4 if deep else names
    wrong = F.sum((~F.col("found") | ~F.col("kind_ok")).cast("int")) if deep else F.lit(0)
    return checks.groupBy("file").agg(F.count("*").alias("n_symbols"), score.alias("similarity"), wrong.alias("errors")).withColumn("passed", (F.col("similarity") >= threshold) & (F.col("errors") == 0))


def deep_checks(spec: DataFrame, made: DataFrame, broken: DataFrame) -> DataFrame:
    """A row for each symbol of spec(file, at, name, target_name, kind, params, return_type, is_async, target_signature): found, and severity, message,
    expected, actual, line_hint of what is wrong with it (null where nothing is).

    made: rust_items.items with file; items of the top level alone, the first of a name counts. broken(file): files that can't be read, all of
    whose symbols are missing. Parameters are compared place by place, the receiver apart, names without case and underscores, types without
    blanks; an expected type or result that is empty is not compared."""
    top = made.filter("owner is null and name is not null").join(broken.select("file"), "file", "left_anti")
    item = F.struct("kind", "line", "params", "result", "is_async", "fields", "variants")
    first = top.groupBy("file", loose(F.col("name")).alias("key")).agg(F.min_by(item, "at").alias("m"))
    out = spec.withColumn("key", loose(F.col("target_name"))).join(first.hint("merge"), ["file", "key"], "left")
    m, found = F.col("m"), F.col("m").isNotNull()
    quote = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    bare = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    none = F.lit(None).cast("string")
    wrong_kind = F.when(~acceptable(F.col("kind"), m["kind"]), quote("kind mismatch: expected '", F.col("kind"), "', got '", m["kind"], "'"))
    expected = F.coalesce("params", F.array().cast(spec.schema["params"].dataType))
    number = F.when(F.size(m["params"]) != F.size(expected), quote("parameter count: expected ", F.size(expected).cast("string"), ", got ", F.size(m["params"]).cast("string")))

    def place(p: Column, i: Column) -> Column:
        got = F.get(m["params"], i)
        name = F.when(loose(got["name"]) != loose(p["name"]), quote("param[", i.cast("string"), "] name: expected '", p["name"], "', got '", got["name"], "'"))
        kind = F.when((bare(p["type"]) != "") & (bare(got["type"]) != bare(p["type"])), quote("param[", i.cast("string"), "] '", p["name"], "' type: expected '", p["type"], "', got '", got["type"], "'"))
        return F.array(name, kind)

    asked, result = F.col("return_type"), m["result"]
    returned = (
        F.when(result.isNotNull() & asked.isNotNull(), F.when((bare(asked) != "") & (bare(result) != bare(asked)), quote("return type: expected '", asked, "', got '", result, "'")))
        .when(asked.isNotNull(), quote("return type: expected '", asked, "', got unit ()"))
        .when(result.isNotNull(), F.lit("unexpected return type (spec has none)"))
    )
    waits = F.when(F.col("is_async") != m["is_async"], quote("async: expected ", F.col("is_async").cast("string"), ", got ", m["is_async"].cast("string")))
    fields = F.filter(F.transform(F.split(F.coalesce("target_signature", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    field_number = F.when(m["fields"].isNotNull() & (F.size(fields) > 0) & (F.size(m["fields"]) != F.size(fields)), quote("field count: expected ", F.size(fields).cast("string"), ", got ", F.size(m["fields"]).cast("string")))
    of_function = F.concat(F.array(wrong_kind, number), F.flatten(F.transform(expected, place)), F.array(returned, waits))
    both = lambda kind: (F.col("kind") == kind) & (m["kind"] == kind)
    every = F.when(both("function"), of_function).when(both("struct"), F.array(wrong_kind, field_number)).when(both("enum"), F.array(wrong_kind, F.when(F.size(m["variants"]) == 0, F.lit("enum has no variants")))).otherwise(F.array(wrong_kind, none))
    details = F.array_compact(every)
    names = quote("'", F.col("name"), "' (target: '", F.col("target_name"), "')")
    bad = found & (F.size(details) > 0)
    return out.select(
        "file", "at", "name", found.alias("found"), F.when(~found, "error").when(bad, "warning").alias("severity"),
        F.when(~found, quote("Exported symbol ", names, " not found in generated Rust code")).when(bad, quote("Symbol ", names, " has structural mismatches: ", F.array_join(details, "; "))).alias("message"),
        F.when(~found, quote(F.col("kind"), " named '", F.col("target_name"), "'")).when(bad, F.concat_ws(" ", "kind", "target_name")).alias("expected"),
        F.when(bad, quote(m["kind"], " at line ", m["line"].cast("string"))).alias("actual"), F.when(bad, m["line"]).alias("line_hint"),
    )


def deep_verdicts(checks: DataFrame, broken: DataFrame, threshold: float = 0.85) -> DataFrame:
    """file, n_symbols, matched, correct, similarity (.6 by names, .4 by the part of those found that is right), status, instruction. A missing symbol fails
    a file whatever its similarity; so do files that can't be read."""
    sums = checks.groupBy("file").agg(
        F.count("*").alias("n_symbols"), F.count_if("found").alias("matched"), F.count_if(F.col("found") & F.col("severity").isNull()).alias("correct"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("message").isNotNull(), F.struct("at", "message")))), lambda x: x["message"]).alias("messages"),
    )
    sums = sums.join(broken.select("file", F.lit(True).alias("unread")).distinct(), "file", "left")
    score = F.col("matched") / F.col("n_symbols") * 0.6 + F.when(F.col("matched") > 0, F.col("correct") / F.col("matched")).otherwise(0.0) * 0.4
    passed = (score >= threshold) & (F.col("matched") == F.col("n_symbols"))
    of = lambda a, b: F.concat(a.cast("string"), F.lit("/"), b.cast("string"))
    good = F.concat(F.lit("File '"), "file", F.lit("' deep-verified — "), of(F.col("correct"), F.col("n_symbols")), F.lit(" symbols match structurally."))
    bad = F.concat(F.lit("File '"), "file", F.lit("' needs revision — "), of(F.col("matched"), F.col("n_symbols")), F.lit(" symbols found, "), of(F.col("correct"), F.greatest("matched", F.lit(1))), F.lit(" structurally correct. Issues: "), F.array_join("messages", "; "))
    text = F.when(F.col("unread"), "Fix the Rust syntax errors and try again.").when(passed, good).otherwise(bad)
    return sums.select("file", "n_symbols", "matched", "correct", F.when(F.col("unread"), 0.0).otherwise(score).alias("similarity"), F.when(passed & F.col("unread").isNull(), "verified").otherwise("needs_revision").alias("status"), text.alias("instruction"))


def coverage(source: DataFrame, target: DataFrame) -> DataFrame:
    """source(stem, name, translated, change_type) with covered: target(stem, name, change_type) has it by any of three names."""
    keys = F.array_distinct(F.array(F.concat(F.lit("="), "translated"), F.concat(F.lit("="), "name"), F.concat(F.lit("~"), F.lower("translated"))))
    asked = source.withColumn("_row", F.struct("stem", "name", "translated", "change_type")).withColumn("key", F.explode(keys))
    there = target.select("stem", "change_type", F.explode(F.array(F.concat(F.lit("="), "name"), F.concat(F.lit("~"), F.lower("name")))).alias("key")).distinct()
    hit = asked.join(there, ["stem", "change_type", "key"], "left_semi").select("stem", "name", "translated", "change_type").distinct().withColumn("covered", F.lit(True))
    return source.join(hit, ["stem", "name", "translated", "change_type"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def coverage_summary(rows: DataFrame, threshold: float = 0.9) -> DataFrame:
    out = rows.agg(F.count("*").alias("total"), F.count_if("covered").alias("covered"))
    return out.withColumn("coverage", F.when(F.col("total") > 0, F.col("covered") / F.col("total")).otherwise(1.0)).withColumn("passed", F.col("coverage") >= threshold)
