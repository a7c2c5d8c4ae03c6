"""Migration readiness of modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.levels import effort_label, level_score, round2
from factloom.operators.rounds import numbered

#: The weights of the five parts.
WEIGHTS = {"in_degree": 30.0, "complexity": 25.0, "compatibility": 20.0, "cycles": 15.0, "tests": 10.0}


def reference_degree(refs: DataFrame) -> DataFrame:
    """refs(module, symbol, file) -> module, in_degree: over its symbols, the number of distinct files that use each."""
    return refs.select("module", "symbol", "file").distinct().groupBy("module").agg(F.count("*").alias("in_degree"))


def complexity(symbols: DataFrame) -> DataFrame:
    """symbols(module, ordinal, line_end) -> module, complexity: their number times the log of the last one's last line."""
    last = F.greatest(F.max_by("line_end", "ordinal"), F.lit(1))
    return symbols.groupBy("module").agg((F.count("*") * F.log(last)).alias("complexity"))


def cycle_counts(cycles: DataFrame) -> DataFrame:
    """cycles(members: array) -> module, cycle_count: the closing member counts again."""
    return cycles.select(F.explode("members").alias("module")).groupBy("module").agg(F.count("*").alias("cycle_count"))


def project_average(compat: DataFrame) -> DataFrame:
    """One row: the mean level score of compat(package, level), 0.5 without packages."""
    return compat.agg(F.coalesce(F.avg(level_score(F.col("level"))), F.lit(0.5)).alias("project_average"))


def module_compatibility(modules: DataFrame, module_deps: DataFrame, compat: DataFrame) -> DataFrame:
    """modules(module), module_deps(module, package) -> module, external_compatibility."""
    deps = module_deps.distinct().join(compat.select("package", level_score(F.col("level")).alias("s")), "package", "left")
    known = deps.groupBy("module").agg(F.count("*").alias("n"), F.avg("s").alias("mean"))
    out = modules.select("module").join(known, "module", "left").crossJoin(F.broadcast(project_average(compat)))
    alone = F.when(F.lower("module").rlike("test|spec"), F.least(F.col("project_average") + 0.15, F.lit(1.0))).otherwise(F.col("project_average"))
    value = F.when(F.col("n").isNull(), alone).otherwise(F.coalesce(F.least(F.greatest("mean", F.lit(0.0)), F.lit(1.0)), "project_average"))
    return out.select("module", value.alias("external_compatibility"))


def readiness(modules: DataFrame, degree: DataFrame, complex_: DataFrame, compat: DataFrame, cycles: DataFrame, tests: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Scores, labels and ranks of modules(module); the other frames are keyed by module, tests lists those that have some."""
    facts = modules.select("module").join(degree, "module", "left").join(complex_, "module", "left").join(compat, "module", "left").join(cycles, "module", "left").join(tests.select("module").distinct().withColumn("has_tests", F.lit(True)), "module", "left")
    facts = facts.fillna({"in_degree": 0, "complexity": 1.0, "cycle_count": 0, "has_tests": False, "external_compatibility": 0.5})
    most = facts.agg(*[F.greatest(F.max(c), F.lit(1)).alias(f"max_{c}") for c in ("in_degree", "complexity", "cycle_count")])
    out = facts.crossJoin(F.broadcast(most))  # one row
    share = lambda c: F.greatest(F.lit(0.0), 1 - F.col(c) / F.col(f"max_{c}"))
    parts = {
        "part_in_degree": weights["in_degree"] * F.col("in_degree") / F.col("max_in_degree"),
        "part_complexity": weights["complexity"] * share("complexity"),
        "part_compatibility": weights["compatibility"] * F.col("external_compatibility"),
        "part_cycles": weights["cycles"] * share("cycle_count"),
        "part_tests": F.when(F.col("has_tests"), weights["tests"]).otherwise(0.0),
    }
    out = out.withColumns(parts).withColumn("raw", sum((F.col(p) for p in parts), F.lit(0.0)))
    out = out.select("module", round2(F.col("raw")).alias("score"), effort_label(F.col("raw")).alias("migration_effort"), "in_degree", round2(F.col("complexity")).alias("complexity"), round2(F.col("external_compatibility")).alias("external_compatibility"), "cycle_count", "has_tests", *[round2(F.col(p)).alias(p) for p in parts])
    return ranked(out)


def ranked(scores: DataFrame) -> DataFrame:
    """With rank, from 1, by score and then module."""
    return numbered(scores, (F.desc("score"), F.col("module")), "rank")
