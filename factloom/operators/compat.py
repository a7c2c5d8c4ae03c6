"""Packages of one ecosystem held against those of another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.levels import default_effort, is_high_impact, level_of, risk_tags, version_change
from factloom.operators.rounds import settled

#: What tags and an equal type weigh.
TAG_WEIGHT, TYPE_WEIGHT = 0.8, 0.2


def jaccard(a, b) -> F.Column:
    """Of two arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def similarity(tags_a, tags_b, same_type) -> F.Column:
    return TAG_WEIGHT * jaccard(tags_a, tags_b) + F.when(same_type, TYPE_WEIGHT).otherwise(0.0)


def best_matches(source: DataFrame, target: DataFrame) -> DataFrame:
    """source, target (name, lib_type, tags) -> name, equivalent, similarity, level; ties go to the smaller name.

    Libraries meet by shared tags, never as a cross product. A library's tags are tried from the rarest in the target up,
    one a round, and only as long as a library that shares none of those tried could still be as good as the best so far:
    it shares the others at most. Where no tag is shared, the first library of the same type is the best."""
    sides = [df.select("name", "lib_type", F.array_distinct("tags").alias("tags")) for df in (source, target)]
    b = settled(sides[1].select(F.col("name").alias("b_name"), F.col("lib_type").alias("b_type"), F.col("tags").alias("b_tags"), F.explode_outer("tags").alias("tag")))
    often = b.filter("tag is not null").groupBy("tag").agg(F.count("*").alias("often"))
    tagged = sides[0].withColumn("tag", F.explode_outer("tags")).join(often, "tag", "left")
    ranked = tagged.groupBy("name", "lib_type", "tags").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("tag").isNotNull(), F.struct(F.coalesce("often", F.lit(0).cast("long")).alias("often"), "tag")))), lambda x: x["tag"]).alias("order"))
    by_type = sides[1].groupBy("lib_type").agg(F.min("name").alias("b_name"))
    first = F.when(F.col("b_name").isNotNull(), F.struct(F.lit(-TYPE_WEIGHT).alias("s"), "b_name"))
    now = settled(ranked.join(by_type, "lib_type", "left").select("name", "lib_type", "tags", "order", first.alias("best")))
    for k in range(now.agg(F.max(F.size("order"))).first()[0] or 0):
        most = TAG_WEIGHT * (F.size("tags") - k) / F.size("tags") + TYPE_WEIGHT
        asked = now.filter((F.size("order") > k) & (F.col("best").isNull() | (most >= -F.col("best.s"))))
        if asked.isEmpty():
            break
        met = asked.withColumn("tag", F.get("order", F.lit(k))).join(b, "tag")
        score = similarity(F.col("tags"), F.col("b_tags"), F.col("lib_type") == F.col("b_type"))
        found = met.groupBy("name", "lib_type", "tags").agg(F.min(F.struct((-score).alias("s"), "b_name")).alias("new"))
        now = settled(now.join(found, ["name", "lib_type", "tags"], "left").select("name", "lib_type", "tags", "order", F.least("best", "new").alias("best")))
    out = F.coalesce(-F.col("best.s"), F.lit(0.0))
    return now.select("name", F.col("best.b_name").alias("equivalent"), out.alias("similarity"), level_of(out).alias("level"))


def evaluated(packages: DataFrame, overrides: DataFrame, built_in: DataFrame) -> DataFrame:
    """packages(package): the override's (equivalent, level), else the registry's, else unknown; with effort and tags of risk.

    A package that neither has is tagged unmapped, and nothing else."""
    pick = lambda df, x: df.select("package", F.struct("equivalent", "level", "tags", "guidance").alias(x))
    none = F.struct(F.lit(None).cast("string").alias("equivalent"), F.lit("unknown").alias("level"), F.lit(None).cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("guidance"))
    mapped = F.coalesce("o", "b").isNotNull()
    out = packages.select("package").distinct().join(pick(overrides, "o"), "package", "left").join(pick(built_in, "b"), "package", "left")
    out = out.select("package", mapped.alias("_mapped"), F.coalesce("o", "b", none).alias("e")).select("package", "_mapped", "e.*")
    effort = default_effort(F.col("level"))
    return out.withColumn("effort", effort).withColumn("risk_tags", F.when(F.col("_mapped"), risk_tags(effort, F.col("level"), F.col("tags"), F.col("guidance"))).otherwise(F.array(F.lit("unmapped")))).drop("_mapped")


def package_modules(module_deps: DataFrame, shown: int = 20) -> DataFrame:
    """package, affected (its number of modules), modules (the first `shown`): each task keeps the first ones before the shuffle."""
    each = module_deps.select("package", "module").distinct()
    first = each.withColumn("_place", F.row_number().over(Window.partitionBy("package").orderBy("module"))).filter(F.col("_place") <= shown)
    lists = first.groupBy("package").agg(F.array_sort(F.collect_list("module")).alias("modules"))
    return each.groupBy("package").agg(F.count("*").alias("affected")).join(lists, "package")


def touches_many() -> F.Column:
    """Of rows with affected (modules) and level: more than five modules, and no known equivalent."""
    return (F.col("affected") > 5) & F.col("level").isin("unknown", "none")


def recommendations(evaluated_: DataFrame, modules: DataFrame) -> DataFrame:
    """In order: high impact (many modules touched, without a known equivalent) first, then by affected modules, then by name."""
    out = evaluated_.join(modules, "package", "left").withColumn("affected", F.coalesce("affected", F.lit(0).cast("long")))
    return out.withColumn("high_impact", touches_many()).orderBy(F.desc("high_impact"), F.desc("affected"), "package")


def recommendation_counts(recommended: DataFrame) -> DataFrame:
    return recommended.agg(F.count("*").alias("total"), F.count_if(F.array_contains("risk_tags", "unmapped")).alias("unmapped"), F.count_if(is_high_impact(F.col("effort"))).alias("heavy"))


def dependency_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """old, new (package, version): added, removed, upgraded, downgraded or patch, and whether the major number rose."""
    both = old.select("package", F.col("version").alias("old_version")).join(new.select("package", F.col("version").alias("new_version")), "package", "full_outer")
    kind = F.when(F.col("old_version").isNull(), "added").when(F.col("new_version").isNull(), "removed").otherwise(version_change(F.col("old_version"), F.col("new_version")))
    return both.filter(~F.col("old_version").eqNullSafe(F.col("new_version"))).withColumn("change_type", kind)


def reviewed(changes: DataFrame, levels: DataFrame) -> DataFrame:
    """changes with needs_review: what is added without a known equivalent, removed with one, or changed with a doubtful one."""
    out = changes.join(levels.select("package", "level"), "package", "left").withColumn("level", F.coalesce("level", F.lit("unknown")))
    need = F.when(F.col("change_type") == "added", F.col("level").isin("unknown", "none")).when(F.col("change_type") == "removed", F.col("level").isin("full", "partial")).otherwise(F.col("level").isin("partial", "unknown"))
    return out.withColumn("needs_review", need)


def change_impact(changes: DataFrame, modules: DataFrame, shown: int = 20) -> DataFrame:
    """changes with the modules they touch, the first few of them, and whether many are touched without an equivalent."""
    out = changes.join(modules, "package", "left").withColumn("affected", F.coalesce("affected", F.lit(0).cast("long")))
    return out.withColumn("modules", F.slice(F.coalesce("modules", F.array().cast("array<string>")), 1, shown)).withColumn("high_risk", touches_many())


def ordered_first(rows: DataFrame, key: list[str], by: list) -> DataFrame:
    """Of each key the first row in the given order."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(*by))).filter("_nth = 1").drop("_nth")
