"""Symbols of one language matched with those of another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.naming import Conventions, candidates, default_target, translate_name, translate_type
from factloom.operators.rounds import settled

#: Confidence of a match by name, and the least score of one by signature.
BY_NAME, LEAST = 0.85, 0.5


def signature_similarity(a: dict[str, Column], b: dict[str, Column], rules: Conventions = Conventions()) -> Column:
    """a, b: name, types (array), returns. Names weigh .4, the number of parameters .3, their types .2, the result .1."""
    named = F.when((translate_name(a["name"], rules) == b["name"]) | (a["name"] == b["name"]), 0.4).otherwise(0.0)
    apart = F.abs(F.size(a["types"]) - F.size(b["types"]))
    counted = F.when(apart == 0, 0.3).when(apart <= 2, 0.15).otherwise(0.0)
    met = F.size(F.filter(a["types"], lambda t: F.array_contains(b["types"], translate_type(t, rules)) | F.array_contains(b["types"], t)))
    typed = F.when((F.size(a["types"]) > 0) & (F.size(b["types"]) > 0), met / F.greatest(F.size(a["types"]), F.size(b["types"])) * 0.2).otherwise(0.0)
    same = F.coalesce((translate_type(a["returns"], rules) == b["returns"]) | (a["returns"] == b["returns"]), F.lit(False))
    returned = F.when(a["returns"].isNull() & b["returns"].isNull(), 0.05).when(same, 0.1).otherwise(0.0)
    return F.least(named + counted + typed + returned, F.lit(1.0))


def children_similarity(source: Column, target: Column, rules: Conventions = Conventions()) -> Column:
    """The part of the source's child names that the target has, translated or as they are."""
    hit = F.filter(source, lambda n: F.array_contains(target, translate_name(n, rules)) | F.array_contains(target, n))
    return F.when(F.size(source) > 0, F.size(hit) / F.size(source)).otherwise(1.0)


def match_by_name(source: DataFrame, target: DataFrame, rules: Conventions = Conventions()) -> DataFrame:
    """source(file, name), target(file, name, ordinal) -> file, name, target_file, target_name, confidence.

    A source is looked for in its default target file if there is one, and else in all; the first of the target's order
    wins. Without a match it keeps its default file, no name and confidence 0."""
    files = target.select(F.col("file").alias("target_file")).distinct().withColumn("there", F.lit(True))
    asked = source.withColumn("target_file", default_target(F.col("file"))).join(files, "target_file", "left").withColumn("key", F.explode(candidates(F.col("name"), rules)))
    at = target.select(F.col("file").alias("at_file"), F.col("name").alias("key"), "ordinal")
    hit = asked.join(at, "key").filter("there is null or at_file = target_file")
    best = hit.groupBy("file", "name").agg(F.min(F.struct("at_file", "ordinal", "key")).alias("m"))
    out = source.join(best, ["file", "name"], "left")
    return out.select("file", "name", F.coalesce("m.at_file", default_target(F.col("file"))).alias("target_file"), F.col("m.key").alias("target_name"), F.when(F.col("m").isNotNull(), BY_NAME).otherwise(0.0).alias("confidence"))


def match_by_signature(source: DataFrame, target: DataFrame, rules: Conventions = Conventions()) -> DataFrame:
    """source, target (file, name, types, returns) -> file, name, target_file, target_name, confidence: of the symbols in the source's default target
    file, or of all where there is no such file, the one whose signature is most alike, if it is by more than LEAST; ties go to the smaller
    name, then file.

    Over all files a score above LEAST without the name needs as many parameters, more than half of their types and the same result
    (or none on both sides). So symbols of one profile (types and result) are one row each, those of the target by their first name, and
    profiles meet by number, result and a type; symbols that share a name meet by it."""
    other = target.select(F.col("file").alias("target_file"), F.col("name").alias("target_name"), F.col("types").alias("_types"), F.col("returns").alias("_returns"))
    score = signature_similarity({c: F.col(c) for c in ("name", "types", "returns")}, {"name": F.col("target_name"), "types": F.col("_types"), "returns": F.col("_returns")}, rules)
    asked = source.withColumn("target_file", default_target(F.col("file")))
    known = other.select("target_file").distinct()
    scored = [asked.join(other, "target_file")]
    free = asked.join(known, "target_file", "left_anti").drop("target_file")
    scored.append(free.withColumn("_key", F.explode(F.array_distinct(F.array(F.col("name"), translate_name(F.col("name"), rules))))).join(other, F.col("_key") == F.col("target_name")).drop("_key"))
    # profiles
    none = F.lit(None).cast("string")
    either = lambda x: F.array_distinct(F.array(x, translate_type(x, rules)))
    own = free.filter(F.size("types") > 0).select("types", "returns").distinct()
    own = own.withColumn("_r", F.explode(F.when(F.col("returns").isNull(), F.array(none)).otherwise(either(F.col("returns"))))).withColumn("_t", F.explode(F.flatten(F.transform("types", either))))
    first = other.filter(F.size("_types") > 0).groupBy("_types", "_returns").agg(F.min(F.struct("target_name", "target_file")).alias("m"))
    first = first.withColumn("_type", F.explode(F.array_distinct("_types")))
    met = (F.size("types") == F.size("_types")) & F.col("_r").eqNullSafe(F.col("_returns")) & (F.col("_t") == F.col("_type"))
    near = own.join(first, met).select("types", "returns", "_types", "_returns", "m.target_file", "m.target_name").distinct()
    profile = near.withColumn("name", F.lit("")).withColumn("_s", score).filter(F.col("_s") > LEAST).groupBy("types", "returns").agg(F.min(F.struct((-F.col("_s")).alias("s"), "target_name", "target_file", "_types", "_returns")).alias("p"))
    best_profile = profile.select(F.col("types").alias("_a"), F.col("returns").alias("_b"), "p.target_file", "p.target_name", "p._types", "p._returns")
    scored.append(free.join(best_profile, (F.col("types") == F.col("_a")) & F.col("returns").eqNullSafe(F.col("_b"))).drop("_a", "_b"))
    columns = ("file", "name", "types", "returns", "target_file", "target_name", "_types", "_returns")
    every = scored[0].select(*columns).unionByName(scored[1].select(*columns)).unionByName(scored[2].select(*columns))
    best = every.withColumn("s", score).filter(F.col("s") > LEAST).groupBy("file", "name").agg(F.min(F.struct((-F.col("s")).alias("s"), "target_name", "target_file")).alias("m"))
    return best.select("file", "name", F.col("m.target_file").alias("target_file"), F.col("m.target_name").alias("target_name"), (-F.col("m.s")).alias("confidence"))


def aligned(source: DataFrame, target: DataFrame, rules: Conventions = Conventions()) -> DataFrame:
    """source(file, name, types, returns), target(file, name, ordinal, types, returns) -> file, name, target_file, target_name, confidence, match_level: by
    name, what is left by signature, and what is left then with its default file alone (match_level none)."""
    named = settled(match_by_name(source.select("file", "name").distinct(), target, rules))
    left = named.filter("target_name is null")
    found = settled(match_by_signature(source.join(left.select("file", "name"), ["file", "name"], "left_semi"), target, rules))
    rest = left.join(found.select("file", "name"), ["file", "name"], "left_anti")
    level = lambda df, name: df.withColumn("match_level", F.lit(name))
    return level(named.filter("target_name is not null"), "name").unionByName(level(found, "signature")).unionByName(level(rest, "none"))


def child_context(matched: DataFrame, changes: DataFrame, children: DataFrame, rules: Conventions = Conventions()) -> DataFrame:
    """file, name, target_child, line, line_end of matched symbols (file, name, target_file, target_name) with changes within.

    changes(file, name, at, aspect, new_value, old_value): the first that is a member's, method's or property's counts.
    children(file, parent, name, line, line_end, parent_line, parent_line_end): those of the targets. A child that isn't
    there is named as it would be, with its parent's lines."""
    inner = changes.filter("aspect in ('member', 'method', 'property')").groupBy("file", "name").agg(F.min_by(F.coalesce("new_value", "old_value"), "at").alias("child")).filter("child <> ''")
    asked = matched.filter("target_name is not null").join(inner, ["file", "name"]).withColumn("target_child", translate_name(F.col("child"), rules))
    there = children.select(F.col("file").alias("target_file"), F.col("parent").alias("target_name"), F.col("name").alias("target_child"), "line", "line_end")
    parents = children.groupBy(F.col("file").alias("target_file"), F.col("parent").alias("target_name")).agg(F.min("parent_line").alias("parent_line"), F.max("parent_line_end").alias("parent_line_end"))
    out = asked.join(parents, ["target_file", "target_name"], "left").join(there, ["target_file", "target_name", "target_child"], "left")
    return out.select("file", "name", "target_child", F.coalesce("line", "parent_line").alias("line"), F.coalesce("line_end", "parent_line_end").alias("line_end"))
