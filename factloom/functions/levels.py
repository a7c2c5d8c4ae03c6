"""Levels, efforts, labels, rounding and risk tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers of the levels and efforts, and the effort each level defaults to.
LEVEL_SCORE = {"full": 1.0, "partial": 0.5, "none": 0.0, "unknown": 0.3}
EFFORT_SCORE = {"trivial": 0.15, "moderate": 0.45, "heavy": 0.75, "rewrite": 1.0, "unknown": 0.5}
DEFAULT_EFFORT = {"full": "trivial", "partial": "moderate", "none": "rewrite", "unknown": "unknown"}
RISKY_TAGS = ("async", "ffi", "concurrency", "unsafe", "crypto", "realtime", "ssr")
ACCEPTABLE_KINDS = (("interface", "struct"), ("interface", "enum"), ("type_alias", "enum"), ("type_alias", "struct"), ("type_alias", "type"), ("variable", "const"), ("variable", "static"), ("enum", "struct"))


def _by(value: Column, table: dict, default) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[value], F.lit(default))


def round2(x: Column) -> Column:
    """Two decimals, half away from zero on the binary value times 100."""
    return F.round(x * 100) / 100


def effort_label(score: Column) -> Column:
    return F.when(score >= 70, "trivial").when(score >= 50, "moderate").when(score >= 30, "heavy").otherwise("rewrite")


def level_of(similarity: Column) -> Column:
    return F.when(similarity >= 0.5, "full").when(similarity >= 0.25, "partial").when(similarity > 0, "none").otherwise("unknown")


def level_score(level: Column) -> Column:
    return _by(level, LEVEL_SCORE, LEVEL_SCORE["unknown"])


def effort_score(effort: Column) -> Column:
    return _by(effort, EFFORT_SCORE, EFFORT_SCORE["unknown"])


def default_effort(level: Column) -> Column:
    return _by(level, DEFAULT_EFFORT, "unknown")


def is_high_impact(effort: Column) -> Column:
    return effort.isin("heavy", "rewrite")


def parsed(text: Column, known: dict) -> Column:
    """A level or effort as written by hand; what isn't known is unknown."""
    name = F.lower(F.trim(text))
    return F.when(name.isin(*known), name).otherwise("unknown")


def risk_tags(effort: Column, level: Column, tags: Column, guidance: Column) -> Column:
    """Tags of what may go wrong, each once, in a fixed order."""
    own = F.array_compact(F.array(F.when(is_high_impact(effort), effort), F.when(level == "none", "no-equivalent"), F.when(level == "unknown", "unverified")))
    listed = F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.lower), lambda t: t.isin(*RISKY_TAGS))
    low = F.lower(guidance)
    said = F.array_compact(F.array(F.when(low.contains("unsafe") | low.contains("ffi") | low.contains("no direct"), "ffi")))
    return F.array_distinct(F.concat(own, listed, said))


def acceptable(expected: Column, actual: Column) -> Column:
    """Kinds that stand for each other across languages, besides equal ones."""
    pairs = F.array(*[F.lit(f"{a} {b}") for a, b in ACCEPTABLE_KINDS])
    return (expected == actual) | F.array_contains(pairs, F.concat_ws(" ", expected, actual))


def percent(part: Column, whole: Column, empty: float) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(empty))


def version_part(version: Column, place: int) -> Column:
    """The number at a place of a dotted version with or without v; 0 where there is none."""
    return F.coalesce(F.get(F.split(F.regexp_replace(version, "^v+", ""), r"\."), F.lit(place)).try_cast("long"), F.lit(0).cast("long"))


def version_change(old: Column, new: Column) -> Column:
    """upgraded, downgraded or patch, by major and minor."""
    a = F.struct(version_part(old, 0).alias("major"), version_part(old, 1).alias("minor"))
    b = F.struct(version_part(new, 0).alias("major"), version_part(new, 1).alias("minor"))
    return F.when(b > a, "upgraded").when(b < a, "downgraded").otherwise("patch")


def is_major(old: Column, new: Column) -> Column:
    """Whether the first number rose; false where a version is missing."""
    return F.coalesce(version_part(new, 0) > version_part(old, 0), F.lit(False)) & old.isNotNull() & new.isNotNull()
