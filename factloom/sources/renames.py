"""Renamed and copied files between two snapshots (path, source), by the lines they share.

Two files are alike by the bytes of the lines both hold, over the bytes of the larger. Exact moves are found first, by content.
For the others only a file's rarest lines are indexed: so many that the rest weighs less than the threshold allows, so
files alike enough share one of them (in one global order of lines, rare ones first); pairs are then verified over all lines.
Of the pairs left, those that are best for both sides are taken, round by round: what a pass from the most alike pair down would take.

Defined cases: a null source is an empty file, and empty files are never renamed; of equal similarities the smaller old path, then the
smaller new one, goes first. Families of nearly equal files that differ in frequent lines alone meet pair by pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.rounds import settled, stored

#: The part of the larger file that two files share at least.
ALIKE = 0.5


def _lines(files: DataFrame) -> DataFrame:
    """path, line (its hash), weight (bytes of all its occurrences, with their breaks), bytes (of the file)."""
    source = F.coalesce("source", F.lit(""))
    each = files.select("path", (F.octet_length(source) + 1).cast("long").alias("bytes"), F.explode(F.split(source, "\n")).alias("line"))
    return each.groupBy("path", F.xxhash64("line").alias("line")).agg(F.sum(F.octet_length("line") + 1).alias("weight"), F.max("bytes").alias("bytes"))


def _rarest(lines: DataFrame, common: DataFrame, alike: float) -> DataFrame:
    """path, line of the lines that are indexed."""
    order = Window.partitionBy("path").orderBy("files", "line").rowsBetween(Window.unboundedPreceding, -1)
    ranked = lines.join(common, "line").withColumn("before", F.coalesce(F.sum("weight").over(order), F.lit(0)))
    return ranked.filter(F.col("bytes") - F.col("before") >= F.col("bytes") * alike).select("path", "line")


def alike(old: DataFrame, new: DataFrame, least: float = ALIKE) -> DataFrame:
    """old_path, path, similarity of all pairs of these files with `least` or more."""
    a, b = stored(_lines(old), "old-lines"), stored(_lines(new), "new-lines")
    common = a.select("line").unionByName(b.select("line")).groupBy("line").agg(F.count("*").alias("files"))
    left = _rarest(a, common, least).withColumnRenamed("path", "old_path")
    pairs = left.join(_rarest(b, common, least), "line").select("old_path", "path").distinct()
    sizes = lambda x, name: x.select(F.col("path").alias(name), F.col("bytes").alias(f"{name}_bytes")).distinct()
    pairs = pairs.join(sizes(a, "old_path"), "old_path").join(sizes(b, "path"), "path")
    pairs = pairs.filter(F.least("old_path_bytes", "path_bytes") >= F.greatest("old_path_bytes", "path_bytes") * least)  # no smaller file can share that much
    both = pairs.join(a.select(F.col("path").alias("old_path"), "line", F.col("weight").alias("v")), "old_path").join(b.select("path", "line", F.col("weight").alias("w")), ["path", "line"])
    shared = both.groupBy("old_path", "path").agg(F.sum(F.least("v", "w")).alias("shared"), F.first(F.greatest("old_path_bytes", "path_bytes")).alias("most"))
    return shared.filter(F.col("shared") >= F.col("most") * least).select("old_path", "path", (F.col("shared") / F.col("most")).alias("similarity"))


def _moved(removed: DataFrame, added: DataFrame) -> DataFrame:
    """old_path, path of equal contents: the n-th that is gone is the n-th that is new."""
    key = F.sha2(F.col("source"), 256)
    nth = lambda df, name: df.filter("source <> ''").select(F.col("path").alias(name), key.alias("key")).withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(name)))
    return nth(removed, "old_path").join(nth(added, "path"), ["key", "n"]).select("old_path", "path")


def _differing(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """path, status A, D or M of all files that differ; path, source of those that are gone, and of those that are new. The snapshots are met
    once and what differs is stored, as all that follows reads it several times."""
    plain = lambda df, name: df.select("path", F.coalesce("source", F.lit("")).alias(name))
    both = plain(old, "o").join(plain(new, "n"), "path", "full_outer").filter(~F.col("o").eqNullSafe(F.col("n")))
    both = stored(both, "differing-files")
    status = F.when(F.col("o").isNull(), "A").when(F.col("n").isNull(), "D").otherwise("M")
    one = lambda name, other: both.filter(f"{other} is null").select("path", F.col(name).alias("source"))
    return both.select("path", status.alias("status")), one("o", "n"), one("n", "o")


def renames(old: DataFrame, new: DataFrame, least: float = ALIKE, copies: bool = False) -> DataFrame:
    """path, old_path, status (R, with copies also C), similarity of the files of new that were renamed, or copied from a file that stays."""
    _, removed, added = _differing(old, new)
    return _renamed(removed, added, old, least, copies)


def _renamed(removed: DataFrame, added: DataFrame, old: DataFrame, least: float, copies: bool) -> DataFrame:
    exact = settled(_moved(removed, added))
    a = removed.filter("source <> ''").join(exact.select(F.col("old_path").alias("path")), "path", "left_anti")
    b = added.filter("source <> ''").join(exact.select("path"), "path", "left_anti")
    pairs = settled(alike(a, b, least))
    taken = exact.withColumn("similarity", F.lit(1.0))
    order: tuple[Column, ...] = (F.desc("similarity"), F.asc("old_path"), F.asc("path"))
    while not pairs.isEmpty():
        best = lambda side: F.row_number().over(Window.partitionBy(side).orderBy(*order)) == 1
        both = settled(pairs.withColumns({"_o": best("old_path"), "_p": best("path")}).filter("_o and _p").select("old_path", "path", "similarity"))
        taken = taken.unionByName(both)
        pairs = settled(pairs.join(both.select("old_path"), "old_path", "left_anti").join(both.select("path"), "path", "left_anti"))
    out = taken.select("path", "old_path", F.lit("R").alias("status"), "similarity")
    if not copies:
        return out
    out = settled(out)
    rest = added.filter("source <> ''").join(out.select("path"), "path", "left_anti")
    near = alike(old.filter("source <> ''"), rest, least)
    first = near.groupBy("path").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "old_path")).alias("v"))
    return out.unionByName(first.select("path", "v.old_path", F.lit("C").alias("status"), (-F.col("v.s")).alias("similarity")))


def changes(old: DataFrame, new: DataFrame, least: float = ALIKE, copies: bool = False) -> DataFrame:
    """path, old_path, status (A, C, D, M, R), normalised (a rename is a change, a copy an addition) of all files that differ."""
    plain, removed, added = _differing(old, new)
    found = settled(_renamed(removed, added, old, least, copies))
    gone = found.filter("status = 'R'").select(F.col("old_path").alias("path"))
    plain = plain.join(found.select("path"), "path", "left_anti").join(gone, "path", "left_anti")
    out = plain.select("path", F.lit(None).cast("string").alias("old_path"), "status").unionByName(found.select("path", "old_path", "status"))
    return out.withColumn("normalised", F.when(F.col("status") == "R", "M").when(F.col("status") == "C", "A").otherwise(F.col("status")))
