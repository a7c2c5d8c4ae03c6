"""Two versions of symbols, files and imports compared.

symbols(module, name, kind, ordinal, line_start, line_end, params array<struct<name,type,optional>>, return_type,
is_async, value, doc, attributes array<string>, children array<struct<kind,name>>)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: removed and added symbols this alike are a rename.
RENAME = 0.75


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays: a fold that carries one row of the table."""

    def row(prev: Column, x: Column) -> Column:
        def cell(acc: Column, j: Column) -> Column:
            best = F.when(F.get(b, j) == x, F.get(prev, j) + 1).otherwise(F.greatest(F.element_at(acc, -1), F.get(prev, j + 1)))
            return F.concat(acc, F.array(best))

        places = F.when(F.size(b) > 0, F.sequence(F.lit(0), F.size(b) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, F.array(F.lit(0)), cell)

    return F.element_at(F.aggregate(a, F.array_repeat(F.lit(0), F.size(b) + 1), row), -1)


def structural_similarity(old: dict[str, Column], new: dict[str, Column]) -> Column:
    """Half by the order of child kinds, then by lines and by number of children; old, new: kinds (array) and lines."""
    n, m = F.size(old["kinds"]), F.size(new["kinds"])
    ratio = lambda x, y: F.when(F.greatest(x, y) == 0, 1.0).otherwise(F.least(x, y) / F.greatest(x, y))
    order = F.when(n + m == 0, 1.0).otherwise(2.0 * lcs(old["kinds"], new["kinds"]) / (n + m))
    return order * 0.5 + ratio(old["lines"], new["lines"]) * 0.3 + ratio(n, m) * 0.2


def _versions(old: DataFrame, new: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of rows with one key the last; each as a struct."""
    side = lambda df, x: df.groupBy(*key).agg(F.max_by(F.struct("*"), "ordinal").alias(x))
    return side(old, "old"), side(new, "new")


def symbol_mapping(old: DataFrame, new: DataFrame) -> DataFrame:
    """module, old_name, new_name, status (stable, renamed, removed, added), confidence.

    A removed symbol is renamed if an added one of its module and kind is alike enough: the last such one."""
    a, b = _versions(old, new, ["module", "name"])
    both = a.join(b, ["module", "name"], "full_outer")
    stable = both.filter("old is not null and new is not null").select("module", F.col("name").alias("old_name"), F.col("name").alias("new_name"), F.lit("stable").alias("status"), F.lit(1.0).alias("confidence"))
    removed = both.filter("new is null").select("module", F.col("name").alias("old_name"), "old")
    added = both.filter("old is null").select("module", F.col("name").alias("new_name"), "new")
    traits = lambda x: {"kinds": F.transform(F.col(f"{x}.children"), lambda c: c["kind"]), "lines": F.col(f"{x}.line_end") - F.col(f"{x}.line_start")}
    near = removed.join(added, (removed["module"] == added["module"]) & (F.col("old.kind") == F.col("new.kind"))).select(removed["module"], "old_name", "new_name", F.col("new.ordinal").alias("at"), structural_similarity(traits("old"), traits("new")).alias("s")).filter(F.col("s") >= RENAME)
    renamed = near.groupBy("module", "old_name").agg(F.max(F.struct("at", "new_name", "s")).alias("m")).select("module", "old_name", F.col("m.new_name").alias("new_name"), F.lit("renamed").alias("status"), F.col("m.s").alias("confidence"))
    gone = removed.join(renamed, ["module", "old_name"], "left_anti").select("module", "old_name", F.lit(None).cast("string").alias("new_name"), F.lit("removed").alias("status"), F.lit(1.0).alias("confidence"))
    fresh = added.join(renamed, ["module", "new_name"], "left_anti").select("module", F.lit(None).cast("string").alias("old_name"), "new_name", F.lit("added").alias("status"), F.lit(1.0).alias("confidence"))
    return stable.unionByName(renamed).unionByName(gone).unionByName(fresh)


def _change(aspect: Column | str, severity: str, detail: Column) -> Column:
    return F.struct((F.lit(aspect) if isinstance(aspect, str) else aspect).alias("aspect"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail"))


def param_changes(old: Column, new: Column) -> Column:
    """Changes of parameters, by place: a rename where type stays, a changed type (breaking), optionality; by name: removed, added."""
    pairs = F.filter(F.arrays_zip(old.alias("o"), new.alias("n")), lambda p: p["o"].isNotNull() & p["n"].isNotNull())
    names = lambda x: F.transform(x, lambda p: p["name"])
    renames = F.filter(pairs, lambda p: (p["o"]["name"] != p["n"]["name"]) & p["o"]["type"].eqNullSafe(p["n"]["type"]))
    was, now = F.transform(renames, lambda p: p["o"]["name"]), F.transform(renames, lambda p: p["n"]["name"])
    typed = F.filter(pairs, lambda p: ~p["o"]["type"].eqNullSafe(p["n"]["type"]) & (p["o"]["name"] == p["n"]["name"]))
    optional = F.filter(pairs, lambda p: (p["o"]["name"] == p["n"]["name"]) & (p["o"]["optional"] != p["n"]["optional"]))
    removed = F.array_except(F.array_except(names(old), names(new)), was)
    added = F.array_except(F.array_except(names(new), names(old)), now)
    return F.concat(
        F.transform(renames, lambda p: _change("param_renamed", "compatible", F.concat_ws("->", p["o"]["name"], p["n"]["name"]))),
        F.transform(removed, lambda x: _change("param_removed", "compatible", x)),
        F.transform(added, lambda x: _change("param_added", "compatible", x)),
        F.transform(typed, lambda p: _change("param_type", "breaking", F.concat_ws("->", p["o"]["type"], p["n"]["type"]))),
        F.transform(optional, lambda p: _change("param_optional", "compatible", p["n"]["name"])),
    )


def child_changes(old: Column, new: Column) -> Column:
    """Children by kind and name: added, or removed (breaking)."""
    return F.concat(
        F.transform(F.array_except(new, old), lambda c: _change(c["kind"], "compatible", F.concat(F.lit("+"), c["name"]))),
        F.transform(F.array_except(old, new), lambda c: _change(c["kind"], "breaking", F.concat(F.lit("-"), c["name"]))),
    )


def flag_change(aspect: str, severity: str, old: Column, new: Column) -> Column:
    """One change where the values differ; nulls equal each other."""
    text = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    return F.array_compact(F.array(F.when(~old.eqNullSafe(new), _change(aspect, severity, F.concat_ws("->", text(old), text(new))))))


def doc_change(old: Column, new: Column) -> Column:
    return F.when(old.isNull() & new.isNotNull(), "added").when(old.isNotNull() & new.isNull(), "removed").when(old != new, "changed")


def doc_notes(doc: Column, attributes: Column) -> Column:
    """What a symbol's documentation tells besides: is_deprecated, has_todo, has_safety_note."""
    says = lambda *words: F.coalesce(F.reduce(F.array(*[F.lit(w) for w in words]), F.lit(False), lambda acc, w: acc | doc.contains(w)), F.lit(False))
    old = F.coalesce(F.arrays_overlap(attributes, F.array(F.lit("#[deprecated]"), F.lit("@deprecated"))), F.lit(False))
    return F.struct(old.alias("is_deprecated"), says("TODO", "FIXME", "HACK").alias("has_todo"), says("SAFETY", "unsafe").alias("has_safety_note"))


def doc_changes(pairs: DataFrame) -> DataFrame:
    """pairs(module, name, o, n), the versions as structs with doc and attributes -> module, name, change, the later version's notes, old_doc,
    new_doc: where the text or a note differs."""
    noted = pairs.select("module", "name", F.col("o.doc").alias("old_doc"), F.col("n.doc").alias("new_doc"), doc_notes(F.col("o.doc"), F.col("o.attributes")).alias("a"), doc_notes(F.col("n.doc"), F.col("n.attributes")).alias("b"))
    change = F.coalesce(doc_change(F.col("old_doc"), F.col("new_doc")), F.lit("changed"))
    return noted.filter((F.col("a") != F.col("b")) | ~F.col("old_doc").eqNullSafe(F.col("new_doc"))).select("module", "name", change.alias("change"), "b.*", "old_doc", "new_doc")


def symbol_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """module, name, change_type, aspect, severity, detail of all symbols that changed, came or went."""
    mapping = symbol_mapping(old, new)
    a, b = _versions(old, new, ["module", "name"])
    pairs = mapping.filter("status in ('stable', 'renamed')").join(a.select("module", F.col("name").alias("old_name"), "old"), ["module", "old_name"]).join(b.select("module", F.col("name").alias("new_name"), "new"), ["module", "new_name"])
    o, n = (lambda f: F.col(f"old.{f}")), (lambda f: F.col(f"new.{f}"))
    rename = F.array_compact(F.array(F.when(F.col("status") == "renamed", _change("name", "compatible", F.concat_ws("->", "old_name", "new_name")))))
    value = F.when(o("kind").isin("const", "variable", "static"), flag_change("value", "compatible", o("value"), n("value"))).otherwise(F.array_compact(F.array(F.when(F.lit(False), _change("value", "compatible", F.lit(""))))))
    every = F.concat(rename, param_changes(o("params"), n("params")), flag_change("return_type", "breaking", o("return_type"), n("return_type")), flag_change("async", "breaking", o("is_async"), n("is_async")), child_changes(o("children"), n("children")), value)
    changed = pairs.select("module", F.col("new_name").alias("name"), F.when(F.col("status") == "renamed", "renamed").otherwise("modified").alias("change_type"), F.explode(every).alias("c")).select("module", "name", "change_type", "c.*")
    whole = mapping.filter("status in ('added', 'removed')").select("module", F.coalesce("old_name", "new_name").alias("name"), F.col("status").alias("change_type"), F.lit("symbol").alias("aspect"), F.when(F.col("status") == "removed", "breaking").otherwise("compatible").alias("severity"), F.coalesce("old_name", "new_name").alias("detail"))
    return changed.unionByName(whole)


def summary(changes: DataFrame, imports: DataFrame) -> DataFrame:
    """One row of counts of symbol and import changes (change_type, severity; change_type)."""
    kinds = ("added", "removed", "modified", "renamed")
    of = changes.agg(*[F.count_if(F.col("change_type") == k).alias(k) for k in kinds], F.count_if(F.col("severity") == "breaking").alias("breaking"))
    return of.crossJoin(imports.agg(*[F.count_if(F.col("change_type") == k).alias(f"imports_{k}") for k in ("added", "removed")]))


def set_changes(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of key on one side only, with change_type."""
    both = old.select(*key).distinct().withColumn("_o", F.lit(True)).join(new.select(*key).distinct().withColumn("_n", F.lit(True)), key, "full_outer")
    return both.filter("_o is null or _n is null").select(*key, F.when(F.col("_o").isNull(), "added").otherwise("removed").alias("change_type"))


def file_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """old, new (path, source) -> path, status: added, removed, modified or unchanged, and line counts."""
    lines = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(F.split(c, "\n")))
    both = old.select("path", F.col("source").alias("o")).join(new.select("path", F.col("source").alias("n")), "path", "full_outer")
    status = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") == F.col("n"), "unchanged").otherwise("modified")
    return both.select("path", status.alias("status"), lines("o").cast("long").alias("old_lines"), lines("n").cast("long").alias("new_lines"))
