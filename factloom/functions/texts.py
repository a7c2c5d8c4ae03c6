"""Paths, source text, documentation flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Manifests and lock files.
DEPENDENCY_FILES = ("package.json", "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "Cargo.toml", "Cargo.lock", "pnpm-lock.yaml", "bun.lock")


def normalised(path: Column, keep_leading: bool = True) -> Column:
    """Without . and ..; leading .. are kept or fall away."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")

    def step(acc: Column, p: Column) -> Column:
        n = F.size(acc)
        back = F.when((n > 0) & (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) != ".."), F.slice(acc, F.lit(1), n - 1)).otherwise(F.concat(acc, F.array(p)) if keep_leading else acc)
        return F.when(p.isin("", "."), acc).when(p == "..", back).otherwise(F.concat(acc, F.array(p)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def top_dir(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def dir_path(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def snippet(source: Column, first: Column, last: Column) -> Column:
    """Lines first to last, from 1; the empty text for a range that isn't there."""
    lines = F.split(source, "\n")
    ok = (first >= 1) & (first <= last) & (last <= F.size(lines))
    return F.when(ok, F.array_join(F.slice(lines, F.greatest(first, F.lit(1)), F.greatest(last - first + 1, F.lit(0))), "\n")).otherwise("")


def line_of(source: Column, offset: Column) -> Column:
    """The line, from 1, of a place in a text."""
    before = source.substr(F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def doc_flags(doc: Column, attributes: Column) -> dict[str, Column]:
    return {
        "deprecated": F.exists(attributes, lambda a: a.contains("deprecated")),
        "todo": F.coalesce(doc.rlike("TODO|FIXME|HACK"), F.lit(False)),
        "unsafe": F.coalesce(doc.rlike("SAFETY|unsafe"), F.lit(False)),
    }


def is_dependency_file(path: Column) -> Column:
    return F.substring_index(path, "/", -1).isin(*DEPENDENCY_FILES)


def has_extension(path: Column, extensions: list[str]) -> Column:
    return F.regexp_extract(path, r"\.([^./]+)$", 1).isin(*extensions)


def html_escaped(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def test_candidates(path: Column) -> Column:
    """Files whose presence shows that a module has tests."""
    folder = F.regexp_extract(path, "^(.*/)?[^/]*$", 1)
    stem = F.regexp_extract(path, r"^(?:.*/)?([^/]*?)(?:\.[^./]*)?$", 1)
    own = F.transform(F.array(F.lit(".test.rs"), F.lit(".test.ts"), F.lit(".spec.ts")), lambda e: F.concat(folder, stem, e))
    shared = F.transform(F.array(*map(F.lit, ("mod.test.rs", "mod.spec.ts", "index.test.ts", "index.spec.ts"))), lambda e: F.concat(folder, e))
    return F.when(stem.isin("mod", "index"), F.concat(own, shared)).otherwise(own)
