"""Names, types, calls and paths carried from one language's conventions to another's."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes that fall off a type name, in order, and the type and call maps from TypeScript to Rust.
STRIP_PREFIXES = ("I", "IBase", "T")
TYPE_MAP = {
    "string": "String",
    "number": "i32",
    "bigint": "i64",
    "boolean": "bool",
    "any": "Any",
    "void": "()",
    "null": "None",
    "undefined": "()",
    "never": "!",
    "unknown": "Box<dyn Any>",
    "object": "serde_json::Value",
    "Error": "Box<dyn std::error::Error>",
    "Date": "chrono::DateTime<Utc>",
    "Buffer": "Vec<u8>",
    "RegExp": "regex::Regex",
}
#: Generic types from TypeScript to Rust; what stands in a hole is itself translated and holds no other generic.
GENERICS = {
    "Promise<{T}>": "Result<{T}>",
    "Array<{T}>": "Vec<{T}>",
    "Record<string, {T}>": "HashMap<String, {T}>",
    "Map<{K}, {V}>": "HashMap<{K}, {V}>",
    "Set<{T}>": "HashSet<{T}>",
}


@dataclass(frozen=True)
class Conventions:
    """A language pair's rules, as sources.registry reads them or as above."""

    strip_prefixes: tuple[str, ...] = STRIP_PREFIXES
    types: dict[str, str] = field(default_factory=lambda: dict(TYPE_MAP))
    generics: dict[str, str] = field(default_factory=lambda: dict(GENERICS))
    calls: dict[str, str] = field(default_factory=dict)
    to_snake: bool = True


def snake_case(name: Column) -> Column:
    """XMLParser -> xml_parser, APP_NAME -> app_name: ASCII capitals only."""
    apart = F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.lower(F.regexp_replace(apart, "([^_A-Z])([A-Z])", "$1_$2"))


def camel_case(name: Column) -> Column:
    """display_name -> displayName; the part before the first underscore stays."""
    parts = F.split(name, "_")
    raised = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p))))
    return F.concat(F.get(parts, F.lit(0)), F.array_join(raised, ""))


def strip_prefix(name: Column, prefixes: tuple[str, ...] = STRIP_PREFIXES) -> Column:
    """Without the first prefix that a capital follows."""
    out = name
    for p in reversed(prefixes):
        out = F.when(name.rlike(f"^{p}[A-Z]"), name.substr(F.lit(len(p) + 1), F.length(name))).otherwise(out)
    return out


def translate_name(name: Column, rules: Conventions = Conventions()) -> Column:
    bare = strip_prefix(name, rules.strip_prefixes)
    return snake_case(bare) if rules.to_snake else camel_case(bare)


def candidates(name: Column, rules: Conventions = Conventions()) -> Column:
    """The names to look for: as it is, stripped, recased, both."""
    recase = snake_case if rules.to_snake else camel_case
    bare = strip_prefix(name, rules.strip_prefixes)
    return F.array_distinct(F.array(name, bare, recase(name), recase(bare)))


def _mapped(value: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[value] if table else F.lit(None).cast("string")


def translate_type(name: Column, rules: Conventions = Conventions()) -> Column:
    """Exact, or a generic of the rules, the first that fits; others stay."""
    plain = lambda x: F.coalesce(_mapped(x, rules.types), x)
    out = plain(name)
    for source, target in reversed(rules.generics.items()):
        parts, holes = re.split(r"\{\w+\}", source), re.findall(r"\{\w+\}", source)
        pattern = "^" + r"([^<>]*?)".join(map(re.escape, parts)) + "$"
        made = [plain(F.regexp_extract(name, pattern, holes.index(x) + 1)) if x in holes else F.lit(x) for x in re.split(r"(\{\w+\})", target) if x]
        out = F.when(name.rlike(pattern), F.concat(*made)).otherwise(out)
    return out


def translate_calls(calls: Column, rules: Conventions) -> Column:
    """Each call of a chain by the map, or as it is."""
    return F.transform(calls, lambda c: F.coalesce(_mapped(c, rules.calls), c))


def loose(name: Column) -> Column:
    """Lower-cased without underscores: names that differ in case style alone are equal."""
    return F.lower(F.replace(name, F.lit("_"), F.lit("")))


def target_path(path: Column, extension: str = "rs") -> Column:
    return F.regexp_replace(path, r"\.[^./]+$", f".{extension}")


def default_target(path: Column) -> Column:
    """By suffix; other files have none."""
    return F.when(path.rlike(r"\.(ts|tsx|js|vue)$"), F.regexp_replace(path, r"\.(ts|tsx|js|vue)$", ".rs"))
