"""Registries, conventions and overrides from TOML files."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from factloom.functions.naming import Conventions


def _tables(folder: str) -> list[dict]:
    out = []
    for path in sorted(Path(folder).glob("*.toml")):
        with path.open("rb") as f:
            out.append(tomllib.load(f))
    return out


def libraries(spark: SparkSession, folder: str, ecosystem: str) -> DataFrame:
    """ecosystem, name, lib_type, description, tags of each [library.<name>] in a folder's TOML files; odd entries are skipped."""
    rows = {}
    for found in _tables(folder):
        for name, x in found.get("library", {}).items():
            if isinstance(x, dict) and isinstance(x.get("tags", []), list):
                rows[name] = (ecosystem, name, str(x.get("type", "library")), x.get("description"), [str(t) for t in x.get("tags", [])])
    return spark.createDataFrame(list(rows.values()), "ecosystem string, name string, lib_type string, description string, tags array<string>")


def conventions(folder: str) -> Conventions:
    """A language pair's prefixes, case style, types (those with holes are generics) and calls; what a file lacks stays empty."""
    found: dict = {}
    for x in _tables(folder):
        found |= x
    rule = found.get("convention", {})
    types = found.get("type_mapping", {})
    plain, generics = ({k: v for k, v in types.items() if ("{" in k) == hole} for hole in (False, True))
    return Conventions(tuple(rule.get("strip_prefixes", ())), plain, generics, dict(found.get("api_mapping", {})), rule.get("case") != "SnakeToCamel")


#: Fixed value: languages that a project may have.
LANGUAGES = ("typescript", "rust", "javascript")


@dataclass(frozen=True)
class Project:
    """A project's settings; a source language that isn't given is to be found out."""

    target_language: str = "rust"
    source_language: str | None = None
    ignored: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        for what, language in (("source", self.source_language), ("target", self.target_language)):
            if language is not None and language not in LANGUAGES:
                raise ValueError(f"{what} language {language!r} is none of {', '.join(LANGUAGES)}")


def project(path: str) -> Project:
    """The settings of a TOML file's [project] (source_lang, target_lang) and [ignore] (patterns)."""
    with Path(path).open("rb") as f:
        found = tomllib.load(f)
    of = found.get("project", {})
    return Project(of.get("target_lang", "rust"), of.get("source_lang"), tuple(found.get("ignore", {}).get("patterns", ())))


def overrides(spark: SparkSession, path: str, target: str) -> DataFrame:
    """package, equivalent, level, tags, guidance of an override file's entries for a target language.

    Guidance is one text for all targets or a table by target."""
    with Path(path).open("rb") as f:
        found = tomllib.load(f)
    rows = []
    for package, x in found.items():
        if not isinstance(x, dict):
            continue
        said = x.get("guidance")
        said = said.get(target) if isinstance(said, dict) else said
        level = str(x.get("compatibility", "unknown")).strip().lower()
        rows.append((package, (x.get("packages") or {}).get(target), level if level in ("full", "partial", "none") else "unknown", [str(t) for t in x.get("tags", [])], said))
    return spark.createDataFrame(rows, "package string, equivalent string, level string, tags array<string>, guidance string")
