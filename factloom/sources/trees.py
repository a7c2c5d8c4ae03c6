"""Source trees and snapshots as relations."""

from __future__ import annotations

import re
import tomllib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that are never read, and files by language.
SKIPPED = ("node_modules", "target", ".git", "dist", "build")
EXTENSIONS = {"typescript": ("ts", "tsx"), "rust": ("rs",), "javascript": ("js", "jsx", "mjs", "cjs")}


#: Packages of frameworks, which are left out on request.
FRAMEWORK_PATTERNS = (
    "packages/vue/**",
    "packages/svelte/**",
    "packages/solid/**",
    "packages/react/**",
    "packages/next/**",
    "packages/ink/**",
    "packages/remotion/**",
    "packages/image/**",
    "packages/react-email/**",
    "packages/react-native/**",
    "packages/react-pdf/**",
    "packages/react-three-fiber/**",
    "packages/react-state/**",
    "packages/devtools-react/**",
    "packages/devtools-solid/**",
    "packages/devtools-svelte/**",
    "packages/devtools-vue/**",
    "packages/shadcn/**",
    "packages/shadcn-svelte/**",
    "packages/ui/**",
    "**/components/ui/*",
)


def language(path: Column) -> Column:
    ending = F.regexp_extract(path, r"\.([^./]+)$", 1)
    out = F.lit(None).cast("string")
    for name, endings in EXTENSIONS.items():
        out = F.when(ending.isin(*endings), name).otherwise(out)
    return out


def pattern(glob: str) -> str:
    """A glob as a regular expression over the whole relative path; * and ? also match a slash, ** any folders."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": ".*", "?": "."}.get(glob[i], re.escape(glob[i])), i + 1
    return f"^{out}$"


def selected(files: DataFrame, wanted: str | None = None, ignored: tuple[str, ...] = ()) -> DataFrame:
    """files(path, ...) outside the skipped folders and ignored globs, with language, or of one language."""
    folders = "|".join(re.escape(s) for s in SKIPPED)
    out = files.filter(~F.col("path").rlike(rf"(^|/)(({folders})(/|$)|[^/]*-migration(/|$))")).withColumn("language", language(F.col("path"))).filter("language is not null")
    for g in ignored:
        out = out.filter(~F.col("path").rlike(pattern(g)))
    return out if wanted is None else out.filter(F.col("language") == wanted)


def scan(spark: SparkSession, root: str, wanted: str | None = None, ignored: tuple[str, ...] = ()) -> DataFrame:
    """path (below root), source and language of a tree's files, read by Spark; source is null where a file isn't UTF-8 (see unreadable)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub(r"^[a-z]+:/+|^/+", "", root).rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", ""), f"^{re.escape(base)}/", "")
    return selected(found.select(path.alias("path"), F.try_validate_utf8(F.col("content").cast("string")).alias("source")), wanted, ignored)


def unreadable(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The files of a scan that could be read, and the paths of those that couldn't."""
    return files.filter("source is not null"), files.filter("source is null").select("path")


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two snapshots (path, source): path, status A, D or M, and lines added and removed, counted by line content."""
    line = lambda df: df.select("path", F.explode(F.split("source", "\n")).alias("line")).groupBy("path", "line").agg(F.count("*").alias("n"))
    lines = line(old).withColumnRenamed("n", "o").join(line(new).withColumnRenamed("n", "m"), ["path", "line"], "full_outer").fillna(0, ["o", "m"])
    counts = lines.groupBy("path").agg(F.sum(F.greatest(F.col("m") - F.col("o"), F.lit(0))).alias("added"), F.sum(F.greatest(F.col("o") - F.col("m"), F.lit(0))).alias("removed"))
    both = old.select("path", F.col("source").alias("o")).join(new.select("path", F.col("source").alias("n")), "path", "full_outer").filter(~F.col("o").eqNullSafe(F.col("n")))
    status = F.when(F.col("o").isNull(), "A").when(F.col("n").isNull(), "D").otherwise("M")
    return both.select("path", status.alias("status")).join(counts, "path")


def latest_tag(tags: DataFrame) -> DataFrame:
    """Of tags(tag) the one with the largest numbers, then the most parts, then the last by name."""
    numbers = F.transform(F.regexp_extract_all("tag", F.lit("([0-9]+)"), F.lit(1)), lambda x: x.cast("long"))
    return tags.agg(F.max_by("tag", F.struct(numbers.alias("numbers"), F.size(numbers).alias("n"), F.col("tag").alias("tag"))).alias("tag"))


#: Sections of manifests that list packages.
SECTIONS = {"package.json": ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"), "Cargo.toml": ("dependencies", "dev-dependencies", "build-dependencies")}
_LISTED = "array<struct<package:string,version:string,section:string>>"


def _toml_packages(text: str) -> list[dict[str, str]]:
    version = lambda v: str(v.get("version", "*")) if isinstance(v, dict) else str(v)
    try:
        found = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return []
    return [{"package": p, "version": version(v), "section": s} for s in SECTIONS["Cargo.toml"] for p, v in (found.get(s) or {}).items()]


def packages(spark: SparkSession, files: DataFrame) -> DataFrame:
    """package, version, section of all manifests among files(path, source); a broken one has none.

    JSON is read by built-in functions; TOML, which Spark doesn't read, a batch of files at a time."""
    name = F.substring_index("path", "/", -1)
    found = files.filter(name.isin(*SECTIONS)).select("path", "source", name.alias("kind"))
    read = F.from_json("source", ", ".join(f"`{s}` map<string,string>" for s in SECTIONS["package.json"]))
    listed = lambda s: F.transform(F.map_entries(F.coalesce(read[s], F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("package"), e["value"].alias("version"), F.lit(s).alias("section")))
    scripts = found.filter("kind = 'package.json'").select("path", F.explode(F.concat(*map(listed, SECTIONS["package.json"]))).alias("d"))

    @F.arrow_udf(_LISTED)
    def toml(sources: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([(c, pa.string()) for c in ("package", "version", "section")]))
        return pa.array([_toml_packages(x or "") for x in sources.to_pylist()], kind)

    crates = found.filter("kind = 'Cargo.toml'").select("path", F.explode(toml("source")).alias("d"))
    return scripts.unionByName(crates).select("path", "d.*")


#: Of what an import's conditions stand for, the first that is there counts.
CONDITIONS = ("eve-source", "development", "source", "default")


def aliases(files: DataFrame) -> DataFrame:
    """prefix, target, at of path aliases in the package.json (imports) and tsconfig.json (paths) among files(path, source).

    Files nearer to the root come first, package.json before tsconfig.json, then by name."""
    text = lambda c: F.regexp_replace(c, r"\*$", "")
    name = F.substring_index("path", "/", -1)
    folder = F.regexp_extract("path", "^(.*/)?[^/]*$", 1)
    base = files.filter(name.isin("package.json", "tsconfig.json")).select("path", "source", name.alias("name"), folder.alias("folder"), F.size(F.split("path", "/")).alias("depth"))
    imports = base.filter("name = 'package.json'").select("*", F.explode(F.from_json("source", "imports map<string,string>")["imports"]).alias("key", "value"))
    chosen = F.coalesce(*[F.from_json("value", "map<string,string>")[c] for c in CONDITIONS])
    imports = imports.select("name", "depth", "folder", "key", F.when(F.col("value").startswith("{"), chosen).otherwise(F.col("value")).alias("value"))
    config = F.from_json("source", "compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>", {"allowComments": "true"})["compilerOptions"]
    paths = base.filter("name = 'tsconfig.json'").select("*", config["baseUrl"].alias("base"), F.explode(config["paths"]).alias("key", "values"))
    paths = paths.select("name", "depth", F.concat("folder", F.coalesce(F.concat("base", F.lit("/")), F.lit(""))).alias("folder"), "key", F.get("values", F.lit(0)).alias("value"))
    out = imports.unionByName(paths).filter("value is not null")
    return out.select(text("key").alias("prefix"), F.concat("folder", text("value")).alias("target"), F.struct("depth", "name", "folder", "key").alias("at"))
