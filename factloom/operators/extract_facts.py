"""Facts of source text: imports, bindings, top-level symbols, uses, and the files that imports stand for. files(path, source, language).

With built-in functions: imports by patterns over the text without comments, the rest over its tokens (operators.tokens)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.texts import normalised
from factloom.operators import tokens as T
from factloom.operators.rounds import stored

#: What an import of each language may stand for, in order. An ending of its own is replaced, as a path's is.
CANDIDATES = {
    "typescript": (("", ".ts", ".tsx", ".js"), ("index.ts", "index.tsx", "index.js")),
    "javascript": (("", ".js", ".jsx", ".mjs", ".cjs"), ("index.js", "index.jsx", "index.mjs", "index.cjs")),
}
#: Strings, which stay, and comments, which go.
_KEPT = r"""('(?:[^'\\\n]|\\.)*+'|"(?:[^"\\]|\\.)*+"|`(?:[^`\\]|\\.)*+`)|/\*(?s:.*?)\*/|//[^\n]*"""
_KEPT_RUST = r"""('(?:\\[^'\n]+|[^'\\\n])'|"(?:[^"\\]|\\.)*+")|/\*(?s:.*?)\*/|//[^\n]*"""


def without_comments(source: Column, language: Column | None = None) -> Column:
    """Without block comments, over however many lines, and line comments; what stands in strings is no comment."""
    script = F.regexp_replace(source, _KEPT, "$1 ")
    return script if language is None else F.when(language == "rust", F.regexp_replace(source, _KEPT_RUST, "$1 ")).otherwise(script)


def symbols(files: DataFrame) -> DataFrame:
    """module, name, kind, line, line_end, ordinal, is_public, is_async and parameters' text of top-level declarations."""
    files = stored(files.select("path", "source", "language"), "sources")
    # declarations are told by the tokens outside of brackets, which are cut and numbered once
    stmts = T.statements(T.tokens(files).filter("depth = 0 and paren = 0"))
    stmts = stored(stmts.select("path", "language", "stmt", "i", "text", "type", "offset", "line", "last_line", "depth", "paren", "prev", "prev2", "next", "next2"), "statements")
    made = T.declarations(stmts).filter("word <> 'impl' and (language = 'rust' or word not in ('const', 'let', 'var'))").unionByName(T.declarators(stmts))
    close = stmts.filter("text = ')' and depth = 0 and paren = 0").select("path", "stmt", F.col("offset").alias("close"))
    closed = made.select("path", "stmt", "i", "open").join(close, ["path", "stmt"]).filter("close > open").groupBy("path", "stmt", "i").agg(F.min("close").alias("close"))
    out = made.join(closed.hint("merge"), ["path", "stmt", "i"], "left").join(files.select("path", "source").hint("merge"), "path")
    params = F.coalesce(F.substring("source", F.col("open") + 2, F.col("close") - F.col("open") - 1), F.lit(""))
    return out.select(F.col("path").alias("module"), "name", "kind", "line", "line_end", F.col("i").cast("long").alias("ordinal"), "is_public", "is_async", params.alias("params"))


def reexports(files: DataFrame) -> DataFrame:
    """module, name (as others see it), original, specifier of what scripts export from other modules; * where all of it is."""
    clean = without_comments(F.col("source"))
    found = files.filter("language <> 'rust'").select(F.col("path").alias("module"), F.explode(F.regexp_extract_all(clean, F.lit(r"(?m)^\s*export\s+((?:type\s+)?(?:\{[^}]*\}|\*(?:\s*as\s+[\w$]+)?)\s*from\s*['\"][^'\"]+['\"])"), F.lit(1))).alias("e"))
    found = found.select("module", F.regexp_extract("e", r"['\"]([^'\"]+)['\"]$", 1).alias("specifier"), F.regexp_extract("e", r"\{([^}]*)\}", 1).alias("named"), F.regexp_extract("e", r"^\*\s*as\s+([\w$]+)", 1).alias("space"), F.col("e").startswith("*").alias("all"))
    part = found.filter("named <> ''").select("module", "specifier", F.explode(F.split("named", ",")).alias("n")).withColumn("n", F.trim(F.regexp_replace("n", r"^\s*type\s+", ""))).filter("n <> ''")
    some = part.select("module", F.regexp_extract("n", r"([\w$]+)\s*$", 1).alias("name"), F.regexp_extract("n", r"^([\w$]+)", 1).alias("original"), "specifier")
    return some.unionByName(found.filter("all").select("module", F.when(F.col("space") != "", F.col("space")).otherwise("*").alias("name"), F.lit("*").alias("original"), "specifier"))


def imports(files: DataFrame) -> DataFrame:
    """module, specifier, is_external of imports and re-exports, each once."""
    clean = without_comments(F.col("source"), F.col("language"))
    script = F.array_distinct(F.concat(F.regexp_extract_all(clean, F.lit(r"(?m)^\s*(?:import|export)\b[^;'\"]*?\bfrom\s*['\"]([^'\"]+)['\"]"), F.lit(1)), F.regexp_extract_all(clean, F.lit(r"(?m)^\s*import\s*['\"]([^'\"]+)['\"]"), F.lit(1))))
    modules = F.transform(F.regexp_extract_all(clean, F.lit(r"(?m)^\s*(?:pub\s+)?mod\s+(\w+)\s*;"), F.lit(1)), lambda m: F.concat(F.lit("self::"), m))
    rust = F.array_distinct(F.concat(F.regexp_extract_all(clean, F.lit(r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([\w:]+?)(?:::\{|::\*|\s+as\b|;)"), F.lit(1)), modules))
    found = files.select(F.col("path").alias("module"), "language", F.explode(F.when(F.col("language") == "rust", rust).otherwise(script)).alias("specifier")).distinct()
    inside = F.when(F.col("language") == "rust", F.col("specifier").rlike("^(crate|super|self)(::|$)")).otherwise(F.col("specifier").rlike("^[./]"))
    return found.select("module", "specifier", (~inside).alias("is_external"))


def package_of(specifier: Column) -> Column:
    """The package that an external import names: with its scope, without what lies inside; in Rust the first segment."""
    scoped = F.regexp_extract(specifier, r"^(@[^/]+/[^/]+)", 1)
    return F.when(scoped != "", scoped).otherwise(F.regexp_extract(specifier, r"^([^/:]+)", 1))


def module_packages(found: DataFrame) -> DataFrame:
    return found.filter("is_external").select("module", package_of(F.col("specifier")).alias("package")).distinct()


def resolved(found: DataFrame, files: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """module, specifier, target: the first file that an import may stand for. Self-imports fall away.

    files(path), with language where modules are of several. aliases(prefix, target, at): prefixes that end with a slash
    (or are whole specifiers) and what they stand for, the first by `at` that an import begins with."""
    language = F.when(F.col("module").endswith(".rs"), "rust").when(F.col("module").rlike(r"\.(js|jsx|mjs|cjs)$"), "javascript").otherwise("typescript")
    folder = F.regexp_extract("module", "^(.*/)?[^/]*$", 1)
    asked = found.select("module", "specifier", language.alias("language"))
    relative = asked.filter("language <> 'rust' and specifier like '.%'").withColumn("base", normalised(F.concat(folder, F.col("specifier")), keep_leading=False))
    if aliases is not None:
        parts = F.split("specifier", "/")
        prefixes = F.concat(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/"))), F.array("specifier"))
        open_ = asked.filter("language <> 'rust' and specifier not like '.%'").withColumn("prefix", F.explode(prefixes)).join(aliases.select("prefix", F.col("target").alias("stands_for"), "at"), "prefix")
        first = open_.groupBy("module", "specifier", "language").agg(F.min_by(F.concat("stands_for", F.col("specifier").substr(F.length("prefix") + 1, F.length("specifier"))), "at").alias("base"))
        relative = relative.unionByName(first.withColumn("base", normalised(F.col("base"), keep_leading=False)))
    bare = F.regexp_replace("base", r"\.[^./]+$", "")
    names = lambda lang: F.array(*[F.concat(bare if e else F.col("base"), F.lit(e)) for e in CANDIDATES[lang][0]], *[F.concat("base", F.lit(f"/{e}")) for e in CANDIDATES[lang][1]])
    tried = relative.select("module", "specifier", F.when(F.col("language") == "javascript", names("javascript")).otherwise(names("typescript")).alias("names"))
    tried = tried.unionByName(_rust_candidates(asked.filter("language = 'rust'"), folder))
    each = tried.select("module", "specifier", F.posexplode("names").alias("at", "target"))
    hit = each.join(files.select(F.col("path").alias("target")).distinct(), "target")
    return hit.groupBy("module", "specifier").agg(F.min_by("target", "at").alias("target")).filter("target <> module")


def _rust_candidates(asked: DataFrame, folder: Column) -> DataFrame:
    """The files of a crate-local path: crate and self from the module's own folder, super from one folder up for each."""
    ups = F.size(F.regexp_extract_all("specifier", F.lit("(super)(?:::|$)"), F.lit(1)))
    rest = F.replace(F.regexp_replace("specifier", "^(crate::|self::|(super::)+)", ""), F.lit("::"), F.lit("/"))
    base = normalised(F.concat(folder, F.repeat(F.lit("../"), ups), rest), keep_leading=False)
    inside = asked.filter(F.col("specifier").rlike("^(crate|self|super)(::|$)"))
    root = F.array(F.lit("src/lib.rs"), F.lit("src/main.rs"))
    return inside.select("module", "specifier", F.when(F.col("specifier") == "crate", root).otherwise(F.array(F.concat(base, F.lit(".rs")), F.concat(base, F.lit("/mod.rs")))).alias("names"))


def bindings(files: DataFrame, reexported: bool = False) -> DataFrame:
    """module, local_name, exported_name, specifier of named and default imports of scripts, and of use trees of Rust.

    TypeScript: only of what may be a file of the project (relative, with a hash or a slash), no namespaces; with reexported, names
    that are exported from elsewhere besides, by the name that others see. JavaScript: of every import, a namespace as *."""
    clean = without_comments(F.col("source"))
    whole = F.regexp_extract_all(clean, F.lit(r"(?m)^\s*import\s+((?:type\s+)?[^;'\"]*?\bfrom\s*['\"][^'\"]+['\"])"), F.lit(1))
    each = files.filter("language <> 'rust'").select(F.col("path").alias("module"), "language", F.explode(whole).alias("i"))
    each = each.select("module", "language", F.regexp_extract("i", r"['\"]([^'\"]+)['\"]$", 1).alias("specifier"), F.regexp_extract("i", r"\{([^}]*)\}", 1).alias("named"), F.regexp_extract("i", r"^(?:type\s+)?([A-Za-z_$][\w$]*)\s*(?:,|from)", 1).alias("default"), F.regexp_extract("i", r"\*\s*as\s+([\w$]+)", 1).alias("space"))
    part = each.select("module", "language", "specifier", F.explode(F.split("named", ",")).alias("n")).withColumn("n", F.trim(F.regexp_replace("n", r"^\s*type\s+", ""))).filter("n <> ''")
    named = part.select("module", "language", F.regexp_extract("n", r"([\w$]+)\s*$", 1).alias("local_name"), F.regexp_extract("n", r"^([\w$]+)", 1).alias("exported_name"), "specifier")
    default = each.filter("default <> '' and default <> 'from'").select("module", "language", F.col("default").alias("local_name"), F.lit("default").alias("exported_name"), "specifier")
    space = each.filter("language = 'javascript' and space <> ''").select("module", "language", F.col("space").alias("local_name"), F.lit("*").alias("exported_name"), "specifier")
    again = reexports(files.filter("language = 'typescript'")).filter("original <> '*'").select("module", F.lit("typescript").alias("language"), F.col("name").alias("local_name"), F.col("original").alias("exported_name"), "specifier")
    scripts = named.unionByName(default).unionByName(space)
    scripts = scripts.unionByName(again) if reexported else scripts
    scripts = scripts.filter((F.col("language") == "javascript") | F.col("specifier").rlike("^[./]|^#.|/")).drop("language")
    return scripts.unionByName(T.rust_bindings(files, without_comments(F.col("source"), F.col("language"))))


def references(files: DataFrame, bound: DataFrame, targets: DataFrame) -> DataFrame:
    """target_symbol, source_symbol, file, line, col, kind of every use of a bound name; targets(module, specifier, target)."""
    return T.uses(files, bound, targets)


def reference_index(found: DataFrame) -> DataFrame:
    """symbol, direction, other, kind, n, first_line: references looked up from either end, by what is used and by what uses it."""
    ends = F.array(F.struct(F.col("target_symbol").alias("symbol"), F.lit("used by").alias("direction"), F.col("source_symbol").alias("other")), F.struct(F.col("source_symbol").alias("symbol"), F.lit("uses").alias("direction"), F.col("target_symbol").alias("other")))
    both = found.groupBy("target_symbol", "source_symbol", "kind").agg(F.count("*").alias("n"), F.min("line").alias("first_line"))
    return both.select(F.explode(ends).alias("e"), "kind", "n", "first_line").select("e.*", "kind", "n", "first_line")
