"""Joined views over facts: specifications by file, checklists, change reports, ordered lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.levels import is_high_impact
from factloom.functions.texts import is_dependency_file, snippet


def specifications(modules: DataFrame, used_by: DataFrame, layers: DataFrame, scores: DataFrame) -> DataFrame:
    """modules(module, ...) with what is known of them: used_by(module, n_users), layers(id, layer), scores(module, score, rank).

    A module that nothing uses has 0 users, one without a layer is in layer 0; scores may be missing. In the order of
    migration: by rank, those without one last."""
    out = modules.join(used_by.select("module", "n_users"), "module", "left").join(layers.select(F.col("id").alias("module"), "layer"), "module", "left").join(scores.select("module", "score", "rank"), "module", "left")
    out = out.withColumns({"n_users": F.coalesce("n_users", F.lit(0).cast("long")), "layer": F.coalesce("layer", F.lit(0).cast("long"))})
    return migration_order(out)


def migration_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.asc_nulls_last("rank"), "module")


def documents(spec: DataFrame, symbols: DataFrame) -> DataFrame:
    """directory, path, document: each module's specification and its symbols(module, name, kind, at) as JSON, to be written by directory.

    A document holds one module's symbols, which lie in one file."""
    listed = symbols.groupBy("module").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name", "kind"))), lambda s: F.struct(s["name"].alias("name"), s["kind"].alias("kind"))).alias("symbols"))
    none = F.array().cast("array<struct<name:string,kind:string>>")
    out = spec.join(listed, "module", "left").withColumn("symbols", F.coalesce("symbols", none))
    return out.select(F.regexp_extract("module", "^(?:(.*)/)?[^/]*$", 1).alias("directory"), F.col("module").alias("path"), F.to_json(F.struct(*[c for c in out.columns if c != "module"])).alias("document"))


def in_directory(rows: DataFrame, prefix: str) -> DataFrame:
    """By prefix of the path's text: src/a also takes src/ab."""
    return rows.filter(F.col("path").startswith(prefix))


def symbol_keys(shards: DataFrame) -> DataFrame:
    """shards(path, symbols: array of structs with name) -> key (file:symbol) and the struct, as rows; empty shards give none."""
    return shards.select("path", F.explode("symbols").alias("symbol")).select(F.concat_ws(":", "path", "symbol.name").alias("key"), "symbol.*")


def checklist(tasks: DataFrame, symbols: DataFrame) -> DataFrame:
    """tasks(module, status) with each of their symbols(module, name, target_name, kind): target, source, kind, and present.

    present is true for verified tasks, false for failed ones, null for others. Tasks without symbols have no row."""
    present = F.when(F.col("status") == "verified", True).when(F.col("status") == "failed", False)
    target = F.replace(F.replace("module", F.lit(".ts"), F.lit(".rs")), F.lit(".js"), F.lit(".rs"))
    return tasks.join(symbols, "module").select("module", target.alias("target"), "status", F.col("name").alias("source"), "target_name", "kind", present.alias("present"))


def todo(tasks: DataFrame) -> DataFrame:
    return tasks.filter("status <> 'verified'")


def changed_recommendations(changed: DataFrame, module_deps: DataFrame, recommended: DataFrame) -> DataFrame:
    """changed(path) with the recommendations of the packages that the file uses; files without any keep a row of nulls."""
    by_file = module_deps.select(F.col("module").alias("path"), "package").distinct().join(recommended, "package")
    return changed.join(by_file, "path", "left")


def enriched(changes: DataFrame, recommended: DataFrame) -> DataFrame:
    """changes(package, effort, guidance, risk_tags) where unknown, null or empty filled from recommendations of the package, whatever its case.

    Of recommendations that differ by case alone, the last by name counts."""
    known = recommended.groupBy(F.lower("package").alias("_key")).agg(F.max_by(F.struct("effort", "guidance", "risk_tags"), "package").alias("_r"))
    out = changes.withColumn("_key", F.lower("package")).join(known, "_key", "left")
    filled = {
        "effort": F.when((F.col("effort") == "unknown") & F.col("_r").isNotNull(), F.col("_r.effort")).otherwise(F.col("effort")),
        "guidance": F.coalesce("guidance", "_r.guidance"),
        "risk_tags": F.when((F.size("risk_tags") == 0) & F.col("_r").isNotNull(), F.col("_r.risk_tags")).otherwise(F.col("risk_tags")),
    }
    return out.withColumns(filled).drop("_key", "_r")


def update_summary(files: DataFrame, changes: DataFrame) -> DataFrame:
    """One row: changed files(path) by whether they list dependencies, and changes(change_type, needs_review) of packages by type."""
    dep = is_dependency_file(F.col("path"))
    a = files.agg(F.count("*").alias("total_changed_files"), F.count_if(~dep).alias("source_files_changed"), F.count_if(dep).alias("dep_files_changed"))
    of = lambda *kinds: F.count_if(F.col("change_type").isin(*kinds))
    b = changes.agg(of("added").alias("deps_added"), of("removed").alias("deps_removed"), of("upgraded", "downgraded").alias("deps_modified"), F.count_if("needs_review").alias("deps_needing_review"))
    return a.crossJoin(b)  # one row each


def risks(changes: DataFrame) -> DataFrame:
    """risk, n: how often each tag stands among changes(risk_tags)."""
    return changes.select(F.explode("risk_tags").alias("risk")).groupBy("risk").agg(F.count("*").alias("n"))


def to_review(changes: DataFrame) -> DataFrame:
    """changes of high effort, or that need review."""
    return changes.filter(is_high_impact(F.col("effort")) | F.col("needs_review"))


def batch_totals(verdicts: DataFrame) -> DataFrame:
    """One row over verdicts(passed): total, verified, failed and a summary of them."""
    out = verdicts.agg(F.count("*").alias("total"), F.count_if("passed").alias("verified"), F.count_if(~F.col("passed")).alias("failed"))
    share = lambda c: F.concat_ws("/", c, "total")
    return out.withColumn("summary", F.concat(F.lit("Batch verification: "), share("verified"), F.lit(" verified, "), share("failed"), F.lit(" failed")))


def availability(packages: DataFrame, status: DataFrame) -> DataFrame:
    """One row: packages(package) whose status(package, status) is available, partial, or anything else or none."""
    known = packages.join(status, "package", "left")
    return known.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "available").alias("available"), F.count_if(F.col("status") == "partial").alias("partial"), F.count_if(~F.coalesce(F.col("status").isin("available", "partial"), F.lit(False))).alias("unavailable"))


def largest_modules(symbols: DataFrame, shown: int = 100) -> DataFrame:
    """The modules of the most symbols(module)."""
    return symbols.groupBy("module").agg(F.count("*").alias("n_symbols")).orderBy(F.desc("n_symbols"), "module").limit(shown)


def api_surface(exports: DataFrame, modules: int = 20, shown: int = 30) -> DataFrame:
    """exports(module, name, kind, at) -> module, module_place, n_symbols, name, kind, place: the first `shown` of each of the modules that have most.

    The modules are a bounded top list; of their exports, each task keeps the first ones before the shuffle, so no task holds a module's."""
    top = numbered_few(exports.groupBy("module").agg(F.count("*").alias("n_symbols")).orderBy(F.desc("n_symbols"), "module").limit(modules), (F.desc("n_symbols"), F.asc("module")), "module_place")
    each = exports.join(F.broadcast(top), "module")  # `modules` rows
    place = F.row_number().over(Window.partitionBy("module").orderBy("at"))
    return each.withColumn("place", place).filter(F.col("place") <= shown).select("module", "module_place", "n_symbols", "name", "kind", "place")


def numbered_few(rows: DataFrame, order: tuple, name: str) -> DataFrame:
    """The places (from 1) of a top list's rows, which one task holds anyway."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def layer_members(modules: DataFrame) -> DataFrame:
    """modules(module, layer, in_degree) by layer, the most used first."""
    return modules.orderBy("layer", F.desc("in_degree"), "module")


def by_direction(uncut: DataFrame, shown: int | None = None) -> DataFrame:
    """Uncut references by the text of their direction, so that L10 comes before L2."""
    out = uncut.orderBy("direction", "consumer", "provider", "symbol")
    return out if shown is None else out.limit(shown)


def whole_file_changes(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """A row for each symbol(path, name, kind) of files(path, status) that came or went whole: low for added, high for removed."""
    gone = F.col("status") == "removed"
    return files.filter("status in ('added', 'removed')").join(symbols, "path").select("path", "name", "kind", F.col("status").alias("change_type"), F.when(gone, "high").otherwise("low").alias("severity"))


def with_snippets(changes: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """changes(path, old_start, old_end, new_start, new_end) with the lines of old and new(path, source); empty where there are none."""
    side = lambda df, x: df.select("path", F.col("source").alias(f"_{x}"))
    out = changes.join(side(old, "old"), "path", "left").join(side(new, "new"), "path", "left")
    text = lambda x: F.coalesce(snippet(F.col(f"_{x}"), F.col(f"{x}_start"), F.col(f"{x}_end")), F.lit(""))
    return out.withColumns({"old_snippet": text("old"), "new_snippet": text("new")}).drop("_old", "_new")


def next_response(tasks: DataFrame) -> DataFrame:
    """The next pending task of tasks(module, layer, in_degree, status), as in progress, and has_next: whether more than it is pending, or any is verified."""
    counts = tasks.agg((F.count_if(F.col("status") == "pending") > 1).alias("_more"), (F.count_if(F.col("status") == "verified") > 0).alias("_done"))
    first = tasks.filter("status = 'pending'").orderBy("layer", F.desc("in_degree"), "module").limit(1)
    out = first.crossJoin(counts)  # one row each
    return out.withColumns({"status": F.lit("in_progress"), "has_next": F.col("_more") | F.col("_done")}).drop("_more", "_done")


def languages(manifests: DataFrame) -> DataFrame:
    """root, language of projects by the manifests(root, name) in them: rust, typescript (with a tsconfig) or javascript; error where
    both package.json and Cargo.toml are there, unknown where neither."""
    has = lambda name: F.bool_or(F.col("name") == name)
    out = manifests.groupBy("root").agg(has("package.json").alias("js"), has("Cargo.toml").alias("rs"), has("tsconfig.json").alias("ts"))
    kind: Column = F.when(F.col("js") & F.col("rs"), "error").when(F.col("rs"), "rust").when(F.col("js") & F.col("ts"), "typescript").when(F.col("js"), "javascript").otherwise("unknown")
    return out.select("root", kind.alias("language"))
