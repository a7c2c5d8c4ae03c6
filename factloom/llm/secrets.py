"""Secret scans through an incremental blob ledger.

Every version of a text is addressed by the SHA-256 of its content. The ledger lists the pairs of blob and rule version
that were scanned, and keeps what they held; a scan takes only the blobs that lack a pair, runs the rules that they lack, and
joins the findings, old and new, back to all paths (rows) whose content is that blob. Copies are thus scanned once, and
a new rule version alone is run over old blobs.

The ledger is a folder of Parquet tables. Each scan writes its findings and then its pairs, in parts of its own; findings
of a scan without pairs (one that was broken off) don't count, and its blobs are scanned again.

DataFrame functions only. Matches are marked by one replacement a rule, and the text is split at the marks; running
sums of the parts' lengths give the places.

Defined cases: a null text is an empty one; blobs without findings have none to join; a text's own mark characters are
replaced by another of the same length before; repeated rows each get their findings.
"""

from __future__ import annotations

from dataclasses import dataclass

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm._shared import scratch_path

#: Private-use characters: what begins and ends a match, and what stands in for them in a text.
BEGIN, END, OTHER = "\ue000", "\ue001", "\ue002"

#: Parts of the copies of a blob, where its findings are joined to its paths.
SALTS = 16


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    #: Where given, this group of the pattern must have so many characters.
    group: int = 0
    least: int = 0
    base: bool = True


#: Fixed values of the contract, in its order (a length that a whole match needs is in the pattern), then added ones.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
    Rule("pem", 1, r"-----BEGIN (?:[A-Z]{1,16} ){0,4}PRIVATE KEY-----", base=False),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", base=False),
)


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def paths(docs: DataFrame) -> DataFrame:
    """Each row's doc_id and blob."""
    return docs.select("doc_id", F.sha2(_text(), 256).alias("blob"))


def unseen(docs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, text and todo (the kinds of rules to run) of each blob that lacks a rule version in the ledger (blob, kind, version).

    Copies are merged within tasks before the shuffle."""
    blobs = docs.select(F.sha2(_text(), 256).alias("blob"), _text().alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    every = F.array(*[F.lit(r.kind) for r in rules])
    if ledger is None:
        return blobs.withColumn("todo", every)
    done = _versions(ledger, rules).groupBy("blob").agg(F.collect_set("kind").alias("done"))
    return blobs.join(done, "blob", "left").withColumn("todo", F.array_except(every, F.coalesce("done", F.array().cast("array<string>")))).drop("done").filter("size(todo) > 0")


def scanned(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, kind, start, end (code points, end exclusive) of all findings of the rules to do."""
    safe = F.when(F.col("text").rlike(f"[{BEGIN}{END}]"), F.translate("text", BEGIN + END, OTHER * 2)).otherwise(F.col("text"))
    ready = blobs.withColumn("text", safe)
    split = lambda r: F.split(F.regexp_replace("text", r.pattern, f"{BEGIN}$0{END}"), f"[{BEGIN}{END}]")
    marked = lambda r: F.when(F.array_contains("todo", r.kind) & F.col("text").rlike(r.pattern), F.struct(F.lit(r.kind).alias("kind"), split(r).alias("parts")))
    found = ready.select("blob", F.explode(F.array_compact(F.array(*[marked(r) for r in rules]))).alias("m"))
    parts = found.select("blob", "m.kind", F.posexplode("m.parts").alias("i", "part"))
    until = F.sum(F.length("part")).over(Window.partitionBy("blob", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    spans = parts.withColumn("end", until).filter("i % 2 = 1")
    for r in rules:
        if r.group:
            spans = spans.filter((F.col("kind") != r.kind) | (F.length(F.regexp_extract("part", r.pattern, r.group)) >= r.least))
    return spans.select("blob", "kind", (F.col("end") - F.length("part")).alias("start"), "end")


_PAIRS, _FINDINGS = "blob string, kind string, version int, run string", "blob string, kind string, version int, start long, end long, run string"


def pairs(spark: SparkSession, ledger: str) -> DataFrame:
    """blob, kind, version and run of what a ledger's scans have done."""
    return spark.read.schema(_PAIRS).parquet(f"{ledger}/pairs")


def findings(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, kind, start, end of what a ledger holds for these rules' versions."""
    done = pairs(spark, ledger).select("run").distinct()
    return _versions(spark.read.schema(_FINDINGS).parquet(f"{ledger}/findings"), rules).join(done, "run", "left_semi").select("blob", "kind", "start", "end")


def _versions(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    return rows.filter(F.array_contains(F.array(*[F.lit(f"{r.kind} {r.version}") for r in rules]), F.concat_ws(" ", "kind", "version")))


def _append(spark: SparkSession, ledger: str, run: str, found: DataFrame | None, done: DataFrame | None) -> None:
    for name, schema, rows in (("findings", _FINDINGS, found), ("pairs", _PAIRS, done)):
        rows = spark.createDataFrame([], schema).drop("run") if rows is None else rows
        rows.write.parquet(f"{ledger}/{name}/run={run}", mode="ignore")


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans what the ledger (a folder that all executors share; made where there is none) lacks of docs, and adds it.

    Gives blob, kind, start, end of all that the ledger then holds for these rules."""
    spark = docs.sparkSession
    _append(spark, ledger, "none", None, None)
    todo = unseen(docs, pairs(spark, ledger), rules)
    version = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.version)])
    versioned = lambda rows: rows.withColumn("version", version[F.col("kind")])
    run = uuid.uuid4().hex
    before = findings(spark, ledger, rules)
    new = versioned(scanned(todo, rules)).select("blob", "kind", "version", "start", "end")
    done = versioned(todo.select("blob", F.explode("todo").alias("kind"))).select("blob", "kind", "version")
    _append(spark, ledger, run, new, done)
    return before.unionByName(spark.read.schema(_FINDINGS).parquet(f"{ledger}/findings/run={run}").select("blob", "kind", "start", "end"))


def by_path(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Each row's doc_id with the columns that found has for its blob (one row a blob; null for others).

    Copies of a blob are dealt into SALTS parts, so that those of a frequent one don't meet in one task."""
    salt = F.pmod(F.xxhash64(F.col("doc_id"), F.spark_partition_id()), F.lit(SALTS)).cast("int")
    dealt = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return paths(docs).withColumn("_salt", salt).join(dealt, ["blob", "_salt"], "left").drop("_salt")


def digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: str | None = None) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 over their spans, and spans: all, by start, then kind as listed.

    ledger: the folder of one to go on with; without, a new one."""
    docs = docs.select("doc_id", "text")
    found = scan(docs, ledger or scratch_path(docs.sparkSession, "ledger"), rules)
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    base = [r.kind for r in rules if r.base]
    item = F.struct("start", order[F.col("kind")].alias("k"), F.concat_ws(":", "kind", "start", "end").alias("s"))
    of = lambda kinds: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind").isin(kinds), item))), lambda x: x["s"]), ",")
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in base]
    out = by_path(docs, found.groupBy("blob").agg(*counts, of(base).alias("base"), of([r.kind for r in rules]).alias("spans")))
    zero = [F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in base]
    return out.select("doc_id", *zero, F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
