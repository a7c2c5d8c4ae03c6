"""Quality rules: counted base rules, and a hashed n-gram log-likelihood ratio between trusted and raw text.

DataFrame functions only. Two passes over the corpus: the first counts hashed n-grams of all documents and of a
bounded sample of trusted ones (labels with quality 1), the second scores every document by the mean log ratio of its
n-grams. Both multinomials have BUCKETS cells, so what reaches the driver has a fixed size.

n-grams: single words and adjacent pairs, whole as they are written, each with a cell by its hash.

Defined cases: a null or empty text has no word and is rejected by the base rules; a text of one word has one n-gram;
without trusted documents all ratios are 1, so the base rules decide alone; repeated rows each get their own verdict.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm._shared import SPACE, let, words

#: Cells of both multinomials.
BUCKETS = 65_536
#: At most so many trusted documents are sampled, those of the smallest hashed ids.
TRUSTED = 20_000
#: Mean log ratio under which a document is rejected: of labelled texts of the given tables no good one lies under it, and 0.96 of the bad ones do.
THRESHOLD = -0.1
#: Fixed values of the contract.
WINDOW, LEAST_WORDS, REPEATED_PERCENT, SYMBOLS = 8, 20, 30, r"[#*$%&|<>]+"


def _paired(hashes: Column, step: int) -> Column:
    """Hashes of spans twice as long: each element with the one `step` places on (with nothing, at the end)."""
    return F.transform(hashes, lambda x, i: F.xxhash64(x, F.get(hashes, i + step)))


def _repeat_words(hashes: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more, from the hashes of all words.

    A window found again repeats WINDOW / 2 + 1 spans of half its length, so most texts are settled by those."""

    def covered(pairs: Column) -> Column:
        again = F.filter(pairs, lambda e, k: (e["h"] == F.get(pairs, k - 1)["h"]) | (e["h"] == F.get(pairs, k + 1)["h"]))
        at = F.array_sort(F.transform(again, lambda e: e["i"]))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda acc, i: F.struct((i + WINDOW).alias("end"), (acc["n"] + F.least(F.lit(WINDOW), i + WINDOW - acc["end"])).alias("n"))
        return F.aggregate(at, start, step, lambda acc: acc["n"])

    def settled(halves: Column) -> Column:
        n = F.size(halves)
        windows = F.slice(_paired(halves, WINDOW // 2), F.lit(1), n - (WINDOW - 1))
        sorted_windows = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        few = (n <= WINDOW) | (F.size(F.array_distinct(halves)) >= n - WINDOW // 2)
        return F.when(few, F.lit(0)).otherwise(let(sorted_windows, covered))

    return let(hashes, lambda h: let(_paired(h, 1), lambda p: let(_paired(p, 2), settled))).cast("long")


def base_features(docs: DataFrame) -> DataFrame:
    """docs with _hashes (those of its words) and the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Columns of docs with one of these names are replaced."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("_words", words(F.col("text"))).withColumn("_hashes", _hashes(F.col("_words")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _repeat_words(F.col("_hashes")),
    }).drop("_words")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w))


def grams(hashes: Column) -> Column:
    """The cells of all n-grams of a text, from the hashes of its words: the words', then those of adjacent pairs."""
    cell = lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")
    pairs = lambda h: F.transform(F.slice(h, F.lit(2), F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: cell(F.xxhash64(F.get(h, i), x)))
    return let(hashes, lambda h: F.concat(F.transform(h, cell), pairs(h)))


def log_ratios(docs: DataFrame, labels: DataFrame) -> list[float]:
    """log(p_trusted / p_raw) of each cell; the trusted counts are smoothed by BUCKETS pseudo-counts spread as the raw ones."""
    trusted = labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRUSTED)
    # at most TRUSTED ids of 8 bytes: a bounded broadcast
    known = docs.select("doc_id", "text").join(F.broadcast(trusted.withColumn("_trusted", F.lit(1))), "doc_id", "left")
    cells = known.select("_trusted", F.explode(grams(_hashes(words(F.col("text"))))).alias("cell"))
    counts = cells.groupBy("cell").agg(F.count("*").alias("raw"), F.count("_trusted").alias("trusted"))
    found = {r["cell"]: (r["raw"], r["trusted"]) for r in counts.collect()}  # BUCKETS rows at most
    n_raw, n_trusted = sum(r for r, _ in found.values()), sum(t for _, t in found.values())
    out = [0.0] * BUCKETS
    for cell, (raw, kept) in found.items():
        p = raw / n_raw
        out[cell] = round(math.log((kept + BUCKETS * p) / (n_trusted + BUCKETS) / p), 3)
    return out


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with the base counts, score (mean log ratio of its n-grams; null without any) and kept."""
    ratios = log_ratios(docs, labels)
    weights = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")  # folded into one literal
    total = lambda cells: F.aggregate(cells, F.lit(0.0), lambda acc, c: acc + F.get(weights, c)) / F.when(F.size(cells) > 0, F.size(cells))
    out = base_features(docs).withColumn("score", let(grams(F.col("_hashes")), total)).drop("_hashes")
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(False)))


def kept_rows(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the rules keep, with their own columns alone, whatever these are called."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return judged(docs.select("doc_id", "text", row), labels, threshold).filter("kept").select("_row.*")
