"""Mixing sources to target weights by Sainte-Laguë apportionment.

The words of a source, its documents end to end in a seeded order, form blocks of BLOCK words; only its last one may be shorter.
The mix has as many blocks as the corpus. They go to the sources one by one, each to the source with the highest quotient
target / (2 * blocks so far + 1), ties to the first; a source gets REPEATS times its blocks at most. As this sequence doesn't
depend on its length, shard k of the mix takes the k-th equal part of it, and the differences are integer quotas for each
shard and source. Of a source's blocks all are taken quota div blocks times, and a seeded choice of quota mod blocks once
more: those that a permutation b -> (a * b + c) mod n puts first.

DataFrame functions only. A row for each source, of which each has a weight of its own, goes to the driver, which settles
targets, quotas and permutations. A document's place in its source is the sum of what stands before: of the cells (the
first digits of its digest) before its own, and of the documents before it within the cell, so that no window holds more than
1 / 4096 of a source. Rows that are alike are counted first. No row is made for a block: each row sums over its own blocks.

Targets: sources in code-point order, null last, weigh WEIGHTS in turn and share all words; no target is above REPEATS times its
source's words, and what is cut off is shared by weight among the rest.

Defined cases: null texts and texts without words have size 0, of which nothing is taken; a null source is a source; repeated
rows, and rows without a doc_id, take one place each; an empty table gives no rows; further columns of docs are ignored. A source
holds fewer than 2**41 blocks. The words taken from a source differ from its target by 4 * BLOCK at most, and by a
block more where roundings add up over very many sources.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm._shared import words, written

#: Words of a block, and how often one block may be taken.
BLOCK = 8
REPEATS = 3
#: The weights that sources take in turn.
WEIGHTS = (1, 2, 3)
SEED = 12
#: Copies of one repeated row that are made at a time.
COPIES = 4096
#: A factor above 2**20 is applied in two steps, so that products stay below 2**63.
_HALF = 1 << 20


class Share(NamedTuple):
    """What the mix takes of one source."""

    source: str | None
    source_size: int
    target: float
    blocks: int
    permuted: int
    whole: int
    extra: int
    factor: int
    shift: int
    ends: list[int]


def targets(sizes: Sequence[int], weights: Sequence[int], repeats: int = REPEATS) -> list[float]:
    """Each source's part of all words by weight, repeats times its own words at most.

    By the words it has for its weight, a source is either cut off or, with all after it, gets its share of the rest."""
    rest, weight, out = sum(sizes), sum(weights), [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda s: (repeats * sizes[s] / weights[s], s))
    for at, s in enumerate(order):
        if rest * weights[s] <= repeats * sizes[s] * weight:
            for t in order[at:]:
                out[t] = rest * weights[t] / weight
            break
        out[s] = float(repeats * sizes[s])
        rest -= repeats * sizes[s]
        weight -= weights[s]
    return out


def apportioned(votes: Sequence[float], most: Sequence[int], seats: int) -> list[int]:
    """The first `seats` seats by highest quotients votes / (2 * seats so far + 1), no more than `most` to any.

    Webster's divisor lies within half a seat for each party of the even one, so all but a few seats are given at once."""
    total = sum(votes)
    if not total:
        return [0] * len(votes)
    sure = [max(0, min(m, math.floor(v * max(0.0, seats - len(votes) / 2 - 1) / total - 0.5) - 1)) for v, m in zip(votes, most, strict=True)]
    heap = [(-v / (2 * n + 1), s) for s, (v, n) in enumerate(zip(votes, sure, strict=True)) if n < most[s] and v > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(sure)):
        if not heap:
            break
        s = heapq.heappop(heap)[1]
        sure[s] += 1
        if sure[s] < most[s]:
            heapq.heappush(heap, (-votes[s] / (2 * sure[s] + 1), s))
    return sure


def plan(sources: Sequence[tuple[str | None, int]], shards: int, weights: Sequence[int] = WEIGHTS, block: int = BLOCK, repeats: int = REPEATS, seed: int = SEED) -> list[Share]:
    """A share for each (source, words), sources in order."""
    sizes = [n for _, n in sources]
    want = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], repeats)
    blocks = [-(-n // block) for n in sizes]
    seats = -(-sum(sizes) // block)
    upto = [apportioned(want, [repeats * b for b in blocks], seats * (k + 1) // shards) for k in range(shards)]
    out = []
    for i, (source, n) in enumerate(sources):
        permuted = max(1, n // block)  # a short last block is never taken once more than the others
        factor = permuted * 618034 // 1000000
        while math.gcd(factor, permuted) != 1:
            factor += 1
        shift = int(hashlib.md5(f"{seed}/{i}".encode()).hexdigest()[:8], 16) % permuted
        whole, extra = divmod(upto[-1][i], blocks[i]) if blocks[i] else (0, 0)
        out.append(Share(source, n, want[i], blocks[i], permuted, whole, extra, factor, shift, [0, *(u[i] for u in upto)]))
    return out


def _place(b: Column, n: Column, factor: Column, shift: Column) -> Column:
    high = F.shiftright(factor, 20) * b % n
    return (high * _HALF + factor % _HALF * b + shift) % n


def placed(docs: DataFrame, shards: int = 16, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, source, size, at (the place of its first word in its source) and its source's share."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(text)))
    rows = docs.select(doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), F.size(words(F.col("text").cast("string"))).cast("long").alias("size"), digest.alias("digest"))
    alike = rows.groupBy("source", "doc_id", "size", "digest").agg(F.count("*").alias("copies"))
    keys = written(alike.withColumn("cell", F.substring("digest", 1, 3)), "mix-keys")
    cells = written(keys.groupBy("source", "cell").agg(F.sum(F.col("size") * F.col("copies")).alias("n")), "mix-cells")
    totals = {r["source"]: r["n"] for r in cells.groupBy("source").agg(F.sum("n").alias("n")).collect()}  # a row for each source
    order = sorted(totals, key=lambda s: (s is None, s or ""))  # by code points, as Python compares
    shares = plan([(s, totals[s]) for s in order], shards, block=block, seed=seed)
    schema = "source string, source_size long, target double, blocks long, permuted long, whole long, extra long, factor long, shift long, ends array<long>"
    share = docs.sparkSession.createDataFrame([tuple(s) for s in shares], schema).withColumnRenamed("source", "_source")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("_base", before(Window.partitionBy("source").orderBy("cell"))).drop("n")  # 4096 rows a source
    cells = cells.join(share, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").select(F.col("source").alias("_source"), F.col("cell").alias("_cell"), "_base", *share.columns[1:])
    keys = keys.withColumn("n", F.col("size") * F.col("copies"))
    keys = keys.withColumn("_before", before(Window.partitionBy("source", "cell").orderBy("digest", "doc_id", "size")))
    found = keys.join(cells, F.col("source").eqNullSafe(F.col("_source")) & (F.col("cell") == F.col("_cell")))
    # copies of a row that is repeated very often are made COPIES at a time, each time from a row of its own
    last = F.col("copies") - 1
    some = found.withColumn("_first", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(COPIES).cast("long"))))
    each = some.withColumn("_copy", F.explode(F.sequence(F.col("_first"), F.least(F.col("_first") + COPIES - 1, last))))
    return each.withColumn("at", F.col("_base") + F.col("_before") + F.col("_copy") * F.col("size")).select("doc_id", "source", "size", "at", *share.columns[1:])


def _blocks(block: int, body) -> Column:
    """body(block, its words of the document, its place in the permutation) for each block that a document reaches into; none if empty."""
    at, size = F.col("at"), F.col("size")
    first, last = F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}")
    words_of = lambda b: F.least(at + size, (b + 1) * block) - F.greatest(at, b * block)
    place = lambda b: F.when(b < F.col("permuted"), _place(b, F.col("permuted"), F.col("factor"), F.col("shift")))
    return F.when(size > 0, F.transform(F.sequence(first, last), lambda b: body(b, words_of(b), place(b))))


def mix(docs: DataFrame, shards: int = 16, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, size, source_size, target, taken; a row for each row of docs."""
    times = lambda place: F.col("whole") + F.when(place < F.col("extra"), 1).otherwise(0)
    taken = F.aggregate(_blocks(block, lambda b, n, place: n * times(place)), F.lit(0).cast("long"), lambda acc, n: acc + n)
    out = placed(docs, shards, seed, block)
    return out.select("doc_id", "size", "source_size", "target", F.coalesce(taken, F.lit(0)).cast("long").alias("taken"), "source", F.get("ends", F.lit(shards)).alias("quota"))


def pieces(docs: DataFrame, shards: int = 16, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """What each shard of the mix holds: shard, doc_id, source, start (words of the document before), length (words), round (which
    repeat of the block it is). A block's turns are numbered round by round; a shard has those that its source's quotas give it."""
    whole, extra, ends = F.col("whole"), F.col("extra"), F.col("ends")
    turns = lambda b, place: F.concat(
        F.when(whole > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(whole - 1, F.lit(0))), lambda r: r * F.col("blocks") + b)).otherwise(F.array().cast("array<bigint>")),
        F.when(place < extra, F.array(whole * F.col("blocks") + place)).otherwise(F.array().cast("array<bigint>")),
    )
    each = _blocks(block, lambda b, n, place: F.struct((F.greatest(F.col("at"), b * block) - F.col("at")).alias("start"), n.alias("length"), turns(b, place).alias("turns")))
    out = placed(docs, shards, seed, block).withColumn("b", F.explode(each)).withColumn("turn", F.explode("b.turns"))
    shard = (F.size(F.filter(ends, lambda e: e <= F.col("turn"))) - 1).cast("int")
    return out.select(shard.alias("shard"), "doc_id", "source", F.col("b.start").alias("start"), F.col("b.length").alias("length"), F.expr("turn div blocks").alias("round"))


def digest(docs: DataFrame) -> DataFrame:
    return mix(docs)


ORACLE_SQL = f"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    md5(concat_ws('/', '{SEED}', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))) AS digest
  FROM documents),
sized AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no,
    [{", ".join(map(str, WEIGHTS))}][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)})::INT]::BIGINT AS w
  FROM docs GROUP BY source),
filling AS (
  SELECT *, (SELECT sum(source_size) FROM sized)::BIGINT - coalesce(sum({REPEATS} * source_size) OVER o, 0)::BIGINT AS rest,
    (SELECT sum(w) FROM sized)::BIGINT - coalesce(sum(w) OVER o, 0)::BIGINT AS weight, row_number() OVER (ORDER BY {REPEATS} * source_size / w, no) AS pos
  FROM sized WINDOW o AS (ORDER BY {REPEATS} * source_size / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT pos, rest, weight FROM filling WHERE rest * w <= {REPEATS} * source_size * weight ORDER BY pos LIMIT 1),
wanted AS (
  SELECT f.source, f.no, f.source_size, CASE WHEN f.pos < l.pos THEN ({REPEATS} * f.source_size)::DOUBLE ELSE (l.rest * f.w)::DOUBLE / l.weight END AS target,
    (f.source_size + {BLOCK - 1}) // {BLOCK} AS blocks, greatest(1, f.source_size // {BLOCK}) AS permuted
  FROM filling f, level l),
quotients AS (
  SELECT no, row_number() OVER (ORDER BY target / (2 * j + 1) DESC, no) AS seat
  FROM (SELECT no, target, unnest(range(least({REPEATS} * blocks, (target / {BLOCK})::BIGINT + 1 + (SELECT count(*) FROM wanted)))) AS j FROM wanted WHERE target > 0)),
quotas AS (SELECT no, count(*) AS quota FROM quotients WHERE seat <= (SELECT (sum(source_size)::BIGINT + {BLOCK - 1}) // {BLOCK} FROM sized) GROUP BY no),
share AS (
  SELECT w.*, coalesce(q.quota, 0) AS quota, coalesce(coalesce(q.quota, 0) // nullif(w.blocks, 0), 0) AS whole, coalesce(coalesce(q.quota, 0) % nullif(w.blocks, 0), 0) AS extra,
    (SELECT min(a) FROM range(permuted * 618034 // 1000000, permuted * 618034 // 1000000 + 64) r(a) WHERE gcd(a, permuted) = 1) AS factor,
    ('0x' || substr(md5(concat('{SEED}', '/', w.no)), 1, 8))::BIGINT % permuted AS shift
  FROM wanted w LEFT JOIN quotas q USING (no)),
places AS (SELECT row_number() OVER () AS id, docs.*, sum(size) OVER (PARTITION BY source ORDER BY digest, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS pos FROM docs),
reached AS (SELECT id, pos, size, source, unnest(range(pos // {BLOCK}, (pos + size - 1) // {BLOCK} + 1)) AS b FROM places WHERE size > 0),
took AS (
  SELECT r.id, sum((least(r.pos + r.size, (r.b + 1) * {BLOCK}) - greatest(r.pos, r.b * {BLOCK}))
    * (s.whole + CASE WHEN r.b < s.permuted AND (s.factor::HUGEINT * r.b + s.shift) % s.permuted < s.extra THEN 1 ELSE 0 END))::BIGINT AS taken
  FROM reached r JOIN share s ON r.source IS NOT DISTINCT FROM s.source GROUP BY r.id)
SELECT p.doc_id, p.size, s.source_size, s.target, coalesce(t.taken, 0) AS taken, p.source, s.quota
FROM places p JOIN share s ON p.source IS NOT DISTINCT FROM s.source LEFT JOIN took t USING (id)
"""
