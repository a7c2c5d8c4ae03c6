"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Keys hash into CELLS places of a ring on which every shard has many virtual nodes. A key belongs to the first node
clockwise. No shard takes more than its capacity: what overflows continues clockwise to the next node whose shard has
room. Shards first fill from their own keys, so only the overflow of full shards moves.

DataFrame functions only. Counts of the cells (CELLS rows at most) go to the driver, which settles how many keys of
each cell go where; the table of these shares (a row for each cell and overflow) is broadcast, and every key finds its
shard and slot by its rank within its cell. Windows thus run over 1/CELLS of the keys; rows that are alike in
doc_id, size and checksum are counted first, so that repeated rows never meet in one window.

Defined cases: null texts have size 1 and checksum 0; null doc_ids are keys of their own; repeated rows take one place
each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm._shared import written

#: Places of the ring.
CELLS = 1 << 16
#: Copies of one repeated row that are made at a time.
COPIES = 4096
#: Virtual nodes of a shard.
NODES = 128


def ring(shards: int, nodes: int = NODES) -> list[tuple[int, int]]:
    """(place, shard) of all virtual nodes, clockwise."""
    place = lambda s, v: int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=4).digest()) % CELLS
    return sorted((place(s, v), s) for s in range(shards) for v in range(nodes))


def shares(counts: dict[int, int], capacity: Sequence[int], nodes: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, rank after the last, shard, slot of the first) of all keys of the cells."""
    home, at = {}, 0
    for cell in sorted(counts):
        while at < len(nodes) and nodes[at][0] < cell:
            at += 1
        home[cell] = at % len(nodes)
    load, out, over = [0] * len(capacity), [], []

    def give(cell: int, first: int, n: int, shard: int) -> int:
        n = min(n, capacity[shard] - load[shard])
        if n:
            out.append((cell, first, first + n, shard, load[shard]))
            load[shard] += n
        return n

    for cell, node in home.items():
        n = give(cell, 0, counts[cell], nodes[node][1])
        if n < counts[cell]:
            over.append((cell, n, node))
    for cell, first, node in over:
        while first < counts[cell]:
            node = (node + 1) % len(nodes)
            first += give(cell, first, counts[cell] - first, nodes[node][1])
    return out


def capacities(n: int, shards: int, slack: float) -> list[int]:
    """Without slack the capacities sum to n and differ by one at most."""
    if slack:
        return [-(-int(n * (1 + slack)) // shards) + 1] * shards
    return [n // shards + (s < n % shards) for s in range(shards)]


def assign(docs: DataFrame, shards: int = 16, slack: float = 0.0, nodes: int = NODES) -> DataFrame:
    """docs (doc_id, text) -> doc_id, size, text_crc32, shard, slot; a row for each row of docs.

    slack: the part by which a shard may exceed its even share; without it, counts are at most one apart."""
    utf8 = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(utf8) + 1).cast("long").alias("size"), F.crc32(utf8).alias("text_crc32"))
    hashed = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies")).withColumn("hash", F.xxhash64("doc_id", "size", "text_crc32"))
    keys = written(hashed.withColumn("cell", F.shiftrightunsigned("hash", 48).cast("int")), "keys")
    counts = {r["cell"]: r["n"] for r in keys.groupBy("cell").agg(F.sum("copies").alias("n")).collect()}  # CELLS rows at most
    table = shares(counts, capacities(sum(counts.values()), shards, slack), ring(shards, nodes))
    spark = docs.sparkSession
    share = spark.createDataFrame(table, "cell int, first long, until long, shard int, base long")
    before = Window.partitionBy("cell").orderBy("hash", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    ranked = keys.withColumn("_before", F.coalesce(F.sum("copies").over(before), F.lit(0)))
    # copies of a row that is repeated very often are made COPIES at a time, each time from a row of its own
    last = F.col("_before") + F.col("copies") - 1
    parts = ranked.withColumn("_first", F.explode(F.sequence(F.col("_before"), last, F.lit(COPIES).cast("long"))))
    each = parts.withColumn("rank", F.explode(F.sequence(F.col("_first"), F.least(F.col("_first") + COPIES - 1, last))))
    # a row for each cell, and for each shard that overflows into it: a bounded broadcast
    found = each.join(F.broadcast(share), (each["cell"] == share["cell"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("until")))
    return found.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("first")).alias("slot"))


def digest(docs: DataFrame, shards: int = 16) -> DataFrame:
    """The law `rows` holds: the shards' counts are at most one apart."""
    out = assign(docs, shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
