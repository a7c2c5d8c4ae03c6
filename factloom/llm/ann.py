"""Approximate nearest neighbours by inner product: lists of vectors, scanned a block of dimensions at a time.

Centroids, a random rotation and the number of lists to probe are fitted on a bounded sample (SAMPLE vectors at most, those
of the smallest hashed ids); every vector is indexed. A query probes the lists whose centroids have the largest inner
product with it, as many as hold SHARE of the sample's true neighbours. Members of the sample in the probed lists give
the query a floor: the k-th best of those lists can't be under it. The sample gives no rows; all come from the scan of
the probed lists.

Within a probed list the rotated vectors are read in blocks of BLOCK_DIMS dimensions. After d of D dimensions a partial
product p of a pair whose full product is t has, under a random rotation, mean t d / D and a known deviation; a
candidate is abandoned when p lies Z deviations under what the floor asks. Survivors are scored in
double precision on the original vectors. The test can abandon a true one; a query left with fewer than k rows
is scanned again without a floor.

There are as many lists as the root of the number of vectors (fewer while lists would hold under LIST_SIZE), so what a
query reads grows with that root, up to a quarter of the sample; past that lists grow.

Lists are split by hash into parts of LIST_PART vectors, and the queries of a list into parts of QUERY_PART, so that no
task holds more than one of each, however large a list grows.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose
length isn't the table's most common one (the smaller of two); rows alike in id and vector are one candidate; ties go to the smaller id; fewer
candidates than k give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm._shared import written

#: Vectors that the index is fitted on, at most and where there are few lists; and their bytes, at most.
SAMPLE, LEAST_SAMPLE = 65_536, 16_384
SAMPLE_BYTES = 128 << 20
SHARE = 0.97
LIST_SIZE = 512
LIST_PART = 8192
QUERY_PART = 2048
BLOCK_DIMS = 16
Z = 3.5
#: The floor of a query that has none.
NO_FLOOR = -1e300


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray
    rotation: np.ndarray
    probes: int
    sample_ids: np.ndarray
    sample: np.ndarray
    sample_lists: np.ndarray


def _vectors(column: pa.Array, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The vectors that take part, in double precision, and their rows."""
    flat, sizes = column.flatten(), np.diff(column.offsets.to_numpy())
    if len(column) and not column.null_count and not flat.null_count and sizes.min() == sizes.max() == (sizes[0] if dims is None else dims) > 0:
        x, rows = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1), np.arange(len(column))
    else:
        lists = column.to_pylist()
        dims = dims or Counter(len(v) for v in lists if v).most_common(1)[0][0] if any(lists) else dims or 0
        rows = np.array([i for i, v in enumerate(lists) if v and len(v) == dims and None not in v], np.int64)
        x = np.array([lists[i] for i in rows], np.float64).reshape(len(rows), dims)
    ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return x[ok], rows[ok]


def fit(vectors: DataFrame, k: int) -> Index | None:
    """The index of vectors (vec_id, embedding); None where no vector takes part."""
    size = F.size("embedding")
    n, dims = vectors.agg(F.count("*"), F.mode(F.when(size > 0, size), True)).first()
    if dims is None:
        return None
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dims)))
    lists_n = max(1, min(n // LIST_SIZE, math.isqrt(n), most // 4))
    # Arrow batches of doubles: no vector becomes a Python list
    found = vectors.filter((size == dims) & F.col("vec_id").isNotNull()).orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(most, max(LEAST_SAMPLE, 16 * lists_n))).toArrow().combine_chunks()
    if not len(found):
        return None
    x, at = _vectors(found.column("embedding").combine_chunks(), dims)
    ids = found.column("vec_id").to_numpy()[at]
    del found
    if not len(x):
        return None
    rng = np.random.default_rng(0)
    lists_n = min(lists_n, len(x))
    c = x[rng.permutation(len(x))[:lists_n]].copy()
    for _ in range(8):
        of = _nearest(x, c)
        order = np.argsort(of, kind="stable")
        lists, first, counts = np.unique(of[order], return_index=True, return_counts=True)
        for j, start, n_own in zip(lists, first, counts):
            c[j] = x[order[start : start + n_own]].mean(axis=0)
    of = _nearest(x, c)
    # how far down a query's order of lists its true neighbours lie, within the sample
    q = x[rng.permutation(len(x))[:512]]
    order = np.argsort(-(q @ c.T), axis=1, kind="stable")
    depth = np.empty_like(order)
    np.put_along_axis(depth, order, np.arange(lists_n)[None, :], axis=1)
    best = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, 1 : k + 1]
    at = np.sort(np.take_along_axis(depth, of[best], axis=1).ravel()) if best.size else np.zeros(1, int)
    probes = int(at[min(len(at) - 1, int(SHARE * len(at)))]) + 1
    rotation, _ = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))
    return Index(c, rotation, probes, ids, x, of)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c**2).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ c.T - half, axis=1) for i in range(0, len(x), 4096)])


def _scan(q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, x_ids: np.ndarray, x: np.ndarray, rotation: np.ndarray, k: int) -> tuple[list, list, list]:
    """(query ids, vector ids, scores) of each query's k best of x that reach its floor."""
    dims = x.shape[1]
    qr, xr = q @ rotation, x @ rotation
    q_norm, x_norm = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
    out: tuple[list, list, list] = ([], [], [])
    step = max(1, (1 << 20) // max(1, len(x)))
    for lo in range(0, len(q), step):
        rows = slice(lo, lo + step)
        scale = q_norm[rows, None] * x_norm[None, :]
        least = np.broadcast_to(floor[rows, None], scale.shape)
        cos2 = np.square(np.clip(least / scale, -1, 1))
        partial = np.zeros_like(scale)
        alive = np.ones(scale.shape, bool)
        pairs = None  # few survivors are followed one by one
        for d in range(0, dims, BLOCK_DIMS):
            block = slice(d, d + BLOCK_DIMS)
            done = min(d + BLOCK_DIMS, dims) / dims
            if pairs is None:
                partial += qr[rows, block] @ xr[:, block].T
                ask = least * done - Z * scale * np.sqrt(done * (1 - done) * (1 + cos2) / dims) - 1e-9 * scale
                alive &= partial >= ask
                if alive.mean() < 0.05:
                    a, b = np.nonzero(alive)
                    pairs = (a, b, partial[a, b])
            else:
                a, b, p = pairs
                p = p + np.einsum("ij,ij->i", qr[rows][a, block], xr[b, block])
                s = scale[a, b]
                keep = p >= least[a, b] * done - Z * s * np.sqrt(done * (1 - done) * (1 + cos2[a, b]) / dims) - 1e-9 * s
                pairs = (a[keep], b[keep], p[keep])
        a, b = pairs[:2] if pairs is not None else np.nonzero(alive)
        apart = q_ids[rows][a] != x_ids[b]
        a, b = a[apart], b[apart]
        score = np.einsum("ij,ij->i", q[rows][a], x[b])
        order = np.lexsort((x_ids[b], -score, a))
        a, b, score = a[order], b[order], score[order]
        first = np.ones(len(a), bool)  # rows alike are one candidate
        first[1:] = (np.diff(a) != 0) | (np.diff(x_ids[b]) != 0) | (np.diff(score) != 0)
        a, b, score = a[first], b[first], score[first]
        nth = np.arange(len(a)) - np.searchsorted(a, a)
        keep = nth < k
        out[0].extend(q_ids[rows][a[keep]].tolist())
        out[1].extend(x_ids[b[keep]].tolist())
        out[2].extend(score[keep].tolist())
    return out


def _as_bytes(x: np.ndarray) -> pa.Array:
    return pa.array([v.tobytes() for v in x], pa.binary())


def _as_matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """vectors, queries (vec_id, embedding) -> query_id, rank (from 1), vec_id, score: the k nearest found of other ids."""
    spark = vectors.sparkSession
    vectors, queries = (df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).filter("vec_id is not null") for df in (vectors, queries))
    index = fit(vectors, k)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # apart, so that a task loads what it needs: SAMPLE_BYTES of vectors, a quarter as many centroids, and one matrix at most
    dims, probes = index.sample.shape[1], index.probes
    centroids, rotation, members = (spark.sparkContext.broadcast(part) for part in (index.centroids, index.rotation, (index.sample_ids, index.sample, index.sample_lists)))
    del index

    def to_list(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in it:
            x, at = _vectors(rows.column("embedding"), dims)
            yield pa.RecordBatch.from_pydict({"list": pa.array(_nearest(x, centroids.value) if len(x) else [], pa.int64()), "vec_id": rows.column("vec_id").take(pa.array(at)), "vector": _as_bytes(x)})

    def to_queries(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, (sample_ids, sample, sample_lists) = centroids.value, members.value
        for all_rows in it:
            for lo in range(0, len(all_rows), 512):
                rows = all_rows.slice(lo, 512)
                q, at = _vectors(rows.column("embedding"), dims)
                ids = rows.column("vec_id").take(pa.array(at)).to_numpy()
                lists = np.argsort(-(q @ c.T), axis=1, kind="stable")[:, :probes]
                probed = np.zeros((len(q), len(c)), bool)
                np.put_along_axis(probed, lists, True, axis=1)
                inside = q @ sample.T
                inside[(ids[:, None] == sample_ids[None, :]) | ~probed[:, sample_lists]] = -np.inf
                floor = np.partition(inside, -k, axis=1)[:, -k] if inside.shape[1] >= k else np.full(len(q), -np.inf)
                floor = np.where(np.isfinite(floor), floor - 1e-9 * np.abs(floor), NO_FLOOR)
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array(ids, pa.int64()),
                    "floor": pa.array(floor, pa.float64()),
                    "vector": _as_bytes(q),
                    "lists": pa.array(lists.tolist(), pa.list_(pa.int64())),
                })

    listed = written(vectors.mapInArrow(to_list, "list long, vec_id long, vector binary"), "lists")
    asking = written(queries.mapInArrow(to_queries, "query_id long, floor double, vector binary, lists array<long>"), "queries")
    exploded = lambda asked: asked.select("query_id", "floor", "vector", F.explode("lists").alias("list"))
    probed = exploded(asking)
    # how many parts each list and its queries make: a row for each list, SAMPLE / 4 at most
    parts = listed.groupBy("list").agg(F.ceil(F.count("*") / LIST_PART).alias("xs"))
    asked = probed.groupBy("list").agg(F.ceil(F.count("*") / QUERY_PART).alias("qs"))
    size = F.broadcast(written(parts.join(asked, "list"), "parts"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    right = listed.join(size, "list").withColumn("xp", F.pmod(F.xxhash64("vec_id", F.lit(1)), "xs")).withColumn("qp", every("qs")).select("list", "xp", "qp", "vec_id", "vector")

    def scan(q: pa.Table, x: pa.Table) -> pa.Table:
        found: tuple[list, list, list] = ([], [], [])
        if len(q) and len(x):
            found = _scan(q.column("query_id").to_numpy(), _as_matrix(q.column("vector")), q.column("floor").to_numpy(), x.column("vec_id").to_numpy(), _as_matrix(x.column("vector")), rotation.value, k)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    keys = ("list", "xp", "qp")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))

    def nearest(probed: DataFrame, name: str) -> DataFrame:
        left = probed.join(size, "list").withColumn("qp", F.pmod(F.xxhash64("query_id"), "qs")).withColumn("xp", every("xs")).select("list", "xp", "qp", "query_id", "floor", "vector")
        near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scan, "query_id long, vec_id long, score double").distinct()
        return written(near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), name)

    found = nearest(probed, "near")
    full = found.groupBy("query_id").count().filter(F.col("count") >= k).select("query_id")
    short = written(asking.filter(F.col("floor") > NO_FLOOR).join(full, "query_id", "left_anti").withColumn("floor", F.lit(NO_FLOOR)), "short")
    if short.isEmpty():
        return found
    again = nearest(exploded(short), "again")
    return found.join(short.select("query_id").distinct(), "query_id", "left_anti").unionByName(again)
