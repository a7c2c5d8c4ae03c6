"""Mixing sources: targets and apportionment against plain computations, the query against its SQL, pieces against the sums."""

import collections
import heapq

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import mixing as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, at long, target double"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, s, 0, 7, 8, 0.5) for i, t, s in rows], SCHEMA)


@given(st.lists(st.tuples(st.integers(0, 400), st.integers(1, 3)), min_size=1, max_size=8))
@settings(max_examples=200, deadline=None)
def test_targets_reshare_until_none_is_above(sources):
    sizes, weights = [n for n, _ in sources], [w for _, w in sources]
    cut = set()
    while True:  # by rounds, as the contract has it
        rest = sum(sizes) - sum(3 * sizes[s] for s in cut)
        weight = sum(w for s, w in enumerate(weights) if s not in cut)
        want = [3 * n if s in cut else rest * weights[s] / weight for s, n in enumerate(sizes)]
        above = {s for s, n in enumerate(sizes) if s not in cut and want[s] > 3 * n}
        if not above:
            break
        cut |= above
    assert M.targets(sizes, weights) == pytest.approx(want)


@given(st.lists(st.tuples(st.floats(0, 1e6), st.integers(0, 300)), min_size=1, max_size=9), st.integers(0, 500))
@settings(max_examples=300, deadline=None)
def test_seats_go_to_the_highest_quotients(parties, seats):
    votes, most = [v for v, _ in parties], [m for _, m in parties]
    got, heap = [0] * len(votes), [(-v, s) for s, v in enumerate(votes) if v > 0 and most[s]]
    heapq.heapify(heap)
    for _ in range(seats):
        if heap:
            s = heapq.heappop(heap)[1]
            got[s] += 1
            if got[s] < most[s]:
                heapq.heappush(heap, (-votes[s] / (2 * got[s] + 1), s))
    assert M.apportioned(votes, most, seats) == got


@given(st.lists(st.integers(0, 5000), min_size=1, max_size=7), st.integers(1, 9))
@settings(max_examples=100, deadline=None)
def test_quotas_of_shards_are_even_and_permutations_whole(sizes, shards):
    shares = M.plan([(str(i), n) for i, n in enumerate(sizes)], shards)
    for s in shares:
        assert s.ends == sorted(s.ends) and s.ends[-1] == s.whole * s.blocks + s.extra <= 3 * s.blocks
        assert s.extra <= s.permuted
        assert sorted((s.factor * b + s.shift) % s.permuted for b in range(s.permuted)) == list(range(s.permuted))
    each = [sum(s.ends[k + 1] - s.ends[k] for s in shares) for k in range(shards)]
    assert max(each) - min(each) <= 1


def test_the_query_is_the_sql_with_nulls_repeats_and_hot_sources(spark):
    rows = [(i, "w " * (i % 37), f"s{i % 4}" if i % 3 else "hot") for i in range(400)]
    rows += [(None, "same text here", "hot")] * 300 + [(5, None, None), (5, None, None), (6, "", "é"), (7, " \t\n", "Z"), (8, "x " * 20000, "long"), (9, "a b c", None), (None, None, None)]
    df = docs(spark, rows)
    got = sorted(M.digest(df).collect(), key=repr)
    con = duckdb.connect()
    con.register("documents", df.toPandas().astype({"doc_id": "Int64"}))
    cols = ["doc_id", "size", "source_size", "target", "taken", "source", "quota"]
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({M.ORACLE_SQL})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    taken, target = collections.Counter(), {}
    for r in got:
        assert r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= 4 * M.BLOCK for s, t in target.items())


def test_pieces_sum_to_what_is_taken_and_fill_shards_evenly(spark):
    df = docs(spark, [(i, "w " * (i % 29), f"s{i % 3}") for i in range(300)])
    taken = {r["doc_id"]: r["taken"] for r in M.mix(df, shards=5).collect()}
    made = M.pieces(df, shards=5).collect()
    sums, shards, seen = collections.Counter(), collections.defaultdict(collections.Counter), set()
    for r in made:
        sums[r["doc_id"]] += r["length"]
        shards[r["shard"]][r["source"]] += r["length"]
        assert 0 <= r["start"] and r["length"] <= M.BLOCK
        key = (r["doc_id"], r["start"], r["round"])
        assert key not in seen
        seen.add(key)
    assert {i: sums[i] for i in taken} == taken
    assert sorted(shards) == list(range(5))
    for s in ("s0", "s1", "s2"):  # every shard has the mix's parts
        parts = [c[s] for c in shards.values()]
        assert max(parts) - min(parts) <= 4 * M.BLOCK
    assert sorted(made) == sorted(M.pieces(df.repartition(7), shards=5).collect())


def test_empty_table(spark):
    assert M.digest(docs(spark, [])).collect() == [] and M.pieces(docs(spark, [])).collect() == []
    only = M.digest(docs(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert sorted((r["doc_id"], r["size"], r["target"], r["taken"]) for r in only) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
