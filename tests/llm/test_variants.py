"""Spelling variants: acceptors and pairs against all pairs, the query against a plain computation."""

import collections
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import variants as V

SCHEMA = "doc_id long, text string, lang string, word string, n long, size int, state string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", 1, 2, "y") for i, t in rows], SCHEMA)


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, least=V.LEAST, factor=V.FACTOR):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= least and len(w) >= 6}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= factor * n else None
    def root(w):
        return w if form[w] is None else root(form[w])
    return sorted((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()), len(words)


@given(st.sets(st.text("ab", max_size=5), max_size=14))
@settings(max_examples=300, deadline=None)
def test_pairs_of_an_acceptor_are_all_pairs_once(words):
    found = list(V.Acceptor(words).near())
    assert sorted(map(sorted, found)) == sorted([a, b] for a in words for b in words if a < b and one_edit(a, b))


@given(st.sets(st.text("abc", min_size=1, max_size=6), min_size=1, max_size=30))
@settings(max_examples=200, deadline=None)
def test_acceptors_are_minimal(words):
    made = V.Acceptor(words)
    ends = lambda p: frozenset(made.common(p, p))
    assert ends(made.start) == words
    assert len({ends(p) for p in range(len(made.arcs))}) == len(made.arcs)


@pytest.mark.parametrize("most", [V.MOST, 3])
def test_against_all_pairs(spark, most):
    draw = random.Random(11)
    base = ["".join(draw.choice("abé") for _ in range(draw.randint(6, 9))) for _ in range(40)]
    rows = []
    for i in range(300):
        made = []
        for _ in range(30):
            w = base[min(int(draw.expovariate(0.15)), 39)]
            at = draw.randrange(len(w))
            made.append(draw.choice((w, w, w.upper(), w.title(), w[:at] + w[at + 1 :], w[:at] + "z" + w[at:], w[:at] + "b" + w[at + 1 :])))
        rows.append((i if i % 7 else None, " 'x1".join(made)))
    rows += [(5, None), (None, None), (6, ""), (7, "12 .. \n")] + [rows[3]] * 4
    got = sorted(tuple(r) for r in V.variants(docs(spark, rows), most=most).collect())
    want, n = plain(rows)
    assert n > 100 and sum(w[1] is not None for w in want) > 20
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    again = V.variants(docs(spark, rows[::-1]).repartition(5), most=most).collect()
    assert sorted(map(repr, (tuple(r) for r in again))) == sorted(map(repr, got))


def test_paths_to_the_root(spark):
    chain = [("aaaaaaaa", 4000), ("aaaaaaab", 700), ("aaaaaabb", 130), ("aaaaabbb", 25), ("aaaabbbb", 5)]
    rows = [(1, " ".join([w] * n)) for w, n in chain]
    assert sorted(tuple(r) for r in V.variants(docs(spark, rows)).collect()) == plain(rows)[0]
    assert {r["root"] for r in V.variants(docs(spark, rows)).collect()} == {"aaaaaaaa"}


def test_very_long_words(spark):
    long = "ab" * 6000
    texts = [long, long + "c", "x" + long, long[:7000] + "q" + long[7001:], "a" * 9000, "a" * 9001]
    rows = [(i, t) for t in texts for i in range(6)]
    assert sorted(tuple(r)[3:5] for r in V.variants(docs(spark, rows)).collect()) == sorted(r[3:5] for r in plain(rows)[0])


def test_empty_table_and_rare_words(spark):
    assert V.variants(docs(spark, [])).collect() == []
    assert V.variants(docs(spark, [(1, "singular words only"), (2, None)])).collect() == []
