"""Collocations: word splitting, counting and the whole operator against a plain computation, the query against its SQL."""

import collections
import random
import re

import duckdb
import numpy as np

from factloom.llm import phrases as P
from factloom.llm import queries

SCHEMA = "doc_id long, text string, lang string, key string, f long, rank int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "k", 1, 2) for i, (t, lang) in enumerate(rows)], SCHEMA)


def plain(rows, least, best=P.BEST):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    longer = {k: a for k, a in f.items() if a >= least}
    covered = {}
    for (lang, w), a in longer.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                covered[lang, w[i : i + k]] = max(a, covered.get((lang, w[i : i + k]), 0))
    out = collections.defaultdict(list)
    for (lang, w), a in longer.items():
        if len(w) > 1 and 100 * covered.get((lang, w), 0) < 80 * a:
            cuts = [(2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            phrase = " ".join(w)
            out[lang].append((-score, -a, phrase.encode(), phrase, f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i, p, -a, l_, r, n[lang], -s) for lang, rows in out.items() for i, (s, a, _, p, l_, r) in enumerate(sorted(rows)[:best], 1))


def sample(seed=1, n=150):
    draw = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "hall", "é", "a-b", "x\x00y", "Ünder", "日本", "\x1f"]
    rows = []
    for i in range(n):
        text = "".join(draw.choice(words) + draw.choice([" ", " ", "  ", "\t", ". ", ",", "\n", " ", "\r\n"]) for _ in range(draw.randint(0, 80)))
        text += "New York City hall. " * (i % 3) + "of the of the of the " * (i % 2)
        rows.append((text, draw.choice(["en", "fr", None, "und", ""])))
    return rows + [(None, "en"), ("", None), (" \t\n.,", "de"), (None, None)] + [rows[5]] * 6


def test_splitting():
    texts = ["The  cat.sat\ton, a", "", "mat cat", "...", "é A"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t.encode()) for t in texts])
    hashes, starts, until, text, follows = P.split(data, ends, np.zeros(5, np.uint64))
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, until, strict=True)] == ["The", "cat", "sat", "on", "a", "mat", "cat", "é", "A"]
    assert text.tolist() == [0, 0, 0, 0, 0, 2, 2, 4, 4]
    assert follows.tolist() == [False, True, False, True, False, False, True, False, True]
    assert hashes[1] == hashes[6] and hashes[4] == hashes[8] and len(set(hashes.tolist())) == 7


def test_against_a_plain_computation(spark):
    rows = sample()
    want = plain(rows, 5)
    assert len(want) > 100 and any(len(w[2].split()) == 4 for w in want)
    assert sorted(tuple(r) for r in P.collocations(docs(spark, rows), least=5).collect()) == want
    assert sorted(tuple(r) for r in P.collocations(docs(spark, rows[::-1]).repartition(6), least=5).collect()) == want
    few = sorted(tuple(r) for r in P.collocations(docs(spark, rows), least=5, best=7).collect())
    assert few == plain(rows, 5, 7)


def test_small_stores_and_a_full_filter(spark, monkeypatch):
    monkeypatch.setattr(P, "HELD", 64)
    monkeypatch.setattr(P, "MOST_BITS", 64)
    rows = sample(2)
    assert sorted(tuple(r) for r in P.collocations(docs(spark, rows), least=5).collect()) == plain(rows, 5)


def test_very_long_pieces_and_repeats(spark):
    rows = [("spam " * 300000, "en"), ("one very long tail " * 50000, "en"), ("x" * 2000000 + " y", "en")]
    assert sorted(tuple(r) for r in P.collocations(docs(spark, rows)).collect()) == plain(rows, 30)


def test_empty_table_and_rare_phrases(spark):
    assert P.collocations(docs(spark, [])).collect() == []
    assert P.collocations(docs(spark, [("nothing here repeats", "en"), (None, None)])).collect() == []
    assert P.collocations(docs(spark, [("w. " * 40, "en")])).collect() == []


def test_scores_pass_64_bits(spark):
    big = 9 * 10**13
    rows = [([1], 9 * big), ([2], 8 * big), ([1, 2], big)]
    got = P.scored(spark.createDataFrame(rows, "key array<long>, f long")).collect()
    assert [(r["a"], r["l"], r["r"], r["score"]) for r in got] == [(big, 9 * big, 8 * big, 2000000 // 17)]


def test_queries_are_their_sql(spark, tmp_path):
    rows = sample(3, 300)
    df = docs(spark, rows)
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("op11_spelling_variants", "op13_collocations"):
        got = queries.QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
        assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))
