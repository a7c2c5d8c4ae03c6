"""Renames and copies against a plain comparison of all pairs."""

import collections
import random

from factloom.sources import renames as R

FILES = "path string, source string"


def similarity(a, b):
    weigh = lambda s: collections.Counter(s.split("\n"))
    x, y = weigh(a), weigh(b)
    size = lambda c: sum((len(k.encode()) + 1) * n for k, n in c.items())
    return sum((len(k.encode()) + 1) * min(n, y[k]) for k, n in x.items()) / max(size(x), size(y))


def plain(old, new, least):
    removed, added = {p: s for p, s in old.items() if p not in new and s}, {p: s for p, s in new.items() if p not in old and s}
    out, by = {}, collections.defaultdict(lambda: ([], []))
    for side, files in enumerate((removed, added)):
        for p in sorted(files):
            by[files[p]][side].append(p)
    for olds, news in by.values():
        for o, n in zip(olds, news, strict=False):
            out[n] = (o, "R", 1.0)
    used = {o for o, _, _ in out.values()}
    pairs = sorted((-similarity(a, b), o, n) for o, a in removed.items() if o not in used for n, b in added.items() if n not in out)
    for s, o, n in pairs:
        if -s >= least and o not in used and n not in out:
            out[n] = (o, "R", -s)
            used.add(o)
    for n, b in added.items():
        if n not in out:
            best = min(((-similarity(a, b), o) for o, a in old.items() if a), default=(0, ""))
            if -best[0] >= least:
                out[n] = (best[1], "C", -best[0])
    return out


def test_against_all_pairs(spark):
    draw = random.Random(3)
    words = [f"line {i} é" * draw.randint(1, 3) for i in range(40)] + ["", "}", "{"]
    make = lambda: [draw.choice(words) for _ in range(draw.randint(1, 12))]
    old = {f"o{i}": "\n".join(make()) for i in range(40)} | {"same": "a\nb", "empty": "", "gone": None, "twin1": "t\nt", "twin2": "t\nt"}
    new = {"same": "a\nb", "e2": "", "n_twin1": "t\nt", "n_twin2": "t\nt", "n_twin3": "t\nt"}
    for i in range(40):
        lines = old[f"o{i}"].split("\n")
        for _ in range(draw.randint(0, 6)):
            lines[draw.randrange(len(lines))] = draw.choice(words)
        new[f"o{i}" if i % 4 == 0 else f"n{i}"] = "\n".join(lines)
    a, b = spark.createDataFrame(list(old.items()), FILES), spark.createDataFrame(list(new.items()), FILES)
    for least in (0.5, 0.8):
        got = {r["path"]: (r["old_path"], r["status"], round(r["similarity"], 9)) for r in R.renames(a, b, least, copies=True).collect()}
        assert got == {n: (o, s, round(x, 9)) for n, (o, s, x) in plain(old, new, least).items()}
        assert {"R", "C"} <= {s for _, s, _ in got.values()}
    rows = {r["path"]: (r["old_path"], r["status"], r["normalised"]) for r in R.changes(a, b, copies=True).collect()}
    assert "same" not in rows and rows["e2"] == (None, "A", "A") and rows["gone"] == (None, "D", "D")
    assert all(n == {"R": "M", "C": "A"}.get(s, s) for _, s, n in rows.values())
    assert not {o for o, s, _ in rows.values() if s == "R"} & set(rows)


def test_nothing_to_compare(spark):
    none, one = spark.createDataFrame([], FILES), spark.createDataFrame([("a", "x"), ("b", None)], FILES)
    assert R.renames(none, one).collect() == R.renames(one, none, copies=True).collect() == R.changes(one, one).collect() == []
    assert sorted(tuple(r) for r in R.changes(none, one).collect()) == [("a", None, "A", "A"), ("b", None, "A", "A")]


def test_snapshots_are_read_once(spark):
    """Building a snapshot may cost as much as all that follows: neither may be computed again for each part of the job."""
    read = {"old": spark.sparkContext.accumulator(0), "new": spark.sparkContext.accumulator(0)}

    def counted(name, rows):
        seen = read[name]

        def tell(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return spark.createDataFrame(rows, FILES).mapInArrow(tell, FILES)

    old = [(f"o{i}", "\n".join(f"line {i} {j}" for j in range(6))) for i in range(10)] + [("same", "x"), ("mod", "a\nb"), ("gone", None)]
    new = [(f"n{i}", "\n".join(f"line {i} {j}" for j in range(6 - i % 2))) for i in range(10)] + [("same", "x"), ("mod", "a\nc"), ("e", "")]
    rows = {r["path"]: (r["old_path"], r["status"]) for r in R.changes(counted("old", old), counted("new", new)).collect()}
    assert rows == {f"n{i}": (f"o{i}", "R") for i in range(10)} | {"mod": (None, "M"), "gone": (None, "D"), "e": (None, "A")}
    assert {name: seen.value for name, seen in read.items()} == {"old": len(old), "new": len(new)}
