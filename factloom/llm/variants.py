"""Spelling variants: words one edit apart, by composing the vocabulary's minimal acceptor with a one-edit transducer and with itself.

A path of the composition reads a common beginning, then one edit, then a common rest. Its accepted pairs are listed by the state
in which it begins: words of n code points that share their first half leave the acceptor's initial state for the same state, so
each such state is a partition with a minimal acceptor of its own, that of the words' ends. Pairs whose edit comes later than the
half are paths from there. The others share their second half, and are paths of the acceptor of the reversed words from the state
after that half. A pair of n and n + 1 code points is found with those of n. The edit stands at the first place where two words
differ, read in the direction of the acceptor, so each pair is accepted once.

A state that more than MOST words leave is split into the states one code point on; pairs whose edit lies on just that code point
then meet by what is before and behind it, at most as many words as there are code points (`_split`, until no state is above
MOST). Partitions are sorted runs of one shuffle by state; a task holds one state's acceptor at a time.

A word's form is its near word with the most occurrences, if it has FACTOR times the word's own. Forms lead to more frequent
words only, at least FACTOR times each, so paths to the root are short and are followed by doubling.

Defined cases: null texts have no words; a null doc_id is written as an empty string before the colon; repeated rows count as often as they
stand; an empty table, or one without words of LEAST occurrences, gives no rows; further columns of docs are ignored.
"""

from __future__ import annotations

import os.path
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm._shared import small_batches, written

#: Fixed values of the contract: what a run is, and which runs lose a code point.
RUN = "[A-Za-zÀ-ÿ]+"
LOSES = 199
#: Code points and occurrences that a word has at least, and how much more frequent its form is.
LENGTH = 6
LEAST = 5
FACTOR = 5
#: Words that leave one state at most.
MOST = 4096
#: Words a task counts before it sends them on.
HELD = 1 << 19

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def altered(doc_id: int | None, run: str) -> str:
    """A lower-cased run as it counts: without one code point where the checksum says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % LOSES:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs_of = re.compile(RUN).findall
    held: Counter = Counter()

    def rows() -> Iterator[pa.RecordBatch]:
        words, counts = list(held), list(held.values())
        for lo in range(0, len(words), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(words[lo : lo + (1 << 16)], pa.string()), pa.array(counts[lo : lo + (1 << 16)], pa.int64())], ["word", "n"])
        held.clear()

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            before, crc = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), zlib.crc32
            for run, n in Counter(runs_of((text.as_py() or "").translate(_LOWER))).items():
                h = crc(run.encode(), before)
                if not h % LOSES:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                if len(run) >= LENGTH:
                    held[run] += n
            if len(held) > HELD:
                yield from rows()
    yield from rows()


def vocabulary(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs (doc_id, text) -> word, n."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


class Acceptor:
    """The minimal acyclic acceptor of some words: states with equal ends are one. arcs[state]: what each code point leads to."""

    def __init__(self, words: Iterable[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self._known: dict[tuple, int] = {}
        self._ends: dict[tuple[int, int], bool] = {}
        path: list[tuple[dict[str, int], list[bool]]] = [({}, [False])]  # states of the word before that may still branch
        before = ""
        for word in sorted(set(words)):
            shared = len(os.path.commonprefix((before, word)))
            self._close(path, before, shared)
            path += [({}, [False]) for _ in range(len(word) - shared)]
            path[-1][1][0] = True
            before = word
        self._close(path, before, 0)
        self.start = self._state(*path[0])

    def _close(self, path: list, word: str, depth: int) -> None:
        """The states below depth branch no more: each becomes the known one with the same ends, or a new one."""
        for at in range(len(path) - 1, depth, -1):
            path[at - 1][0][word[at - 1]] = self._state(*path.pop())

    def _state(self, arcs: dict[str, int], final: list[bool]) -> int:
        key = (final[0], tuple(arcs.items()))
        at = self._known.setdefault(key, len(self.arcs))
        if at == len(self.arcs):
            self.arcs.append(arcs)
            self.final.append(final[0])
        return at

    def _both(self, p: int, q: int) -> bool:
        """Whether something may be read to the end from p as well as from q; each pair of states is settled once."""
        if p == q:
            return True
        known, stack = self._ends, [(p, q)]
        while stack:
            pair = stack[-1]
            if pair not in known:
                a, b = self.arcs[pair[0]], self.arcs[pair[1]]
                found, more = self.final[pair[0]] and self.final[pair[1]], None
                for c in () if found else a.keys() & b.keys():
                    found = a[c] == b[c] or known.get((a[c], b[c]))
                    if found:
                        break
                    if found is None:
                        more = (a[c], b[c])
                if not found and more:
                    stack.append(more)
                    continue
                known[pair] = bool(found)
            stack.pop()
        return known[p, q]

    def common(self, p: int, q: int, but: str = "") -> Iterator[str]:
        """What may be read to the end from p as well as from q, unless it begins with `but`."""
        stack = [(p, q, "")]
        while stack:
            p, q, read = stack.pop()
            if self.final[p] and self.final[q]:
                yield read
            a, b = self.arcs[p], self.arcs[q]
            stack += [(a[c], b[c], read + c) for c in (a if p == q else a.keys() & b.keys()) if (read or c != but) and self._both(a[c], b[c])]

    def near(self) -> Iterator[tuple[str, str]]:
        """Accepted pairs of the composition: every two words one edit apart, the shorter or smaller one first."""
        stack = [(self.start, "")]
        while stack:
            state, read = stack.pop()
            arcs = self.arcs[state]
            stack += [(to, read + c) for c, to in arcs.items()]
            for c, to in arcs.items():
                for other, there in arcs.items():
                    if c < other:
                        for z in self.common(to, there):
                            yield read + c + z, read + other + z
                for z in self.common(to, state, but=c):
                    yield read + z, read + c + z


_KEY = ("turned", "size", "state")


def _begins(words: DataFrame) -> DataFrame:
    """word, n -> turned (read from its end), size (of pairs of so many code points and one more at most), read, depth (code points that
    lead to the state) and state: a row for each state in which a word's pairs may begin."""
    each = words.withColumn("turned", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("size", F.explode(F.array(F.length("word"), F.length("word") - 1)))
    half = F.expr("size div 2").cast("int")
    depth = F.when(F.col("turned"), F.col("size") - half).otherwise(half)
    read = F.when(F.col("turned"), F.reverse("word")).otherwise(F.col("word"))
    return each.select("turned", "size", "n", read.alias("read"), depth.alias("depth")).withColumn("state", _prefix(F.col("depth")))


def _prefix(depth: Column) -> Column:
    return F.concat(F.lit(">"), F.col("read").substr(F.lit(1), depth))


def _split(begins: DataFrame, most: int) -> DataFrame:
    """begins without states that more than `most` words leave: their words begin one code point on, and pairs that differ there meet by
    what is before and behind it, as replaced (`=`) or as left out in the shorter word (`+`)."""
    while True:
        large = begins.filter(F.col("state").startswith(">")).groupBy(*_KEY).count().filter(F.col("count") > most).drop("count")
        if not large.limit(1).count():
            return begins
        hot, depth, size = begins.join(large, list(_KEY), "left_semi"), F.col("depth"), F.col("size")
        before, behind = F.col("read").substr(F.lit(1), depth), F.col("read").substr(depth + 2, size)
        same = F.length("read") == size
        further = hot.filter(F.length("read") > depth).withColumn("state", _prefix(depth + 1)).withColumn("depth", depth + 1)
        replaced = hot.filter(same & (F.length("read") > depth)).withColumn("state", F.concat(F.lit("="), before, F.lit("\n"), behind))
        left_out = hot.withColumn("state", F.concat(F.lit("+"), before, F.lit("\n"), F.when(same, F.col("read").substr(depth + 1, size)).otherwise(behind)))
        rest = begins.join(large, list(_KEY), "left_anti")
        begins = written(rest.unionByName(further).unionByName(replaced).unionByName(left_out), "variant-states")


def _pairs(size: int, state: str, depth: int, reads: list[str]) -> Iterator[tuple[str, str]]:
    """The words one edit apart whose path begins in this state."""
    if state[0] == ">":
        before = reads[0][:depth]
        for a, b in Acceptor(r[depth:] for r in reads).near():
            if len(a) < len(b) or len(a) + depth == size:  # others are found where their own size is
                yield before + a, before + b
    elif state[0] == "=":
        yield from ((a, b) for a in reads for b in reads if a < b)
    else:
        yield from ((a, b) for a in reads if len(a) == size for b in reads if len(b) > size and a[depth : depth + 1] != b[depth])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of states -> word, near (number of its near words here), best and best_n (the most frequent of them, the smaller of equal ones)."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True)

    out: list[tuple] = []

    def made() -> pa.RecordBatch:
        arrays = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(arrays, ["word", "near", "best", "best_n"])

    for (turned, size, state), group in groupby(rows(), key=itemgetter(0, 1, 2)):
        counts: dict[str, int] = {}
        for _, _, _, depth, read, n in group:
            counts[read] = n
        if len(counts) < 2:
            continue
        found: dict[str, list] = {}
        for a, b in _pairs(size, state, depth, list(counts)):
            x, y = (a[::-1], b[::-1]) if turned else (a, b)
            if turned and x[: size // 2] == y[: size // 2]:
                continue  # accepted from the other side
            for word, other, n in ((x, y, counts[b]), (y, x, counts[a])):
                at = found.setdefault(word, [0, other, n])
                at[0] += 1
                if (-n, other) < (-at[2], at[1]):
                    at[1:] = other, n
        out += [(word, *at) for word, at in found.items()]
        if len(out) > 1 << 14:
            yield made()
    if out:
        yield made()


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """word, n -> word, n_near, best, best_n of the words that have near ones."""
    begins = _split(_begins(words), most).select(*_KEY, "depth", "read", "n")
    found = begins.repartition(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(_near, "word string, near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.word").alias("best"), (-F.col("b.n")).alias("best_n"))


def _roots(forms: DataFrame, steps: int) -> DataFrame:
    """word, form -> word, root, where paths have `steps` steps at most: each round doubles what is behind a word."""
    now = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(0, steps - 1).bit_length()):
        on = now.select(F.col("word").alias("_at"), F.col("root").alias("_on"))
        now = written(now.join(on, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_on", "root").alias("root")), "variant-roots")
    return now


def variants(docs: DataFrame, least: int = LEAST, factor: int = FACTOR, most: int = MOST) -> DataFrame:
    """docs (doc_id, text) -> word, form, root, n, n_near, form_n; a row for each word."""
    words = written(vocabulary(docs, least), "variant-words")
    out = words.join(near_words(words, most), "word", "left")
    has = F.col("best_n") >= F.col("n") * factor
    out = written(out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")), "variant-forms")
    top, steps = out.agg(F.max("n")).first()[0] or 0, 0
    while least * factor ** (steps + 1) <= top:
        steps += 1
    roots = _roots(out.filter("form is not null"), steps)
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE_SQL = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i::BIGINT], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  GROUP BY ALL),
hexes AS (SELECT run, n, hex(encode(concat(doc_id, ':', run))) AS x FROM runs),
sums AS (
  SELECT run, n, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(len(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM hexes, crc_table),
counted AS (SELECT CASE WHEN h % {LOSES} = 0 THEN run[: h % len(run)] || run[h % len(run) + 2 :] ELSE run END AS word, sum(n)::BIGINT AS n FROM sums GROUP BY 1),
words AS (SELECT * FROM counted WHERE n >= {LEAST} AND len(word) >= {LENGTH}),
gaps AS (SELECT word, n, i, word[: i] || word[i + 2 :] AS rest FROM words, range(1000) r(i) WHERE i < len(word)),
pairs AS (
  SELECT a.word, b.word AS near, b.n FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gaps a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM gaps a JOIN words b ON a.rest = b.word),
found AS (SELECT word, count(*) AS n_near, min_by(near, (-n, near)) AS best, max(n) AS best_n FROM pairs GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(f.n_near, 0) AS n_near, CASE WHEN f.best_n >= {FACTOR} * w.n THEN f.best END AS form, CASE WHEN f.best_n >= {FACTOR} * w.n THEN f.best_n END AS form_n
  FROM words w LEFT JOIN found f USING (word)),
paths AS (SELECT word, word AS at_word FROM forms UNION ALL SELECT p.word, f.form FROM paths p JOIN forms f ON f.word = p.at_word WHERE f.form IS NOT NULL),
roots AS (SELECT p.word, p.at_word AS root FROM paths p JOIN forms f ON f.word = p.at_word WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""
