"""Phrase collocations by relational mining (SETM): occurrence relations sorted by piece and position, joined by adjacency.

The relation of a length holds the occurrences that may still be phrases of that length, in rows of about ROW words: the words
in their order as 64-bit hashes of language and word, and a flag at each word that ends an occurrence. Relations are persisted
in that order, so the merge join of an occurrence with the one beside it in the same piece reads two neighbouring flags and
needs no shuffle. Groups are counted within each task first, then by Spark, by the words themselves, which is exact. Before the
next length the groups of FREQUENT occurrences or more are semi-joined back: a filter of bounded size (MOST_BITS), made from
them, drops occurrences of other groups, and words that no occurrence is left of are dropped with them. The filter lets
some of the others pass, all of which the next count drops, since a phrase is no more frequent than its parts.

Scores, containment, ranks and texts of the candidates are joins and groups over the frequent groups alone. The best of a language
are first taken within parts of it. Products are decimals of 38 digits.

Defined cases: null texts are empty; a null lang is `und`; repeated rows count as often as they stand; an empty table, or one
without frequent phrases, gives no rows; further columns of docs are ignored. A word may hold anything but blanks, tabs and what
separates pieces. Two frequent words of one hash, of which one run in a thousand has a pair at 10**8 frequent words, raise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm._hashing import mix, runs
from factloom.llm._shared import small_batches, written

#: Occurrences that make a phrase frequent, the most words of one, and the rows of a language.
FREQUENT = 30
LONGEST = 4
BEST = 2000
#: A longer phrase with this part (percent) of a phrase's occurrences takes its place.
COVERS = 80
#: What separates pieces, and the words of one.
PIECES, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Groups that a task holds before it sends them on.
HELD = 1 << 18
#: Words of a relation's row, as Spark reads thousands of rows at a time.
ROW = 1 << 10
#: Bits of a filter at most.
MOST_BITS = 1 << 27
#: Parts of a language that are ranked apart first.
PARTS = 64

_U = np.uint64
_SPREAD = _U(0x9E3779B97F4A7C15)
_BREAK = np.zeros(256, bool)
_BREAK[list(PIECES)] = True
_GAP = _BREAK.copy()
_GAP[list(BLANKS)] = True
#: A random value for each byte, A-Z as a-z.
_BYTES = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
_BYTES[65:91] = _BYTES[97:123]
_BASE = 0x2545F4914F6CDD1D


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: dict[str, np.ndarray] = {"up": _powers(1 << 20, _BASE), "down": _powers(1 << 20, pow(_BASE, -1, 1 << 64))}


def split(data: np.ndarray, ends: np.ndarray, langs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts that lie end to end in data: hash, first byte, byte after the last, its text, and whether it follows the word before in
    the same piece. langs: a hash for each text."""
    n, none = len(data), np.empty(0, np.int64)
    if n > len(_tables["up"]):
        _tables.update(up=_powers(2 * n, _BASE), down=_powers(2 * n, pow(_BASE, -1, 1 << 64)))
    gap = _GAP[data] if n else np.empty(0, bool)
    begins, closes = ~gap, ~gap
    begins[1:] &= gap[:-1]
    closes[:-1] &= gap[1:]
    cuts = ends[:-1][(ends[:-1] < n) & (ends[:-1] > 0)]
    begins[cuts] = ~gap[cuts]
    closes[cuts - 1] = ~gap[cuts - 1]
    starts, until = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    if not len(starts):
        return np.empty(0, _U), none, none, none, np.empty(0, bool)
    value = _BYTES[data] * _tables["up"][:n]
    value[gap] = 0
    text = np.searchsorted(ends, starts, side="right")
    hashes = mix(mix(np.add.reduceat(value, starts) * _tables["down"][starts] + (until - starts).astype(_U)) + langs[text])
    breaks = np.cumsum(_BREAK[data])[starts]
    follows = np.zeros(len(starts), bool)
    follows[1:] = (breaks[1:] == breaks[:-1]) & (text[1:] == text[:-1])
    return hashes, starts, until, text, follows


def phrase_hashes(words: np.ndarray) -> np.ndarray:
    """A hash of each row of words."""
    x = mix(words[:, 0] + _SPREAD)
    for j in range(1, words.shape[1]):
        x = mix(x * _SPREAD + words[:, j])
    return x


def ending(words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k words that end at each of these places, as rows."""
    return words[at[:, None] - np.arange(k - 1, -1, -1)[None, :]]


class Tally:
    """Rows of words and their counts, alike rows as one, until HELD rows are sent on."""

    def __init__(self, k: int):
        self.k, self.parts, self.rows, self.least = k, [], 0, 0

    def add(self, words: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(self._alike(words, np.ones(len(words), np.int64)))
        self.rows += len(self.parts[-1][0])
        if self.rows > 2 * self.least + HELD // 4:
            self._merge()
            if self.rows > HELD:
                yield from self.rest()

    def _alike(self, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(words):
            return words, counts
        order = np.argsort(phrase_hashes(words), kind="stable")
        words, counts = words[order], counts[order]
        first = np.flatnonzero(np.append(True, (words[1:] != words[:-1]).any(axis=1)))
        return words[first], np.add.reduceat(counts, first)

    def _merge(self) -> None:
        if len(self.parts) > 1:
            self.parts = [self._alike(np.concatenate([w for w, _ in self.parts]), np.concatenate([c for _, c in self.parts]))]
        self.rows = self.least = sum(len(w) for w, _ in self.parts)

    def rest(self) -> Iterator[pa.RecordBatch]:
        self._merge()
        for words, counts in self.parts:
            for lo in range(0, len(words), 1 << 16):
                w, c = words[lo : lo + (1 << 16)].view(np.int64), counts[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(w[:, j])) for j in range(self.k)), pa.array(c)], [*(f"w{j}" for j in range(self.k)), "f"])
        self.parts, self.rows, self.least = [], 0, 0


def _lang_hashes(langs: list[str]) -> np.ndarray:
    known = {lang: int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little") for lang in set(langs)}
    return np.array([known[lang] for lang in langs], _U)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, w, f of the words of these texts; the number of all words of a language under a null word."""
    found: dict[int, list] = {}
    totals: dict[str, int] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        held = [(lang, word, w, f) for w, (lang, word, f) in found.items()] + [(lang, None, None, f) for lang, f in totals.items()]
        found.clear()
        totals.clear()
        for lo in range(0, len(held), 1 << 16):
            lang, word, w, f = zip(*held[lo : lo + (1 << 16)], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(w, pa.int64()), pa.array(f, pa.int64())], ["lang", "word", "w", "f"])

    for batch in batches:
        names = batch.column(0).to_pylist()
        hashes = _lang_hashes(names)
        for lo, hi, data, ends in runs(batch.column(1)):
            words, starts, until, text, _ = split(data, ends, hashes[lo:hi])
            alike, first, counts = np.unique(words.view(np.int64), return_index=True, return_counts=True)
            raw = data.tobytes()
            for w, i, f in zip(alike.tolist(), first.tolist(), counts.tolist(), strict=True):
                known = found.get(w)
                if known is None:
                    found[w] = [names[lo + text[i]], raw[starts[i] : until[i]].lower().decode(), f]
                else:
                    known[2] += f
            for at, f in zip(*(x.tolist() for x in np.unique(text, return_counts=True)), strict=True):
                totals[names[lo + at]] = totals.get(names[lo + at], 0) + f
        if len(found) > HELD:
            yield from rows()
    yield from rows()


class Filter:
    """Bits of the hashes of groups: a group that isn't set isn't among them."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.shift = bits, _U(64 - (len(bits) * 64).bit_length() + 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.bits[(at >> _U(6)).astype(np.int64)] >> (at & _U(63)) & _U(1)).astype(bool)


def _filter(groups: DataFrame, k: int) -> Filter:
    """The filter of groups (w0, ..., f): 16 bits a group, MOST_BITS at most. Its words are what goes to the driver."""
    n = groups.count()
    log = min(max(16 * n, 1 << 12).bit_length(), MOST_BITS.bit_length() - 1)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.stack([batch.column(j).to_numpy(zero_copy_only=False).view(_U) for j in range(k)], axis=1)
            at = phrase_hashes(words) >> _U(64 - log)
            where, order = np.unique(at >> _U(6), return_inverse=True)
            out = np.zeros(len(where), _U)
            np.bitwise_or.at(out, order, _U(1) << (at & _U(63)))
            yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int64)), pa.array(out.view(np.int64))], ["at", "bits"])

    made = groups.select(*[f"w{j}" for j in range(k)]).mapInArrow(bits, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (log - 6), _U)
    out[made["at"].to_numpy()] = made["bits"].to_numpy().view(_U)
    return Filter(out)


def _left(words: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The words that stand in an occurrence of k words, and which of them end one."""
    keep = ends.copy()
    for j in range(1, k):
        keep[:-j] |= ends[j:]
    return words[keep], ends[keep]


def _relation(words: np.ndarray, ends: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The relation's rows of about ROW words, cut where no occurrence goes on."""
    if not len(words):
        return
    inside = ends.copy()
    for j in range(1, k - 1):
        inside[:-j] |= ends[j:]
    free = np.flatnonzero(~inside)
    at = np.searchsorted(free, np.arange(0, len(words), ROW))
    offsets = pa.array(np.append(np.unique(free[at[at < len(free)]]), len(words)).astype(np.int32))
    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(words.view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(ends))], ["words", "ends"])


_OCCURRENCES = "words array<long>, ends array<boolean>"


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The words and flags of a relation's rows, end to end: a row begins with an occurrence, so none goes on from the row before."""
    return batch.column(0).flatten().to_numpy().view(_U), batch.column(1).flatten().to_numpy(zero_copy_only=False)


def _pairs(docs: DataFrame, frequent: Filter) -> DataFrame:
    """The relation of two words: frequent words beside each other in a piece."""
    spread = docs.sparkSession.sparkContext.broadcast(frequent)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = spread.value
        for batch in batches:
            hashes = _lang_hashes(batch.column(0).to_pylist())
            for lo, hi, data, ends in runs(batch.column(1)):
                words, _, _, _, follows = split(data, ends, hashes[lo:hi])
                if len(words):
                    passed = known.has(phrase_hashes(words[:, None]))
                    follows[1:] &= passed[1:] & passed[:-1]
                    yield from _relation(*_left(words, follows, 2), 2)

    return docs.mapInArrow(made, _OCCURRENCES)


def _extended(relation: DataFrame, frequent: Filter, k: int) -> DataFrame:
    """The relation of k + 1 words: occurrences of frequent groups of k words that lie one place apart."""
    spread = relation.sparkSession.sparkContext.broadcast(frequent)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = spread.value
        for batch in batches:
            words, ends = _read(batch)
            at = np.flatnonzero(ends)
            left = np.zeros(len(ends), bool)
            left[at[known.has(phrase_hashes(ending(words, at, k)))]] = True
            left[1:] &= left[:-1].copy()
            left[:1] = False
            yield from _relation(*_left(words, left, k + 1), k + 1)

    return relation.mapInArrow(made, _OCCURRENCES)


def _counted(relation: DataFrame, k: int, least: int) -> DataFrame:
    """w0, ..., f of the groups of k words with `least` occurrences or more."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(k)
        for batch in batches:
            words, ends = _read(batch)
            yield from tally.add(ending(words, np.flatnonzero(ends), k))
        yield from tally.rest()

    keys = [f"w{j}" for j in range(k)]
    found = relation.mapInArrow(made, ", ".join(f"{x} long" for x in keys) + ", f long")
    return found.groupBy(*keys).agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def frequent(docs: DataFrame, least: int = FREQUENT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs (text, lang) -> the words (lang, word, w, f), the phrases (key: their words' hashes; f) of one word or more, all with `least`
    occurrences or more, and (lang, n), the number of all words."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = texts.mapInArrow(_word_counts, "lang string, word string, w long, f long").groupBy("lang", "word").agg(F.min("w").alias("w"), F.sum("f").alias("f"))
    counts = written(counts.filter((F.col("f") >= least) | F.col("word").isNull()), "phrase-words")
    words = counts.filter("word is not null")
    if words.groupBy("w").count().filter("count > 1").limit(1).count():
        raise ValueError("two frequent words share a hash")
    groups = [words.select(F.array("w").alias("key"), "f")]
    relation, now = texts, words.select(F.col("w").alias("w0"), "f")
    for k in range(2, longest + 1):
        passed = _filter(now, k - 1)
        relation = written(_pairs(relation, passed) if k == 2 else _extended(relation, passed, k - 1), f"phrase-occurrences-{k}")
        now = written(_counted(relation, k, least), f"phrase-groups-{k}")
        groups.append(now.select(F.array(*[f"w{j}" for j in range(k)]).alias("key"), "f"))
    phrases = groups[0]
    for g in groups[1:]:
        phrases = phrases.unionByName(g)
    return words, phrases, counts.filter("word is null").select("lang", F.col("f").alias("n"))


def _exact(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def scored(phrases: DataFrame) -> DataFrame:
    """key, a, l, r, score of the phrases of two words or more that no longer one stands for: the lowest score of a cut, the first of equal ones."""
    many = phrases.filter(F.size("key") > 1).withColumnRenamed("f", "a")
    size = F.size("key")
    cuts = many.select("key", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("key", F.lit(1), F.col("k")), "right": F.slice("key", F.col("k") + 1, size - F.col("k"))})
    side = lambda name, f: phrases.select(F.col("key").alias(name), F.col("f").alias(f))
    cuts = cuts.join(side("left", "l"), "left").join(side("right", "r"), "right")
    score = F.expr("cast(2000000 as decimal(38,0)) * a div (cast(l as decimal(38,0)) + r)").cast("long")
    best = cuts.groupBy("key").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b")).select("key", "a", "b.l", "b.r", "b.score")
    parts = lambda n: F.when(size > n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.slice("key", i, F.lit(n)))).otherwise(F.array().cast("array<array<bigint>>"))
    inside = many.filter(size > 2).select(F.explode(F.concat(*[parts(n) for n in range(2, LONGEST)])).alias("key"), F.col("a").alias("longer"))
    inside = inside.groupBy("key").agg(F.max("longer").alias("longer"))
    stays = F.col("longer").isNull() | (_exact(F.col("longer")) * 100 < _exact(F.col("a")) * COVERS)
    return best.join(inside, "key", "left").filter(stays).drop("longer")


def collocations(docs: DataFrame, least: int = FREQUENT, best: int = BEST) -> DataFrame:
    """docs (text, lang) -> lang, rank, phrase, a, l, r, n, score: each language's best by score, then a, then phrase."""
    words, phrases, totals = frequent(docs, least)
    found = scored(phrases)
    each = found.select("*", F.posexplode("key").alias("at", "w")).join(words.select("w", "lang", "word"), "w")
    text = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]))
    named = each.groupBy("key").agg(F.first("lang").alias("lang"), text.alias("phrase"), *[F.first(c).alias(c) for c in ("a", "l", "r", "score")])
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    top = named.withColumn("_part", F.pmod(F.xxhash64("key"), F.lit(PARTS)))
    top = top.withColumn("_place", place("lang", "_part")).filter(F.col("_place") <= best)  # PARTS * best rows a language are left
    top = top.withColumn("rank", place("lang").cast("long")).filter(F.col("rank") <= best)
    return top.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT d, lang, unnest(regexp_extract_all(text, '[^.,;:!?\\x0A-\\x0D]+')) AS piece FROM docs),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang HAVING sum(len(w)) > 0),
grams AS (SELECT lang, len(w) AS size, w, k FROM w, range(1, {LONGEST + 1}) r(k) WHERE len(w) >= k),
every AS (SELECT lang, k, unnest(list_transform(range(1, size - k + 2), lambda i: w[i : i + k - 1])) AS words FROM grams),
f AS (SELECT lang, k, words, count(*) AS f FROM every GROUP BY ALL HAVING count(*) >= {FREQUENT}),
cuts AS (SELECT lang, k, words, f AS a, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
scores AS (
  SELECT c.lang, c.words, c.a, c.cut, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a) // (l.f::HUGEINT + r.f) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.words = c.words[1 : c.cut] JOIN f r ON r.lang = c.lang AND r.words = c.words[c.cut + 1 : c.k]),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, cut) = 1),
parts AS (SELECT lang, f AS longer, k, words, unnest(range(2, k)) AS n FROM f WHERE k > 2),
inside AS (SELECT lang, words, max(longer) AS longer FROM (SELECT lang, longer, unnest(list_transform(range(1, k - n + 2), lambda i: words[i : i + n - 1])) AS words FROM parts) GROUP BY ALL),
kept AS (SELECT s.* FROM lowest s LEFT JOIN inside i ON i.lang = s.lang AND i.words = s.words WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < {COVERS}::HUGEINT * s.a),
ranked AS (SELECT lang, array_to_string(words, ' ') AS phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(words, ' ')) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {BEST}
"""
