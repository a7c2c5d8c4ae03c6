"""Exact n-gram Jaccard self-join by universe partition and the pigeonhole principle.

A document is its set of distinct k-word shingles (64-bit hashes). Documents with equal sets form a class; classes are
joined, copies never are. Sizes fall into bands, so that a set links only within its band or with the next. In a band,
two linked sets differ in at most H tokens; tokens are dealt by hash into H + 1 segments and some spare ones, so

* two linked sets agree on the subset of at least one segment (index of segment subsets), and
* for any allocation v of 0, 1 or 2 to the segments that sums to H + 1 or more, some segment with v = 1 agrees or some with
  v = 2 differs by at most one token (one-deletion neighbourhoods).

First every class is indexed with v = 1 throughout. Subsets of at most COLD classes give their pairs. A subset held by
more classes (a passage that many documents share, a large group of near copies) is hot. Classes with no more hot
subsets than spare segments do without them. For all others the allocation is chosen by cost: hot subsets get v = 0, the
cheapest others v = 2, which are probed by their one-deletion neighbourhoods. They are also compared with the best
connected class of each hot subset, its hub. Classes that can't do without hot subsets, or whose probes are hot again,
are compared by sketch in blocks with the others of their hub, but only where they aren't yet connected. No pair is lost
and no candidate is dropped by a cap.

Candidates are held against a sketch of token counts (its L1 distance never exceeds that of the sets), and those left
are verified on the full sets. Components come from linked pairs alone.

Defined cases: null or empty texts and texts without words have an empty set, link with nothing and are their own
component; repeated rows and equal texts are one class; rows with a null doc_id take part, but don't name a component.
Equal 64-bit class hashes of sets of one size are taken as equal sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm._hashing import mix, runs, shingle_sets, word_hashes
from factloom.llm._shared import small_batches, written
from factloom.llm.components import components

#: Subsets held by at most so many classes give all their pairs.
COLD = 16
#: Cells of the sketch.
CELLS = 128
#: Members of a block where what is left of a hot subset is compared.
BLOCK = 256
#: Tokens, 8 bytes each, that a task of the verification holds, or twice as many.
GROUP_TOKENS = 1 << 20
#: Ids of documents, 8 bytes each, that are broadcast at most.
BROADCAST_IDS = 250_000
_U = np.uint64


def band_starts(percent: int, most: int = 1 << 40) -> np.ndarray:
    """The least size of each band: a set of size r links with sizes up to 100 r / percent only."""
    out = [1]
    while out[-1] < most:
        out.append(out[-1] * 100 // percent + 1)
    return np.array(out)


def band_distance(starts: np.ndarray, band: np.ndarray, percent: int) -> np.ndarray:
    """The largest symmetric difference of two linked sets whose smaller one is in this band."""
    return (100 - percent) * (starts[band + 1] - 1) // percent


def spare(distance: np.ndarray) -> np.ndarray:
    """Segments beyond distance + 1: two linked sets agree on so many more, so as many hot ones can be done without."""
    return np.where(distance > 0, 1 + distance // 8, 0)


def _counts(starts: np.ndarray, band: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each band the number of segments and of spare ones. Where linked sets are equal, there are none: they are one class."""
    distance = np.where(band >= 0, band_distance(starts, np.maximum(band, 0), percent), 0)
    return np.where(distance > 0, distance + 1 + spare(distance), 0), spare(distance)


def _segments(tokens: np.ndarray, owner: np.ndarray, band: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: its segment's place in the concatenated segments of all owners, and its share of the subset's hash.

    owner: of each token; band, m: of each owner. Also gives each segment's salt."""
    base = np.concatenate(([0], np.cumsum(m)))
    seed = mix(band.astype(_U) + _U(0x5851F42D4C957F2D))
    x = mix(tokens ^ seed[owner])
    place = base[owner] + ((x >> _U(33)) * m[owner].astype(_U) >> _U(31)).astype(np.int64)
    share = mix(x + _U(0x14057B7EF767814F))
    number = np.arange(base[-1]) - np.repeat(base[:-1], m)
    salt = mix(np.repeat(seed, m) + number.astype(_U) * _U(0xD1342543DE82EF95))
    return place, share, salt


def _subset_hashes(place: np.ndarray, share: np.ndarray, salt: np.ndarray) -> np.ndarray:
    total = np.zeros(len(salt), _U)
    np.add.at(total, place, share)
    return mix(total + salt)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.LargeListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))), pa.array(values)).cast(pa.list_(pa.int64()))


def _sets(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    with np.errstate(over="ignore"):
        for lo, hi, data, ends in runs(texts):
            tokens, sizes = shingle_sets(*word_hashes(data, ends), k)
            yield lo, hi, tokens, sizes


def _class_ids(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """An even 64-bit hash of each set."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    total = np.zeros(len(sizes), _U)
    np.add.at(total, owner, mix(tokens + _U(0xA0761D6478BD642F)))
    return (mix(total + sizes.astype(_U)) & ~_U(1)).view(np.int64)


def signatures(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, cls (hash of the set), n (its size), spare_own and spare_prev (in its band and the one before), sketch."""
    starts = band_starts(percent)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in it:
            for lo, hi, tokens, sizes in _sets(rows.column("text"), k):
                with np.errstate(over="ignore"):
                    owner = np.repeat(np.arange(hi - lo), sizes)
                    band = np.searchsorted(starts, sizes, side="right") - 1
                    cell = owner * CELLS + (mix(tokens + _U(0xE7037ED1A0B428DB)) >> _U(57)).astype(np.int64)
                    counts = np.minimum(np.bincount(cell, minlength=(hi - lo) * CELLS), 65535).astype("<u2").tobytes()
                    width = 2 * CELLS
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": rows.column("doc_id").slice(lo, hi - lo),
                        "cls": pa.array(_class_ids(tokens, sizes)),
                        "n": pa.array(sizes),
                        "spare_own": pa.array(_counts(starts, band, percent)[1]),
                        "spare_prev": pa.array(_counts(starts, band - 1, percent)[1]),
                        "sketch": pa.array([counts[i * width : (i + 1) * width] for i in range(hi - lo)], pa.binary()),
                    })

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(batches, "doc_id long, cls long, n long, spare_own long, spare_prev long, sketch binary")


def _entries(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(sig, member): a row for each subset; member is the class, its last bit set in the scheme of the band before.

    A class repeated within a task gives its rows once: copies are merged before the shuffle."""
    starts = band_starts(percent)

    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for rows in it:
            for _, _, tokens, sizes in _sets(rows.column("text"), k):
                with np.errstate(over="ignore"):
                    cls = _class_ids(tokens, sizes)
                    fresh = np.zeros(len(cls), bool)
                    for i, c in enumerate(cls.tolist()):
                        if c not in seen and sizes[i]:
                            seen.add(c)
                            fresh[i] = True
                    owner = np.repeat(np.arange(len(sizes)), sizes)
                    band = np.searchsorted(starts, sizes, side="right") - 1
                    for b, flag in ((band, 0), (band - 1, 1)):
                        m = _counts(starts, b, percent)[0]
                        m[~fresh] = 0
                        use = (m > 0)[owner]
                        place, share, salt = _segments(tokens[use], owner[use], b, m)
                        sig = _subset_hashes(place, share, salt).view(np.int64)
                        yield pa.RecordBatch.from_pydict({"sig": pa.array(sig), "member": pa.array(np.repeat(cls | flag, m))})
            if len(seen) > 200_000:  # bounds memory; later copies are merged after the shuffle
                seen.clear()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(emit, "sig long, member long")


def _classes(table: DataFrame) -> DataFrame:
    """A row for each set that isn't empty: cls, n, spare_own, spare_prev, sketch, and first, the smallest doc_id that has it."""
    same = [F.first(c).alias(c) for c in ("n", "spare_own", "spare_prev", "sketch")]
    return table.filter("n > 0").groupBy("cls").agg(*same, F.min("doc_id").alias("first"))


def _hot_members(found: DataFrame, classes: DataFrame) -> DataFrame:
    """(sig, member) of the hot subsets, of members that have more of them than spare segments: others are found without."""
    hot = found.filter("b is null").select("sig", F.col("a").alias("member"))
    many = hot.groupBy("member").agg(F.count("*").alias("k")).withColumn("cls", F.col("member").bitwiseAND(F.lit(-2)))
    kept = many.join(classes.select("cls", "spare_own", "spare_prev"), "cls").filter("k > if(member & 1 = 0, spare_own, spare_prev)").select("member")
    return hot.join(kept, "member", "left_semi")


def _bucketed(entries: DataFrame) -> DataFrame:
    """(sig, a, b): candidate pairs of cold subsets, and for hot subsets a row for each member with b null.

    Streams over entries sorted by subset; holds COLD + 1 members at most."""

    def stream(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, hot = None, [], False
        for rows in it:
            sig, member = rows.column("sig").to_numpy(), rows.column("member").to_numpy()
            n = len(sig)
            if not n:
                continue
            same = sig[1:] == sig[:-1]
            alone = ~(np.append(False, same) | np.append(same, False))
            alone[0] &= sig[0] != key
            alone[-1] = False  # may go on in the next batch
            out_s, out_a, out_b = [], [], []

            def close() -> None:
                if len(held) > 1 and not hot:
                    for i, x in enumerate(held):
                        for y in held[:i]:
                            if x >> 1 != y >> 1 and not x & y & 1:
                                out_s.append(key)
                                out_a.append(min(x >> 1, y >> 1) << 1)
                                out_b.append(max(x >> 1, y >> 1) << 1)

            for i in np.flatnonzero(~alone).tolist():
                s, m = int(sig[i]), int(member[i])
                if s != key:
                    close()
                    key, held, hot = s, [m], False
                elif m != held[-1]:
                    held.append(m)
                    if not hot and len(held) > COLD:
                        hot = True
                        out_s += [s] * len(held)
                        out_a += held
                        out_b += [None] * len(held)
                        held = [m]
                    elif hot:
                        out_s.append(s)
                        out_a.append(m)
                        out_b.append(None)
                        held = [m]
            yield pa.RecordBatch.from_pydict({"sig": pa.array(out_s, pa.int64()), "a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})
        if len(held) > 1 and not hot:
            found = [(min(x >> 1, y >> 1) << 1, max(x >> 1, y >> 1) << 1) for i, x in enumerate(held) for y in held[:i] if x >> 1 != y >> 1 and not x & y & 1]
            yield pa.RecordBatch.from_pydict({"sig": pa.array([key] * len(found), pa.int64()), "a": pa.array([p[0] for p in found], pa.int64()), "b": pa.array([p[1] for p in found], pa.int64())})

    return entries.repartition("sig").sortWithinPartitions("sig", "member").mapInArrow(stream, "sig long, a long, b long")


def _near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches allow a link."""
    side = lambda x: classes.select(F.col("cls").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))

    def test(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in it:
            na, nb = rows.column("na").to_numpy(), rows.column("nb").to_numpy()
            ok = percent * np.maximum(na, nb) <= 100 * np.minimum(na, nb)
            rows, na, nb = rows.filter(pa.array(ok)), na[ok], nb[ok]
            if not len(na):
                continue
            a, b = (np.frombuffer(b"".join(rows.column(c).to_pylist()), "<u2").reshape(-1, CELLS).astype(np.int32) for c in ("sa", "sb"))
            apart = np.abs(a - b).sum(axis=1)
            near = pa.array(apart * (100 + percent) <= (100 - percent) * (na + nb))
            yield rows.select(["a", "b"]).filter(near)

    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")
    return joined.mapInArrow(test, "a long, b long")


def _sets_of(asked: DataFrame, classes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(cls, tokens) of the classes asked for, from the text of one row of each."""
    one = classes.filter("first is not null").select("cls", F.col("first").alias("doc_id")).join(asked, "cls", "left_semi")
    one = written(one, "representatives")
    wanted = one.select("doc_id").distinct()
    # a checked size: few ids are broadcast, and no text is shuffled; many meet the texts in a shuffle
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).join(F.broadcast(wanted) if one.count() <= BROADCAST_IDS else wanted, "doc_id", "left_semi")

    def sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in it:
            for _, _, tokens, sizes in _sets(rows.column("text"), k):
                with np.errstate(over="ignore"):
                    yield pa.RecordBatch.from_pydict({"cls": pa.array(_class_ids(tokens, sizes)), "tokens": _lists(tokens.view(np.int64), sizes)})

    # a doc_id that several rows bear gives several sets; those asked for are kept, once each
    out = texts.mapInArrow(sets, "cls long, tokens array<long>").join(one.select("cls"), "cls", "left_semi")
    return out.dropDuplicates(["cls"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets link.

    A set is sent once to where its candidates meet, not once for each pair: candidates that hang together form a group,
    small groups share tasks, and one of more than GROUP_TOKENS tokens is dealt into blocks, whose pairs are tasks."""
    nodes = components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    weighed = written(nodes.join(sets.select(F.col("cls").alias("node"), F.size("tokens").alias("n")), "node"), "weighed")
    total = weighed.agg(F.sum("n").alias("n")).first()["n"] or 0
    tasks = max(1, -(-total // GROUP_TOKENS))
    large = written(weighed.groupBy("component").agg(F.ceil(F.sum("n") / GROUP_TOKENS).alias("blocks")).filter("blocks > 1"), "large")
    placed = weighed.join(large, "component", "left").select(
        "node",
        F.when(F.col("blocks") > 1, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(tasks))).alias("group"),
        F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("node"), "blocks")).otherwise(F.lit(-1).cast("long")).alias("block"),
    )
    side = lambda x: placed.select(F.col("node").alias(x), F.col("group"), F.col("block").alias(f"block_{x}"))
    keyed = written(pairs.join(side("a"), "a").join(side("b").drop("group"), "b").select("group", F.least("block_a", "block_b").alias("i"), F.greatest("block_a", "block_b").alias("j"), "a", "b"), "keyed")
    there = [F.col(x).alias(f"{x}_") for x in ("group", "i", "j")]
    sent = keyed.select(*there, F.explode(F.array("a", "b")).alias("cls")).distinct().join(sets, "cls")

    def test(asked: pa.Table, known: pa.Table) -> pa.Table:
        tokens = known.column("tokens").combine_chunks()
        flat, at = tokens.flatten().to_numpy(), tokens.offsets.to_numpy() - (tokens.offsets[0].as_py() if len(tokens) else 0)
        place = {c: i for i, c in enumerate(known.column("cls").to_pylist())}
        ok = []
        for a, b in zip(asked.column("a").to_pylist(), asked.column("b").to_pylist(), strict=True):
            x, y = (flat[at[place[c]] : at[place[c] + 1]] for c in (a, b))
            common = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(100 * common >= percent * (len(x) + len(y) - common))
        return asked.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return keyed.groupBy("group", "i", "j").cogroup(sent.groupBy("group_", "i_", "j_")).applyInArrow(test, "a long, b long")


def _neighbourhoods(hot: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(key, member, role) of the classes with hot subsets: role 1 index, subset; 2 index, one token out; 4 and 8 the same as probes.

    hot: (sig, member). The probes follow the allocation of least cost; a member that can't do without its hot subsets
    has no probe and one row of role 16."""
    starts = band_starts(percent)
    by = hot.groupBy("member").agg(F.collect_list("sig").alias("hot")).withColumn("cls", F.col("member").bitwiseAND(F.lit(-2)))

    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in it:
            for member, hot_sigs, own in zip(rows.column("member").to_pylist(), rows.column("hot"), rows.column("tokens"), strict=True):
                tokens, marked = (x.values.to_numpy().view(_U) for x in (own, hot_sigs))
                band = np.searchsorted(starts, len(tokens), side="right") - 1 - (member & 1)
                with np.errstate(over="ignore"):
                    m, spares = _counts(starts, np.array([band]), percent)
                    place, share, salt = _segments(tokens, np.zeros(len(tokens), np.int64), np.array([band]), m)
                    total = np.zeros(len(salt), _U)
                    np.add.at(total, place, share)
                    whole = mix(total + salt)
                    less = mix(total[place] - share + salt[place])
                is_hot = np.isin(whole, marked)
                size = np.bincount(place, minlength=len(salt))
                short = max(0, int(is_hot.sum()) - int(spares[0]))  # what hot segments, with v = 0, lack is made up by as many with v = 2
                cost = np.where(size <= 2, 1 << 40, size)
                cost[is_hot] = 1 << 50
                order = np.argsort(cost, kind="stable")
                keys, roles = [whole, less], [np.full(len(whole), 1), np.full(len(less), 2)]
                if short <= int((~is_hot).sum()):
                    two = np.zeros(len(salt), bool)
                    two[order[:short]] = True
                    keys += [whole[two], less[two[place]]]
                    roles += [np.full(int(two.sum()), 4), np.full(int(two[place].sum()), 8)]
                else:
                    keys.append(np.zeros(1, _U))
                    roles.append(np.full(1, 16))
                key = np.concatenate(keys).view(np.int64)
                yield pa.RecordBatch.from_pydict({"key": pa.array(key), "member": pa.array(np.full(len(key), member)), "role": pa.array(np.concatenate(roles).astype(np.int32))})

    return by.join(sets, "cls").select("member", "hot", "tokens").mapInArrow(emit, "key long, member long, role int")


def _escapes(hot: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs found by the neighbourhoods; and the members whose probes don't find all, for the hot subsets."""
    rows = written(_neighbourhoods(hot, sets, percent), "neighbourhoods")
    merged = rows.filter("role < 16").groupBy("key", "member").agg(F.expr("bit_or(role)").alias("role"))
    probed = merged.groupBy("key").agg(F.sum((F.col("role") >= 4).cast("int")).alias("probes"), F.count("*").alias("n"))
    sized = written(merged.join(probed.filter("probes > 0 and n > 1"), "key"), "probes")
    cool = sized.filter(f"n <= {4 * COLD}")
    left, right = cool.filter("role >= 4").select("key", F.col("member").alias("x"), F.col("role").alias("rx")), cool.select("key", F.col("member").alias("y"), F.col("role").alias("ry"))
    meet = "x <> y and ((rx & 4 <> 0 and ry & 2 <> 0) or (rx & 8 <> 0 and ry & 1 <> 0)) and (x & y & 1) = 0"
    pairs = left.join(right, "key").filter(meet).select(*_ordered("x", "y")).filter("a <> b")
    stuck = rows.filter("role = 16").select("member").union(sized.filter(f"n > {4 * COLD} and role >= 4").select("member")).distinct()
    return pairs, stuck


def _ordered(x: str, y: str) -> list:
    even = lambda c: F.col(c).bitwiseAND(F.lit(-2))
    return [F.least(even(x), even(y)).alias("a"), F.greatest(even(x), even(y)).alias("b")]


def _hubs(hot: DataFrame) -> DataFrame:
    """(sig, hub): of each hot subset the member with the most hot subsets; the original of a group of near copies has them all."""
    mass = hot.groupBy("member").agg(F.count("*").alias("mass"))
    return hot.join(mass, "member").groupBy("sig").agg(F.max(F.struct("mass", "member")).alias("top")).select("sig", F.col("top.member").alias("hub"))


def _with_hubs(hot: DataFrame, hubs: DataFrame) -> DataFrame:
    return hot.join(hubs, "sig").select(*_ordered("member", "hub")).filter("a <> b")


def _rest(hot: DataFrame, hubs: DataFrame, stuck: DataFrame, nodes: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of stuck members of one hot subset that are not yet connected and whose sketches allow a link.

    Subsets with one hub share most members, so members meet by hub. They are dealt into blocks of about BLOCK, and each
    pair of blocks is compared in a task of its own; nothing larger than two blocks is held."""
    met = hot.join(stuck, "member", "left_semi").join(hubs, "sig").select("hub", "member").distinct()
    met = met.withColumn("cls", F.col("member").bitwiseAND(F.lit(-2)))
    known = met.join(nodes.withColumnRenamed("node", "cls"), "cls", "left").withColumn("c", F.coalesce("component", "cls")).select("hub", "member", "cls", "c")
    known = written(known, "known")
    size = known.groupBy("hub").agg(F.count("*").alias("n_members"), F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high")
    size = written(size, "sizes")  # so that members of a large hub aren't held together by the sum
    rows = known.join(size, "hub").join(classes.select("cls", "n", "sketch"), "cls").withColumn("blocks", F.ceil(F.col("n_members") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("member"), "blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = rows.select("hub", "member", "c", "n", "sketch", "block", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")

    def compare(group: pa.Table) -> pa.Table:
        member, c, n, block = (group.column(x).to_numpy() for x in ("member", "c", "n", "block"))
        cells = np.frombuffer(b"".join(group.column("sketch").to_pylist()), "<u2").reshape(-1, CELLS).astype(np.int32)
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        right = np.flatnonzero(block == j)
        left, right_member = [], []
        for x in np.flatnonzero(block == i).tolist():
            y = right[(c[right] != c[x]) & ((member[right] & member[x] & 1) == 0)]
            if i == j:
                y = y[y > x]
            y = y[percent * np.maximum(n[y], n[x]) <= 100 * np.minimum(n[y], n[x])]
            y = y[np.abs(cells[y] - cells[x]).sum(axis=1) * (100 + percent) <= (100 - percent) * (n[y] + n[x])]
            left += [member[x]] * len(y)
            right_member += member[y].tolist()
        return pa.table({"x": pa.array(left, pa.int64()), "y": pa.array(right_member, pa.int64())})

    near = dealt.groupBy("hub", "i", "j").applyInArrow(compare, "x long, y long")
    return near.select(*_ordered("x", "y")).filter("a <> b").distinct()


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id; a row for each row of docs.

    k: words of a shingle; two documents link when 100 * common >= percent * union."""
    small_batches(docs.sparkSession)
    table = written(signatures(docs, k, percent), "signatures")
    classes = written(_classes(table), "classes")
    found = written(_bucketed(_entries(docs, k, percent)), "buckets")
    hot = written(_hot_members(found, classes), "hot")
    hubs = written(_hubs(hot), "hubs")
    pairs = written(_near(found.filter("b is not null").select("a", "b").union(_with_hubs(hot, hubs)).distinct(), classes, percent), "pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("cls")).union(hot.select(F.col("member").bitwiseAND(F.lit(-2)))).distinct()
    sets = written(_sets_of(asked, classes, docs, k), "sets")
    links = written(_verified(pairs, sets, percent), "links")
    if not hot.isEmpty():
        more, stuck = _escapes(hot, sets, percent)
        more = _near(more.distinct().join(pairs, ["a", "b"], "left_anti"), classes, percent)
        links = written(links.union(_verified(more, sets, percent)), "links")
        nodes = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
        rest = written(_rest(hot, hubs, written(stuck, "stuck"), nodes, classes, percent), "rest")
        links = links.union(written(_verified(rest, sets, percent), "links"))
    nodes = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = classes.select("cls", "first").join(nodes.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    label = written(named.join(least, "component").select("cls", "component_id"), "labels")
    out = table.select("doc_id", "n", "cls").join(label, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without near copies: of each component the row with the smallest doc_id stays, with all its columns.

    Documents without words and rows with a null doc_id stay; of rows that share a kept doc_id, one stays."""
    named = jaccard_components(docs, k, percent)
    kept = written(named.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("_rows")), "kept")
    out = docs.join(kept.filter("_rows = 1").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    out = out.unionByName(docs.filter("doc_id is null"))
    again = kept.filter("_rows > 1").select("doc_id")
    return out if again.isEmpty() else out.unionByName(docs.join(again, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"]))
