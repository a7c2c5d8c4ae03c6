"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import dataclasses
import hashlib
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from factloom.llm import ann, extract, packing, pii, quality, secrets, sharding, simjoin, unigram, warc

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LONG = "a long text of many words, " * 3000
TEXTS = [None, "", " \n\t ", "word", "two words", LONG, "x" * 20000, "the same text again and again", "the same text again and again", "émigré 日本語 😀 text", "a  b   c \n d ", "a <|endoftext|> b"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kind string, start long, kept boolean, cls long, shard int, spans string"


def docs(spark, rows=None):
    """The texts with ids from 0, one row twice, one without id; columns that clash with results' names."""
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "word"), (None, "no id here")] if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", 7, False, 1, 2, "z") for i, t in rows], DOCS)


def test_sharding(spark):
    got = sharding.digest(docs(spark)).collect()
    assert len(got) == len(TEXTS) + 2
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(by.get(s, [])) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    texts = {i: t for i, t in enumerate(TEXTS)}
    assert all(r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) and r["size"] == len((texts[r["doc_id"]] or "").encode()) + 1 for r in got if r["doc_id"] is not None)
    assert sharding.digest(docs(spark, [])).collect() == []


def test_sharding_moves_little_when_a_shard_is_added():
    counts = {c: 1 for c in range(0, sharding.CELLS, 7)}
    n = sum(counts.values())

    def places(shards):
        out = {}
        for cell, first, until, shard, _ in sharding.shares(counts, sharding.capacities(n, shards, 0.1), sharding.ring(shards)):
            out |= {(cell, r): shard for r in range(first, until)}
        return out

    a, b = places(16), places(17)
    assert len(a) == len(b) == n
    assert max(np.bincount(list(b.values()))) <= 1.1 * n / 17 + 2
    assert sum(a[k] != b[k] for k in a) < 0.3 * n


def test_sharding_repeated_rows_share_no_slot(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 3)
    got = sharding.digest(docs(spark, [(1, "same")] * 100)).collect()
    assert len({(r["shard"], r["slot"]) for r in got}) == 100


def brute_secrets(text):
    found = []
    for k, (kind, p) in enumerate({"assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}.items()):
        for m in re.finditer(p, text):
            if (kind == "assign" and len(m[2]) >= 6) or (kind == "access" and len(m[0]) >= 20) or (kind == "hex" and len(m[0]) >= 24):
                found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(found))


SECRETS = ["Token= 'abcdef' x", "é😀 API_KEY:\"a.b.c.d\" PassWD=short", "AKIA" + "A" * 16 + " AKIAAKIA123", "f" * 24 + "g" + "0" * 23, "token=password=secret123", " token=abcdefgh  " + "a1" * 20]


def test_secrets(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS + SECRETS)] + [(99, SECRETS[0])]
    got = {r["doc_id"]: r for r in secrets.digest(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = brute_secrets(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), t
        assert got[i]["n_hex"] == want.count("hex:")
    assert secrets.digest(docs(spark, [])).collect() == []


def test_ledger_scans_only_what_is_new(spark, tmp_path, monkeypatch):
    scanned, seen = secrets.scanned, []

    def watched(blobs, rules):
        seen.append(sorted(len(r["todo"]) for r in blobs.collect()))
        return scanned(blobs, rules)

    monkeypatch.setattr(secrets, "scanned", watched)
    ledger = f"file://{tmp_path}/ledger"
    first, more = [(1, SECRETS[0]), (2, SECRETS[0]), (3, SECRETS[3])], [(1, SECRETS[0]), (4, SECRETS[2]), (5, SECRETS[4])]
    every = len(secrets.RULES)
    rows = lambda df: {r["doc_id"]: r for r in df.collect()}
    alone = rows(secrets.digest(docs(spark, first + more[1:])))
    seen.clear()
    got = rows(secrets.digest(docs(spark, first), ledger=ledger))
    assert seen == [[every] * 2] and got == {i: alone[i] for i, _ in first}
    got = rows(secrets.digest(docs(spark, more), ledger=ledger))  # an old text's findings are still told
    assert seen[1:] == [[every] * 2] and got == {i: alone[i] for i, _ in more}
    assert rows(secrets.digest(docs(spark, first + more[1:]), ledger=ledger)) == alone
    assert seen[2:] == [[]]
    newer = tuple(dataclasses.replace(r, version=r.version + (r.kind == "hex")) for r in secrets.RULES)
    assert rows(secrets.digest(docs(spark, first), newer, ledger)) == {i: alone[i] for i, _ in first}
    assert seen[3:] == [[1, 1]]
    # a scan that was broken off before its pairs were written is done again, and its findings don't count
    spark.createDataFrame([("b", "hex", 1, 0, 9)], "blob string, kind string, version int, start long, end long").write.parquet(f"{ledger}/findings/run=broken")
    assert secrets.findings(spark, ledger).filter("blob = 'b'").count() == 0


PII = ["a@b.co x.y+z@sub.mail.org @no a@b", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8", "4539 1488 0343 6467 and 4539148803436468", "+1 (555) 123-4567 +12", "0" * 5000 + ".1.1.1"]


def test_pii(spark):
    rows = list(enumerate(TEXTS + PII))
    got = {r["doc_id"]: r for r in pii.digest(docs(spark, rows)).collect()}
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(len(x.lstrip("0")) < 4 and int(x[-3:]) <= 255 for x in m.split("."))), ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub(r"\D", "", m)) <= 19 and pii._luhn(re.sub(r"\D", "", m))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub(r"\D", "", m)) <= 15)]
    for i, t in rows:
        want = [f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, t or "") if ok(m[0])]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert all(got[i][f"n_{k}"] == sum(w.startswith(k) for w in want) for k, *_ in kinds)
    assert pii.digest(docs(spark, [])).collect() == []


def test_addresses_as_the_pattern_finds_them():
    rng = np.random.default_rng(9)
    pattern = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for i in range(3000):
        text = "".join(rng.choice([*"0123..... x", "255", "256", "0007", "1.2.3.4"], 30))
        want = [("ip", m.start(), m.end()) for m in pattern.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
        assert list(pii._ips(text, 0)) == want, text


def test_a_million_digits_take_one_walk():
    for text in ("7" * 1_000_000, "1.1." * 250_000 + "x", "1 1-" * 250_000, "+1 " * 300_000, "one two " * 100_000):
        began = time.process_time()
        pii.find(text)
        assert time.process_time() - began < 20, text[:8]


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("é write to joe [at] mail [dot] example [dot] com now", "email", "joe [at] mail [dot] example [dot] com"),
        ("joe.b at mail dot example dot com", "email", "joe.b at mail dot example dot com"),
        ("jоe@example.cоm", "email", "jоe@example.cоm"),
        ("at +1 five five five one two three four five six seven.", "phone", "+1 five five five one two three four five six seven"),
        ("host １９２.１６８.0.1", "ip", "１９２.１６８.0.1"),
        ("a​@ex​ample.org", "email", "a​@ex​ample.org"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, part):
    _, more = pii.find(text)
    assert [(k, text[s:e]) for k, s, e in more] == [(kind, part)]


def test_plain_prose_has_no_disguise():
    for text in ("He looked at the dot on the map. At one or two, at three.", "meet at noon at the cafe, row 1 dot", LONG):
        assert pii.find(text) == ([], [])


def test_masking_keeps_columns(spark):
    got = pii.masked(docs(spark, [(1, "a@b.co is é"), (2, None)])).collect()
    assert got[0]["text"] == "<EMAIL> is é" and got[0]["n_chars"] == 12 and got[0]["kind"] == "k" and got[1]["text"] is None


def test_packing(spark):
    got = packing.digest(packing.pack(docs(spark).repartition(2), BPE)).collect()
    t = Tokenizer.from_file(BPE)
    want = sorted((i if i is not None else -1, len(t.encode(x or "", add_special_tokens=False).ids) + 1) for i, x in [*enumerate(TEXTS), (3, "word"), (None, "no id here")])
    starts = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["doc_tokens"]) for r in got if r["start"] == 0)
    assert starts == want
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for i, x in enumerate(TEXTS)}
    assert all(zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in got if r["doc_id"] is not None)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["tier"]))
    for pieces in by.values():
        at = 0
        for offset, length, tier in sorted(pieces):
            assert offset == at
            at += length
        assert at == tier <= 1024 and at & (at - 1) == 0
    assert sum(r["length"] for r in got) == sum(n for _, n in want)
    assert packing.pack(docs(spark, []), BPE).collect() == []


def test_packing_of_random_lengths_covers_each_token_once():
    rng = np.random.default_rng(3)
    for tiers in ((1024, 512, 256, 128), (64, 32)):
        pool, seen = packing._Pool(), {}
        lengths = rng.integers(1, 3 * tiers[0], 200).tolist()
        for lo in range(0, 200, 50):
            rows = list(range(lo, lo + 50))
            for window, pieces in packing.plan(lengths[lo : lo + 50], pool, rows, tiers, lo == 150):
                assert sum(n for _, _, n in pieces) == window
                for r, s, n in pieces:
                    seen.setdefault(r, []).append((s, n))
        for r, n in enumerate(lengths):
            at = 0
            for s, m in sorted(seen[r]):
                assert s == at
                at += m
            assert at == n


def test_both_ways_of_encoding_give_the_tokenizers_ids():
    plain, e = Tokenizer.from_file(BPE), packing.Encoder(BPE)
    assert e.fast is not None
    texts = ["a b", " a", "a  b", "a   b ", "x \n y", "don't  stop\n\n now ", "I'LL we'll 'tis 12'345", "é 日本 <|endoftext|> 😀", " ", "  ", "\n a", "", "a <|endoftext|> b", "<|endoftext|>", "a\u00a0 \u3000 b", "a\u2003 b", "x\x85 \x1c y"]
    rng = np.random.default_rng(5)
    alphabet = [*"abcXYZ019 '.,-#%", "\n", "\t", "é", "ß", "Ж", "щ", "Ω", "ё", "²", "½", "×", "ª", "ҁ", "ʰ", "中", "\u00ad", "ǅ", "\x0b", "ͅ", "Ԧ"]
    texts += ["".join(rng.choice(alphabet[: 36 * (i % 2) or 22], 40)) for i in range(3000)]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in e.encode(pa.array(texts))] == want
    assert [x.tolist() for x in e.encode(pa.array([None, "a"]))] == [[], plain.encode("a").ids]
    common = pc.match_substring_regex(pa.array(texts), packing._COMMON).to_pylist()
    assert 100 < sum(common) < len(texts)


def brute_join(rows, k, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w)} if 0 < len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    label = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return {i: (len(sets[i]), label[i]) for i in sets}


def near_copies(seed, n, words, changes):
    """Groups of texts around a few bases, some of them with shared passages."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [rng.choice(vocabulary, words).tolist() for _ in range(3)]
    passage = rng.choice(vocabulary, words // 2).tolist()
    rows = []
    for i in range(n):
        text = list(bases[i % 3])
        for at in rng.integers(0, words, rng.integers(0, changes)):
            text[at] = str(rng.choice(vocabulary))
        if i % 5 == 0:
            text = passage + rng.choice(vocabulary, words // 2).tolist()
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize(("k", "percent", "small"), [(3, 90, False), (5, 80, True)])
def test_join_against_brute_force(spark, k, percent, small, monkeypatch):
    monkeypatch.setattr(simjoin, "COLD", 2 if small else 4)  # so that the small groups are hot
    monkeypatch.setattr(simjoin, "BLOCK", 8)
    if small:  # groups of candidates in blocks, representatives' ids shuffled
        monkeypatch.setattr(simjoin, "GROUP_TOKENS", 200)
        monkeypatch.setattr(simjoin, "BROADCAST_IDS", 0)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, t) for i, t in near_copies(1, 120, 60, 6)] + [(300 + i, t) for i, t in near_copies(2, 60, 14, 3)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in simjoin.jaccard_components(docs(spark, rows), k, percent).collect()}
    assert got == brute_join(rows, k, percent)


def test_join_of_no_and_repeated_rows(spark):
    assert simjoin.jaccard_components(docs(spark, []), 3, 90).collect() == []
    got = simjoin.jaccard_components(docs(spark), 3, 90).collect()
    assert len(got) == len(TEXTS) + 2
    assert {r["component_id"] for r in got if r["doc_id"] in (7, 8)} == {7}
    kept = simjoin.one_of_each(docs(spark), 3, 90).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == [(False, i) for i in range(len(TEXTS)) if i != 8] + [(True, 0)]
    assert kept[0].asDict().keys() == {f.split()[0] for f in DOCS.split(", ")}


def brute_quality(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows, covered = {}, set()
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    for at in windows.values():
        if len(at) > 1:
            covered |= {i + j for i in at for j in range(8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, monkeypatch):
    monkeypatch.setattr(quality, "BUCKETS", 64)  # as many pseudo-counts: a small corpus tells little
    rng = np.random.default_rng(5)
    clean = [" ".join(rng.choice(["alpha", "beta", "gamma,", "delta.", "epsilon"], 60)) for _ in range(40)]
    junk = [" ".join(f"{x}$$$%%%" for x in rng.choice(["alpha", "beta"], 60)) for _ in range(6)]
    more = ["l1 a b c d e f g h\nl1 a b c d e f g h\n\n \n" * 2, "z " * 19, "one two three four five six seven eight " * 2 + "nine " * 3 + " ".join(map(str, range(30))), "a|b <c> #*$"]
    rows = list(enumerate(TEXTS + clean + junk + more))
    labels = spark.createDataFrame([(i, int(i < len(TEXTS) + 40), 0) for i in range(len(TEXTS), len(TEXTS) + 46)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.judged(docs(spark, rows), labels).collect()}
    for i, t in rows:
        r = got[i]
        n, chars, symbols, lines, repeated = brute_quality(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeated), t
        assert r["base_failed"] == (n < 20 or 100 * repeated > 30 * n)
        assert not (r["base_failed"] and r["kept"])
    at = len(TEXTS)
    assert all(got[i]["kept"] or got[i]["base_failed"] for i in range(at, at + 40))
    assert not any(got[i]["kept"] for i in range(at + 40, at + 46))
    assert quality.judged(docs(spark, []), labels).collect() == []
    unlabelled = quality.judged(docs(spark, rows), labels.filter("false")).collect()
    assert all(r["kept"] != r["base_failed"] for r in unlabelled)


def test_search(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 8)).astype("float32")
    x[100:200] = x[0]  # a hot vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0, None] + [0.0] * 6), (904, [1.0]), (905, [float("inf")] + [0.0] * 7)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(vectors, vectors.filter("vec_id % 20 = 0"), 20).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    d = x.astype(float)
    for q in range(0, 300, 20):
        s = np.einsum("j,ij->i", d[q], d)
        want = [i for i in np.lexsort((np.arange(300), -s)) if i != q][:20]
        assert [v for _, v, _ in sorted(by[q])] == want
        assert np.allclose([z for *_, z in sorted(by[q])], s[want])
    assert set(by) == set(range(0, 300, 20))
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert ann.search(few, few, 20).count() == 6
    assert ann.search(vectors.filter("false"), vectors, 20).collect() == []
    assert ann.search(vectors.filter("vec_id >= 900"), vectors, 20).count() in (0, 1)


def test_search_beyond_the_sample(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 300)
    monkeypatch.setattr(ann, "LIST_SIZE", 100)
    monkeypatch.setattr(ann, "LIST_PART", 64)
    x = np.random.default_rng(4).standard_normal((2000, 16))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(vectors, vectors.filter("vec_id % 20 = 0"), 20).collect()
    hit = 0
    for q in range(0, 2000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20].tolist()) & {r["vec_id"] for r in got if r["query_id"] == q})
    assert len(got) == 100 * 20 and hit / (100 * 20) >= 0.9


PAGES = [(1, "http://www.a.org/x?b=1#c", "<p>one"), (2, "https://A.org:8080/", None), (3, None, ""), (4, "odd", "<p>one"), (5, "http://b.a.org/x", "é" * 5000), (6, "http://b.a.org/x", "<p>one"), (6, "http://b.a.org/x", "<p>one"), (7, "http://a.org/x", "<p>two")]


def test_warc(spark):
    pages = spark.createDataFrame([(*p, "clash", 1) for p in PAGES], "page_id long, url string, html string, payload string, kind int")
    got = warc.digest(pages).collect()
    assert len(got) == len(PAGES)
    last = {}
    for i, _, h in PAGES:
        last[h or ""] = max(last.get(h or "", 0), i)
    for r in got:
        payload = {i: h or "" for i, _, h in PAGES}[r["page_id"]]
        assert r["payload_bytes"] == len(payload.encode())
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(payload.encode()).digest()).decode()
        if r["page_id"] != 6:
            assert r["record_type"] == ("response" if last[payload] == r["page_id"] else "revisit")
            assert r["refers_to"] == (None if r["record_type"] == "response" else last[payload])
    assert sorted(r["record_type"] for r in got if r["page_id"] == 6) == ["response", "revisit"]
    assert warc.digest(pages.filter("false")).collect() == []
    found = warc.lookup(warc.write(pages), spark.createDataFrame([("http://a.org/x", 7), ("http://a.org/none", 7)], "url string, page_id long")).collect()
    assert [warc.parse(bytes(r["record"]))["payload"] for r in found] == [b"<p>two"]


def test_lookups_among_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 4)
    monkeypatch.setattr(warc, "GROUP_BYTES", 256)
    rows = [(i, f"http://h{i % 7}.org/{i % 50}" if i % 11 else None, f"<p>{i % 120}") for i in range(400)]  # keys that run over blocks
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    directory = warc.write(pages)
    assert directory.count() >= 100
    wanted = [r for r in rows if r[0] % 3 == 0]
    asked = spark.createDataFrame([(u, i) for i, u, _ in wanted] + [("http://h1.org/none", 1), ("http://zz.org/", 2), (None, 401)], "url string, page_id long")
    found = {r["page_id"]: warc.parse(bytes(r["record"])) for r in warc.lookup(directory, asked).collect()}
    assert found.keys() == {i for i, _, _ in wanted}
    last = {h: i for i, _, h in rows}
    for i, _, h in wanted:
        assert found[i]["payload"] == (h.encode() if last[h] == i else None)
        assert found[i]["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()


def test_surt():
    assert [warc.surt(u) for u in ("http://www.a.org/x?b=1#c", "https://A.org:8080", None, "odd")] == ["org,a)/x?b=1", "org,a:8080)/", "-", "odd"]


def test_unigram_against_the_library():
    model = unigram.load(PIECES)
    with open(PIECES, "rb") as f:
        library = sentencepiece.SentencePieceProcessor(model_proto=f.read() + b"\x12\x02\x18\x01")  # the same pieces and scores, type unigram
    codec = unigram.Codec(model)
    texts = ["", "a", "hend", "ly hend", " lead", "two  sp", "trail ", "日本語", "😀 x", "\x00b", "é" * 60, "b" * 300, None]
    ids, sizes = codec.encode_all(texts)
    ends = np.cumsum(sizes)
    for t, n, e in zip(texts, sizes, ends, strict=True):
        own = ids[e - n : e].tolist()
        theirs = library.encode(t or "")
        unknown = any(model.byte_ids[0] <= i <= model.byte_ids[255] for i in own)
        assert own == theirs or (not unknown and sum(model.scores[own]) >= sum(model.scores[theirs])), t
    decoded = codec.decode_all(ids, sizes)
    assert decoded == [t or "" for t in texts]
    assert [library.decode(ids[e - n : e].tolist()) for n, e in zip(sizes, ends, strict=True)] == decoded


def test_unigram_paths_are_best():
    """Against a plain Viterbi over all pieces of random short chunks; both forms agree."""
    model = unigram.load(PIECES)
    pieces = {bytes(model.data[model.offsets[i] : model.offsets[i + 1]]): model.scores[i] for i in range(len(model.scores)) if model.ends.max() >= i and model.offsets[i + 1] > model.offsets[i] and i not in model.byte_ids}
    rng = np.random.default_rng(0)
    for _ in range(60):
        chunk = (" " + "".join(rng.choice(list("thesandé日 "), rng.integers(1, 12)))).replace("  ", " ").encode()
        text = chunk.decode()
        best = [0.0] + [-np.inf] * len(text)
        for i in range(len(text)):
            for j in range(i + 1, len(text) + 1):
                p = text[i:j].encode()
                s = pieces.get(p, model.unknown if j == i + 1 else -np.inf)
                best[j] = max(best[j], best[i] + s)
        one = unigram._one(model, chunk)
        many, _ = unigram._many(model, [chunk])
        assert one == many.tolist()
        is_byte = np.isin(one, model.byte_ids)
        if not is_byte.any():
            assert sum(model.scores[one]) == pytest.approx(best[-1])


def test_unigram_frames(spark):
    d = docs(spark)
    out = unigram.digest(d, PIECES).collect()
    assert len(out) == len(TEXTS) + 2 and all(r["round_trip"] for r in out)
    assert [r["n_ids"] for r in out if r["doc_id"] in (0, 1)] == [0, 0]
    back = unigram.decode(unigram.encode(d, PIECES), PIECES).collect()
    assert all((r["text"] or "") == r["decoded"] for r in back)
    assert unigram.digest(docs(spark, []), PIECES).collect() == []


ARTICLE = "<html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul><li>Home<li>News</ul></nav><div class='cookie-notice'>We use</div>{}<aside>Side</aside><footer>&copy; F</footer></body></html>"


def test_extract(spark):
    pages = [
        (1, "http://a.org/1", ARTICLE.format("<article><h1>A &amp; B</h1><p><b>bo</b>ld\n text<br>x<p>two<!-- no --></p><div id=comments>rude</div><form>f</form></article>")),
        (2, "http://a.org/2", ARTICLE.format("<article><h1>C</h1><p>more</p></article>")),
        (3, None, None),
        (4, "http://c.org/", "plain text only"),
        (5, "http://a.org/1", ""),
        (5, "http://a.org/1", ""),
    ] + [(10 + i, f"http://b.org/{i}", f"<body><div class=x1>Same on all</div><div class=x2><p>Text number {i} is long enough</p><p>and goes on {i}</p></div></body>") for i in range(5)]
    frame = spark.createDataFrame([(*p, "clash", "w") for p in pages], "page_id long, url string, html string, text string, wrapper string")
    got = {r["page_id"]: r for r in extract.digest(frame).collect()}
    assert got[1]["text"] == "A & B bold text x two"
    assert got[2]["text"] == "C more" and got[2]["n_chars"] == 6
    assert got[3]["text"] == got[5]["text"] == "" and got[4]["text"] == "plain text only"
    assert got[12]["text"] == "Text number 2 is long enough and goes on 2"
    assert extract.digest(frame).count() == len(pages)
    assert extract.digest(frame.filter("false")).collect() == []


def test_wrappers_merge_to_that_of_all_pages():
    pages = [f"<body><ul>{'<li>a</li>' * n}</ul>{'<p>x</p>' if n % 2 else ''}<div>t{n}</div></body>" for n in range(1, 5)]
    whole, parts = extract.learn(pages), extract.learn(pages[:2])
    extract.align(parts, extract.learn(pages[2:]), True)
    assert parts.to_json() == whole.to_json()
    assert extract.expression(whole, whole.times) == "<body><ul>(<li>text</li>)+</ul>(<p>text</p>)?<div>#PCDATA</div></body>"


def read_all(pages):
    root = extract.learn(pages)
    kept = extract.articles(root)
    return [extract.main_text(p, root, kept) for p in pages]


def test_pages_without_marks_on_a_host_with_marked_ones():
    marked = [f"<body><article><p>Marked {i}</p></article></body>" for i in range(4)]
    plain = [f"<body><div class=x><p>Plain text number {i}</p></div></body>" for i in range(4)]
    empty = "<body><article></article><div class=x><p>Beside</p></div></body>"
    assert read_all([*marked, *plain, empty]) == [f"Marked {i}" for i in range(4)] + [f"Plain text number {i}" for i in range(4)] + [""]


def test_elements_of_different_marks_share_no_group():
    utility = "flex items-center justify-between px-four py-two text-small leading-loose "
    for drop, keep in (("role=banner", ""), ("aria-hidden=hidden", ""), (f"class='{utility}sidebar'", f"class='{utility}prose'")):
        menu, text = (lambda i, a=drop: f"<div {a}>Menu {i}</div>"), (lambda i, a=keep: f"<div {a}>Text {i}</div>")
        assert read_all([f"<body>{menu(i)}{text(i)}</body>" for i in range(4)]) == [f"Text {i}" for i in range(4)]
        assert read_all([f"<body>{text(i)}{menu(i)}</body>" for i in range(4)]) == [f"Text {i}" for i in range(4)]


def test_text_beside_the_longest_and_copies_of_pages_stay():
    page = "<body><div class=menu>Menu</div><div><h3>Imprint</h3><h1>Title {0}</h1><p>lead {0}</p><div><p>{1}</p><p>{1}</p></div></div></body>"
    body = [" ".join([f"long body {i}"] * 40) for i in range(4)]
    assert read_all([page.format(i, b) for i, b in enumerate(body)]) == [f"Title {i} lead {i} {b} {b}" for i, b in enumerate(body)]
    for n in (1, 2, 3, 50):
        assert read_all(["<body><div><p>The one text</p></div></body>"] * n) == ["The one text"] * n
    assert read_all([f"<body><nav>{i}</nav><p>Copied text</p></body>" for i in range(4)]) == ["Copied text"] * 4
    own = "<body><header>Site {0}</header><div><header><h1>Title {0}</h1></header><p>text {0}</p></div></body>"
    assert read_all([own.format(i) for i in range(4)]) == [f"Title {i} text {i}" for i in range(4)]


def test_text_around_marked_inline_elements_and_deep_marks():
    ad = "<span class=ad>Buy</span>"
    pages = [f"<body><article><p>{ad} real {i}</p><p>text {i} {ad}</p><pre><span class=hljs-comment># x</span> code {i}</pre></article></body>" for i in range(4)]
    assert read_all(pages) == [f"real {i} text {i} # x code {i}" for i in range(4)]
    assert read_all([f"<body><p>{ad} real {i}</p><p>text {i} {ad}</p></body>" for i in range(4)]) == [f"real {i} text {i}" for i in range(4)]
    deep = f"<body>{'<div>' * 100}<nav>Menu {{0}}</nav><article><p>Deep {{0}}<div class=comments>rude</div></article>{'</div>' * 100}</body>"
    assert read_all([deep.format(i) for i in range(4)]) == [f"Deep {i}" for i in range(4)]
    cells = "".join(f"<tr><td>a{i}<td>b{i}" for i in range(99))
    table = f"<body><article><table>{cells}</table><dl>{'<dt>t<dd>d' * 99}</dl><nav>Menu</nav><p>end {{0}}</p></article></body>"
    want = " ".join(f"a{i} b{i}" for i in range(99)) + " t d" * 99
    assert read_all([table.format(i) for i in range(4)]) == [f"{want} end {i}" for i in range(4)]
    nested = f"<body>{'<article><nav>' * 3000}x{'</nav></article>' * 3000}<article>y{{0}}</article></body>"
    assert read_all([nested.format(i) for i in range(4)]) == [f"y{i}" for i in range(4)]
    wrapper = extract.learn([table.format(0)]).groups[0].groups[0].groups
    assert [g.tag for g in wrapper[0].groups] == ["tr"] and [g.tag for g in wrapper[0].groups[0].groups] == ["td"]


def test_words_are_hints_that_the_host_overrules():
    page = "<body><div class='content has-sidebar'><p>Main text of page {0}</p><div class=sidebar>Side {0}</div></div><div class=related>More {0}</div></body>"
    assert read_all([page.format(i) for i in range(4)]) == [f"Main text of page {i}" for i in range(4)]
    other = "<body><article>Another template {0}</article><div class=comments>rude {0}</div></body>"
    pages = [other.format(i) for i in range(9)] + [page.format(i) for i in range(3)]
    assert read_all(pages) == [f"Another template {i}" for i in range(9)] + [f"Main text of page {i}" for i in range(3)]
    inner = "<body><div class=has-sidebar><article>An article {0}</article></div></body>"
    assert read_all([inner.format(i) for i in range(4)]) == [f"An article {i}" for i in range(4)]


def test_all_neighbours_come_from_the_probed_lists(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_SIZE", 100)
    fit = ann.fit
    made = []

    def one_probe(*a):
        made.append(dataclasses.replace(fit(*a), probes=1))
        return made[0]

    monkeypatch.setattr(ann, "fit", one_probe)
    x = np.random.default_rng(5).standard_normal((1000, 16))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    scan = ann._scan

    def lossy(ids, q, floor, *rest):
        found = scan(ids, q, floor, *rest)
        return tuple(c[1:] for c in found) if (floor > -1e300).any() else found

    for once in (scan, lossy):  # what the second abandons is found without a floor
        monkeypatch.setattr(ann, "_scan", once)
        made.clear()
        got = ann.search(vectors, vectors.filter("vec_id % 20 = 0"), 20).collect()
        of = ann._nearest(x, made[0].centroids)
        for q in range(0, 1000, 20):
            s = x @ x[q]
            s[(of != np.argmax(made[0].centroids @ x[q])) | (np.arange(1000) == q)] = -np.inf
            want = [i for i in np.argsort(-s)[:20] if np.isfinite(s[i])]
            assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want


@pytest.mark.parametrize("kind", ["plain", "clustered", "uneven"])
def test_recall_of_the_scan(spark, monkeypatch, kind):
    monkeypatch.setattr(ann, "SAMPLE", 1000)
    rng = np.random.default_rng(7)
    x = rng.standard_normal((6000, 32))
    if kind == "clustered":
        x = x * 0.3 + rng.standard_normal((40, 32))[rng.integers(0, 40, 6000)]
    if kind == "uneven":
        x *= rng.lognormal(0, 0.7, (6000, 1))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(vectors, vectors.filter("vec_id % 20 = 0"), 20).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    s = x[::20] @ x.T
    s[np.arange(300), np.arange(0, 6000, 20)] = -np.inf
    best = np.argsort(-s, axis=1)[:, :20]
    assert len(got) == 300 * 20
    assert sum(len(found[20 * i] & set(b.tolist())) for i, b in enumerate(best)) / 6000 >= 0.9


def test_search_with_batches_of_unusable_vectors_and_clashing_columns(spark, tmp_path):
    kind = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("list", pa.int64()), ("score", pa.string()), ("rank", pa.int32())])
    parts = [[[1.0, 2.0], [2.0, 1.0], [3.0, 3.0]], [None, None], [[], []], [None, [], [None, 1.0]], [[0.0, 0.0], [1.0, 2.0, 3.0]]]
    for i, vectors in enumerate(parts):
        n = len(vectors)
        pq.write_table(pa.table([[10 * i + j for j in range(n)], vectors, [0] * n, ["x"] * n, [1] * n], schema=kind), tmp_path / f"{i}.parquet")
    read = spark.read.parquet(str(tmp_path)).repartition(5, "list", "vec_id")
    for df in (spark.read.parquet(str(tmp_path)), read):
        assert [(r["query_id"], r["vec_id"]) for r in ann.search(df, df, 1).orderBy("query_id").collect()] == [(0, 2), (1, 2), (2, 0)]
    assert [len(x) for x in ann._vectors(pa.array([None, None], pa.list_(pa.float64())), 4)] == [0, 0]
    assert ann._vectors(pa.array([[], []], pa.list_(pa.float64())), 4)[0].shape == (0, 4)


def test_quality_ratios_and_verdicts_against_a_plain_computation(spark, monkeypatch):
    monkeypatch.setattr(quality, "BUCKETS", 97)
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(rng.choice(["ab", "Ab", "c,", "d#", "longer-word", "é"], rng.integers(0, 60), p=[0.3, 0.1, 0.2, 0.1, 0.2, 0.1] if i % 3 else [0.1, 0.1, 0.1, 0.5, 0.1, 0.1]))) for i in range(60)] + [(60, "one"), (61, ""), (62, None)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(0, 50, 2)] + [(4, 1, 0), (None, 1, 0), (999, 1, 0)]

    def h(*parts):
        seed = 42
        for x in parts:
            seed = xxhash.xxh64_intdigest(x.encode() if isinstance(x, str) else x.to_bytes(8, "little"), seed)
        return seed

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    cells = {}
    for i, t in rows:
        w = [h(x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        cells[i] = [signed(x) % 97 for x in w] + [signed(h(a, b)) % 97 for a, b in zip(w, w[1:])]
    raw, trusted = np.zeros(97), np.zeros(97)
    for i, _ in rows:
        np.add.at(raw, cells[i], 1)
        if i in {d for d, q, _ in labels if q == 1}:
            np.add.at(trusted, cells[i], 1)
    seen = raw > 0
    p = raw[seen] / raw.sum()
    want = np.zeros(97)
    want[seen] = np.log((trusted[seen] + 97 * p) / (trusted.sum() + 97) / p)
    label_rows = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert np.allclose(quality.log_ratios(docs(spark, rows), label_rows), want, atol=1e-3)
    got = {r["doc_id"]: r for r in quality.judged(docs(spark, rows), label_rows, -0.05).collect()}
    rejected = 0
    for i, t in rows:
        score = want[cells[i]].mean() if cells[i] else None
        assert (got[i]["score"] is None) == (score is None)
        if score is not None:
            assert abs(got[i]["score"] - score) < 2e-3
            if abs(score + 0.05) > 2e-3:
                assert got[i]["kept"] == (not got[i]["base_failed"] and score >= -0.05)
                rejected += not got[i]["base_failed"] and score < -0.05
    assert rejected


def test_quality_keeps_columns_named_like_its_own(spark):
    text = "some words that are all unlike each other so that no rule of the base finds any fault in this text here"
    names = ["doc_id", "text", "score", "kept", "n_words", "_words", "_hashes", "_row", "a.b"]
    df = spark.createDataFrame([(1, text, "s", "k", "n", "w", "h", "r", "d"), (2, "short", "s", "k", "n", "w", "h", "r", "d")], names)
    out = quality.kept_rows(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert out.columns == names and [tuple(r) for r in out.collect()] == [(1, text, "s", "k", "n", "w", "h", "r", "d")]


def brute_anchors(known, runs):
    """The best score of all pairings that keep both orders."""
    if not known or not runs:
        return 0.0
    a, b = known[0], runs[0][0]
    best = max(brute_anchors(known[1:], runs), brute_anchors(known, runs[1:]))
    if extract._fits(a, b):
        best = max(best, 4 + (a.same is not None and a.same == b.same) + extract._alike(a, b) + brute_anchors(known[1:], runs[1:]))
    return best


def test_alignment_against_brute_force():
    rng = np.random.default_rng(10)

    def groups(n):
        out = []
        for _ in range(n):
            g = extract.Group(*[("div", "", ""), ("p", "", ""), ("ul", "m", ""), ("div", "x", "")][rng.integers(4)])
            g.same = [None, 1, 2][rng.integers(3)]
            g.groups = [extract.Group(t) for t in rng.choice(["li", "a"], rng.integers(0, 3))]
            out.append(g)
        return out

    for _ in range(300):
        known, runs = groups(rng.integers(0, 6)), extract._runs(groups(rng.integers(0, 6)))
        pairs = extract._anchors(known, runs)
        assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
        score = sum(4 + (known[i].same is not None and known[i].same == runs[j][0].same) + extract._alike(known[i], runs[j][0]) for i, j in pairs)
        assert all(extract._fits(known[i], runs[j][0]) for i, j in pairs)
        want = brute_anchors(known, runs)
        assert score == want or len(known) == len(runs) == len(pairs)


def test_mismatches_become_optional_repeated_and_slots():
    pages = ["<body><h2>Site</h2><div class=a><b>x</b><p>one</p></div></body>", "<body><h2>Site</h2><ul><li>1</li><li>2</li></ul><div class=b><p>two</p><p>three</p></div></body>", "<body><h2>Site</h2><ul><li>3</li></ul><div class=c><p>four</p></div></body>"]
    wrapper = extract.learn(pages)
    assert extract.expression(wrapper, 3) == "<body><h2>text</h2>(<ul>(<li>#PCDATA</li>)+</ul>)?<div.*>#PCDATA(<p>#PCDATA</p>)+</div.*></body>".replace("<div.*>#PCDATA", "<div.*>text")
    for order in ([0, 1, 2], [2, 1, 0], [1, 0, 2]):
        root = extract.learn([pages[i] for i in order])
        assert [g.tag for g in root.groups[0].groups] == ["h2", "ul", "div"] and root.groups[0].groups[1].parents == 2


def test_wrappers_stay_small_where_every_page_has_names_of_its_own():
    page = "<body><nav>n</nav><div class='post-{0}'><h1>t{0}</h1><p>text {0}</p></div><div id='end-{0}'>Imprint</div></body>"
    words = ["".join(chr(97 + int(d)) for d in str(i * 7919)) for i in range(200)]
    root = extract.learn([page.format(w) for w in words])
    assert sum(1 for _ in root.preorder()) < 12
    assert read_all([page.format(w) for w in words])[7] == f"t{words[7]} text {words[7]}"


def test_containers_without_names_are_told_apart():
    page = "<body><div><ul><li>Home</li><li>News {1}</li></ul></div><div><p>{0}</p></div><div>Imprint</div></body>"
    texts = [" ".join(f"a text {i}" for _ in range(9)) for i in range(5)]
    got = read_all([page.format(t, "") for t in texts])
    assert got == texts


def test_words_that_lie_around_the_article():
    body = "<p>" + "text of the page {0} " * 9 + "</p>"
    for around in ("text-widget-area", "share-your-views", "promo-free legal"):
        for inner in (body, f"<h1>T {{0}}</h1>{body}", f"<article>{body}</article>"):
            page = f"<body><div class=menu>Menu {{0}}</div><div class='{around}'>{inner}</div></body>"
            want = [" ".join(re.sub("<[^>]*>", " ", inner).format(i).split()) for i in range(5)]
            assert read_all([page.format(i) for i in range(5)]) == want, (around, inner)
    page = f"<body><header><h1>Site</h1></header><article><header class=entry-header><h1>Title {{0}}</h1></header>{body}<div class=comments>rude {{0}}</div></article></body>"
    assert read_all([page.format(0)])[0].startswith("Title 0 text of") and "rude" not in read_all([page.format(0)])[0]
    deep = f"<body><article>{'<div>' * 70}<nav>Menu {{0}}</nav><p>Deep {{0}}</p>{'</div>' * 70}</article></body>"
    assert read_all([deep.format(i) for i in range(3)]) == [f"Deep {i}" for i in range(3)]


def test_no_group_is_merged_for_its_number_or_the_length_of_its_name():
    long = "u " * 80
    page = f"<body><div class='{long}a'>Same</div><div class='{long}b'>Text {{0}}</div></body>"
    assert read_all([page.format(i) for i in range(4)]) == [f"Text {i}" for i in range(4)]
    names = ["".join(chr(97 + int(d)) for d in str(k)) for k in range(1000, 1600)]
    page = "<body>" + "".join(f"<div class=k{n}>Same {n}</div>" if k % 2 else f"<div class=k{n}>Own {n} {{0}}</div>" for k, n in enumerate(names)) + "</body>"
    want = " ".join(f"Own {n} {{0}}" for k, n in enumerate(names) if not k % 2)
    assert read_all([page.format(i) for i in range(4)]) == [want.format(i) for i in range(4)]


def test_many_wrappers_and_many_hosts(spark, monkeypatch):
    rows = [(i, f"http://h{i % 9}.org/{i}" if i % 10 else None, f"<body><div class=m{i % 3}>Same</div><p>Text {i}</p></body>") for i in range(120)] + [(5, "http://h5.org/5", "<p>again")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    few = sorted(map(tuple, extract.digest(pages).collect()))
    assert len(few) == len(rows) and (7, "http://h7.org/7", "Text 7", 6) in few
    monkeypatch.setattr(extract, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(extract, "HOSTS", 3)
    assert sorted(map(tuple, extract.digest(pages).collect())) == few
    assert extract.digest(pages.filter("false")).collect() == []
