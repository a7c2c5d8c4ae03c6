"""SentencePiece encoding by the best unigram path, and decoding.

The pieces of a public model and their log scores are laid out in a double-array trie over UTF-8 bytes. A text gets the
whitespace marker for spaces and one in front. No piece has a marker behind another character, so the best path of a
text is that of its chunks (markers and what follows), each found by Viterbi over the trie; many chunks advance in
step, and chunks seen before are remembered. A character that no piece holds costs the least score less UNKNOWN and is
spelled in byte pieces. Where two paths score alike, the last piece that begins earlier wins.

Decoding joins the pieces' bytes, turns markers into spaces, drops the first and replaces broken UTF-8.

Defined cases: null and empty texts have no ids and decode to the empty text; texts are not normalised, but a text's own marker reads as a
space; ids outside the
model and control pieces decode to nothing; repeated rows are each worked on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm._shared import small_batches

MARKER = "▁"
#: What an unknown character costs beyond the least score (SentencePiece's own value).
UNKNOWN = 10.0
#: Chunks of more bytes are worked on one by one.
LONG = 128
#: Chunks that a task remembers.
MEMO = 400_000
_CHUNKS = re.compile(r" *[^ ]+| +")


@dataclass(frozen=True)
class Model:
    """A double-array trie (base, check, and the piece that ends at a node or -1), scores, and the pieces' bytes."""

    base: np.ndarray
    check: np.ndarray
    ends: np.ndarray
    scores: np.ndarray
    unknown: float
    byte_ids: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


def _double_array(entries: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node 1 is the root; node t is a child of s by byte c if t = base[s] + c and check[t] = s."""
    size = 1 << 12
    base, check, ends = [0] * size, [0] * size, [-1] * size
    keys = sorted(entries)
    todo = [(1, 0, len(keys), 0)]  # node, its keys, their common length
    check[1], free, roomy, top = -1, 2, 2, 2  # the root has no parent
    while todo:
        node, lo, hi, depth = todo.pop()
        if len(keys[lo]) == depth:
            ends[node] = entries[keys[lo]]
            lo += 1
        if lo == hi:
            continue
        groups, start = [], lo
        for i in range(lo + 1, hi + 1):
            if i == hi or keys[i][depth] != keys[start][depth]:
                groups.append((keys[start][depth], start, i))
                start = i
        while check[free]:
            free += 1
        at, tries = max(1, (free if len(groups) == 1 else roomy) - groups[0][0]), 0
        while True:
            if max(at, top) + 512 > len(check):
                more = len(check)
                base += [0] * more
                check += [0] * more
                ends += [-1] * more
            if not any(check[at + c] for c, _, _ in groups):
                break
            at += 1
            tries += 1
            if tries == 64:  # too dense here for nodes of several children
                at = roomy = top
        base[node] = at
        for c, a, b in groups:
            check[at + c] = node
            top = max(top, at + c + 1)
            todo.append((at + c, a, b, depth + 1))
    return tuple(np.array(x[: top + 256], np.int32) for x in (base, check, ends))


def load(path: str) -> Model:
    """The pieces of a SentencePiece model file; its scores are taken as log scores."""
    from sentencepiece import SentencePieceProcessor

    found = SentencePieceProcessor(model_file=path)
    entries, byte_ids, parts, scores = {}, np.full(256, -1, np.int32), [], np.zeros(found.get_piece_size())
    for i in range(found.get_piece_size()):
        piece = found.id_to_piece(i)
        scores[i] = found.get_score(i)
        part = b""
        if found.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
            part = bytes([int(piece[1:-1], 16)])
        elif not (found.is_control(i) or found.is_unknown(i) or found.is_unused(i)):
            if re.search(rf"[^{MARKER}]{MARKER}", piece):
                raise ValueError(f"a marker within piece {piece!r}: chunks would not be independent")
            part = piece.replace(MARKER, " ").encode()
            entries[part] = i
        parts.append(part)
    base, check, ends = _double_array(entries)
    normal = [scores[i] for i in entries.values()]
    return Model(base, check, ends, scores, min(normal) - UNKNOWN, byte_ids, np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in parts]))))


def _one(m: Model, chunk: bytes) -> list[int]:
    n = len(chunk)
    best, back = [-np.inf] * (n + 1), [(0, -1)] * (n + 1)
    best[0] = 0.0
    base, check, ends, scores = m.base, m.check, m.ends, m.scores
    for i in range(n):
        if best[i] == -np.inf:
            continue
        width = 1 + (chunk[i] >= 0xC0) + (chunk[i] >= 0xE0) + (chunk[i] >= 0xF0)
        node, single = 1, False
        for j in range(i, n):
            to = base[node] + chunk[j]
            if check[to] != node:
                break
            node = to
            if ends[node] >= 0:
                single |= j + 1 - i == width
                if best[i] + scores[ends[node]] > best[j + 1]:
                    best[j + 1], back[j + 1] = best[i] + scores[ends[node]], (i, int(ends[node]))
        if not single and best[i] + m.unknown > best[i + width]:
            best[i + width], back[i + width] = best[i] + m.unknown, (i, -1)
    out, at = [], n
    while at:
        start, piece = back[at]
        out += [piece] if piece >= 0 else [int(m.byte_ids[c]) for c in reversed(chunk[start:at])]
        at = start
    return out[::-1]


def _many(m: Model, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all chunks end to end, and their numbers; the chunks are about as long as each other."""
    sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
    n, longest = len(chunks), int(sizes.max())
    text = np.frombuffer(b"".join(c.ljust(longest, b"\0") for c in chunks), np.uint8).reshape(n, longest)
    best = np.full((n, longest + 4), -np.inf)
    best[:, 0] = 0
    start, piece = np.zeros((n, longest + 4), np.int32), np.full((n, longest + 4), -1, np.int32)
    lead = text & 0xC0 != 0x80
    for i in range(longest):
        rows = np.flatnonzero((sizes > i) & lead[:, i] & (best[:, i] > -np.inf))
        if not len(rows):
            continue
        first = text[rows, i]
        width = 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
        single = np.zeros(len(rows), bool)
        live, node = np.arange(len(rows)), np.ones(len(rows), np.int64)
        for j in range(i, longest):
            inside = sizes[rows[live]] > j
            live, node = live[inside], node[inside]
            to = m.base[node] + text[rows[live], j]
            ok = m.check[to] == node
            live, node = live[ok], to[ok]
            if not len(live):
                break
            ends = m.ends[node]
            hit = ends >= 0
            who, what = live[hit], ends[hit]
            single[who] |= width[who] == j + 1 - i
            r = rows[who]
            score = best[r, i] + m.scores[what]
            better = score > best[r, j + 1]
            r = r[better]
            best[r, j + 1], start[r, j + 1], piece[r, j + 1] = score[better], i, what[better]
        lone = ~single
        r, at = rows[lone], i + width[lone]
        score = best[r, i] + m.unknown
        better = score > best[r, at]
        r, at = r[better], at[better]
        best[r, at], start[r, at], piece[r, at] = score[better], i, -1
    # from the ends back; an unknown character stands for its bytes
    steps_row, steps_start, steps_piece, steps_end = [], [], [], []
    rows, at = np.arange(n), sizes.copy()
    while len(rows):
        s, p = start[rows, at], piece[rows, at]
        steps_row.append(rows)
        steps_start.append(s)
        steps_piece.append(p)
        steps_end.append(at)
        more = s > 0
        rows, at = rows[more], s[more].astype(np.int64)
    row, s, p, e = (np.concatenate(x) for x in (steps_row, steps_start, steps_piece, steps_end))
    times = np.where(p >= 0, 1, e - s)
    order = np.argsort(row * (longest + 1) + s, kind="stable")
    row, s, p, times = row[order], s[order], p[order], times[order]
    row, s, p = np.repeat(row, times), np.repeat(s, times), np.repeat(p, times)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    ids = np.where(p >= 0, p, m.byte_ids[text[row, np.minimum(s + nth, longest - 1)]])
    return ids.astype(np.int32), np.bincount(row, minlength=n)


class Codec:
    def __init__(self, model: Model):
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.memo: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 18, np.int32), 0
        self.offsets = np.zeros(1 << 16, np.int64)

    def _learn(self, chunks: list[str]) -> None:
        chunks = sorted(chunks, key=len)
        short = [c for c in chunks if len(c) * 4 <= LONG]
        for lo in range(0, len(short), 8192):
            part = short[lo : lo + 8192]
            self._keep(part, *_many(self.model, [c.encode() for c in part]))
        for c in chunks[len(short) :]:
            ids = _one(self.model, c.encode())
            self._keep([c], np.array(ids, np.int32), np.array([len(ids)]))

    def _keep(self, chunks: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        k = len(self.memo)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty(len(self.flat) + len(ids), np.int32)))
        if k + len(chunks) + 1 > len(self.offsets):
            self.offsets = np.concatenate((self.offsets, np.zeros(len(self.offsets) + len(chunks), np.int64)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.offsets[k + 1 : k + 1 + len(chunks)] = self.used + np.cumsum(sizes)
        self.used += len(ids)
        self.memo.update(zip(chunks, range(k, k + len(chunks)), strict=True))

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and their numbers."""
        if len(self.memo) > MEMO:
            self._reset()
        # a space that follows a space or begins a text belongs to the next chunk
        texts = [t and t.replace(MARKER, " ") for t in texts]
        split = [[] if not t else t.split(" ") if "  " not in t and t[0] != " " and t[-1] != " " else None for t in texts]
        chunks = [[f" {w}" for w in s] if s is not None else _CHUNKS.findall(f" {t}") for s, t in zip(split, texts, strict=True)]
        fresh = {c for x in chunks for c in x if c not in self.memo}
        if fresh:
            self._learn(list(fresh))
        index = np.fromiter((i for x in chunks for i in map(self.memo.__getitem__, x)), np.int64)
        begin = self.offsets[index]
        sizes = self.offsets[index + 1] - begin
        until = np.cumsum(sizes)
        ids = self.flat[np.repeat(begin - until + sizes, sizes) + np.arange(until[-1] if len(until) else 0)]
        ends = np.concatenate(([0], until))[np.cumsum([len(x) for x in chunks])] if chunks else np.empty(0, np.int64)
        return ids, np.diff(np.concatenate(([0], ends)))

    def decode_all(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        m = self.model
        ids = np.where((ids >= 0) & (ids < len(m.scores)), ids, 0)
        begin = m.offsets[ids]
        width = m.offsets[ids + 1] - begin
        until = np.cumsum(width)
        data = m.data[np.repeat(begin - until + width, width) + np.arange(until[-1] if len(until) else 0)].tobytes()
        ends = np.concatenate(([0], until))[np.cumsum(sizes)] if len(sizes) else np.empty(0, np.int64)
        out, at = [], 0
        for end in ends.tolist():
            part = data[at:end]
            out.append((part[1:] if part[:1] == b" " else part).decode("utf-8", "replace"))
            at = end
        return out


def _mapped(df: DataFrame, path: str, work, fields: list[T.StructField]) -> DataFrame:
    """df with the columns that work(codec, rows) gives."""
    small_batches(df.sparkSession)
    names = [f.name for f in fields]
    df = df.drop(*names)
    schema = T.StructType([*df.schema.fields, *fields])
    model = df.sparkSession.sparkContext.broadcast(load(path))  # a vocabulary: its size doesn't follow the data

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model.value)
        for rows in it:
            for lo in range(0, len(rows), 256):
                part = rows.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, *work(codec, part)], names=schema.names)

    return df.mapInArrow(batches, schema)


def _ids(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, model: str) -> DataFrame:
    """docs with ids, the piece ids of text."""

    def work(codec: Codec, rows: pa.RecordBatch) -> list[pa.Array]:
        return [_ids(*codec.encode_all(rows.column("text").to_pylist()))]

    return _mapped(docs.withColumn("text", F.col("text").cast("string")), model, work, [T.StructField("ids", T.ArrayType(T.IntegerType()))])


def decode(docs: DataFrame, model: str) -> DataFrame:
    """docs with decoded, the text of ids (null ids: empty)."""

    def work(codec: Codec, rows: pa.RecordBatch) -> list[pa.Array]:
        lists = [x or [] for x in rows.column("ids").to_pylist()]
        ids = np.array([i if i is not None else 0 for x in lists for i in x], np.int64)
        return [pa.array(codec.decode_all(ids, np.array([len(x) for x in lists], np.int64)), pa.string())]

    return _mapped(docs.withColumn("ids", F.col("ids").cast("array<int>")), model, work, [T.StructField("decoded", T.StringType())])


def digest(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_ids, n_byte_ids, ids_crc32 (over little-endian unsigned 32-bit ids), and round_trip: whether decoding gives the text."""
    import zlib

    def work(codec: Codec, rows: pa.RecordBatch) -> list[pa.Array]:
        texts = rows.column("text").to_pylist()
        ids, sizes = codec.encode_all(texts)
        ends = np.cumsum(sizes)
        is_byte = np.concatenate(([0], np.cumsum(np.isin(ids, codec.model.byte_ids))))
        raw = ids.astype("<u4").tobytes()
        crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
        same = [d == (t or "") for d, t in zip(codec.decode_all(ids, sizes), texts, strict=True)]
        return [pa.array(sizes), pa.array(is_byte[ends] - is_byte[ends - sizes]), pa.array(crc, pa.int64()), pa.array(same)]

    fields = [T.StructField(n, T.LongType()) for n in ("n_ids", "n_byte_ids", "ids_crc32")] + [T.StructField("round_trip", T.BooleanType())]
    return _mapped(docs.select("doc_id", F.col("text").cast("string").alias("text")), model, work, fields).drop("text")
