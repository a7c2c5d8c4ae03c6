"""Hierarchical packing of tokenised documents into windows of several lengths.

Each document is its token ids and an end id. What fills whole longest windows is cut off; the rest is routed to the
tier of the shortest window that holds it. Tiers are packed from the longest down: a window begins with the longest
rest of its tier, and its gap is filled with the longest rests of shorter tiers that fit, the last one cut. What is
left at a task's end is split into powers of two. Sequences are thus full, and none is padded. Sequences of a tier are
dealt into step groups of GROUP by their attention cost, forwards and backwards in turn, so that steps cost alike.

Every task packs the rows of its own partition as they stream by, so nothing is shuffled, one document never waits for
another task, and at most BLOCK tokens (or one document) are held. Sequence ids hold the partition's number.

Defined cases: a null or empty text has the end id alone; a special token's string in a text is that token, as the
tokenizer has it by default; repeated rows are packed each; empty tables give no rows.
"""

from __future__ import annotations

import bisect
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm._shared import small_batches

#: Tokens that are packed at a time.
BLOCK = 1 << 21
#: Sequences of a step group.
GROUP = 32
_TASK_BITS = 36
#: Characters (ASCII, Latin, Greek, Cyrillic) that both tokenizer libraries put into the same classes.
_COMMON = r"^[\t\n\r -~\x{a1}-\x{24f}\x{391}-\x{3a1}\x{3a3}-\x{3ff}\x{400}-\x{481}\x{48a}-\x{52f}]*$"
#: Fixed value: the pattern of pre-tokens of a byte-level tokenizer.
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A byte-level vocabulary writes printable bytes of Latin-1 as they are, and the others moved past 255.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_MOVED = {256 + i: b for i, b in enumerate(sorted({*range(256)} - {*_PRINTED}))}


class Encoder:
    """Token ids of texts by a byte-level tokenizer's file.

    Most texts are encoded by tiktoken over the file's own vocabulary, whose merges are in the order of their ids, which
    takes a third of the time and gives the same ids. The file's tokenizer itself takes what that can't decide: texts
    with a special token's string or with characters that the two libraries may class unlike, and all texts where the
    file isn't of that form."""

    def __init__(self, path: str):
        import tiktoken

        self.path, self.slow = path, None
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        vocab, own = made["model"]["vocab"], {t["content"] for t in made["added_tokens"]}
        self.special = "|".join(map(re.escape, own))
        order = [vocab[x.replace(" ", "") if isinstance(x, str) else "".join(x)] for x in made["model"]["merges"]]
        form = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.fast = None
        if made["pre_tokenizer"] == form and not made["normalizer"] and order == sorted(order):
            ranks = {k.translate(_MOVED).encode("latin-1"): v for k, v in vocab.items() if k not in own}
            self.fast = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        if self.slow is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return [np.array(x.ids, np.uint32) for x in self.slow.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; a null one has none."""
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = pc.invert(pc.match_substring_regex(texts, _COMMON))
        if self.special:
            odd = pc.or_(odd, pc.match_substring_regex(texts, self.special))
        for text, by_file in zip(texts, odd.to_pylist(), strict=True):
            if by_file or self.fast is None:
                yield self._whole([text.as_py()])[0]
            else:
                yield self.fast.encode_to_numpy(text.as_py(), disallowed_special=())


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """This worker's encoder; it outlives tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class _Pool:
    """Rests of documents by length: (row, start, length), shortest and longest first."""

    def __init__(self) -> None:
        self.by: dict[int, list[tuple[int, int]]] = {}
        self.lengths: list[int] = []
        self.total = 0

    def add(self, row: int, start: int, length: int) -> None:
        if length not in self.by:
            self.by[length] = []
            bisect.insort(self.lengths, length)
        self.by[length].append((row, start))
        self.total += length

    def take(self, length: int) -> tuple[int, int, int]:
        row, start = self.by[length].pop()
        if not self.by[length]:
            del self.by[length]
            self.lengths.remove(length)
        self.total -= length
        return row, start, length

    def at_most(self, length: int) -> int | None:
        """The largest length there is up to this one."""
        i = bisect.bisect_right(self.lengths, length)
        return self.lengths[i - 1] if i else None


def _fill(pool: _Pool, window: int) -> list[tuple[int, int, int]]:
    """The pieces of one full window; pool holds as many tokens at least."""
    pieces, gap = [], window
    while gap:
        best = pool.at_most(gap)
        if best is not None:
            pieces.append(pool.take(best))
            gap -= best
        else:  # all rests are longer than the gap: the shortest is cut
            row, start, length = pool.take(pool.lengths[0])
            pieces.append((row, start, gap))
            pool.add(row, start + gap, length - gap)
            gap = 0
    return pieces


def plan(lengths: list[int], pool: _Pool, rows: list[int], tiers: tuple[int, ...], last: bool) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """(window, pieces) of full sequences of the documents with these lengths and what pool still has; with last, of all."""
    longest = tiers[0]
    out = []
    for row, n in zip(rows, lengths, strict=True):
        whole = n - n % longest
        out += [(longest, [(row, at, longest)]) for at in range(0, whole, longest)]
        if n > whole:
            pool.add(row, whole, n - whole)
    for tier, below in zip(tiers, (*tiers[1:], 0), strict=True):
        # windows of this tier, as long as one of its own rests is there to begin with
        while pool.total >= tier and (own := pool.at_most(tier) or 0) > below:
            first = pool.take(own)
            rest = _fill(pool, tier - own) if own < tier else []
            out.append((tier, [first, *rest]))
    while last and pool.total:
        window = min(longest, 1 << (pool.total.bit_length() - 1))
        out.append((window, _fill(pool, window)))
    return out


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, n_tiers: int = 4, end_id: int = 0) -> DataFrame:
    """docs (doc_id, text) -> a row for each piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset, tier (the sequence's length) and step_group.

    tokenizer: path of a byte-level tokenizer's file, on every executor."""
    small_batches(docs.sparkSession)
    tiers = tuple(window >> i for i in range(n_tiers))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pool, held, row = _encoder(tokenizer), _Pool(), {}, 0
        sequence = group = TaskContext.get().partitionId() << _TASK_BITS
        waiting: list[int] = []
        tokens = 0

        def close(last: bool) -> pa.RecordBatch:
            nonlocal sequence, group, tokens
            made = plan([len(held[r][1]) for r in waiting], pool, waiting, tiers, last)
            tier = np.array([t for t, _ in made], np.int64)
            n_pieces = np.array([len(p) for _, p in made], np.int64)
            rows, start, length = np.array([x for _, p in made for x in p], np.int64).reshape(-1, 3).T
            of = np.repeat(np.arange(len(made)), n_pieces)
            cost = np.bincount(of, length.astype(np.float64) ** 2, len(made))
            steps = np.zeros(len(made), np.int64)
            for t in tiers + tuple(sorted(set(tier.tolist()) - set(tiers))):
                own = np.flatnonzero(tier == t)
                own = own[np.argsort(-cost[own], kind="stable")]
                n = -(-len(own) // GROUP)
                lap, at = np.divmod(np.arange(len(own)), max(n, 1))
                steps[own] = group + np.where(lap % 2 == 0, at, n - 1 - at)
                group += n
            first = np.cumsum(n_pieces) - n_pieces
            before = np.concatenate(([0], np.cumsum(length)))
            ids = [held[r][1][s : s + n] for r, s, n in zip(rows.tolist(), start.tolist(), length.tolist(), strict=True)]
            data = pa.py_buffer(np.concatenate([np.empty(0, "<u4"), *ids]).astype("<u4"))
            out = {
                "doc_id": pa.array([held[r][0] for r in rows.tolist()], pa.int64()),
                "start": pa.array(start),
                "length": pa.array(length),
                "ids": pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((4 * before).astype(np.int32)), data]),
                "doc_tokens": pa.array([len(held[r][1]) for r in rows.tolist()], pa.int64()),
                "sequence_id": pa.array(sequence + of),
                "offset": pa.array(before[:-1] - before[first][of] if len(made) else np.zeros(0, np.int64)),
                "tier": pa.array(tier[of].astype(np.int32)),
                "step_group": pa.array(steps[of]),
            }
            sequence += len(made)
            kept = {r for pieces in pool.by.values() for r, _ in pieces}
            for r in [r for r in held if r not in kept]:
                del held[r]
            waiting.clear()
            tokens = 0
            return pa.RecordBatch.from_pydict(out)

        for rows in it:
            for doc_id, ids in zip(rows.column("doc_id").to_pylist(), encoder.encode(rows.column("text")), strict=True):
                held[row] = doc_id, np.append(ids, np.uint32(end_id))
                waiting.append(row)
                row += 1
                tokens += len(ids) + 1
                if tokens >= BLOCK:
                    yield close(False)
        yield close(True)

    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(batches, schema)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")
