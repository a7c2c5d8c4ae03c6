"""Hashed words and shingle sets of Arrow text columns, in numpy, a bounded number of bytes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in runs of about so many bytes; one longer text is a run of its own.
RUN_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.ones(n, _U)
    done = 1
    while done < n:
        more = min(done, n - done)
        np.multiply(out[:more], _U(pow(base, done, 1 << 64)), out=out[done : done + more])
        done += more
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A random 64-bit value for each byte, A-Z as a-z.
_BYTES = mix((np.arange(1, 257, dtype=_U)) * _U(0xD1342543DE82EF95))
_BYTES[65:91] = _BYTES[97:123]
_tables: dict[str, np.ndarray] = {"up": _powers(RUN_BYTES, _BASE), "down": _powers(RUN_BYTES, _INVERSE)}


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie end to end in data, A-Z lowered, and for each text the number of words up to its end."""
    n = len(data)
    if n == 0:
        return np.empty(0, _U), np.zeros(len(ends), np.int64)
    if n > len(_tables["up"]):
        _tables.update(up=_powers(2 * n, _BASE), down=_powers(2 * n, _INVERSE))
    gap = _SPACE[data]
    begins = ~gap
    begins[1:] &= gap[:-1]
    cuts = ends[ends < n]
    begins[cuts] = ~gap[cuts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, _U), np.zeros(len(ends), np.int64)
    value = _BYTES[data] * _tables["up"][:n]
    value[gap] = 0
    filled = np.cumsum(~gap)
    until = np.append(filled[starts[1:] - 1], filled[-1])
    length = np.diff(np.concatenate(([0], until)))
    hashes = mix(np.add.reduceat(value, starts) * _tables["down"][starts] + length.astype(_U))
    return hashes, np.searchsorted(starts, ends)


def shingle_sets(hashes: np.ndarray, until: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct k-word shingles as sorted 64-bit hashes, end to end, and their numbers.

    A text of fewer words has its whole sequence as one shingle; one without words has none."""
    since = np.concatenate(([0], until[:-1]))
    n_words = until - since
    spread = _U(0x9E3779B97F4A7C15)
    n = len(hashes)
    shingle = mix(hashes + spread) if n else hashes
    for j in range(1, k):
        if n > j:
            shingle = shingle.copy() if j == 1 else shingle
            shingle[: n - j] = mix(shingle[: n - j] * spread + hashes[j:])
    parts, sizes = [], np.zeros(len(until), np.int64)
    for i, (lo, hi, words) in enumerate(zip(since.tolist(), until.tolist(), n_words.tolist(), strict=True)):
        if words >= k:
            x = np.sort(shingle[lo : hi - k + 1])
            if len(x) > 1:
                fresh = x[1:] != x[:-1]
                if not fresh.all():
                    x = x[np.append(True, fresh)]
            parts.append(x)
            sizes[i] = len(x)
        elif words:
            total = _U(words)
            for h in hashes[lo:hi]:
                total = mix(np.array([total * spread + h], _U))[0]
            parts.append(np.array([total], _U))
            sizes[i] = 1
    return (np.concatenate(parts) if parts else np.empty(0, _U)), sizes


def runs(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, ends of each row's bytes) of runs of rows; a null row has no bytes."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + RUN_BYTES, side="right")) - 1)
        hi = min(hi, len(texts))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo + 1 : hi + 1] - offsets[lo]
        lo = hi
