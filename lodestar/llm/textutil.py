"""Vectorised helpers over the texts of an Arrow batch: words, their hashes, and runs of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the n + 1 offsets of each text; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if len(col) else np.empty(0, np.uint8)
    return data, offsets - (offsets[0] if len(offsets) else 0)


#: Bytes of words: letters, digits, underscore, and every byte of a multi-byte character.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII letters and of the two-byte Latin letters from U+00C0 to U+00DE."""
    out = _LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1
    second = data[lead]
    up = (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
    out[lead[up]] += 32
    return out


_INV = pow(int(_R), -1, 1 << 64)
_STEP = 1 << 17
_CACHE: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo 2**64; kept for as many as a step of words() needs."""
    if n > 2 * _STEP:
        return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, base, np.uint64)]))
    if base not in _CACHE:
        _CACHE[base] = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(2 * _STEP - 1, base, np.uint64)]))
    return _CACHE[base][:n]


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of every word, in order, and the n + 1 offsets of each text's words.

    The hash is of the bytes ``data`` as given (lower-case them first if case is not to count).
    A word never crosses from one text to the next.
    """
    n = len(data)
    if not n:
        z = np.empty(0, np.int64)
        return z, z, np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    is_word = member[data]
    edge = np.empty(n + 1, bool)
    edge[0], edge[-1] = is_word[0], is_word[-1]
    np.not_equal(is_word[1:], is_word[:-1], out=edge[1:-1])
    inner = offsets[(offsets > 0) & (offsets < n)]
    cut = np.unique(inner[is_word[inner] & is_word[inner - 1]])
    marks = np.flatnonzero(edge)
    if len(cut):
        marks = np.sort(np.concatenate([marks, cut, cut]))
    start, end = marks[0::2], marks[1::2]
    # polynomial prefix sums modulo 2**64; a word's sum is shifted to a common power
    h = np.empty(len(start), np.uint64)
    first = np.searchsorted(start, np.arange(0, n + _STEP, _STEP))
    for a, b in zip(first[:-1], first[1:]):
        if a == b:
            continue
        lo, hi = int(start[a]), int(end[b - 1])
        run = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * _powers(int(_R), hi - lo), out=run[1:])
        h[a:b] = (run[end[a:b] - lo] - run[start[a:b] - lo]) * _powers(_INV, hi - lo + 1)[start[a:b] - lo]
    at = np.searchsorted(start, offsets)
    return start, end, mix64(h), at


def shingles(hashes: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words, and each text's offsets; a shorter text has one run, of all its words."""
    n = len(hashes)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(at), np.int64)
    count = np.diff(at)
    run = np.zeros(n, np.uint64)
    for j in range(k):
        part = run[: n - j] if j else run
        part += mix64(hashes[j:] + np.uint64(j + 1)) if j else mix64(hashes + np.uint64(1))
    doc = np.repeat(np.arange(len(count)), count)
    last = at[1:][doc]
    whole = np.arange(n) + k <= last
    short = np.flatnonzero((count > 0) & (count < k))
    for i in short:  # at most one a text, of under k words
        a, b = at[i], at[i + 1]
        whole[a] = True
        with np.errstate(over="ignore"):
            run[a] = np.sum(mix64(hashes[a:b] + np.arange(1, b - a + 1, dtype=np.uint64)), dtype=np.uint64)
    out = mix64(run[whole])
    per = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    return out, np.concatenate([[0], np.cumsum(per)])


def distinct(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values in ascending order, and their offsets."""
    v = values.copy()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        v[a:b].sort()
    keep = np.ones(len(v), bool)
    keep[1:] = v[1:] != v[:-1]
    keep[at[:-1][np.diff(at) > 0]] = True
    return v[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def pieces(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Slices of a batch with about ``most`` bytes of text each, one row at least."""
    sizes = np.diff(text_bytes(batch.column(column))[1])
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def unused(columns, name: str) -> str:
    """``name``, with as many underscores before it as no column has, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name
