"""Vectorised words and shingles of Arrow string batches (numpy inside Spark tasks).

A word is a maximal run of bytes outside a separator set, with A-Z lowered; its
value is a 64-bit polynomial (Karp-Rabin) fingerprint of its UTF-8 bytes, so a
batch is cut into words by a few array operations and no per-word Python.
Texts are taken in pieces of ``PIECE`` bytes, cut at separators, so memory stays
bounded for very long texts. Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64

SPACE = bytes([0x20, *range(0x09, 0x0E)])  # the contract's white space
#: White space and ASCII punctuation.
PUNCT = SPACE + bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())


def _table(separators: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(separators)] = True
    return t


_TABLES = {s: _table(s) for s in (SPACE, PUNCT)}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, PIECE + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        out = []
        for b in (_BASE, inverse):
            p = np.full(size, b, dtype=_U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _cut(data: np.ndarray, first: np.ndarray, separators: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in ``data``; a word never crosses an offset in ``first``."""
    word = ~_TABLES[separators][data]
    edge = np.zeros(len(data) + 1, bool)
    edge[first] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | edge[1:-1]
    ends = word
    ends[:-1] &= ~word[1:] | edge[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def _hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum((_LOWER[data].astype(_U) + _U(1)) * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(_U))


def pieces(data: np.ndarray, separators: bytes) -> Iterator[tuple[int, int]]:
    """Ranges of about PIECE bytes, ended at a separator."""
    table, at = _TABLES[separators], 0
    while at < len(data):
        to = min(len(data), at + PIECE)
        while to < len(data) and not table[data[to]]:
            to += 1
        yield at, to
        at = to


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; nulls have no bytes."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def words_at(data: np.ndarray, separators: bytes = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Word fingerprints of one text of bounded size, and where each word starts."""
    if not len(data):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    starts, ends = _cut(data, np.zeros(1, np.int64), separators)
    return _hash(data, starts, ends), starts


def word_hashes(column: pa.Array, separators: bytes = SPACE) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word fingerprints in text order) for each row."""
    data, offsets = texts(column)
    n, row = len(offsets) - 1, 0
    while row < n:
        to = int(np.searchsorted(offsets, offsets[row] + PIECE, side="right")) - 1
        if to <= row:  # one text longer than a piece
            own = data[offsets[row]: offsets[row + 1]]
            parts = []
            for a, b in pieces(own, separators):
                starts, ends = _cut(own[a:b], np.zeros(1, np.int64), separators)
                parts.append(_hash(own[a:b], starts, ends))
            yield row, np.concatenate(parts)
            row += 1
            continue
        to = min(to, n)
        block = data[offsets[row]: offsets[to]]
        first = offsets[row:to] - offsets[row]
        starts, ends = _cut(block, first, separators)
        words = _hash(block, starts, ends)
        bounds = np.append(np.searchsorted(starts, first), len(starts))
        for k in range(to - row):
            yield row + k, words[bounds[k]: bounds[k + 1]]
        row = to


_STEPS = [_U(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(64)]


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of every run of ``size`` words, in order; a shorter text is one run."""
    n = len(words)
    if not n:
        return words
    k = min(size, n)
    out = np.full(n - k + 1, k, dtype=_U)
    for j in range(k):
        out += words[j: n - k + 1 + j] * _STEPS[j]
    return mix(out)


def counts(column: pa.Array, separators: bytes = SPACE) -> np.ndarray:
    """Words of each row."""
    return np.array([len(w) for _, w in word_hashes(column, separators)], dtype=np.int64)
