"""Vectorised word and shingle hashing over Arrow string columns.

A column is handled in runs of documents of a few megabytes.  Every byte is
mapped to a random 64-bit value, weighted by a power of an odd number and
summed, so that the hash of any byte range is one subtraction and one product
(modulo 2**64).  Word and shingle hashes are mixed afterwards; they are the
same in every task and on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

RUN_BYTES = 1 << 20

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x5851F42D4C957F2D
_BASE_INV = pow(_BASE, -1, 1 << 64)

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x + _M1
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_ODD = mix(np.arange(1001, 1101, dtype=np.uint64)) | np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: words of everything but ASCII white space
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: words of ASCII letters and digits and everything beyond ASCII
LETTERS = np.zeros(256, bool)
LETTERS[0x30:0x3A] = True
LETTERS[0x61:0x7B] = True
LETTERS[0x41:0x5B] = True
LETTERS[0x80:] = True


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, RUN_BYTES + 1)
        for name, base in (("_powers", _BASE), ("_inverses", _BASE_INV)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            globals()[name] = np.multiply.accumulate(table)
    return _powers, _inverses


@dataclass
class Words:
    """The words of a run of documents: hash, byte range, and each document's range of words."""

    first: int  # row of the first document
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray  # document k has words bounds[k]:bounds[k + 1]
    data: np.ndarray  # lower-cased bytes of the run
    offsets: np.ndarray  # byte offsets of the documents in data
    raw: np.ndarray  # the bytes as they were

    @property
    def n_docs(self) -> int:
        return len(self.bounds) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts)


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data or b"", np.uint8), offsets


def word_runs(column: pa.Array, word: np.ndarray = NON_SPACE, run_bytes: int = RUN_BYTES) -> Iterator[Words]:
    """The column's words, a run of documents at a time; a longer document is a run of its own."""
    data, offsets = column_bytes(column)
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + run_bytes, side="right")) - 1)
        yield words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], word, a)
        a = b


def words_of(data: np.ndarray, offsets: np.ndarray, word: np.ndarray = NON_SPACE, first: int = 0) -> Words:
    raw, data, n = data, LOWER[data], len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(first, np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64), data, offsets, raw)
    inside = word[data]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True  # a document's first byte begins a word whatever came before
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | begins[1:n]
    ends[:-1] &= ~inside[1:] | begins[1:n]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    power, inverse = _tables(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:n], out=total[1:])
    h = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    return Words(first, h, start, end, np.searchsorted(start, offsets), data, offsets, raw)


def _length_seed(n: int) -> np.uint64:
    return np.uint64(n * int(_M3) % (1 << 64))


def window_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive entries of h, by their first position (len(h) - n + 1 of them)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, _length_seed(n), np.uint64)
    for i in range(n):
        out += h[i : i + m] * _ODD[i % 100] if i < 100 else mix(h[i : i + m] + np.uint64(i))
    return mix(out)


def sequence_hash(h: np.ndarray) -> np.uint64:
    """Hash of one whole sequence, equal to its entry in window_hash."""
    return window_hash(h, len(h))[0]


def shingles(words: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every n-word shingle; fewer words, but not none, are one shingle."""
    counts = words.counts
    h = window_hash(words.hash, n)
    doc = words.doc_of_word()
    whole = doc[: len(h)] == doc[n - 1 : n - 1 + len(h)] if len(h) else np.zeros(0, bool)
    docs, hashes = doc[: len(h)][whole], h[whole]
    if len(short := np.flatnonzero((counts > 0) & (counts < n))):
        extra = np.array([sequence_hash(words.hash[words.bounds[k] : words.bounds[k + 1]]) for k in short], np.uint64)
        docs, hashes = np.concatenate([docs, short]), np.concatenate([hashes, extra])
    return docs, hashes


def shingle_sets(words: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every document in ascending order, and each document's bounds in them."""
    docs, hashes = shingles(words, n)
    order = np.lexsort((hashes, docs))
    docs, hashes = docs[order], hashes[order]
    if len(docs):
        new = np.ones(len(docs), bool)
        new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
        docs, hashes = docs[new], hashes[new]
    return hashes, np.searchsorted(docs, np.arange(words.n_docs + 1))
