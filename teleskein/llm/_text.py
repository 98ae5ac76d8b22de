"""Vectorised text kernels over Arrow string columns.

A *word* is a maximal run of bytes that are ASCII letters, digits, ``_`` or part of a
multi-byte UTF-8 character; ASCII and Latin-1 letters are case-folded before hashing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 64), _BASE, np.uint64)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers


def string_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty run."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def slices(batches, column: str, limit: int = CHUNK_BYTES):
    """Record batches cut so that each holds about ``limit`` bytes of text, and one row at least."""
    for batch in batches:
        offs = string_column(batch.column(column))[1]
        at = 0
        while at < len(offs) - 1:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def _fold(buf: np.ndarray) -> np.ndarray:
    low = _LOWER[buf]
    at = np.flatnonzero(buf[:-1] == 0xC3) + 1 if len(buf) else np.zeros(0, np.int64)
    if len(at):
        b = buf[at]
        at = at[(b >= 0x80) & (b <= 0x9E) & (b != 0x97)]
        low[at] += 0x20
    return low


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash, pointer): words of document i are [pointer[i], pointer[i + 1])."""
    if len(buf) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    is_word = _IS_WORD[buf]
    begin = is_word.copy()
    begin[1:] &= ~is_word[:-1]
    firsts = offs[:-1][offs[:-1] < len(buf)]
    begin[firsts] = is_word[firsts]
    finish = is_word.copy()
    finish[:-1] &= ~is_word[1:]
    lasts = offs[1:][offs[1:] > 0] - 1
    finish[lasts] = is_word[lasts]
    start, end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    low = _fold(buf)
    out = np.empty(len(start), np.uint64)
    a = 0
    while a < len(start):  # slices bound the wide temporaries, also within one very long document
        b = max(a + 1, int(np.searchsorted(end, start[a] + CHUNK_BYTES, "right")))
        length = end[a:b] - start[a:b]
        heads = np.cumsum(length) - length
        place = np.arange(int(length.sum())) - np.repeat(heads, length)
        chars = low[start[a] : end[b - 1]][is_word[start[a] : end[b - 1]]]
        terms = _BYTE_VALUE[chars]
        terms *= _power(int(length.max()))[place]
        out[a:b] = np.add.reduceat(terms, heads)
        a = b
    return start, end, mix64(out), np.searchsorted(start, offs).astype(np.int64)


def word_hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(words(raw, np.array([0, len(raw)]))[2][0])


def ngrams(hashes: np.ndarray, pointer: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, gram): word n-grams; a document of 1 to n - 1 words gives one gram of all its words."""
    count = np.diff(pointer)
    total = np.zeros(len(hashes), np.uint64)
    for k in range(n):
        part = mix64(hashes + np.uint64(0x632BE59BD9B4E019 * (k + 1) % 2**64))
        total[: len(hashes) - k or None] += part[k:]
    have = np.where(count >= n, count - n + 1, 0)
    doc = np.repeat(np.arange(len(count)), have)
    at = np.arange(int(have.sum())) - np.repeat(np.cumsum(have) - have, have) + pointer[:-1][doc]
    grams = mix64(total[at])
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.array([_short(hashes[pointer[i] : pointer[i + 1]]) for i in short], np.uint64)
        doc, grams = np.concatenate([doc, short]), np.concatenate([grams, extra])
    return doc, grams


def _short(hashes: np.ndarray) -> int:
    part = [mix64(hashes[k : k + 1] + np.uint64(0x632BE59BD9B4E019 * (k + 1) % 2**64))[0] for k in range(len(hashes))]
    return int(mix64(np.array([np.add.reduce(np.array(part, np.uint64))], np.uint64))[0])


def gram_sets(hashes: np.ndarray, pointer: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, gram), ordered by document and gram."""
    doc, gram = ngrams(hashes, pointer, n)
    order = np.lexsort((gram, doc))
    doc, gram = doc[order], gram[order]
    if len(doc):
        keep = np.ones(len(doc), bool)
        keep[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
        doc, gram = doc[keep], gram[keep]
    return doc, gram
