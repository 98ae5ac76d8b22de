"""Documents coded in chunks of words, and compact messages between chunks and the parts of a hash space.

A chunk holds about CHUNK_TOKENS words of some documents. What it asks of the whole corpus goes, once for
each distinct key, to the part whose range of the 64-bit key space holds it; answers come back in the
order of the keys, so they need no keys of their own.
"""

from __future__ import annotations

import numpy as np
import zstandard

CHUNK_TOKENS = 1 << 20


def wrap(values: np.ndarray) -> bytes:
    """Compressed by byte planes: the high bytes of small numbers cost next to nothing."""
    values = np.ascontiguousarray(values)
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes())


def unwrap(blob: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def wrap_keys(keys: np.ndarray) -> bytes:
    return wrap(np.diff(keys, prepend=np.uint64(0)))


def unwrap_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(unwrap(blob, np.uint64), dtype=np.uint64)


def numbered(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each code among the distinct ones in order, first place of each, how often it occurs). Codes are whole and not negative."""
    n = len(code)
    bits = n.bit_length()
    if n == 0 or int(code.max()).bit_length() + bits > 64:
        _, first, inverse, times = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
        return inverse, first, times
    packed = (code.astype(np.uint64) << np.uint64(bits)) | np.arange(n, dtype=np.uint64)
    packed.sort()  # plain sorts of numbers are many times faster than sorts of places
    place = (packed & np.uint64((1 << bits) - 1)).astype(np.int64)
    value = packed >> np.uint64(bits)
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(value[1:], value[:-1], out=new[1:])
    head = np.flatnonzero(new)
    inverse = np.empty(n, np.int64)
    inverse[place] = np.cumsum(new) - 1
    return inverse, place[head], np.diff(np.append(head, n))


def by_part(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the keys, where each part begins in it): a part holds a range of keys, which are hashes. Keys that agree in their high bits come in the order in which they stand."""
    bits = np.uint64(max(len(keys), 1).bit_length())
    packed = keys >> bits << bits | np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    order = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    part = ((keys[order] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    # keys of equal high bits may lie on both sides of a border: a stable sort puts them right
    if len(part) and (part[1:] < part[:-1]).any():
        again = np.argsort(part, kind="stable")
        order, part = order[again], part[again]
    return order, np.searchsorted(part, np.arange(parts + 1))


def wrap_small(values: np.ndarray) -> bytes:
    """Whole numbers, not negative, in the narrowest type that holds them all."""
    most = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    return bytes([width]) + wrap(values.astype(f"u{width}"))


def unwrap_small(blob: bytes) -> np.ndarray:
    return unwrap(blob[1:], f"u{blob[0]}").astype(np.int64)


def same(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each key among the distinct ones, a place where each of these stands)."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    at = np.empty(len(keys), np.int64)
    at[order] = np.cumsum(new) - 1
    return at, order[new]


def wrap_ranks(ranks: np.ndarray) -> bytes:
    """Whole numbers, not negative, that rise but for few: by their steps."""
    steps = np.diff(ranks, prepend=0)
    width = 4 if not len(ranks) or int(ranks.max()) < 1 << 31 else 8
    return bytes([width]) + wrap(steps.astype(f"i{width}"))


def unwrap_ranks(blob: bytes) -> np.ndarray:
    return np.cumsum(unwrap(blob[1:], f"i{blob[0]}"), dtype=np.int64)
