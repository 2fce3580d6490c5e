"""Shared helpers: word hashing over Arrow batches, names; written tables and checked broadcasts come from the library."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..scratch import broadcast_if_small, materialise, scratch_path

__all__ = ["broadcast_if_small", "fresh_name", "materialise", "mix", "scratch_path", "shingle_sets", "utf8", "word_hashes"]


def fresh_name(df: DataFrame, base: str) -> str:
    """``base``, lengthened until it clashes with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and each row's offsets in them; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if column.offset:
        column = pa.concat_arrays([column])
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), at


# Word hashing: bytes of a word, lower-cased (A-Z), times powers of an odd number, summed and mixed.
_R = np.random.default_rng(20240229)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = _R.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_BYTE[_SPACE] = 0
_POWER = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))
BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _block(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and word starts of ``data``; ``cuts``: offsets at which a new row begins."""
    space = _SPACE[data]
    first = ~space
    head = first.copy()
    head[1:] &= space[:-1]
    inside = cuts[cuts < len(data)]
    head[inside] |= first[inside]
    starts = np.flatnonzero(head)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    place = np.arange(len(data)) - starts[np.maximum(np.cumsum(head) - 1, 0)]
    value = _BYTE[data] * _POWER[place & 4095]
    return mix(np.add.reduceat(value, starts)), starts


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all rows, and each row's offsets in them.

    Works in blocks of about 1 MB, so a very long text needs little more memory than its words.
    """
    hashes, starts, low, end = [], [], int(offsets[0]), int(offsets[-1])
    while low < end:
        high = min(low + BLOCK, end)
        if high < end:
            row = int(offsets[np.searchsorted(offsets, high, "right") - 1])
            if row > low:
                high = row
            else:  # inside a long text: cut at white space
                while high < end and not _SPACE[data[high]]:
                    high += 1
        a, b = np.searchsorted(offsets, (low, high))
        h, s = _block(data[low:high], offsets[a:b] - low)
        hashes.append(h)
        starts.append(s + low)
        low = high
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


_PLACE = _R.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, words: int = 5):
    """For each row its sorted distinct word-shingle hashes; fewer words: the whole sequence as one."""
    if words > len(_PLACE):
        raise ValueError(f"at most {len(_PLACE)} words in a shingle")
    data, offsets = utf8(column)
    hashes, at = word_hashes(data, offsets)
    for low, high in zip(at[:-1], at[1:]):
        h = hashes[low:high]
        if len(h) == 0:
            yield np.empty(0, np.uint64)
            continue
        n = max(1, len(h) - words + 1)
        s = np.zeros(n, np.uint64)
        for j in range(min(words, len(h))):
            s += h[j : j + n] * _PLACE[j]
        s = np.sort(mix(s + np.uint64(min(len(h), words))))
        yield s[np.concatenate(([True], s[1:] != s[:-1]))] if n > 1 else s
