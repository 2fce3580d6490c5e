"""Counting k-mers by minimizer: windows that follow each other travel as one packed string.

The minimizer of a window is the least hash among its canonical m-mers, so a k-mer and its reverse complement share it. Consecutive windows
with one minimizer form a super-k-mer, which is shuffled as two bits a base; a k-mer's windows all meet at its minimizer. There super-k-mers are
expanded to packed words and sorted, and each k-mer comes out once, with its sources. Sources travel as a hash of their tuple.

A minimizer with more than ``HOT`` windows is dealt over as many tasks as that takes by the place of its super-k-mers; what these find of one k-mer is merged after a
second shuffle, by k-mer, of the hot minimizers' k-mers only. A task holds one such part, or minimizers of ``CHUNK`` windows together, at a time.

Null and short sequences have no windows; windows with other letters than A, C, G and T (in either case) don't count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import broadcast_if_small, materialise

M = 15
BLOCK, CHUNK, HOT = 1 << 18, 1 << 19, 1 << 20
_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate(b"ACGT"):
    _CODE[_c] = _CODE[_c + 32] = _i
_LETTER = np.frombuffer(b"ACGT", np.uint8)
_NONE = np.uint64(2**64 - 1)

RUNS = "minimizer long, source long, start long, n int, bases binary"


def minimizer_length(k: int) -> int:
    """Odd, so that no m-mer is its own reverse complement, and short enough that runs are long."""
    m = min(M, max(1, k // 2))
    return m - 1 + m % 2 if m > 1 else 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        x, step = np.minimum(x[:-step], x[step:]), step * 2
    return np.minimum(x[: step - width], x[width - step :]) if step < width else x


def minimizers(codes: np.ndarray, k: int, m: int, both: bool = True) -> np.ndarray:
    """Minimizer of each window of ``codes`` (0 to 3; others end windows), the greatest value where a window holds another code. ``both``: of both strands."""
    n = len(codes)
    forward, back = np.zeros(n - m + 1, np.uint64), np.zeros(n - m + 1, np.uint64)
    for j in range(m):
        c = codes[j : n - m + 1 + j].astype(np.uint64)
        forward = forward << np.uint64(2) | (c & np.uint64(3))
        back |= (np.uint64(3) - (c & np.uint64(3))) << np.uint64(2 * j)
    bad = np.concatenate(([0], np.cumsum(codes > 3)))
    h = np.minimum(_mix(np.minimum(forward, back) if both else forward), _NONE - np.uint64(1))
    out = _least(h, k - m + 1)
    out[bad[k:] != bad[: n - k + 1]] = _NONE
    return out


def _utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = pa.concat_arrays([column.cast(pa.large_string())]).fill_null("") if column.null_count else pa.concat_arrays([column.cast(pa.large_string())])
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), at


def _pack(codes: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.Array:
    """Stretches of codes as binary values, four bases a byte."""
    padded = -(-size // 4)
    ends = np.concatenate(([0], np.cumsum(padded)))
    nth = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out = np.zeros(int(ends[-1]) * 4, np.uint8)
    out[np.repeat(ends[:-1] * 4, size) + nth] = codes[np.repeat(first, size) + nth]
    out = out.reshape(-1, 4)
    raw = out[:, 0] << 6 | out[:, 1] << 4 | out[:, 2] << 2 | out[:, 3]
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])


def _cut(k: int):
    """(source, sequence) to super-k-mers."""
    m = minimizer_length(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sources = b.column(0).to_numpy()
            data, offsets = _utf8(b.column(1))
            low, end = int(offsets[0]), int(offsets[-1])
            while low < end:
                high = min(low + BLOCK, end)
                codes = _CODE[data[low : min(high + k - 1, end)]]
                if len(codes) >= k:
                    least = minimizers(codes, k, m)[: high - low]
                    row = np.searchsorted(offsets, np.arange(low, low + len(least)), "right") - 1
                    ok = (least != _NONE) & (np.arange(low, low + len(least)) + k <= offsets[row + 1])
                    new = np.ones(len(least), bool)
                    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | (ok[1:] != ok[:-1])
                    first = np.flatnonzero(new)
                    n = np.diff(first, append=len(least))
                    first, n = first[ok[first]], n[ok[first]]
                    if len(first):
                        r = row[first]
                        yield pa.RecordBatch.from_arrays([pa.array(least[first].view(np.int64)), pa.array(sources[r]), pa.array(first + low - offsets[r]), pa.array(n.astype(np.int32)), _pack(codes, first, n + k - 1)], ["minimizer", "source", "start", "n", "bases"])
                low = high

    return run


def super_kmers(df: DataFrame, k: int, source: Column, seq_col: str = "seq") -> DataFrame:
    """minimizer, source (a long), start, n (windows) and packed bases of each super-k-mer of ``df``'s sequences."""
    return df.select(source.cast("long").alias("source"), F.col(seq_col).cast("string").alias("seq")).filter(F.length("seq") >= k).mapInArrow(_cut(k), RUNS)


def _words(codes: np.ndarray, starts: np.ndarray, k: int) -> list[np.ndarray]:
    """The windows at ``starts`` as words of 32 bases, two bits each; the last word holds what is left in its low bits. ``codes`` has 32 bases more than the last window."""
    v, step = codes.astype(np.uint64), 1
    while step < 32:
        v, step = v[: len(v) - step] << np.uint64(2 * step) | v[step:], step * 2
    words = [v[starts + 32 * i] for i in range(k // 32)]
    if k % 32:
        words.append(v[starts + k // 32 * 32] >> np.uint64(2 * (32 - k % 32)))
    return words


#: The letters of four bases in a byte.
_LETTERS = _LETTER[np.arange(256)[:, None] >> np.array([6, 4, 2, 0]) & 3].copy().view(np.uint32).ravel()


def _letters(words: list[np.ndarray], k: int) -> np.ndarray:
    """Packed words as rows of letters."""
    parts = []
    for i, w in enumerate(words):
        size = min(32, k - 32 * i)
        raw = (w << np.uint64(64 - 2 * size)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, : -(-size // 4)]
        parts.append(_LETTERS[raw].view(np.uint8)[:, :size])
    return parts[0] if len(parts) == 1 else np.concatenate(parts, 1)


def _strings(words: list[np.ndarray], k: int) -> pa.Array:
    """Packed words as a string column."""
    n = len(words[0])
    out = np.ascontiguousarray(_letters(words, k))
    return pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int64) * k).tobytes()), pa.py_buffer(out.tobytes())]).cast(pa.string())


def expand(raw: np.ndarray, size: np.ndarray, n: np.ndarray, k: int, both: bool = True) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Words (canonical if ``both``) of all windows of packed super-k-mers (of ``size`` bytes and ``n`` windows each, one after the other), each window's super-k-mer, and its place in there."""
    codes = np.stack((raw >> 6, raw >> 4 & 3, raw >> 2 & 3, raw & 3), 1).ravel()
    at = (np.cumsum(size) - size) * 4
    of = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    starts, pad = at[of] + nth, np.zeros(64, np.uint8)
    forward = _words(np.concatenate((codes, pad)), starts, k)
    if not both:
        return forward, of, nth
    back = _words(np.concatenate((3 - codes[::-1], pad)), len(codes) - starts - k, k)
    less, same = np.zeros(len(of), bool), np.ones(len(of), bool)
    for f, r in zip(forward, back):
        less |= same & (r < f)
        same &= r == f
    return [np.where(less, r, f) for f, r in zip(forward, back)], of, nth


_GROUPED = "k int, kmer string, sources array<long>, positions array<long>, partial boolean"


def _group(k: int):
    """Super-k-mers sorted by (minimizer, salt) to one row a k-mer, or one a k-mer and part of a hot minimizer: sources in order and the first position in each."""

    def judge(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, start, n, bases, partial = (pa.concat_arrays([p.column(i) for p in parts]) for i in range(2, 7))
        _, offsets, data = bases.buffers()
        offsets = np.frombuffer(offsets, np.int32, len(bases) + bases.offset + 1)[bases.offset :]
        words, of, nth = expand(np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], np.diff(offsets).astype(np.int64), n.to_numpy().astype(np.int64), k)
        ids, which = np.unique(source.to_numpy(), return_inverse=True)
        # A source's rank and a position in one number: positions are below 2^40.
        place = which[of] << 40 | start.to_numpy()[of] + nth
        hot = partial.to_numpy(zero_copy_only=False)[of]
        order = np.lexsort((place, *words[::-1]))
        words, place, hot = [w[order] for w in words], place[order], hot[order]
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([w[1:] != w[:-1] for w in words])
        each = new.copy()
        each[1:] |= place[1:] >> 40 != place[:-1] >> 40
        first = np.flatnonzero(new)
        ends = np.concatenate(([0], np.cumsum(np.add.reduceat(each.astype(np.int64), first))))
        source, position = ids[place[each] >> 40], place[each] & ((1 << 40) - 1)
        words, hot = [w[first] for w in words], hot[first]
        for i in range(0, len(first), 1 << 16):
            part = slice(i, min(i + (1 << 16), len(first)))
            cut = ends[part.start : part.stop + 1]
            lists = [pa.ListArray.from_arrays(pa.array((cut - cut[0]).astype(np.int32)), pa.array(v[cut[0] : cut[-1]])) for v in (source, position)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(part.stop - part.start, k, np.int32)), _strings([w[part] for w in words], k), *lists, pa.array(hot[part])], ["k", "kmer", "sources", "positions", "partial"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, last = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            minimizer, salt = b.column(0).to_numpy(), b.column(1).to_numpy()
            new = np.ones(b.num_rows, bool)
            new[1:] = (minimizer[1:] != minimizer[:-1]) | (salt[1:] != salt[:-1])
            new[0] = last is not None and (minimizer[0], salt[0]) != last
            last = minimizer[-1], salt[-1]
            # Windows before each row; chunks end where a minimizer does, at the first such place that makes them large enough.
            before = np.concatenate(([0], np.cumsum(b.column(4).to_numpy(), dtype=np.int64)))
            cuts, low = np.flatnonzero(new), 0
            while (i := int(np.searchsorted(before[cuts], before[low] + CHUNK - count))) < len(cuts):
                held.append(b.slice(low, cuts[i] - low))
                yield from judge(held)
                held, count, low, cuts = [], 0, int(cuts[i]), cuts[i + 1 :]
            held.append(b.slice(low))
            count += int(before[-1] - before[low])
        if held:
            yield from judge(held)

    return run


def group_windows(df: DataFrame, k: int, source: Column, seq_col: str = "seq") -> DataFrame:
    """k, kmer (canonical), sources (distinct, in order) and the first position in each, one row per distinct k-mer of all sequences."""
    runs = materialise(super_kmers(df, k, source, seq_col), "super-kmers")
    hot = runs.groupBy("minimizer").agg(F.sum("n").alias("_n")).filter(F.col("_n") > HOT).select("minimizer", F.ceil(F.col("_n") / HOT).alias("_parts"))
    dealt = runs.join(broadcast_if_small(materialise(hot, "hot")), "minimizer", "left")
    salt = F.coalesce(F.pmod(F.xxhash64("source", "start", "bases"), F.col("_parts")), F.lit(0)).cast("int")
    dealt = dealt.select("minimizer", salt.alias("salt"), "source", "start", "n", "bases", F.col("_parts").isNotNull().alias("partial"))
    found = dealt.repartition("minimizer", "salt").sortWithinPartitions("minimizer", "salt").mapInArrow(_group(k), _GROUPED)
    found = materialise(found, "kmers")
    items = found.filter("partial").select("k", "kmer", F.explode(F.arrays_zip("sources", "positions")).alias("x"))
    items = items.groupBy("k", "kmer", F.col("x.sources").alias("source")).agg(F.min("x.positions").alias("position"))
    merged = items.groupBy("k", "kmer").agg(F.sort_array(F.collect_list(F.struct("source", "position"))).alias("x"))
    return found.filter("not partial").drop("partial").unionByName(merged.select("k", "kmer", F.col("x.source").alias("sources"), F.col("x.position").alias("positions")))
