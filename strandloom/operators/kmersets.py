"""K-mers with the sets of sources that hold them, folded where they meet: nothing per k-mer is written.

Windows travel as super-k-mers (see ``superkmers``). A task cuts ``LOAD`` bases at a time, adds up equal super-k-mers of one source, and sends one
packed row for each of ``BUCKETS`` ranges of minimizers, so a repeated passage is sent once for each such load, however often it occurs. Behind the
shuffle about ``CHUNK`` windows are expanded and sorted at a time. Three results come from that: ``fold_sets``, a row for each distinct set of sources, with how many k-mers
have exactly that set (there may be nearly as many sets as k-mers); ``fold_judged`` and ``first_judged``, the number and the first k-mers of each class that judging tells apart; and ``sourced_kmers``, a row for each k-mer, or only for those that other sequences hold (``only``), which are sent along under a mark.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .superkmers import _CODE, _mix, _strings, _utf8, _words, expand, minimizers

LOAD, BLOCK, CHUNK, BUCKETS = 1 << 24, 1 << 18, 1 << 20, 1 << 12
#: The source of the sequences in ``only``; sources are hashes of 63 bits, so none equals it.
MARK = -(2**63)
_FAR = np.int64(2**62)
_PACKED = "bucket int, windows long, sources array<long>, orders array<string>, data binary"
_SETS = "k int, sources array<long>, n_kmers long, first_kmer string, last_kmer string, positions long, counts array<long>"
_KMERS = "k int, kmer string, sources array<long>, example_position long, counts array<long>, firsts array<long>"


def minimizer_length(k: int) -> int:
    """Long enough that there are far more minimizers than buckets; odd, so that no m-mer is its own reverse complement."""
    m = min(15, max(1, k // 2, k - 8 if k > 15 else k - 6), k)
    return m - 1 + m % 2 if m > 1 else 1


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x.astype(np.uint8)


def _sizes(k: int) -> list[int]:
    """Bytes of each word of a super-k-mer's bases."""
    total = -(-(2 * k - minimizer_length(k)) // 4)
    return [min(8, total - i) for i in range(0, total, 8)]


def _cut(k: int, both: bool, apart: bool = False):
    """(source, order, sequence) to packed rows by bucket. ``apart``: super-k-mers are equal only where they start at the same position, too."""
    m = minimizer_length(k)
    most = k - m + 1
    width = -(-(most + k - 1) // 32)

    def load(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = np.concatenate([b.column(0).to_numpy() for b in batches])
        order = pa.concat_arrays([b.column(1) for b in batches])
        data, offsets = _utf8(pa.concat_arrays([b.column(2) for b in batches]))
        ids, at, of = np.unique(source, return_index=True, return_inverse=True)
        names = order.take(pa.array(at)).to_pylist()
        found, low, end = [], int(offsets[0]), int(offsets[-1])
        while low < end:
            high = min(low + BLOCK, end)
            codes = _CODE[data[low : min(high + k - 1, end)]]
            if len(codes) >= k:
                least = minimizers(codes, k, m, both)[: high - low]
                places = np.arange(low, low + len(least))
                row = np.searchsorted(offsets, places, "right") - 1
                ok = (least != np.uint64(2**64 - 1)) & (places + k <= offsets[row + 1])
                new = np.ones(len(least), bool)
                new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | (ok[1:] != ok[:-1])
                first = np.flatnonzero(new)
                n = np.diff(first, append=len(least))
                first, n = first[ok[first]], n[ok[first]]
                parts = -(-n // most)
                if len(n) and parts.max() > 1:
                    nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
                    first, n = np.repeat(first, parts) + nth * most, np.minimum(np.repeat(n, parts) - nth * most, most)
                if len(first):
                    words = _words(np.concatenate((codes & 3, np.zeros(32 * width, np.uint8))), first, 32 * width)
                    for i in range(width):
                        drop = np.clip(64 - 2 * (n + k - 1 - 32 * i), 0, 64).astype(np.uint64)
                        words[i] = np.where(drop < 64, words[i] >> np.minimum(drop, 63) << np.minimum(drop, 63), np.uint64(0))
                    found.append((least[first] & np.uint64(BUCKETS - 1), of[row[first]], first + low - offsets[row[first]], n.astype(np.uint16), *words))
            low = high
        if not found:
            return
        bucket, src, start, n, *words = (np.concatenate(x) for x in zip(*found))
        h = src.astype(np.uint64) << np.uint64(16) | n
        for w in (*words, start.astype(np.uint64)) if apart else words:
            h = _mix(h ^ w)
        key = np.argsort(bucket << np.uint64(52) | h >> np.uint64(12))
        bucket, src, start, n, words = bucket[key], src[key], start[key], n[key], [w[key] for w in words]
        new = np.ones(len(key), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (src[1:] != src[:-1]) | (n[1:] != n[:-1]) | np.logical_or.reduce([w[1:] != w[:-1] for w in ([*words, start] if apart else words)])
        first = np.flatnonzero(new)
        count, start = np.diff(first, append=len(key)), np.minimum.reduceat(start, first)
        bucket, src, n, words = bucket[first], src[first], n[first], [w[first] for w in words]
        # Of each word, the bytes that can hold bases.
        raw, sizes = [w.astype(">u8").view(np.uint8).reshape(-1, 8) for w in words], _sizes(k)
        cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
        rows = []
        for a, b in zip(cuts, cuts[1:]):
            here, s = np.unique(src[a:b], return_inverse=True)
            columns = [_narrow(n[a:b]), _narrow(s), _narrow(start[a:b]), _narrow(count[a:b])]
            head = np.array([b - a, *(c.itemsize for c in columns)], "<u4").tobytes()
            windows = int(n[a:b].sum(dtype=np.int64))
            rows.append((int(bucket[a]), windows, ids[here].tolist(), [names[i] for i in here], head + b"".join(c.tobytes() for c in columns) + b"".join(w[a:b, :size].tobytes() for w, size in zip(raw, sizes))))
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary()]
        for i in range(0, len(rows), 1024):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 1024]), kinds)], ["bucket", "windows", "sources", "orders", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.column(2).nbytes
            if size >= LOAD:
                yield from load(held)
                held, size = [], 0
        if held:
            yield from load(held)

    return run


def _reverse(w: np.ndarray, k: int) -> np.ndarray:
    """Reverse complements of k-mers packed in one word."""
    w = ~w
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        w = (w >> np.uint64(shift)) & np.uint64(mask) | (w & np.uint64(mask)) << np.uint64(shift)
    return w.byteswap() >> np.uint64(64 - 2 * k)


def _genome(order: str) -> bytes:
    """What positions are ordered by: an order that is a JSON list holds it first."""
    return ((json.loads(order)[0] or "") if order.startswith("[") else order).encode()


class _Chunk:
    """The k-mers of some buckets in order. ``words``: of each k-mer; ``at``: its first pair and one more; ``src``, ``first``, ``count`` of each pair (k-mer, source).
    With ``apart``, ``count`` is the number of its distinct positions."""

    def __init__(self, batches: list[pa.RecordBatch], k: int, both: bool, marked: bool, least: int, apart: bool = False):
        sizes, parts, orders = _sizes(k), [], {}
        width = len(sizes)
        for b in batches:
            for source, order, data in zip(b.column(2), b.column(3), b.column(4)):
                source = source.values.to_numpy()
                mine = source.tolist()
                if not orders.keys() >= set(mine):
                    orders.update(zip(mine, order.as_py()))
                data = data.as_py()
                n, *widths = map(int, np.frombuffer(data, "<u4", 5))
                place, columns = 20, []
                for size in widths:
                    columns.append(np.frombuffer(data, f"<u{size}", n, place))
                    place += n * size
                for size in sizes:
                    w = np.zeros((n, 8), np.uint8)
                    w[:, :size] = np.frombuffer(data, np.uint8, n * size, place).reshape(n, size)
                    columns.append(w.view(">u8").ravel().astype(np.uint64))
                    place += n * size
                columns[1] = source[columns[1]]
                parts.append(columns)
        n, source, start, count, *words = (np.concatenate(x) for x in zip(*parts))
        n, start, count = n.astype(np.int64), start.astype(np.int64), count.astype(np.int64)
        self.ids, src = np.unique(source, return_inverse=True)
        if width == 1:
            of = np.repeat(np.arange(len(n)), n)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            w = words[0][of] << (2 * nth).astype(np.uint64) >> np.uint64(64 - 2 * k)
            words = [np.minimum(w, _reverse(w, k)) if both else w]
        else:
            raw = np.stack(words, 1).byteswap().view(np.uint8).ravel()
            words, of, nth = expand(raw, np.full(len(n), 8 * width), n, k, both)
        src, first, count = src[of], start[of] + nth, count[of]
        bits = max(1, int(len(self.ids) - 1).bit_length())
        if apart:
            order = np.lexsort((first, src, *words[::-1]))
        elif len(words) == 1 and 2 * k + bits <= 64:
            order = np.argsort(words[0] << np.uint64(bits) | src.astype(np.uint64))
        else:
            order = np.lexsort((src, *words[::-1]))
        words, src = [w[order] for w in words], src[order]
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([w[1:] != w[:-1] for w in words])
        pair = new.copy()
        pair[1:] |= src[1:] != src[:-1]
        at = np.flatnonzero(pair)
        first, count = first[order], count[order]
        if apart:
            count = (pair | np.concatenate(([True], first[1:] != first[:-1]))).astype(np.int64)
        first, count = np.minimum.reduceat(first, at), np.add.reduceat(count, at)
        words, src, new = [w[at] for w in words], src[at], new[at]
        if marked:
            mark = self.ids[src] == MARK
            wanted = np.logical_or.reduceat(mark, np.flatnonzero(new))
            keep = np.repeat(wanted, np.diff(np.flatnonzero(new), append=len(new))) & ~mark
            # The mark is the least source, so its pair is the first of its k-mer.
            moved = np.concatenate(([False], new[:-1] & mark[:-1]))
            new = (new | moved)[keep]
            words, src, first, count = [w[keep] for w in words], src[keep], first[keep], count[keep]
        if least > 1 and len(src):
            starts = np.flatnonzero(new)
            keep = np.repeat(np.add.reduceat(count, starts) >= least, np.diff(starts, append=len(new)))
            new, words, src, first, count = new[keep], [w[keep] for w in words], src[keep], first[keep], count[keep]
        starts = np.flatnonzero(new)
        self.at = np.append(starts, len(src)).astype(np.int64)
        self.words, self.src, self.first, self.count = [w[starts] for w in words], src, first, count
        if not len(starts):
            return
        self.orders = orders
        rank = {o: i for i, o in enumerate(sorted({_genome(o) for o in orders.values()}))}
        rank = np.array([rank[_genome(orders[i])] for i in self.ids.tolist()])[src]
        self.of = np.repeat(np.arange(len(starts)), np.diff(self.at))
        lead = rank == np.minimum.reduceat(rank, starts)[self.of]
        self.position = np.minimum.reduceat(np.where(lead, first, _FAR), starts)
        # One number for each set of sources: the source where it is alone, else a sum of hashes.
        self._mixed = lambda: np.add.reduceat(_mix(self.ids[src].view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)), starts)

    def number(self) -> None:
        """``which``: the number of each k-mer's set; ``lead``: the first k-mer of each."""
        _, self.lead, self.which = np.unique(self._mixed(), return_index=True, return_inverse=True)


def _chunks(batches: Iterator[pa.RecordBatch], k: int, both: bool, marked: bool, least: int, apart: bool = False) -> Iterator[_Chunk]:
    """Rows in order of bucket as chunks that end where a bucket does."""
    held, size, last = [], 0, None
    for b in batches:
        bucket, windows, low = b.column(0).to_numpy(), b.column(1).to_numpy(), 0
        for i in range(b.num_rows):
            if bucket[i] != last and size >= CHUNK:
                chunk = _Chunk([*held, b.slice(low, i - low)] if i > low else held, k, both, marked, least, apart)
                held, size, low = [], 0, i
                if len(chunk.at) > 1:
                    yield chunk
            size, last = size + int(windows[i]), bucket[i]
        held.append(b.slice(low))
    if size:
        chunk = _Chunk(held, k, both, marked, least, apart)
        if len(chunk.at) > 1:
            yield chunk


def _sets(k: int, both: bool, marked: bool):
    def write(sets: dict) -> pa.RecordBatch:
        rows = [(k, s, n, first, last, total, counts.tolist()) for s, (n, first, last, total, counts) in sets.items()]
        kinds = [pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["k", "sources", "n_kmers", "first_kmer", "last_kmer", "positions", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict = {}
        for c in _chunks(batches, k, both, marked, 1):
            c.number()
            n = np.bincount(c.which)
            total = np.zeros(len(n), np.int64)
            np.add.at(total, c.which, c.position)
            last = np.zeros(len(n), np.int64)
            last[c.which] = np.arange(len(c.which))  # the last assignment holds
            size = np.diff(c.at)[c.lead]
            base = np.cumsum(size) - size
            counts = np.zeros(int(size.sum()), np.int64)
            np.add.at(counts, base[c.which[c.of]] + np.arange(len(c.src)) - c.at[c.of], c.count)
            ends = [_strings([w[i] for w in c.words], k).to_pylist() for i in (c.lead, last)]
            for j, i in enumerate(c.lead):
                key = tuple(c.ids[c.src[c.at[i] : c.at[i + 1]]].tolist())
                mine = counts[base[j] : base[j] + size[j]]
                had = sets.get(key)
                if had is None:
                    sets[key] = (int(n[j]), ends[0][j], ends[1][j], int(total[j]), mine)
                else:
                    sets[key] = (had[0] + int(n[j]), min(had[1], ends[0][j]), max(had[2], ends[1][j]), had[3] + int(total[j]), had[4] + mine)
            if len(sets) > 1 << 17:
                yield write(sets)
                sets = {}
        if sets:
            yield write(sets)

    return run


#: Bits of a k-mer's sets of values, if these lie in words side by side; with more values than that, sets are sorted pairs.
BITS = 1024


def _each(c: _Chunk, lists: list[list], blank: bool = False) -> list[tuple[np.ndarray, np.ndarray, Callable[[int], tuple]]]:
    """For each list of the sources' values: for each k-mer a number of its set of values and how many they are; the set of a k-mer. Null and, unless ``blank``, blank values don't count."""
    known = [sorted({v for v in values if v is not None and (blank or v.strip())}) for values in lists]
    ends = np.cumsum([0, *map(len, known)]).tolist()
    if ends[-1] > BITS:
        return [_each(c, [values], blank)[0] if len(names) <= BITS else _pairs(c, values, names) for values, names in zip(lists, known)]
    masks = [0] * len(c.ids)
    for values, names, low in zip(lists, known, ends):
        at = {v: 1 << low + i for i, v in enumerate(names)}
        masks = [m | at.get(v, 0) for m, v in zip(masks, values)]
    words = [np.bitwise_or.reduceat(np.array([m >> i & 2**64 - 1 for m in masks], np.uint64)[c.src], c.at[:-1]) for i in range(0, max(1, ends[-1]), 64)]
    return [_masked(words, names, low) for names, low in zip(known, ends)]


def _masked(words: list[np.ndarray], names: list, low: int) -> tuple[np.ndarray, np.ndarray, Callable[[int], tuple]]:
    """What ``_each`` gives of the values that have the bits from ``low`` on."""
    mine = (1 << low + len(names)) - (1 << low)
    parts = {i: w & np.uint64(mine >> 64 * i & 2**64 - 1) for i, w in enumerate(words) if mine >> 64 * i & 2**64 - 1}
    number, size = np.zeros(len(words[0]), np.uint64), np.zeros(len(words[0]), np.int64)
    for w in parts.values():
        number = _mix(number) ^ w if len(parts) > 1 else w
        size += np.bitwise_count(w)
    return number, size, lambda i: tuple(v for j, v in enumerate(names, low) if int(parts[j // 64][i]) >> j % 64 & 1)


def _pairs(c: _Chunk, values: list, names: list) -> tuple[np.ndarray, np.ndarray, Callable[[int], tuple]]:
    at = {v: i for i, v in enumerate(names)}
    code = np.array([at.get(v, -1) for v in values], np.int64)[c.src]
    pairs = np.sort((c.of * (len(names) + 1) + code)[code >= 0])  # np.unique would hash them, which takes far longer
    pairs = pairs[np.diff(pairs, prepend=-1) != 0]
    of, code = pairs // (len(names) + 1), pairs % (len(names) + 1)
    size = np.bincount(of, minlength=len(c.at) - 1)
    number = np.zeros(len(size), np.uint64)
    np.add.at(number, of, _mix(code.astype(np.uint64) + np.uint64(1)))
    starts = np.concatenate(([0], np.cumsum(size)))
    return number, size, lambda i: tuple(names[j] for j in code[starts[i] : starts[i + 1]])


def _distinct(c: _Chunk, values: list, blank: bool = False) -> tuple[np.ndarray, np.ndarray, Callable[[int], tuple]]:
    return _each(c, [values], blank)[0]


def _ends(c: _Chunk, places: list) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest of the sources' places; _FAR and -1 where all are null."""
    known = sorted({p for p in places if p is not None})
    at = {p: i for i, p in enumerate(known)}
    low = np.array([at.get(p, len(known)) for p in places], np.int32)
    high = np.where(low < len(known), low, -1)
    known = np.array([*known, _FAR, -1], np.int64)
    return known[np.minimum.reduceat(low[c.src], c.at[:-1])], known[np.maximum.reduceat(high[c.src], c.at[:-1])]


def _hashed(*numbers: np.ndarray) -> np.ndarray:
    h = np.zeros(len(numbers[0]), np.uint64)
    for x in numbers:  # mixed from the start, as low and high are often equal
        h = _mix(h ^ x.view(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
    return h


def _judged(k: int, both: bool, marked: bool):
    """Folds by what judging a set needs: its clades and roles, the sources at both ends of the tree's order, whether its species is single."""
    names = ["k", "low", "high", "clades", "roles", "species", "n_kmers", "first_kmer", "last_kmer", "positions", "n_species", "n_genomes"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), *[pa.int64()], pa.string(), pa.string(), *[pa.int64()] * 3]

    def write(sets: dict) -> pa.RecordBatch:
        rows = [(k, *key, n, first, last, *total) for key, (n, first, last, total) in sets.items()]
        return pa.RecordBatch.from_arrays([pa.array(list(map(list, c)) if pa.types.is_list(t) else c, t) for c, t in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict = {}
        for c in _chunks(batches, k, both, marked, 1):
            of = [json.loads(c.orders[i]) for i in c.ids.tolist()]
            low, high = _ends(c, [x[1] for x in of])
            (clade, _, clades), (role, _, roles), (one, n_species, species), (_, n_genomes, _) = _each(c, [[x[i] for x in of] for i in (3, 4, 2, 0)])
            h = _hashed(low, high, clade, role, np.where(n_species == 1, one, np.uint64(0)))
            order = np.argsort(h)
            starts = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
            first, last = np.minimum.reduceat(order, starts), np.maximum.reduceat(order, starts)
            n = np.diff(starts, append=len(order))
            totals = np.stack([np.add.reduceat(x[order], starts) for x in (c.position, n_species, n_genomes)], 1).tolist()
            ends = [_strings([w[i] for w in c.words], k).to_pylist() for i in (first, last)]
            for j, i in enumerate(first.tolist()):
                key = (None if low[i] == _FAR else int(low[i]), None if high[i] < 0 else int(high[i]), clades(i), roles(i), species(i)[0] if n_species[i] == 1 else None)
                had = sets.get(key)
                mine = (int(n[j]), ends[0][j], ends[1][j], totals[j])
                sets[key] = mine if had is None else (had[0] + mine[0], min(had[1], mine[1]), max(had[2], mine[2]), [p + q for p, q in zip(had[3], mine[3])])
            if len(sets) > 1 << 17:
                yield write(sets)
                sets = {}
        if sets:
            yield write(sets)

    return run


_JUDGED = "k int, low long, high long, clades array<string>, roles array<string>, species string, n_kmers long, first_kmer string, last_kmer string, positions long, n_species long, n_genomes long"


_FIRST = "k int, kmer string, low long, high long, clades array<string>, roles array<string>, species string, taxid string, position long, n_species long, n_genomes long, n_taxids long"


def _common(c: _Chunk, paths: list[list[int] | None]) -> np.ndarray:
    """The last step that the paths of all of a k-mer's sources share, -1 where there is none; null paths don't count."""
    out = np.full(len(c.at) - 1, -1, np.int64)
    for j in range(max((len(p) for p in paths if p), default=0)):
        steps = sorted({p[j] for p in paths if p and len(p) > j})
        at = {step: i for i, step in enumerate(steps)}
        mine = [None if p is None else at[p[j]] if len(p) > j else -1 for p in paths]
        least = np.minimum.reduceat(np.array([len(steps) if i is None else i for i in mine], np.int32)[c.src], c.at[:-1])
        most = np.maximum.reduceat(np.array([-2 if i is None else i for i in mine], np.int32)[c.src], c.at[:-1])
        same = np.flatnonzero((least == most) & (least >= 0))
        out[same] = np.array(steps, np.int64)[least[same]]
    return out


def _first(k: int, most: int, placed: bool):
    """The first k-mers of each class of sets that judging tells apart; the sources' orders are [genome, low, species, clade, role, taxid, path]. ``placed``: only k-mers whose paths share a step,
    which is what judging needs of their places."""

    def write(classes: dict) -> Iterator[pa.RecordBatch]:
        for (_, clades, roles, species, taxid, *_), (words, columns) in classes.items():
            n = len(words[0])
            same = lambda v, t: pa.array([v] * n, t)
            low, high = (pa.array(v, mask=v == none) for v, none in ((columns[0], _FAR), (columns[1], -1)))
            texts = [same(list(v), pa.list_(pa.string())) for v in (clades, roles)] + [same(v, pa.string()) for v in (species, taxid)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int32)), _strings(words, k), low, high, *texts, *map(pa.array, columns[2:])], [x.split()[0] for x in _FIRST.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: dict = {}
        for c in _chunks(batches, k, True, False, 1):
            of = [json.loads(c.orders[i]) for i in c.ids.tolist()]
            node = _common(c, [x[6] for x in of])
            low, high = _ends(c, [x[1] for x in of])
            (clade, _, clades), (role, _, roles), (one, n_species, species), (single, n_taxids, taxid), (_, n_genomes, _) = _each(c, [[x[i] for x in of] for i in (3, 4, 2, 5, 0)])
            few = np.minimum(n_species, 2) * 3 + np.minimum(n_taxids, 2)
            h = _hashed(node, clade, role, few, np.where(n_species == 1, one, np.uint64(0)), np.where(n_taxids == 1, single, np.uint64(0)))
            at = np.flatnonzero(node >= 0) if placed else np.arange(len(node))
            if not len(at):
                continue
            order = at[np.argsort(h[at], kind="stable")]  # of one class, in order of k-mer
            starts = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
            columns = (low, high, c.position, n_species, n_genomes, n_taxids)
            for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(order)]):
                mine, lead = order[i : min(j, i + most)], order[i]
                key = (int(node[lead]), clades(lead), roles(lead), species(lead)[0] if n_species[lead] == 1 else None, taxid(lead)[0] if n_taxids[lead] == 1 else None, int(few[lead]))
                new = [w[mine] for w in c.words], [v[mine] for v in columns]
                if key in classes:
                    both = [[np.concatenate(x) for x in zip(*pair)] for pair in zip(classes[key], new)]
                    kept = np.lexsort(both[0][::-1])[:most]
                    new = [w[kept] for w in both[0]], [v[kept] for v in both[1]]
                classes[key] = new
            if len(classes) * most > 1 << 22:
                yield from write(classes)
                classes = {}
        yield from write(classes)

    return run


def _rows(k: int, both: bool, marked: bool, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches, k, both, marked, least):
            for low in range(0, len(c.at) - 1, 1 << 16):
                i = slice(low, low + (1 << 16))
                ends = c.at[low : low + (1 << 16) + 1]
                pair = slice(ends[0], ends[-1])
                lists = [pa.ListArray.from_arrays(pa.array((ends - ends[0]).astype(np.int32)), pa.array(v)) for v in (c.ids[c.src[pair]], c.count[pair], c.first[pair])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ends) - 1, k, np.int32)), _strings([w[i] for w in c.words], k), lists[0], pa.array(c.position[i]), *lists[1:]], ["k", "kmer", "sources", "example_position", "counts", "firsts"])

    return run


def _counted(k: int, both: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sources: dict = {}
        sizes: dict = {}

        def write() -> Iterator[pa.RecordBatch]:
            rows = [(s, None, None, *n) for s, n in sources.items()] + [(None, g, size, n, None) for (g, size), n in sizes.items()]
            if rows:
                kinds = [pa.int64(), pa.string(), *[pa.int64()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["source", "grp", "size", "n_kmers", "n_windows"])

        for c in _chunks(batches, k, both, False, 1):
            n, windows = np.bincount(c.src, minlength=len(c.ids)), np.zeros(len(c.ids), np.int64)
            np.add.at(windows, c.src, c.count)
            for s, a, b in zip(c.ids.tolist(), n.tolist(), windows.tolist()):
                had = sources.get(s, (0, 0))
                sources[s] = (had[0] + a, had[1] + b)
            groups = sorted({c.orders[s] for s in c.ids.tolist()})
            code = {g: i for i, g in enumerate(groups)}
            pairs, size = np.unique(c.of * len(groups) + np.array([code[c.orders[s]] for s in c.ids.tolist()])[c.src], return_counts=True)
            kinds, n = np.unique(np.stack((pairs % len(groups), size), 1), axis=0, return_counts=True) if len(groups) > 1 else (None, np.bincount(size))
            found = zip(kinds.tolist(), n.tolist()) if kinds is not None else (((0, i), m) for i, m in enumerate(n.tolist()) if m)
            for (g, i), m in found:
                sizes[groups[g], i] = sizes.get((groups[g], i), 0) + m
            if len(sources) + len(sizes) > 1 << 17:
                yield from write()
                sources, sizes = {}, {}
        yield from write()

    return run


def _targets(k: int):
    """Folds by what says whether a k-mer is a diagnostic one; the sources' orders are [lead, whether a target, species, taxid]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict = {}
        for c in _chunks(batches, k, True, False, 1):
            of, starts = [json.loads(c.orders[i]) for i in c.ids.tolist()], c.at[:-1]
            own, other, known = (np.array(x)[c.src] for x in ([x[1] is True for x in of], [x[1] is False for x in of], [x[1] is False and bool((x[3] or "").strip()) for x in of]))
            one, n_species, species = _distinct(c, [x[2] if x[1] is True else None for x in of], blank=True)
            own, known = np.logical_or.reduceat(own, starts), np.logical_or.reduceat(known, starts)
            hits = np.add.reduceat(np.where(other, c.count, 0), starts)
            h = _mix(_mix(np.where(n_species == 1, one, np.uint64(0))) ^ (n_species.astype(np.uint64) << np.uint64(1) | known))
            at = np.flatnonzero(own)
            if not len(at):
                continue
            _, lead, which = np.unique(h[at], return_index=True, return_inverse=True)
            totals = np.zeros((len(lead), 3), np.int64)
            np.add.at(totals, which, np.stack((np.ones(len(at), np.int64), c.position[at], hits[at]), 1))
            for i, total in zip(at[lead].tolist(), totals.tolist()):
                key = (species(i)[0] if n_species[i] == 1 else None, int(n_species[i]), bool(known[i]))
                sets[key] = [a + b for a, b in zip(sets.get(key, (0, 0, 0)), total)]
        if sets:
            kinds = [pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*((*key, *n) for key, n in sets.items())), kinds)], ["species", "n_species", "known", "n_kmers", "positions", "hits"])

    return run


def _with_sets(k: int, names: list[str], least: list[int], most: list[int], least_n: int, blank: bool):
    """A row for each k-mer whose sets have the sizes wanted; the sources' orders are [lead, whether their windows count, attributes]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches, k, True, False, 1):
            of = [json.loads(c.orders[i]) for i in c.ids.tolist()]
            n = np.add.reduceat(np.where(np.array([bool(x[1]) for x in of])[c.src], c.count, 0), c.at[:-1])
            sets = _each(c, [[x[2 + i] for x in of] for i in range(len(names))], blank)
            chosen = np.flatnonzero(np.logical_and.reduce([n >= least_n, *((size >= a) & (size <= b) for (_, size, _), a, b in zip(sets, least, most))]))
            for low in range(0, len(chosen), 1 << 16):
                at, lists = chosen[low : low + (1 << 16)], []
                for hashed, _, get in sets:
                    _, lead, which = np.unique(hashed[at], return_index=True, return_inverse=True)
                    lists.append(pa.array([list(get(i)) for i in at[lead].tolist()], pa.list_(pa.string())).take(pa.array(which)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), _strings([w[at] for w in c.words], k), pa.array(c.position[at]), pa.array(n[at]), *lists], ["k", "kmer", "example_position", "n", *names])

    return run


def _conflicts(k: int):
    """The records of k-mers with several values, or none, of both attributes; the sources' orders are [lead, one, other]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches, k, True, False, 1, apart=True):
            of = [json.loads(c.orders[i]) for i in c.ids.tolist()]
            wanted = np.logical_and.reduce([size != 1 for _, size, _ in _each(c, [[x[i] for x in of] for i in (1, 2)])])
            kinds = sorted({(x[1], x[2]) for x in of}, key=repr)
            code = np.array([kinds.index((x[1], x[2])) for x in of])[c.src]
            here = wanted[c.of]
            pairs, which = np.unique(c.of[here] * len(kinds) + code[here], return_inverse=True)
            n = np.zeros(len(pairs), np.int64)
            np.add.at(n, which, c.count[here])
            for low in range(0, len(pairs), 1 << 16):
                p = slice(low, low + (1 << 16))
                of_kmer, kind = pairs[p] // len(kinds), pa.array(pairs[p] % len(kinds))
                sides = [pa.array([x[i] for x in kinds], pa.string()).take(kind) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(of_kmer), k, np.int32)), _strings([w[of_kmer] for w in c.words], k), *sides, pa.array(n[p])], ["k", "kmer", "one", "other", "n"])

    return run


def _packed(df: DataFrame, k: int, source: Column, order: Column, seq_col: str, only: DataFrame | None, both: bool, apart: bool = False) -> DataFrame:
    if k <= 0:
        raise ValueError("k must be positive")
    rows = df.select(source.cast("long").alias("source"), F.coalesce(order.cast("string"), F.lit("")).alias("order"), F.col(seq_col).cast("string").alias("seq"))
    if only is not None:
        rows = rows.unionByName(only.select(F.lit(MARK).cast("long").alias("source"), F.lit("").alias("order"), F.col("seq").cast("string").alias("seq")))
    # Short sequences are left to the tasks: a filter here would go below the select and have every sequence made twice.
    return rows.mapInArrow(_cut(k, both, apart), _PACKED).repartition("bucket").sortWithinPartitions("bucket")


def fold_sets(df: DataFrame, k: int, source: Column, order: Column, seq_col: str = "seq", *, only: DataFrame | None = None, both: bool = True) -> DataFrame:
    """k, sources (in order), n_kmers, first_kmer, last_kmer, positions, counts: a row for each distinct set of sources. ``positions``: the sum of the k-mers'
    first positions, each among the sources of the least ``order``; ``counts``: windows of each source. ``both``: k-mers of both strands are one."""
    rows = _packed(df, k, source, order, seq_col, only, both).mapInArrow(_sets(k, both, only is not None), _SETS)
    total = [F.sum("n_kmers").alias("n_kmers"), F.min(F.struct("first_kmer"))["first_kmer"].alias("first_kmer"), F.max(F.struct("last_kmer"))["last_kmer"].alias("last_kmer"), F.sum("positions").alias("positions")]
    counts = F.collect_list("counts")
    return rows.groupBy("k", "sources").agg(*total, F.aggregate(counts, F.transform("sources", lambda _: F.lit(0).cast("long")), lambda a, x: F.zip_with(a, x, lambda p, q: p + q)).alias("counts"))


def _order(*columns: str) -> Column:
    """[genome, low, texts]: what judging needs of a source, a list as JSON; ``columns`` come last, as they are."""
    each = [_quoted("genome"), F.col("_low").cast("string"), *map(_quoted, ("species", "clade", "role")), *map(F.col, columns)]
    return F.concat(F.lit("["), F.concat_ws(",", *(F.coalesce(x, F.lit("null")) for x in each)), F.lit("]"))


def fold_judged(df: DataFrame, k: int, source: Column, low: Column, seq_col: str = "seq") -> DataFrame:
    """K-mers folded by what judging them needs: k, low and high (the least and greatest place of their sources in a tree), clades, roles, species (if it is single), n_kmers, first_kmer,
    last_kmer, and positions, n_species, n_genomes, summed over the k-mers. ``df``: genome, species, clade, role and the sequence; ``low`` a long, null if unknown."""
    rows = df.withColumns({"_low": low, "_source": source})
    rows = _packed(rows, k, F.col("_source"), _order(), seq_col, None, True).mapInArrow(_judged(k, True, False), _JUDGED)
    by = ("k", "low", "high", "clades", "roles", "species")
    sums = [F.sum(c).alias(c) for c in ("n_kmers", "positions", "n_species", "n_genomes")]
    return rows.groupBy(*by).agg(*sums, F.min(F.struct("first_kmer"))["first_kmer"].alias("first_kmer"), F.max(F.struct("last_kmer"))["last_kmer"].alias("last_kmer"))


def first_judged(df: DataFrame, k: int, source: Column, low: Column, path: Column | None, most: int, seq_col: str = "seq") -> DataFrame:
    """At least the first ``most`` k-mers of each class: k, kmer, low, high, clades, roles, species and taxid (if single), position, n_species, n_genomes, n_taxids. A class has its sets of clades and roles,
    its single species and taxid, and the last step that the ``path`` (an array of longs; null doesn't count) of all its sources share; without such a step a k-mer is left out. Each task keeps so many
    of a class, whatever the number of k-mers or of distinct sets of sources. ``df``, ``low``: see ``fold_judged``; and taxid."""
    rows = df.withColumns({"_low": low, "_source": source, "_path": F.lit(None).cast("string") if path is None else F.to_json(path), "_taxid": _quoted("taxid")})
    rows = _packed(rows, k, F.col("_source"), _order("_taxid", "_path"), seq_col, None, True)
    return rows.mapInArrow(_first(k, most, path is not None), _FIRST)


def _quoted(c: str) -> Column:
    """A text as JSON, null for null."""
    whole = F.to_json(F.array(F.col(c).cast("string")))
    return F.when(F.col(c).isNotNull(), F.substring(whole, F.lit(2), F.length(whole) - 2))


def sourced_kmers(df: DataFrame, k: int, source: Column, order: Column, seq_col: str = "seq", *, only: DataFrame | None = None, both: bool = True, least: int = 1) -> DataFrame:
    """k, kmer, sources (in order), example_position, counts, firsts (windows and first position in each source): a row for each k-mer; with ``only`` (seq), for those in its sequences.

    ``least``: only k-mers of so many windows.
    """
    return _packed(df, k, source, order, seq_col, only, both).mapInArrow(_rows(k, both, only is not None, least), _KMERS)


def _listed(*values: Column | str) -> Column:
    """Texts and booleans as a JSON list, columns by name as texts; nulls stay."""
    each = [F.coalesce(_quoted(v) if isinstance(v, str) else v.cast("string"), F.lit("null")) for v in values]
    return F.concat(F.lit("["), F.concat_ws(",", *each), F.lit("]"))


def count_sources(df: DataFrame, k: int, source: Column, group: Column | None = None, seq_col: str = "seq", both: bool = True) -> DataFrame:
    """Two kinds of rows: source, n_kmers (distinct ones), n_windows; and, with ``source`` null, grp, size, n_kmers: how many k-mers have so many sources of the ``group`` (a text)."""
    rows = _packed(df, k, source, F.lit("") if group is None else F.concat(F.lit(" "), group), seq_col, None, both).mapInArrow(_counted(k, both), "source long, grp string, size long, n_kmers long, n_windows long")
    return rows.withColumn("grp", F.substring("grp", 2, 2**30)).groupBy("source", "grp", "size").agg(F.sum("n_kmers").alias("n_kmers"), F.sum("n_windows").alias("n_windows"))


def fold_targets(df: DataFrame, k: int, target: Column, source: Column, seq_col: str = "seq") -> DataFrame:
    """K-mers of target sequences, folded: species (if single), n_species, known (whether other sequences with a taxid hold them), and summed up n_kmers, positions (the first of each in its least
    target genome), hits (windows of other sequences). ``df``: genome, species, taxid and the sequence; where ``target`` is null a sequence is neither."""
    rows = df.select("*", F.concat(F.when(target, "0").otherwise("1"), F.coalesce(F.col("genome").cast("string"), F.lit(""))).alias("_lead"), target.alias("_target"), source.alias("_source"))
    rows = _packed(rows, k, F.col("_source"), _listed("_lead", F.col("_target"), "species", "taxid"), seq_col, None, True)
    rows = rows.mapInArrow(_targets(k), "species string, n_species int, known boolean, n_kmers long, positions long, hits long")
    return rows.groupBy("species", "n_species", "known").agg(*(F.sum(c).alias(c) for c in ("n_kmers", "positions", "hits")))


def kmers_with_sets(df: DataFrame, k: int, source: Column, sets: dict[str, Column], least: dict[str, int], counted: Column | None = None, least_n: int = 0, seq_col: str = "seq", *, most: dict[str, int] | None = None, blank: bool = False) -> DataFrame:
    """k, kmer, example_position (the least), n (windows of the sources that are ``counted``) and ``sets`` of attributes (which ``source`` fixes; blank values count only with ``blank``) of the
    k-mers whose sets have at least and at most so many values, and which have at least ``least_n`` such windows; the others never leave their task."""
    names = list(sets)
    rows = df.select(source.alias("_source"), (F.lit(True) if counted is None else counted).alias("_counted"), F.lit("").alias("_lead"), *(v.alias(f"_{c}") for c, v in sets.items()), seq_col)
    rows = _packed(rows, k, F.col("_source"), _listed("_lead", F.col("_counted"), *(f"_{c}" for c in names)), seq_col, None, True)
    schema = ", ".join(["k int, kmer string, example_position long, n long", *(f"`{c}` array<string>" for c in names)])
    return rows.mapInArrow(_with_sets(k, names, [least.get(c, 0) for c in names], [(most or {}).get(c, 2**31) for c in names], least_n, blank), schema)


def conflicting_kmers(df: DataFrame, k: int, source: Column, one: str, other: str, seq_col: str = "seq") -> DataFrame:
    """k, kmer, one, other, n (distinct records, which are a source and a position) of the k-mers that don't have exactly one value of the column ``one``, nor of ``other``; blank values don't count."""
    rows = _packed(df.withColumn("_lead", F.lit("")), k, source, _listed("_lead", one, other), seq_col, None, True, apart=True)
    return rows.mapInArrow(_conflicts(k), "k int, kmer string, one string, other string, n long").select("k", "kmer", F.col("one").alias(one), F.col("other").alias(other), "n")
