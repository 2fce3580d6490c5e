"""Windows of sequences made in Arrow batches, where rows of Spark would carry the sequence along or be sorted whole: every window, each row's windows summed up, the
first windows of each bin, the k-mers of each bin that rank first, the k-mers near given ones. Sequences are ASCII."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .superkmers import _CODE, _letters, _mix, _strings, _utf8, _words

BLOCK = 1 << 16


def _blocks(column: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts of windows in there, row and position of each)."""
    data, offsets = _utf8(column)
    low, end = int(offsets[0]), int(offsets[-1])
    if (data[low:end] > 127).any():
        raise ValueError("a sequence has letters that are not ASCII")
    while low + k <= end:
        part = data[low : min(low + BLOCK + k - 1, end)]
        places = np.arange(low, low + len(part) - k + 1)
        first, last = np.searchsorted(offsets, (low, places[-1]), "right") - 1
        row = np.repeat(np.arange(first, last + 1), np.diff(np.clip(offsets[first : last + 2], low, places[-1] + 1)))
        at = np.flatnonzero(places + k <= offsets[row + 1])
        if len(at):
            yield part, at, row[at], (places - offsets[row])[at]
        low += BLOCK


def _clear(part: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Whether the windows hold nothing but A, C, G and T in either case."""
    bad = np.concatenate(([0], np.cumsum(_CODE[part] > 3)))
    return bad[at + k] == bad[at]


def _canonical(part: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    codes, pad = _CODE[part] & 3, np.zeros(64, np.uint8)
    forward = _words(np.concatenate((codes, pad)), at, k)
    back = _words(np.concatenate((3 - codes[::-1], pad)), len(codes) - at - k, k)
    less, same = np.zeros(len(at), bool), np.ones(len(at), bool)
    for f, r in zip(forward, back):
        less |= same & (r < f)
        same &= r == f
    return [np.where(less, r, f) for f, r in zip(forward, back)]


def _map(df: DataFrame, keep: Sequence[str], seq_col: str, schema: str, make: Callable, *also: str) -> DataFrame:
    """``make`` gives, for the sequences of a batch (and its columns ``also``), (row, columns) pairs; the columns ``keep`` of the row go before them."""
    rows = df.select(*keep, F.col(seq_col).cast("string").alias("_seq"), *(F.col(c).alias(f"_also{i}") for i, c in enumerate(also)))
    kept = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes)
    names = [*keep, *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, columns in make(*b.columns[len(keep) :]):
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(row)) for i in range(len(keep))), *columns], names)

    return rows.mapInArrow(run, f"{kept}, {schema}")


def every_window(df: DataFrame, k: int, keep: Sequence[str], seq_col: str = "seq") -> DataFrame:
    """``keep``, position (from 0), kmer as it stands, valid (upper-case A, C, G and T only): a row for every window."""

    def make(column: pa.Array):
        for part, at, row, position in _blocks(column, k):
            letters = np.lib.stride_tricks.sliding_window_view(part, k)[at]
            kmers = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer((np.arange(len(at) + 1) * k).astype(np.int32).tobytes()), pa.py_buffer(letters.tobytes())])
            lower = np.concatenate(([0], np.cumsum(part > 90)))
            yield row, [pa.array(position.astype(np.int32)), kmers, pa.array(_clear(part, at, k) & (lower[at + k] == lower[at]))]

    return _map(df, keep, seq_col, "position int, kmer string, valid boolean", make)


def summed_windows(df: DataFrame, k_values: Sequence[int], keep: Sequence[str], seq_col: str = "seq") -> DataFrame:
    """``keep``, k, n, first_kmer (the least canonical one), last_position of the unambiguous windows, per values of ``keep``."""
    ks = list(dict.fromkeys(k_values))

    def make(column: pa.Array):
        for k in ks:
            found: dict[int, tuple] = {}
            for part, at, row, position in _blocks(column, k):
                ok = _clear(part, at, k)
                at, row, position = at[ok], row[ok], position[ok]
                if not len(at):
                    continue
                words = _canonical(part, at, k)
                starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                n, best, open_ = np.diff(starts, append=len(row)), [], np.ones(len(row), bool)
                for w in words:
                    least = np.minimum.reduceat(np.where(open_, w, np.uint64(2**64 - 1)), starts)
                    open_ &= w == np.repeat(least, n)
                    best.append(least)
                last = np.maximum.reduceat(position, starts)
                for r, m, p, *b in zip(row[starts].tolist(), n.tolist(), last.tolist(), *(b.tolist() for b in best)):
                    had = found.get(r)
                    found[r] = (m, b, p) if had is None else (had[0] + m, min(had[1], b), max(had[2], p))
            if found:
                n, best, last = zip(*found.values())
                words = [np.array(w, np.uint64) for w in zip(*best)]
                yield np.array(list(found)), [pa.array(np.full(len(n), k, np.int32)), pa.array(n, pa.int64()), _strings(words, k), pa.array(last, pa.int32())]

    rows = _map(df, keep, seq_col, "k int, n long, first_kmer string, last_position int", make)
    return rows.groupBy(*keep, "k").agg(F.sum("n").alias("n"), F.min("first_kmer").alias("first_kmer"), F.max("last_position").alias("last_position"))


def _covered(column: pa.Array, spans: pa.Array) -> np.ndarray:
    """Which bases of the sequences' bytes lie in one of their row's spans, each a first and a last position."""
    _, offsets = _utf8(column)
    rows = np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False))
    ends, length = spans.flatten(), (offsets[1:] - offsets[:-1])[rows]
    change = np.zeros(int(offsets[-1]) + 1, np.int32)
    np.add.at(change, offsets[rows] + np.clip(ends.field(0).to_numpy(), 0, length), 1)
    np.add.at(change, offsets[rows] + np.clip(ends.field(1).to_numpy() + 1, 0, length), -1)
    return np.cumsum(change) > 0


def first_windows(df: DataFrame, k: int, bin_size: int, shift: int, quota: int, keep: Sequence[str], seq_col: str = "seq", barred: str | None = None) -> DataFrame:
    """``keep``, position, kmer (canonical), k of the first ``quota`` unambiguous windows of each row's bins; bins begin ``shift`` bases early. Where a block of a sequence ends there may be more.
    ``barred``: a column of spans (structs of a first and a last position) in which no window may start."""

    def make(column: pa.Array, spans: pa.Array | None = None):
        covered, offsets = (None, None) if spans is None else (_covered(column, spans), _utf8(column)[1])
        for part, at, row, position in _blocks(column, k):
            ok = _clear(part, at, k)
            if covered is not None:
                ok &= ~covered[offsets[row] + position]
            at, row, position = at[ok], row[ok], position[ok]
            if len(at):
                bin_ = (position + shift) // bin_size
                starts = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (bin_[1:] != bin_[:-1]))))
                few = np.arange(len(at)) - np.repeat(starts, np.diff(starts, append=len(at))) < quota
                yield row[few], [pa.array(position[few].astype(np.int32)), _strings(_canonical(part, at[few], k), k), pa.array(np.full(int(few.sum()), k, np.int32))]

    return _map(df, keep, seq_col, "position int, kmer string, k int", make, *([barred] if barred else []))


#: Bases whose windows are made into rows together.
ROW = 1 << 16


def scored_kmers(df: DataFrame, shifts: Mapping[int, int], group: str, contig: str, bin_size: int, quota: int, seq_col: str = "seq") -> DataFrame:
    """group, contig, k, position, kmer (canonical), bin of all windows whose k-mer may be among the ``quota`` lowest scores (``functions.seq.marker_score`` of group and k-mer) of its group, k and bin.
    ``shifts``: for each k, how many bases early its bins begin.

    Tasks put the windows of a group, k and bin side by side, as one text of group, tab and k-mer each, and so many to a row; Spark hashes the texts of a row and keeps the ``quota`` lowest, each k-mer at its first place
    by (contig, position). Only what is below a limit is sorted, which about 8 times ``quota`` of a row's distinct k-mers should be; a row where fewer than ``quota`` are is sorted whole."""

    def make(column: pa.Array, groups: pa.Array, contigs: pa.Array):
        by_contig = pc.sort_indices(contigs, null_placement="at_start").to_numpy()
        data, offsets = _utf8(column.take(pa.array(by_contig)))
        if (data[offsets[0] : offsets[-1]] > 127).any():
            raise ValueError("a sequence has letters that are not ASCII")
        coded = groups.cast(pa.string()).dictionary_encode("encode")
        prefixes, of_row = [f"{g or ''}\t".encode() for g in coded.dictionary.to_pylist()], coded.indices.to_numpy()[by_contig]

        def pieces(k: int) -> Iterator[tuple]:
            # Sequences are cut at bins, long bins in parts; pieces of a group and bin lie side by side, in order of their places.
            parts, n, shift = -(-bin_size // ROW), np.diff(offsets) - k + 1, shifts[k]
            row = np.flatnonzero(n > 0)
            first, last = (q // bin_size * parts + q % bin_size // ROW for q in (np.full(len(row), shift), n[row] - 1 + shift))
            row = np.repeat(row, last - first + 1)
            part = np.arange(len(row)) + np.repeat(first - (np.cumsum(last - first + 1) - (last - first + 1)), last - first + 1)
            begin, end = (q // parts * bin_size + q % parts * ROW - shift for q in (part, part + 1))
            begin, end, bin_, of = np.maximum(begin, 0), np.minimum(end, n[row]), part // parts, of_row[row]
            order = np.lexsort((bin_, of))
            row, begin, end, bin_, of = row[order], begin[order], end[order], bin_[order], of[order]
            size = end - begin + k - 1
            total, width = np.cumsum(size), k + np.array([len(x) for x in prefixes])[of]
            low = 0
            while low < len(row):  # pieces of one width
                high = max(low + 1, int(np.searchsorted(total, total[low] - size[low] + ROW, "right")))
                other = np.flatnonzero(width[low:high] != width[low])
                here = slice(low, low + int(other[0]) if len(other) else high)
                yield from rows(k, int(width[low]), row[here], begin[here], size[here], bin_[here], of[here])
                low = here.stop

        def rows(k, width, row, begin, size, bin_, of) -> Iterator[tuple]:
            piece, nth = np.repeat(np.arange(len(row)), size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            part = data[(offsets[row] + begin)[piece] + nth]
            at = np.flatnonzero(nth <= (size - k)[piece])
            at = at[_clear(part, at, k)]
            n, piece = len(at), piece[at]
            if not n:
                return
            words, row, position = _canonical(part, at, k), row[piece], begin[piece] + nth[at]
            run = np.cumsum(np.concatenate(([False], (bin_[1:] != bin_[:-1]) | (of[1:] != of[:-1]))))[piece]
            starts = np.flatnonzero(np.diff(run, prepend=-1))
            size, bin_, of = np.diff(starts, append=n), bin_[piece[starts]], of[piece[starts]]
            texts, h, limits = np.empty((n, width), np.uint8), words[0], []
            texts[:, width - k :] = _letters(words, k)
            for w in words[1:]:
                h = _mix(h) ^ w
            for a, m, prefix in zip(starts.tolist(), size.tolist(), of.tolist()):
                texts[a : a + m, : width - k] = np.frombuffer(prefixes[prefix], np.uint8)
                known = np.sort(h[a : a + m])
                distinct = 1 + int(np.count_nonzero(known[1:] != known[:-1]))
                limits.append(f"{(8 * quota << 64) // distinct:016x}" if distinct > 8 * quota else "g")  # after all digits
            new = np.ones(n, bool)
            new[1:] = row[1:] != row[:-1]
            new[starts] = True
            own = np.cumsum(new) - 1
            places = (own - np.repeat(own[starts], size)) << 40 | position
            strings = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(texts.tobytes())])
            lists = [(np.append(starts, n), strings), (np.append(own[starts], own[-1] + 1), contigs.take(pa.array(by_contig[row[new]]))), (np.append(starts, n), pa.array(places))]
            yield by_contig[row[starts]], [pa.array(np.full(len(starts), k, np.int32)), pa.array(bin_), pa.array(limits), *(pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), v) for o, v in lists)]

        for k in shifts:
            yield from pieces(k)

    rows_ = _map(df, (group,), seq_col, f"k int, bin long, _limit string, _texts array<string>, _contigs array<{dict(df.dtypes)[contig]}>, _places array<long>", make, group, contig)
    score = lambda x: F.sha2(x, 256)
    low = rows_.withColumn("_low", F.array_distinct(F.filter("_texts", lambda x: score(x) < F.col("_limit"))))
    low = low.withColumn("_low", F.when(F.size("_low") >= quota, F.col("_low")).otherwise(F.array_distinct("_texts")))
    scored = F.array_sort(F.transform("_low", lambda x: F.struct(F.substring(score(x), 1, 16).alias("score"), x.alias("text"))))
    best = low.select(group, "k", "bin", "_texts", "_contigs", "_places", F.explode(F.slice(scored, 1, quota)["text"]).alias("_text"))
    best = best.withColumn("_place", F.get("_places", (F.array_position("_texts", F.col("_text")) - 1).cast("int")))
    position = F.col("_place").bitwiseAND(F.lit((1 << 40) - 1)).cast("int")
    return best.select(group, F.get("_contigs", F.shiftright("_place", 40).cast("int")).alias(contig), "k", position.alias("position"), F.right(F.col("_text"), F.col("k")).alias("kmer"), "bin")


def leading_kmers(df: DataFrame, k: int, group: str, contig: str, bin_size: int, shift: int, quota: int, seq_col: str = "seq") -> DataFrame:
    """group, contig, k, position, kmer (canonical), bin of all windows whose k-mer may be among the first ``quota`` of its group, where a k-mer counts once for each bin.
    Each task leaves out what ``quota`` others of its batch go before; of a k-mer's places in a bin it gives the first by (contig, position)."""

    def make(column: pa.Array, groups: pa.Array, contigs: pa.Array):
        coded = pc.fill_null(groups.cast(pa.string()), "").dictionary_encode()
        of_row = coded.indices.to_numpy()
        by_contig = pc.sort_indices(contigs, null_placement="at_start").to_numpy()
        rank = np.empty(len(contigs), np.int64)
        rank[by_contig] = np.arange(len(contigs))
        found = []
        for part, at, row, position in _blocks(column, k):
            ok = _clear(part, at, k)
            at, row, position = at[ok], row[ok], position[ok]
            if len(at):
                found.append((of_row[row], (position + shift) // bin_size, rank[row] << 40 | position, *_canonical(part, at, k)))
        if not found:
            return
        of, bin_, place, *words = (np.concatenate(x) for x in zip(*found))
        del found
        # Equal (group, bin, k-mer) lie beside each other, each with its first place.
        h = of.astype(np.uint64) << np.uint64(40) | bin_.astype(np.uint64)
        for w in words:
            h = _mix(h) ^ w
        order = np.argsort(_mix(h))
        of, bin_, place, words = of[order], bin_[order], place[order], [w[order] for w in words]
        starts = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (bin_[1:] != bin_[:-1]) | np.logical_or.reduce([w[1:] != w[:-1] for w in words]))))
        place, of, bin_, words = np.minimum.reduceat(place, starts), of[starts], bin_[starts], [w[starts] for w in words]
        order = np.lexsort([bin_, *words[::-1], of])
        of, bin_, place, words = of[order], bin_[order], place[order], [w[order] for w in words]
        new = np.concatenate(([True], of[1:] != of[:-1]))
        other = np.concatenate(([True], np.logical_or.reduce([w[1:] != w[:-1] for w in words])))  # places of one k-mer never part
        other |= new
        starts, nth = np.flatnonzero(new), np.cumsum(other)
        few = nth - np.repeat(nth[starts], np.diff(starts, append=len(of))) < quota
        of, bin_, place, words = of[few], bin_[few], place[few], [w[few] for w in words]
        yield by_contig[place >> 40], [pa.array(np.full(len(of), k, np.int32)), pa.array((place & ((1 << 40) - 1)).astype(np.int32)), _strings(words, k), pa.array(bin_)]

    return _map(df, (group, contig), seq_col, "k int, position int, kmer string, bin long", make, group, contig)


#: Bases that a key of a k-mer has where k allows it, so that few other k-mers share it by chance; the most parts beyond the mismatches that k-mers are cut into for that.
KEY, PARTS = 12, 4


def kept_parts(k: int, mismatches: int) -> list[tuple[tuple[int, int], ...]]:
    """Sets of stretches (first base, end) of a k-mer, one of which at least is free of errors: a k-mer is cut into more parts than mismatches, and each set leaves out as many parts as there
    may be mismatches. Of few parts if their sets have enough bases, else of as many as give the longest ones."""
    best: list = []
    for n in range(mismatches + 1, min(mismatches + PARTS, k) + 1):
        cuts = [i * k // n for i in range(n + 1)]
        sets = list(combinations(zip(cuts, cuts[1:]), n - mismatches))
        size = min(sum(b - a for a, b in s) for s in sets)
        if not best or size > best[0]:
            best = [size, sets]
        if size >= KEY:
            break
    return best[1] if best else [()]


class _Near:
    """The k-mers ``queries`` (packed words) by the parts of which one must be free of errors; ``hits`` says which other k-mers are near one of them."""

    def __init__(self, queries: list[np.ndarray], k: int, mismatches: int):
        self.queries, self.mismatches, self.tables = queries, mismatches, []
        self.shift = np.uint64(64 - min(24, max(10, int(len(queries[0])).bit_length() + 6)))
        for kept in kept_parts(k, mismatches):
            masks = []
            for low in range(0, k, 32):
                size = min(32, k - low)
                masks.append(np.uint64(sum(3 << 2 * (size - 1 - i) for a, b in kept for i in range(max(a - low, 0), min(b - low, size)))))
            keys = self._keys(queries, masks)
            order = np.argsort(keys)
            seen = np.zeros(1 << 64 - int(self.shift), bool)
            seen[self._slot(keys)] = True
            self.tables.append((masks, seen, keys[order], order))

    @staticmethod
    def _keys(words: list[np.ndarray], masks: list[np.uint64]) -> np.ndarray:
        out = words[0] & masks[0]
        for w, m in zip(words[1:], masks[1:]):
            out = _mix(out) ^ (w & m)
        return out

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def _distance(self, words: list[np.ndarray], at: np.ndarray, query: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint8)
        for w, q in zip(words, self.queries):
            x = w[at] ^ q[query]
            out += np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555))
        return out

    def hits(self, words: list[np.ndarray]) -> np.ndarray:
        near = np.zeros(len(words[0]), bool)
        for masks, seen, keys, order in self.tables:
            key = self._keys(words, masks)
            at = np.flatnonzero(seen[self._slot(key)] & ~near)
            low = np.searchsorted(keys, key[at])
            n = np.searchsorted(keys, key[at], "right") - low
            at, low, n = at[n > 0], low[n > 0], n[n > 0]
            ends = np.cumsum(n)
            while len(at):  # about a million pairs at a time
                few = max(1, int(np.searchsorted(ends, (1 << 20) + ends[0] - n[0], "right")))
                of = np.repeat(np.arange(few), n[:few])
                query = order[low[:few][of] + np.arange(len(of)) - np.repeat(np.cumsum(n[:few]) - n[:few], n[:few])]
                near[at[of[self._distance(words, at[:few][of], query) <= self.mismatches]]] = True
                at, low, n, ends = at[few:], low[few:], n[few:], ends[few:]
        return near


def near_kmers(df: DataFrame, k: int, group: str, queries: Sequence[str], mismatches: int, seq_col: str = "seq") -> DataFrame:
    """group, kmer (canonical) of all windows whose k-mer has at most ``mismatches`` substitutions from one of the k-mers ``queries`` (as they stand), each once for a batch. All windows are looked
    at; the others never leave their task. Each task holds an index of the queries."""
    data, _ = _utf8(pa.array(queries, pa.string()))
    packed = _words(np.concatenate((_CODE[data] & 3, np.zeros(64, np.uint8))), np.arange(len(queries)) * k, k)
    index: list[_Near] = []

    def make(column: pa.Array, groups: pa.Array):
        if not index:
            index.append(_Near(packed, k, mismatches))
        coded = groups.cast(pa.string()).dictionary_encode("encode")
        of_row, found = coded.indices.to_numpy(), []
        for part, at, row, _ in _blocks(column, k):
            ok = _clear(part, at, k)
            at, row = at[ok], row[ok]
            if len(at):
                words = _canonical(part, at, k)
                near = np.flatnonzero(index[0].hits(words))
                found.append((row[near], *(w[near] for w in words)))
        if found:
            row, *words = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((of_row[row], *words))
            new = np.ones(len(order), bool)
            new[1:] = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in (of_row[row], *words)])
            row, words = row[order][new], [w[order][new] for w in words]
            if len(row):
                yield row, [_strings(words, k)]

    return _map(df, (group,), seq_col, "kmer string", make, group) if len(queries) else df.select(group, F.lit("").alias("kmer")).limit(0)
