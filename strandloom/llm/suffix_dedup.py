"""Suffix-array deduplication: bytes covered by a repeated string of ``length`` bytes go, found by deep-shallow suffix sorting.

A start is a byte at which a whole string of ``length`` bytes begins inside its text. All starts of a text belong to anchors: of
the grams (12/25 of ``length``) inside a start's string, the leftmost of least hash. Equal strings have equal anchors at equal
places, so only starts whose anchor's gram occurs elsewhere need sorting, and they meet in one group, that of the gram.
The starts of one anchor are neighbours; with the bytes that their strings span they are a context.

1. One pass over the texts gives each anchor's gram and the digest of its context. Equal contexts inside an Arrow batch are settled
   there (all their starts are repeated) and one of them goes on, marked. After one shuffle by gram, equal contexts are
   settled in the same way while rows stream by; grams with one occurrence, or whose contexts are all repeated, need no more.
2. For the rest, one context of each digest is read from its text and all starts of a gram's contexts are suffix-sorted (``deep_shallow``): a
   multikey quicksort, whose keys are eight bytes, to ``SHALLOW`` bytes; then blind tries order each group that is still equal. A trie grows from its group's
   first suffix: the others leave that path at the depth of their longest common prefix, by their next byte, and those that leave together are
   the next groups. All groups take such a step at once. Suffixes that agree for ``length`` bytes are equal strings.
3. Grams with more than ``CROWD`` contexts are sorted in parts of about that many; each part hands on one row of each of its
   different strings, and strings that several parts hold are found by their 128-bit digests.

Nothing is capped or sampled. Texts that occur as a whole more than once are settled by count and one copy stands for them.
A text is known by 89 bits of two hashes while it is away from its rows, a context by 128 bits.

Null texts count as empty; texts shorter than ``length`` lose nothing. Repeated rows, and rows that share an id or have none, are texts of their
own, so that two equal rows lose all bytes if they are long enough. Matches never cross texts. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise, mix, utf8

SHALLOW, CROWD = 16, 4096
#: Starts that are handled together: when texts are cut into anchors, and when suffixes are sorted.
BLOCK, SORTED = 1 << 18, 1 << 18
#: A place: 25 bits of a text's second hash, 31 bits of a start, 7 bits of the number of starts less one.
_STARTS, _START = 7, 31

_R = np.random.default_rng(20240611)
_BYTE = _R.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def _gram(length: int) -> int:
    return max(1, length - 127, length * 12 // 25)


@lru_cache(4)
def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.full(n, base, np.uint64))


def _hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the gram at each byte."""
    n = len(data)
    many = 1 << n.bit_length()
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _powers(_BASE, many)[:n])))
    return mix((upto[gram:] - upto[:-gram]) * _powers(_INVERSE, many)[: n - gram + 1])


def _leftmost_least(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value of each run of ``width`` values, by their upper 44 bits; the first in a tie. At most 2^20 values."""
    m = (h >> np.uint64(20) << np.uint64(20)) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while step * 2 <= width:
        m, step = np.minimum(m[:-step], m[step:]), step * 2
    if step < width:
        m = np.minimum(m[: step - width], m[width - step :])
    return (m & np.uint64((1 << 20) - 1)).astype(np.int64)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of the texts that lie in ``data`` one after the other: row, first start in its row, number of starts, gram and context digest of each anchor, in order."""
    gram = _gram(length)
    found: list[tuple[np.ndarray, ...]] = []
    low, end, raw = int(offsets[0]), int(offsets[-1]), memoryview(data)
    while low < end:
        high = min(low + BLOCK, end)
        if high < end:
            row = int(offsets[np.searchsorted(offsets, high, "right") - 1])
            high = row if row > low else high  # else inside a long text
        block = data[low : min(high + length - 1, end)]
        if len(block) >= length:
            at = _leftmost_least(h := _hashes(block, gram), length - gram + 1)[: high - low]
            a, b = np.searchsorted(offsets, low, "right") - 1, np.searchsorted(offsets, high, "left")
            sizes = np.minimum(offsets[a + 1 : b + 1], high) - np.maximum(offsets[a:b], low)
            row = np.repeat(np.arange(a, b), sizes)[: len(at)]
            whole = np.arange(low, low + len(at)) + length <= offsets[row + 1]
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1]) | (whole[1:] != whole[:-1])
            first = np.flatnonzero(new)
            n = np.diff(first, append=len(at))
            first, n = first[whole[first]], n[whole[first]]
            digest = np.fromiter((xxhash.xxh3_64_intdigest(raw[i:j]) for i, j in zip((first + low).tolist(), (first + low + n + length - 1).tolist())), np.uint64, len(first))
            found.append((row[first], first + low - offsets[row[first]], n, h[at[first]], digest))
        low = high
    if not found:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*found))


_ANCHORS = "gram long, context long, text long, place long, until long"


def _batch(gram, context, text, place, until) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in (gram, context, text, place, until)], ["gram", "context", "text", "place", "until"])


def _find_anchors(length: int):
    """Rows (text hash, second hash, text, met before) to anchors, a negative place for one met twice, and to settled bytes (gram null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, second, again = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
            row, start, n, gram, digest = anchors(*utf8(b.column(2)), length)
            if not len(row):
                continue
            place = second[row] << (_START + _STARTS) | start << _STARTS | (n - 1)
            order = np.lexsort((digest, gram))
            same = (gram[order][1:] == gram[order][:-1]) & (digest[order][1:] == digest[order][:-1])
            head = np.concatenate(([True], ~same))
            size = np.diff(np.flatnonzero(head), append=len(head))
            twice = np.zeros(len(row), bool)
            twice[order] = np.repeat(size > 1, size)
            on, on_twice = order[head], (size > 1) | again[row[order[head]]]
            yield _batch(gram[on].view(np.int64), digest[on].view(np.int64), keys[row[on]], np.where(on_twice, ~place[on], place[on]), pa.nulls(len(on), pa.int64()))
            # Settled starts of a text's neighbouring anchors become one run. Texts met before need none.
            done = np.flatnonzero(twice & ~again[row])
            if len(done):
                r, s, e = row[done], start[done], start[done] + n[done] + length - 1
                cut = np.concatenate(([True], (r[1:] != r[:-1]) | (s[1:] > e[:-1])))
                last = np.concatenate((cut[1:], [True]))
                yield _batch(pa.nulls(int(cut.sum()), pa.int64()), pa.nulls(int(cut.sum()), pa.int64()), keys[r[cut]], second[r[cut]] << (_START + _STARTS) | s[cut] << _STARTS, e[last])

    return run


def _settle(length: int):
    """Anchors sorted by (gram, context) to settled bytes (gram null) and, for grams of several contexts, one row of each context (a negative place: met twice).

    Holds, besides a batch, one row of the current context and one of the gram's first context until a second one comes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:

        def emit(cols: list[np.ndarray], given: bool, final: bool):
            """Output for the rows (gram, context, text, place) but, unless ``final``, for their last context, which stays open; then its row,
            and whether its gram has given contexts. ``given``: whether the first row's gram has."""
            gram, context, text, place = cols
            new_gram = np.concatenate(([True], gram[1:] != gram[:-1]))
            new = new_gram | np.concatenate(([True], context[1:] != context[:-1]))
            at = np.flatnonzero(new)
            size = np.diff(at, append=len(gram))
            twice = (size > 1) | (np.minimum.reduceat(place, at) < 0)
            of_gram = np.cumsum(new_gram)[at] - 1
            contexts = np.bincount(of_gram)
            several = contexts[of_gram] > 1
            if given:
                several |= of_gram == 0
            settled = np.repeat(size > 1, size) & (place >= 0)
            out = []
            p = place[settled]
            if len(p):
                out.append(_batch(pa.nulls(len(p), pa.int64()), pa.nulls(len(p), pa.int64()), text[settled], p >> _STARTS << _STARTS, (p >> _STARTS & (1 << _START) - 1) + (p & (1 << _STARTS) - 1) + length))
            last = len(at) - 1
            send = several.copy()
            if not final:
                send[last] = False
            s = at[send]
            if len(s):
                plain = np.where(place[s] < 0, ~place[s], place[s])
                out.append(_batch(gram[s], context[s], text[s], np.where(twice[send], ~plain, plain), pa.nulls(len(s), pa.int64())))
            if final:
                return out, None, False
            # The open context goes on as one row, which is marked if its bytes are settled.
            rest = [np.array([c[at[last]]]) for c in cols]
            if twice[last] and rest[3][0] >= 0:
                rest[3] = ~rest[3]
            return out, rest, bool(several[last])

        tail, given = None, False
        for b in batches:
            passed = b.filter(pc.is_null(b.column(0)))
            if passed.num_rows:
                yield passed
            b = b.filter(pc.is_valid(b.column(0)))
            if not b.num_rows:
                continue
            cols = [b.column(i).to_numpy() for i in range(4)]
            if tail is not None:
                cols = [np.concatenate((t, c)) for t, c in zip(tail, cols)]
            out, tail, given = emit(cols, given, False)
            yield from out
        if tail is not None:
            yield from emit(tail, given, True)[0]

    return run


def deep_shallow(data: np.ndarray, starts: np.ndarray, length: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of ``data`` at ``starts`` by their first ``length`` bytes, and for each place of that order whether it begins a new string.

    Every start has ``length`` bytes; ties keep no order.
    """
    n = len(starts)
    buffer = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.ndarray((len(data) + 1,), ">u8", buffer, strides=(1,))
    order, head = np.arange(n), np.zeros(n, bool)
    if not n:
        return order, head
    head[0] = True

    def open_places() -> np.ndarray:
        return np.flatnonzero(~(head & np.concatenate((head[1:], [True]))))

    # Shallow: quicksort by eight bytes, equal runs by the next eight.
    for depth in range(0, min(shallow, length), 8):
        at = open_places() if depth else np.arange(n)
        if not len(at):
            break
        key = words[starts[order[at]] + depth].astype(np.uint64)
        if length - depth < 8:
            key >>= np.uint64(8 * (8 - (length - depth)))
        run = np.cumsum(head[at])
        by = np.lexsort((key, run)) if depth else np.argsort(key)
        order[at] = order[at][by]
        key = key[by]
        head[at[1:]] |= key[1:] != key[:-1]
    # Deep: a step of all blind tries. Members, in order, with their group's known common prefix.
    at = open_places()
    member, depth = order[at], np.full(len(at), min(-(-min(shallow, length) // 8) * 8, length), np.int64)
    first = head[at]
    half = (length + 1) << 8
    while len(at):
        group = np.cumsum(first) - 1
        pivot = member[np.flatnonzero(first)][group]
        lcp, going = depth.copy(), np.flatnonzero(~first & (depth < length))
        lcp[first] = length
        while len(going):
            x = words[starts[member[going]] + lcp[going]].astype(np.uint64) ^ words[starts[pivot[going]] + lcp[going]].astype(np.uint64)
            gone = x != 0
            lcp[going] += np.where(gone, 0, 8)
            part, y = going[gone], x[gone]
            zero = np.zeros(len(y), np.int64)
            for bits in (32, 16, 8):
                none = (y >> np.uint64(64 - bits)) == 0
                zero += np.where(none, bits // 8, 0)
                y = np.where(none, y << np.uint64(bits), y)
            lcp[part] += zero
            going = going[~gone]
            going = going[lcp[going] < length]
        np.minimum(lcp, length, out=lcp)
        # Where it leaves its pivot's path: before it at ascending depths, after it at descending ones.
        leaves = lcp < length
        own = buffer[np.where(leaves, starts[member] + lcp, 0)].astype(np.int64)
        before = own < buffer[np.where(leaves, starts[pivot] + lcp, 0)]
        side = np.where(leaves, np.where(before, lcp << 8 | own, half + ((length - lcp) << 8 | own)), half)
        by = np.argsort(group * (2 * half + 1) + side, kind="stable")
        member, side, lcp, group = member[by], side[by], lcp[by], group[by]
        order[at] = member
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | (side[1:] != side[:-1])
        head[at] |= new
        size = np.diff(np.flatnonzero(new), append=len(at))
        more = (side != half) & np.repeat(size > 1, size)
        at, member, depth, first = at[more], member[more], lcp[more] + 1, new[more]
    return order, head


_SORTED_SCHEMA = "text long, place long, until long, low long, high long"


def _sort_contexts(length: int):
    """Contexts sorted by (gram, part) to settled bytes (until set) and, for grams of several parts, strings with their digests (low, high; a negative place: repeated)."""

    def judge(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        # rows: text, place, parts, bytes
        raw = b"".join(r[3] for r in rows)
        data = np.frombuffer(raw, np.uint8)
        sizes = np.array([len(r[3]) for r in rows])
        offsets = np.cumsum(sizes) - sizes
        n = sizes - length + 1
        text, signed = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        parts = np.array([r[2] for r in rows])
        place, twice = np.where(signed < 0, ~signed, signed), signed < 0
        of = np.repeat(np.arange(len(rows)), n)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        order, head = deep_shallow(data, offsets[of] + nth, length)
        size = np.diff(np.flatnonzero(head), append=len(order))
        string = np.empty(len(order), np.int64)
        string[order] = np.repeat(np.arange(len(size)), size)
        repeated = size[string] > 1
        hit = np.flatnonzero(repeated & ~twice[of])
        second, start = place >> (_START + _STARTS), place >> _STARTS & (1 << _START) - 1
        if len(hit):
            cut = np.concatenate(([True], (of[hit][1:] != of[hit][:-1]) | (nth[hit][1:] != nth[hit][:-1] + 1)))
            a, z = hit[cut], hit[np.concatenate((cut[1:], [True]))]
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(text[of[a]]), pa.array(second[of[a]] << (_START + _STARTS) | (start[of[a]] + nth[a]) << _STARTS), pa.array(start[of[z]] + nth[z] + length), none, none], ["text", "place", "until", "low", "high"])
        # One row of each string that another part may hold; repeated or not is known of all its starts here.
        crowd = parts[of] > 1
        if crowd.any():
            one = order[head]
            one = one[crowd[one]]
            many = (size[string[one]] > 1) | twice[of[one]]
            digests = [xxhash.xxh3_128_digest(raw[p : p + length]) for p in (offsets[of[one]] + nth[one]).tolist()]
            both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            p = second[of[one]] << (_START + _STARTS) | (start[of[one]] + nth[one]) << _STARTS
            yield pa.RecordBatch.from_arrays([pa.array(text[of[one]]), pa.array(np.where(many, ~p, p)), pa.nulls(len(one), pa.int64()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["text", "place", "until", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count, last = 0, None
        for b in batches:
            for gram, part, *row in zip(*(c.to_pylist() for c in b.columns)):
                if (gram, part) != last and count >= SORTED:
                    yield from judge(held)
                    held, count = [], 0
                last = (gram, part)
                held.append(tuple(row))
                count += len(row[3]) - length + 1
        if held:
            yield from judge(held)

    return run


def _read_contexts(length: int):
    """Texts with the contexts wanted of them to one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for text, raw, wanted in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                data = memoryview(raw.as_buffer())
                for w in wanted.as_py():
                    place = w["place"] if w["place"] >= 0 else ~w["place"]
                    low = place >> _STARTS & (1 << _START) - 1
                    out.append((w["gram"], w["part"], text, w["place"], w["parts"], bytes(data[low : low + (place & (1 << _STARTS) - 1) + length])))
            for i in range(0, len(out), 4096):
                cols = list(zip(*out[i : i + 4096]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["gram", "part", "text", "place", "parts", "bytes"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, bytes, runs (start, until) in any order) to (id, n_bytes, maximal spans, what is left)."""
    for b in batches:
        spans, kept, sizes = [], [], []
        for raw, runs in zip(b.column(1), b.column(2)):
            data = memoryview(raw.as_buffer())
            r = np.array(sorted((x["start"], x["until"]) for x in runs.as_py()), np.int64).reshape(-1, 2)
            ends = np.maximum.accumulate(r[:, 1])
            new = np.concatenate(([True], r[1:, 0] > ends[:-1]))
            a, z = r[new, 0], ends[np.concatenate((new[1:], [True]))]
            spans.append([{"start": int(s), "end": int(e)} for s, e in zip(a, z)])
            kept.append(b"".join(data[s:e] for s, e in zip([0, *z.tolist()], [*a.tolist(), len(data)])))
            sizes.append(len(data))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def dedup_substrings(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (array of start, end: maximal removed runs), kept (binary: the remaining bytes)."""
    if length < 2:
        raise ValueError("length: 2 or more bytes")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(F.col(id_col).alias("doc_id"), text.cast("binary").alias("bytes"))
    docs = docs.withColumns({"text": F.xxhash64("bytes"), "second": F.crc32("bytes").bitwiseAND((1 << 25) - 1)})
    long = docs.filter(F.length("bytes") >= length)
    copies = long.groupBy("text", "second").agg(F.count("*").alias("n"), F.min("doc_id").alias("one")).filter("n > 1").select(F.col("text").alias("c_text"), F.col("second").alias("c_second"), "one")
    copies = materialise(copies, "copies")

    def with_copies(df: DataFrame) -> DataFrame:
        return df.join(broadcast_if_small(copies), (F.col("text") == F.col("c_text")) & (F.col("second") == F.col("c_second")), "left")

    # One copy of each text; rows without id stand for themselves.
    single = with_copies(long).filter(F.col("c_text").isNull() | F.col("doc_id").eqNullSafe(F.col("one")))
    found = single.select("text", "second", F.col("bytes").cast("string").alias("t"), F.col("c_text").isNotNull().alias("again")).mapInArrow(_find_anchors(length), _ANCHORS)
    met = found.repartition(F.coalesce("gram", "text")).sortWithinPartitions("gram", "context", "place").mapInArrow(_settle(length), _ANCHORS)
    met = materialise(met, "met")

    # Contexts of grams that have some single one; parts of about CROWD contexts.
    contexts = met.filter("gram is not null")
    grams = contexts.groupBy("gram").agg(F.count("*").alias("n"), F.max("place").alias("most")).filter("most >= 0 and n > 1").select("gram", F.ceil(F.col("n") / CROWD).cast("long").alias("parts"))
    plain = F.when(F.col("place") < 0, F.bitwise_not("place")).otherwise(F.col("place"))
    wanted = contexts.join(grams, "gram").select("gram", F.pmod(F.xxhash64("context"), F.col("parts")).cast("int").alias("part"), "parts", "text", "place", F.shiftrightunsigned(plain, _START + _STARTS).alias("second"))
    wanted = wanted.groupBy("text", "second").agg(F.collect_list(F.struct("gram", "part", "parts", "place")).alias("wanted"))
    wanted = materialise(wanted, "wanted")
    keys = broadcast_if_small(wanted.select("text", "second"))
    read = single.select("text", "second", "bytes").join(keys, ["text", "second"], "left_semi").join(wanted, ["text", "second"]).select("text", "bytes", "wanted")
    pieces = read.mapInArrow(_read_contexts(length), "gram long, part int, text long, place long, parts long, bytes binary")
    judged = materialise(pieces.repartition("gram", "part").sortWithinPartitions("gram", "part").mapInArrow(_sort_contexts(length), _SORTED_SCHEMA), "judged")

    # Strings that several parts of a crowded gram hold.
    strings = judged.filter("until is null")
    shared = strings.groupBy("low", "high").agg(F.count("*").alias("n"), F.min("place").alias("least")).filter("n > 1 or least < 0").select("low", "high")
    across = strings.filter("place >= 0").join(shared, ["low", "high"], "left_semi").select("text", "place", (_start(F.col("place")) + length).alias("until"))
    runs = met.filter("gram is null").select("text", "place", "until").union(judged.filter("until is not null").select("text", "place", "until")).union(across)
    runs = runs.select("text", F.shiftrightunsigned("place", _START + _STARTS).alias("second"), _start(F.col("place")).alias("start"), "until").distinct()
    runs = materialise(runs.groupBy("text", "second").agg(F.collect_list(F.struct("start", "until")).alias("runs")), "runs")

    rows = with_copies(docs).drop("c_second", "one")
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = F.length("bytes").cast("long")
    span = "array<struct<start: bigint, end: bigint>>"
    all_of = rows.filter("c_text is not null").select("doc_id", size.alias("n_bytes"), F.array(F.struct(F.lit(0).cast("long").alias("start"), size.alias("end"))).cast(span).alias("spans"), F.lit(b"").alias("kept"))
    rest, keys = rows.filter("c_text is null"), broadcast_if_small(runs.select("text", "second"))
    none_of = rest.join(keys, ["text", "second"], "left_anti").select("doc_id", size.alias("n_bytes"), F.array().cast(span).alias("spans"), F.col("bytes").alias("kept"))
    some_of = rest.join(keys, ["text", "second"], "left_semi").join(runs, ["text", "second"]).select("doc_id", "bytes", "runs")
    return all_of.union(none_of).union(some_of.mapInArrow(_cut, f"doc_id {kind}, n_bytes long, spans {span}, kept binary"))


def _start(place: Column) -> Column:
    return F.shiftrightunsigned(place, _STARTS).bitwiseAND((1 << _START) - 1)
