"""Document fingerprints by improbable features.

Every window of ``WINDOW`` bytes has an entropy; windows whose entropy is rare in the whole corpus are
improbable; plain ones (entropy bins below ``PLAIN``: runs, rules of dashes) rank behind all others, so they are
selected only where there is nothing else. A window is selected when it is the rarest (leftmost on ties) in at least ``VOTES`` of the
``AROUND`` neighbourhoods that hold it; neighbourhoods reach beyond both ends of a text, so one of a few windows has as many.
Some window of every text of ``WINDOW`` bytes or more is selected. Selected features go into a chain of Bloom filters of 2048 bits,
160 features each. Two fingerprints are compared filter by filter: the bits in common beyond what chance gives,
as a share of the most possible; each filter takes its best partner, and filters count by their bits.

Entropies are sums of integers, so they are equal wherever a window stands. Rarity is a histogram over all
windows of all documents (1001 bins); pass ``rarity`` to keep fingerprints comparable between corpora. Very
long texts are worked on in blocks. A text shorter than a window is one feature, an empty or null text has
an empty fingerprint, which equals only another empty one (likeness 1). Equal texts have equal fingerprints.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix

WINDOW, AROUND, VOTES = 16, 16, 5
BITS, FEATURES, HASHES = 2048, 160, 5
BLOCK = 1 << 16
SCALE = 1024
#: Windows of entropy bins below this (of 1000) say little of a text.
PLAIN = 250

_C = np.arange(WINDOW + 1, dtype=np.float64)
_PLAIN = np.rint(SCALE * _C * np.log2(np.maximum(_C, 1))).astype(np.int32)
_STEP = np.diff(_PLAIN, prepend=0).astype(np.int32)
_MOST = int(_PLAIN[WINDOW])
#: Entropy bin (0 to 1000) of a window's sum of c log c.
_BIN = np.rint(1000 * (1 - np.arange(_MOST + WINDOW * 2) / _MOST)).clip(0, 1000).astype(np.int16)


def entropy_bins(data: np.ndarray) -> np.ndarray:
    """The entropy bin of each window of the bytes, by adding and removing one byte at a time."""
    out = []
    for low in range(0, max(0, len(data) - WINDOW + 1), BLOCK):
        x = data[low : low + BLOCK + WINDOW - 1]
        before, after = np.ones(len(x), np.uint8), np.ones(len(x), np.uint8)
        for j in range(1, WINDOW):  # equal bytes j apart count for the later one and for the earlier one
            same = (x[j:] == x[:-j]).view(np.uint8)
            before[j:] += same
            after[:-j] += same
        before, after = _STEP[before], _STEP[after]
        n = len(x) - WINDOW + 1
        total = np.empty(n, np.int32)
        total[0] = before[:WINDOW].sum()
        np.subtract(before[WINDOW:], after[: n - 1], out=total[1:])
        out.append(_BIN[np.cumsum(total)])
    return np.concatenate(out) if out else np.empty(0, np.int16)


def spliced_bins(left: np.ndarray, left_bins: np.ndarray, right: np.ndarray, right_bins: np.ndarray) -> np.ndarray:
    """Entropy bins of left + right from those of longer texts that begin with each."""
    cut = max(0, len(left) - WINDOW + 1)
    seam = entropy_bins(np.concatenate((left[cut:], right[: WINDOW - 1])))
    return np.concatenate((left_bins[:cut], seam, right_bins[: max(0, len(right) - WINDOW + 1)]))[: max(0, len(left) + len(right) - WINDOW + 1)]


def rank_table(histogram: dict[int, int]) -> np.ndarray:
    """Rank of each entropy bin: 0 for the rarest; plain ones last."""
    order = sorted(range(1001), key=lambda b: (b < PLAIN, histogram.get(b, 0), -b))
    table = np.empty(1001, np.uint32)
    table[order] = np.arange(1001)
    return table


def select(bins: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Positions of the selected windows."""
    n, out, edge = len(bins), [], AROUND - 1
    for low in range(0, n, BLOCK):  # windows of [low, low + BLOCK), with the neighbourhoods that hold them
        first, last = max(0, low - edge), min(n, low + BLOCK + edge)
        v = np.full(min(BLOCK, n - low) + 2 * edge, 1 << 14, np.uint32)  # beyond the ends nothing wins
        shift = first - (low - edge)
        v[shift : shift + last - first] = ranks[bins[first:last]]
        v = v << np.uint32(17) | np.arange(len(v), dtype=np.uint32)
        span = 1
        while span < AROUND:
            v = np.minimum(v[:-span], v[span:])
            span *= 2
        votes = np.bincount(v & np.uint32((1 << 17) - 1), minlength=min(BLOCK, n - low) + 2 * edge)
        out.append(np.flatnonzero(votes[edge : edge + min(BLOCK, n - low)] >= VOTES) + low)
    return np.concatenate(out) if out else np.empty(0, np.int64)


_R = np.random.default_rng(4242)
_MUL = _R.integers(1, 2**63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def filters(data: np.ndarray, bins: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The chain of Bloom filters of a text, one row of booleans each."""
    if not len(data):
        return np.zeros((0, BITS), bool)
    if len(data) < WINDOW:
        words = np.zeros(WINDOW, np.uint8)
        words[: len(data)] = data
        words = words.view("<u8")[None, :]
    else:
        at = select(bins, ranks)
        words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, WINDOW)[at]).view("<u8")
    h = mix(mix(words[:, 0] * _MUL[0]) ^ words[:, 1] * _MUL[1])
    if len(h):
        _, firsts = np.unique(h, return_index=True)
        h = h[np.sort(firsts)]
    chain = np.zeros((-(-len(h) // FEATURES), BITS), bool)
    row = np.arange(len(h)) // FEATURES
    for i in range(HASHES):
        chain[row, (h >> np.uint64(11 * i)).astype(np.int64) & (BITS - 1)] = True
    return chain


def digest(chain: np.ndarray) -> str:
    return base64.b64encode(np.packbits(chain, axis=1).tobytes()).decode()


def parse(text: str) -> np.ndarray:
    return np.unpackbits(np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, BITS // 8), axis=1).astype(bool)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: best partners' overlap beyond chance, weighted by bits, averaged over both directions."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    na, nb = a.sum(1).astype(np.float32), b.sum(1).astype(np.float32)
    best_a, best_b = np.zeros(len(a), np.float32), np.zeros(len(b), np.float32)
    for i in range(0, len(a), 256):
        for j in range(0, len(b), 256):
            x, y = a[i : i + 256].astype(np.float32), b[j : j + 256].astype(np.float32)
            both, most = x @ y.T, np.minimum.outer(na[i : i + 256], nb[j : j + 256])
            chance = np.outer(na[i : i + 256], nb[j : j + 256]) / BITS
            floor = np.minimum(chance + np.maximum(0.1 * (most - chance), 3 * np.sqrt(chance)), most)
            score = np.where(both >= most, 1, np.clip((both - floor) / np.maximum(most - floor, 1e-6), 0, 1))
            best_a[i : i + 256] = np.maximum(best_a[i : i + 256], score.max(1))
            best_b[j : j + 256] = np.maximum(best_b[j : j + 256], score.max(0))
    return float(((best_a * na).sum() / na.sum() + (best_b * nb).sum() / nb.sum()) / 2)


def entropy_histogram(docs: DataFrame, text_col: str = "text") -> dict[int, int]:
    """Windows per entropy bin over all texts; at most 1001 rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1001, np.int64)
        for b in batches:
            for text in b.column(0):
                data = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                total += np.bincount(entropy_bins(data), minlength=1001)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bin", "n"])

    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    return {r["bin"]: r["n"] for r in rows.collect()}


def fingerprints(docs: DataFrame, rarity: dict[int, int] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, fingerprint."""
    ranks = rank_table(entropy_histogram(docs, text_col) if rarity is None else rarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(1)]
            prints = []
            for t in texts:
                data = np.frombuffer(t.encode(), np.uint8)
                prints.append(digest(filters(data, entropy_bins(data), ranks)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(prints, pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


class _Text:
    __slots__ = ("doc_id", "text", "data", "bins", "chain")

    def __init__(self, doc_id: int | None, text: str, ranks: np.ndarray):
        self.doc_id, self.text = doc_id, text
        self.data = np.frombuffer(text.encode(), np.uint8)
        self.bins = entropy_bins(self.data)
        self.chain = filters(self.data, self.bins, ranks)

    def against(self, other: _Text, ranks: np.ndarray) -> tuple:
        """The row of this text, edited by putting the other's beginning in place of its last half."""
        n = len(self.text)
        head, tail = self.text[: n - n // 2], other.text[: n // 2]
        left, right = self.data[: len(head.encode())], other.data[: len(tail.encode())]
        edited = filters(np.concatenate((left, right)), spliced_bins(left, self.bins, right, other.bins), ranks)
        sha = hashlib.sha256(left.tobytes() + right.tobytes()).hexdigest()
        return self.doc_id, n, sha, digest(self.chain), digest(edited), likeness(self.chain, edited), likeness(self.chain, other.chain)


_PAIR = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_NAMES = [c.split()[0] for c in _PAIR.split(", ")]


#: Documents in a bucket of neighbours, and the most buckets.
BUCKET, BUCKETS = 4000, 50_000


def neighbour_likeness(docs: DataFrame, rarity: dict[int, int] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its text with the last half replaced from the next document, and both likenesses.

    Next is in order of doc_id (nulls first, ties by text), after the last the first. Documents are dealt to
    buckets between quantiles of doc_id, which are ids themselves; a bucket's first document is also sent to
    the bucket before, as its end. Each text is moved once and buckets are streamed, one document held.
    """
    ranks = rank_table(entropy_histogram(docs, text_col) if rarity is None else rarity)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), key.alias("key"))
    span = rows.agg(F.count("*").alias("n"), F.min("key").alias("low")).first()
    parts = max(1, min(BUCKETS, (span["n"] or 0) // BUCKET))
    splits = [span["low"] or 0]
    if parts > 1:
        splits += rows.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], max(10_000, 10 * parts))).first()[0]  # one id a bucket
    splits = np.array(sorted(set(splits)), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text", "key", "bucket", "end"]
        for b in batches:
            keys = b.column(2).to_numpy()
            bucket = np.searchsorted(splits, keys, "right") - 1
            first = np.flatnonzero(splits[bucket] == keys)
            ends = b.take(pa.array(first))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bucket, pa.int32()), pa.array(np.zeros(len(keys), bool))], names)
            yield pa.RecordBatch.from_arrays([*ends.columns, pa.array((bucket[first] - 1) % len(splits), pa.int32()), pa.array(np.ones(len(first), bool))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, None

        def batch(found):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found) if found else [[]] * 7, _KINDS)], _NAMES)

        for b in batches:
            found = []
            for doc_id, text, bucket, end in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if bucket != at:
                    at, last = bucket, None
                elif last is None:
                    continue  # further rows with the id of the next bucket's first
                now = _Text(doc_id, text.as_py(), ranks)
                if last is not None:
                    found.append(last.against(now, ranks))
                last = None if end else now
                if len(found) == 500:
                    yield batch(found)
                    found = []
            yield batch(found)

    dealt = rows.mapInArrow(deal, "doc_id long, text string, key long, bucket int, end boolean")
    dealt = dealt.repartitionById(len(splits), F.col("bucket")).sortWithinPartitions("bucket", "end", "key", "text")  # one bucket a task
    return dealt.select("doc_id", "text", "bucket", "end").mapInArrow(run, _PAIR)
