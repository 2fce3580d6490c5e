"""Best-fit packing of token sequences by minimum bin slack.

Documents become token ids plus an end id. Those longer than a sequence are cut into full sequences; what is
left over is the document's first piece. Packing depends on lengths only, so it is planned on the histogram
of piece lengths, which has at most ``capacity`` rows whatever the corpus's size: per bin, the longest length
left is fixed and a bitset dynamic program over the available lengths finds the fullest feasible combination;
that combination is taken as often as the counts allow. Pieces then find their place by their rank among
pieces of equal length: each task numbers its pieces per length while it tokenises, and offsets per (task,
length) come from a window over counts. Texts are read once; no task holds more than its own batch.

Null text counts as empty (the end id alone). Repeated rows and rows that share a doc_id are packed each.
The strings of the file's added tokens (such as <|endoftext|>) inside a text give those tokens' ids with
``added=True``, as an unmodified tokenizer gives them, and are ordinary text otherwise. An empty table gives an empty result. Columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise

#: The pre-tokenisation of byte-level BPE.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Characters of a text that are tokenised at once.
SEGMENT = 1 << 20
#: Bytes of ids that a task holds before it hands them on.
HELD = 1 << 20
PIECES = "doc_id long, piece int, start long, length long, ids binary, part int, rank long"
_LOADED: dict = {}


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _encoder(path: str):
    """A byte-level BPE of a tokenizers JSON file, its merges ranked by id; added tokens are left out (see ``encode_texts``).

    The ids are those of the tokenizers library (a test holds both together); this encoder is several times
    faster on short texts.
    """
    if path not in _LOADED:
        import tiktoken

        model, letter = json.load(open(path, encoding="utf-8")), _byte_letters()
        special = {t["content"] for t in model.get("added_tokens", []) if t.get("special")}
        ranks = {bytes(letter[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        _LOADED[path] = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def segments(text: str) -> Iterator[str]:
    """The text cut before single spaces that a word follows; byte-level BPE never joins tokens there."""
    low = 0
    while len(text) - low > SEGMENT:
        cut = text.find(" ", low + SEGMENT)
        while 0 <= cut < len(text) - 1 and text[cut + 1].isspace():
            cut = text.find(" ", cut + 1)
        if cut < 0 or cut >= len(text) - 1:
            break
        yield text[low:cut]
        low = cut
    yield text[low:]


def _added(path: str) -> tuple[re.Pattern | None, dict[str, int]]:
    """A pattern of the file's added tokens, the leftmost and then the longest first, and their ids."""
    if ("added", path) not in _LOADED:
        tokens = [t for t in json.load(open(path, encoding="utf-8")).get("added_tokens", []) if t["content"]]
        odd = [t["content"] for t in tokens if t.get("single_word") or t.get("lstrip") or t.get("rstrip")]
        if odd:
            raise ValueError(f"added tokens that look at their surroundings are not supported: {odd}")
        names = sorted((t["content"] for t in tokens), key=len, reverse=True)
        _LOADED["added", path] = re.compile("|".join(map(re.escape, names))) if names else None, {t["content"]: t["id"] for t in tokens}
    return _LOADED["added", path]


def encode_texts(path: str, texts: Iterable[str], added: bool = False) -> Iterator[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers; with ``added``, the file's added tokens are found in it."""
    encode = _encoder(path).encode_to_numpy
    pattern, ids = _added(path) if added else (None, {})

    def plain(text: str) -> bytes:
        return b"".join(encode(s, disallowed_special=()).astype("<u4", copy=False).tobytes() for s in segments(text))

    for text in texts:
        parts, low = [], 0
        for m in pattern.finditer(text) if pattern else ():
            # The text before an added token is tokenised for itself.
            parts += [plain(text[low : m.start()]), np.array([ids[m[0]]], "<u4").tobytes()]
            low = m.end()
        yield b"".join([*parts, plain(text[low:])]) if parts else plain(text)


def _tokenise(path: str, end_id: int, capacity: int, added: bool):
    """Pieces of the documents of a task, numbered per length inside the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, ranks, size = TaskContext.get().partitionId(), Counter(), 4 * capacity
        end = np.array([end_id], "<u4").tobytes()

        def batch(rows):
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids", "part", "rank"])

        for b in batches:
            out, held = [], 0
            texts = (t.as_py() or "" for t in b.column(1))
            for doc_id, ids in zip(b.column(0).to_pylist(), encode_texts(path, texts, added)):
                ids += end
                first = len(ids) % size or min(size, len(ids))
                at, piece = 0, 0
                while at < len(ids):
                    till = at + size if at else first
                    n = (till - at) // 4
                    out.append((doc_id, piece, at // 4, n, ids[at:till], part, ranks[n]))
                    ranks[n] += 1
                    at, piece = till, piece + 1
                held += len(ids)
                if held > HELD:
                    yield batch(out)
                    out, held = [], 0
            yield batch(out)

    return run


def _fill(target: int, counts: dict[int, int]) -> list[int]:
    """Lengths, each at most as often as counted, with the largest sum up to ``target``; longer ones first.

    A bitset dynamic program: bit s of reach[i] says that s is a sum of the first i items.
    """
    mask, reach, items = (1 << target + 1) - 1, [1], []
    for length in sorted((x for x in counts if x <= target), reverse=True):
        for _ in range(min(counts[length], target // length)):
            grown = reach[-1] | reach[-1] << length & mask
            if grown == reach[-1]:
                break
            items.append(length)
            reach.append(grown)
            if grown >> target & 1:
                break
        if reach[-1] >> target & 1:
            break
    total, chosen = reach[-1].bit_length() - 1, []
    for i in range(len(items), 0, -1):
        if not reach[i - 1] >> total & 1:
            chosen.append(items[i - 1])
            total -= items[i - 1]
    return chosen[::-1]


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(number of bins, lengths in each) by minimum bin slack; every counted piece is in one bin."""
    left, plan = {k: n for k, n in histogram.items() if n}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        rest = _fill(capacity - longest, {k: n for k, n in left.items() if n})
        left[longest] += 1
        need = Counter([longest, *rest])
        times = min(left[k] // n for k, n in need.items())
        plan.append((times, [longest, *rest]))
        for k, n in need.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return plan


def _slots(plan: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length, in order of rank: first rank, first bin, pieces of that length per bin and their first offset."""
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    seen, bins = Counter(), 0
    for times, lengths in plan:
        at = 0
        for length, n in Counter(lengths).items():
            slots.setdefault(length, []).append((seen[length], bins, n, at))
            seen[length] += n * times
            at += n * length
        bins += times
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in slots.items()}


def _place(slots: dict[int, tuple[np.ndarray, ...]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            length, rank = b.column(names.index("length")).to_numpy(), b.column(names.index("rank")).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                first, bins, per, at = slots[int(length[own[0]])]
                i = np.searchsorted(first, rank[own], "right") - 1
                within = rank[own] - first[i]
                sequence[own] = bins[i] + within // per[i]
                offset[own] = at[i] + within % per[i] * length[own]
            keep = [n for n in names if n not in ("rank", "part")]
            yield pa.RecordBatch.from_arrays([*(b.column(names.index(n)) for n in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    return run


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", added: bool = False) -> DataFrame:
    """A written table of pieces: doc_id, piece, start, length, ids, and the place among equals (part, rank)."""
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return materialise(rows.mapInArrow(_tokenise(tokenizer, end_id, capacity, added), PIECES), "pieces")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, added: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (binary), ids_crc32, sequence_id, offset.

    ``tokenizer``: a tokenizers JSON file of byte-level BPE that executors can open.
    """
    pieces = token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col, added)
    counts = materialise(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    slots = _slots(plan_bins(histogram, capacity))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = materialise(counts.select("part", "length", ahead.alias("ahead")), "offsets")
    rows = pieces.withColumn("ids_crc32", F.crc32("ids"))
    rows = rows if with_ids else rows.drop("ids")
    rows = rows.join(broadcast_if_small(offsets), ["part", "length"]).withColumn("rank", F.col("rank") + F.col("ahead")).drop("ahead")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("rank", "part"))
    return rows.mapInArrow(_place(slots), f"{kinds}, sequence_id long, offset long")
