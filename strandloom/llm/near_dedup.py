"""MinHash near-duplicate linking by a multi-index Hamming join.

A document's set: its distinct five-word shingles (fewer words: the whole sequence; none: empty, linked
with nothing). Documents are linked when the Jaccard similarity of full sets reaches the threshold;
components of links are the groups.

Method. Rows with equal sets form a class, whose node is its smallest doc_id. A class has a signature of
``SYMBOLS`` b-bit MinHash symbols, which is split into chunks. For each chunk a key
is made for every way of leaving one symbol out, so that two signatures whose distance is at most
2 * CHUNKS - 1 share a key (pigeonhole: some chunk then has at most one error). Pairs that share no key
despite a Jaccard similarity of 0.75 have probability 0.262 ** CHUNKS, 1e-7.

Within a key's bucket all pairs are never emitted. Each member is first compared, on full sets, with the
bucket's smallest node; components of these links are taken; then only pairs that lie in different
components can matter, at least one of them apart from the leader's component. Of those the triangle
inequality of the Jaccard distance against the leader, the ratio of set sizes and the distance of longer
one-bit signatures rule out most inside the join; the rest are compared on full sets too, each pair once. The
longer signature belongs to the method's threshold like the keys: a pair of similarity 0.75 differs by more than ``FAR`` of
its ``SKETCH`` bits (5 standard deviations) with probability 3e-7, a more similar one more rarely. It lets pairs of similarity
0.68 and more through, so that families of texts just below the threshold cost comparisons. No bucket, partner or candidate is capped.

Nulls: text null counts as empty; a row without doc_id takes its class's node. Rows that share a doc_id
are one node. Empty tables give empty results. Further columns are ignored by ``near_duplicates`` and kept
by ``near_dedup``.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, fresh_name, materialise, shingle_sets

CHUNKS, CHUNK, WORDS = 12, 4, 5
SYMBOLS = CHUNKS * CHUNK
#: One-bit symbols of a sketch, and how many may differ at similarity 0.75: 256 expected, 5 standard deviations more.
SKETCH, FAR = 2048, 331
#: Members that are compared with one hub in one task.
HUB = 200

_R = np.random.default_rng(97531)
_XOR = _R.integers(0, 2**32, SYMBOLS, dtype=np.uint32)[:, None]
_TIMES = (_R.integers(0, 2**31, SYMBOLS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_SKETCH_XOR = _R.integers(0, 2**32, SKETCH, dtype=np.uint32)[:, None]
_SKETCH_TIMES = (_R.integers(0, 2**31, SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]


def signature(shingles: np.ndarray) -> np.ndarray:
    """16-bit MinHash symbols of a set of 64-bit shingle hashes."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(SYMBOLS, 2**32 - 1, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(low, ((x[i : i + 2048] ^ _XOR) * _TIMES).min(1), out=low)
    low = (low ^ (low >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return ((low ^ (low >> np.uint32(12))) * np.uint32(0x297A2D39) >> np.uint32(16)).astype("<u2")


_LEFT_OUT = np.array([[c * CHUNK + j for j in range(CHUNK) if j != o] for c in range(CHUNKS) for o in range(CHUNK)])


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """For each signature, the keys under which it is found: one per chunk and symbol left out."""
    s = signatures.astype(np.uint64)[:, _LEFT_OUT]
    key = np.zeros(s.shape[:2], np.uint64)
    for j in range(CHUNK - 1):
        key = key << np.uint64(16) | s[:, :, j]
    key |= np.arange(len(_LEFT_OUT), dtype=np.uint64) << np.uint64(48)
    return key.view(np.int64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """One bit of each of SKETCH further MinHash symbols, as 64-bit integers."""
    x, bits = (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32), []
    for f in range(0, SKETCH, 64):
        low = np.full(64, 2**32 - 1, np.uint32)
        for i in range(0, len(x), 2048):
            np.minimum(low, ((x[i : i + 2048] ^ _SKETCH_XOR[f : f + 64]) * _SKETCH_TIMES[f : f + 64]).min(1), out=low)
        low = (low ^ (low >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        bits.append((low >> np.uint32(24)) & np.uint32(1))
    return np.packbits(np.concatenate(bits).astype(np.uint8)).view(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes, ids, sigs = [], [], []
        for s in shingle_sets(b.column(1), WORDS):
            sizes.append(len(s))
            ids.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sigs.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "class", "signature"])


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, SYMBOLS)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = chunk_keys(_signatures(b.column(1)))
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(b.column(0).to_numpy(), keys.shape[1]))], ["key", "node"])


_SHAPE = [f"c{i}" for i in range(CHUNKS)] + [f"s{i}" for i in range(SKETCH // 64)]


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sets: their sizes, chunks of signatures (four symbols a long) and sketches."""
    for b in batches:
        sizes, rows = [], []
        for raw in b.column(1):
            x = np.frombuffer(raw.as_py(), np.uint64)
            sizes.append(len(x))
            rows.append(np.concatenate((signature(x).view("<i8"), sketch(x))))
        cols = np.array(rows, np.int64).reshape(-1, len(_SHAPE)).T
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), *(pa.array(np.ascontiguousarray(c)) for c in cols)], ["node", "n", *_SHAPE])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in shingle_sets(b.column(1), WORDS)], pa.binary())], ["node", "shingles"])


def _intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, part), the hub's own set (b null) first; holds one hub's sets at a time."""
    hub, own = None, []
    for batch in batches:
        out = []
        for a, part, b, raw in zip(*(c.to_pylist() for c in batch.columns)):
            s = np.frombuffer(raw, np.uint64)
            if (a, part) != hub:
                hub, own = (a, part), []
            if b is None:
                own.append(s)
            elif len(s):
                for x in own:
                    if len(x):
                        small, large = (s, x) if len(s) < len(x) else (x, s)
                        at = np.searchsorted(large, small)
                        both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                        out.append((a, b, both, len(s) + len(x) - both))
        cols = list(zip(*out)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "both", "either"])


def shingle_table(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The full sets (node, shingles) of all nodes in pairs (a, b), as a written table."""
    nodes = materialise(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "nodes")
    texts = docs.join(broadcast_if_small(nodes), "doc_id", "left_semi").select("doc_id", "text")
    return materialise(texts.mapInArrow(_sets, "node long, shingles binary").filter(F.length("shingles") > 0), "sets")


def compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Sizes of intersection and union of the full sets of each pair (a, b) of nodes; both arguments are written tables.

    A hub's set is sent once for every HUB of its partners, each partner's once per pair.
    """
    parts = materialise(pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB).cast("int").alias("parts")), "parts")
    # Hubs of several parts are at most a HUB-th of the pairs; those of one part need no join.
    large = broadcast_if_small(parts.filter("parts > 1"))
    hubs = parts.join(sets, F.col("a") == F.col("node")).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "shingles")
    part = F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part")
    members = pairs.join(large, "a", "left").select("a", "b", part).join(sets, F.col("b") == F.col("node")).select("a", "part", "b", "shingles")
    both = hubs.unionByName(members).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    found = both.mapInArrow(_intersect, "a long, b long, both long, either long")
    return found.groupBy("a", "b").agg(F.max_by(F.struct("both", "either"), F.col("both") / F.col("either")).alias("x")).select("a", "b", "x.both", "x.either")


def components(edges: DataFrame, label: str = "labels") -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b), for nodes that have an edge.

    Each round takes the least label among neighbours, then the label's own label, which halves
    distances; rounds end when no label changes.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).filter("u <> v").distinct()
    both = materialise(both, f"{label}-edges")
    labels = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("component")).withColumnRenamed("u", "node"), f"{label}-0")
    turn = 0
    while True:
        turn += 1
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("component").alias("least"))
        new = labels.join(near, F.col("node") == F.col("u")).select("node", F.col("component").alias("old"), F.least("component", "least").alias("at"))
        of = labels.select(F.col("node").alias("at"), F.col("component").alias("further"))
        new = materialise(new.join(of, "at", "left").select("node", "old", F.least("at", F.coalesce("further", "at")).alias("component")), f"{label}-{turn}")
        labels = new.select("node", "component")
        if new.filter("old <> component").isEmpty():
            return labels


def _apart(left: str, right: str) -> Column:
    """Number of differing bits of two sketches."""
    return reduce(operator.add, (F.bit_count(F.col(f"{left}.s{i}").bitwiseXOR(F.col(f"{right}.s{i}"))) for i in range(SKETCH // 64)))


def _first_shared(left: str, right: str) -> Column:
    """Whether the row's key is the first that both signatures share, so that a pair is made in one bucket only."""
    index = F.shiftright(F.col(f"{left}.key"), 48).cast("int")
    fine = []
    for i in range(CHUNKS):
        x = F.col(f"{left}.c{i}").bitwiseXOR(F.col(f"{right}.c{i}"))
        y = x
        for step in (8, 4, 2, 1):
            y = y.bitwiseOR(F.shiftrightunsigned(y, step))
        errors = F.bit_count(y.bitwiseAND(F.lit(0x0001000100010001)))
        fine.append((index < CHUNK * (i + 1)) | (errors > 1))
        fine.append((index <= CHUNK * i) | (index >= CHUNK * (i + 1)) | (x != 0))
    return reduce(operator.and_, fine)


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (see the module's text)."""
    if not 75 <= percent <= 100:
        raise ValueError("percent: 75 to 100; keys and bounds are laid out for similarities of 0.75 or more")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    features = materialise(docs.mapInArrow(_features, "doc_id long, n_shingles long, class binary, signature binary"), "features")
    classes = features.filter("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature"))
    classes = materialise(classes, "classes")
    known = classes.filter("node is not null")
    keys = known.select("node", "signature").mapInArrow(_keys, "key long, node long")
    leaders = keys.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).filter("leader < last").drop("last")
    members = materialise(keys.join(leaders, "key").distinct(), "members")
    stars = materialise(members.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    sets = shingle_table(docs, stars)
    first = materialise(compare(stars, sets), "first")
    linked = F.expr(f"100 * both >= {percent} * either")
    links = first.filter(linked).select("a", "b")
    groups = components(links, "stars")

    # Pairs of one bucket in different components, one of them at least outside the leader's.
    near = first.select(F.col("a").alias("leader"), F.col("b").alias("node"), (1 - F.col("both") / F.col("either")).alias("d"))
    of = groups.select(F.col("node").alias("leader"), F.col("component").alias("main"))
    seen = members.join(near, ["leader", "node"], "left").join(groups, "node", "left").join(of, "leader", "left")
    seen = seen.select("key", "node", F.coalesce("d", F.lit(0.0)).alias("d"), F.coalesce("component", "node").alias("component"), F.coalesce("main", "leader").alias("main"), (F.col("node") == F.col("leader")).alias("leads"))
    mixed = seen.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("key")
    seen = materialise(seen.join(mixed, "key", "left_semi").filter("not leads").drop("leads"), "mixed")
    crowd = materialise(seen.select("node").distinct(), "crowd")
    shape = sets.join(broadcast_if_small(crowd), "node", "left_semi").mapInArrow(_shapes, "node long, n long, " + ", ".join(f"{c} long" for c in _SHAPE))
    seen = materialise(seen.join(shape, "node"), "shapes")
    outside = seen.filter("component <> main")
    limit = percent / 100
    apart = (
        (F.col("o.component") != F.col("m.component"))
        & ((F.col("m.component") == F.col("m.main")) | (F.col("o.node") < F.col("m.node")))
        & (F.abs(F.col("o.d") - F.col("m.d")) <= 1 - limit + 1e-9)
        & (F.least("o.n", "m.n") >= limit * F.greatest("o.n", "m.n"))
        & _first_shared("o", "m")
        & (_apart("o", "m") <= FAR)
    )
    cross = outside.alias("o").join(seen.alias("m"), "key").filter(apart).select("o.node", F.col("m.node").alias("b"))
    cross = materialise(cross.toDF("a", "b").distinct().join(first, ["a", "b"], "left_anti"), "cross")
    second = compare(cross, sets).filter(linked).select("a", "b")
    parents = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
    final = components(parents.union(second).distinct(), "final")

    node = classes.select("class", "node").join(final, "node", "left").select("class", F.coalesce("component", "node").alias("component"))
    out = features.join(node, "class", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_dedup(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that another document of their group stands for; all columns stay."""
    gone = near_duplicates(docs, percent, id_col, text_col).filter("not kept").select(F.col("doc_id").alias(fresh_name(docs, "gone_id")))
    gone = materialise(gone.distinct(), "gone")
    return docs.join(broadcast_if_small(gone), docs[id_col] == gone[gone.columns[0]], "left_anti")
