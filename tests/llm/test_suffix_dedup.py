"""Suffix sorting and removal of repeated passages against plain versions."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strandloom.llm import queries, suffix_dedup
from strandloom.llm.common import utf8

SF = "/root/testdata/sf0.001"


def plain(texts, length):
    """n_bytes, spans and remaining bytes of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([False], gone)).astype(int)))
        out.append((len(t), [tuple(map(int, x)) for x in edge.reshape(-1, 2)], bytes(b for b, g in zip(t, gone) if not g)))
    return out


@pytest.mark.parametrize("shallow", [0, 8, 16, 24])
@pytest.mark.parametrize("length, letters", [(1, 2), (7, 2), (16, 1), (20, 2), (33, 3), (200, 2)])
def test_deep_shallow_is_a_suffix_sort(length, letters, shallow):
    r = np.random.default_rng(length)
    block = r.integers(0, letters, 300).astype(np.uint8) + 250  # signed comparisons would show
    data = np.concatenate([block, r.integers(0, 256, 300).astype(np.uint8), block[:250], np.zeros(220, np.uint8), block[37:], np.full(length, 7, np.uint8)])
    starts = r.permutation(len(data) - length + 1)
    order, head = suffix_dedup.deep_shallow(data, starts, length, shallow)
    strings = [data[s : s + length].tobytes() for s in starts[order]]
    assert sorted(order.tolist()) == list(range(len(starts))) and strings == sorted(strings)
    assert head.tolist() == [i == 0 or strings[i] != strings[i - 1] for i in range(len(strings))]


def test_deep_shallow_without_starts():
    order, head = suffix_dedup.deep_shallow(np.empty(0, np.uint8), np.empty(0, np.int64), 5)
    assert len(order) == len(head) == 0


def test_anchors_depend_on_the_string_alone(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab") for _ in range(n)) for n in (0, 19, 20, 500, 3000, 5)] + ["z" * 100, None, ""]
    row, start, n, gram, _ = suffix_dedup.anchors(*utf8(pa.array(texts)), 20)
    of = {}
    for r, s, k, g in zip(row, start, n, gram):
        for p in range(s, s + k):
            of.setdefault(texts[r][p : p + 20], set()).add(int(g))
    assert sum(n) == sum(max(0, len(t or "") - 19) for t in texts) and all(len(g) == 1 for g in of.values())


def corpus():
    """Texts over few words: whole copies, shared passages at the rim and inside, near copies, repeats in one text, junk."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage, other = prose(12), prose(30)
    texts = [prose(rng.randint(0, 40)) for _ in range(60)]
    texts += [prose(rng.randint(0, 9)) + passage + prose(rng.randint(0, 9)) for _ in range(70)]
    texts += [other[: rng.randint(1, len(other))] for _ in range(20)] + [other] * 5
    near = prose(50).split(" ")
    for _ in range(25):
        at = rng.randrange(len(near))
        texts.append(" ".join(near[:at] + ["edit"] + near[at + 1 :]))
    texts += ["x" * 300, "x" * 39, "x" * 40, "x" * 41, "ab" * 100, passage + passage, None, None, "", " "]
    return texts


@pytest.mark.parametrize("crowd, block", [(4096, 1 << 18), (3, 500)])
def test_against_brute_force(spark, monkeypatch, crowd, block):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "SORTED", block)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7" if crowd == 3 else "10000")
    texts = corpus()
    ids = [None if i % 9 == 0 else i // 2 if i % 5 == 0 else i for i in range(len(texts))]
    # Columns of the names that the operator uses inside.
    df = spark.createDataFrame([(i, t, 1, "g", -1) for i, t in zip(ids, texts)], "doc_id long, text string, place int, gram string, second int").repartition(6)
    try:
        got = suffix_dedup.dedup_substrings(df, 40).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = plain(texts, 40)
    assert sum(w[0] - len(w[2]) for w in want) > 5000
    key = lambda x: repr(x)
    assert sorted(((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in got), key=key) == sorted(((i, *w) for i, w in zip(ids, want)), key=key)


def test_equal_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "y" * 10 + "abc" * 4)] * 3 + [(1, "abc" * 4)], "doc_id long, text string")
    assert sorted((r.n_bytes, bytes(r.kept)) for r in suffix_dedup.dedup_substrings(df, 10).collect()) == [(12, b""), (22, b""), (22, b""), (22, b"")]
    assert suffix_dedup.dedup_substrings(df.limit(0), 10).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.dedup_substrings(df, 1)


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {d.doc_id: (n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest()) for d, (n, spans, kept) in zip(docs, plain([d.text for d in docs], 200))}
    assert any(w[1] for w in want.values())
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op11_suffix_dedup(spark, SF).collect()} == want
