"""Whitening and vector codes against plain versions."""

import hashlib
import math

import numpy as np
import pytest

from strandloom.llm import vector_codes, vectors, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(rows, dims):
    return [r for r in rows if r[1] is not None and len(r[1]) == dims and all(x is not None and math.isfinite(x) for x in r[1])]


def odd_rows(dims):
    r = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in r.normal(size=dims).astype(np.float32)], int(i % 3) if i % 7 else None) for i in range(150)]
    rows += [(3, rows[3][1], 0), (None, rows[4][1], None), (None, rows[5][1], 9), (7, rows[8][1], 1)]
    bad = [None, [], [1.0] * (dims + 1), [1.0] * (dims - 1) + [float("nan")], [float("inf")] + [0.0] * (dims - 1), [None] + [0.0] * (dims - 1)]
    return rows + [(1000 + i, b, 2) for i, b in enumerate(bad)], rows


def table(spark, rows):
    # Columns of other tables' results clash with none of the operators'.
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return df.selectExpr("*", "1 AS x", "2 AS n", "'c' AS code", "'d' AS component")


def plain_whitening(rows, components):
    x = np.array([[math.floor(64 * v) + 1_000_000 for v in r[1]] for r in rows], object)
    n = len(x)
    off = n * x - x.sum(0)
    c = (off / n).astype(np.float64)
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return n, (off * off).sum(1), c @ u / np.sqrt(e), e / np.trace(v)


@pytest.mark.parametrize("dims", [3, 48])
def test_whitening(spark, dims):
    rows, good = odd_rows(dims)
    good = usable(good, dims)
    n, deviation, white, share = plain_whitening(good, 32)
    k = white.shape[1]
    got = whitening.whiten(table(spark, rows)).collect()
    assert len(got) == n * k and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    sign = {}
    for i, r in enumerate(good):
        for c in range(k):
            rs = by[r[0], deviation[i]][c + 1]
            for x in rs:
                assert x.explained == pytest.approx(share[c], rel=1e-9)
                assert abs(x.whitened) == pytest.approx(abs(white[i, c]), abs=1e-7)
                if abs(white[i, c]) > 1e-3:
                    assert sign.setdefault(c, np.sign(x.whitened) * np.sign(white[i, c])) == np.sign(x.whitened) * np.sign(white[i, c])


def test_range_finder_expands_only_where_residuals_fail(spark):
    r = np.random.default_rng(3)
    steep = r.normal(size=(400, 60)) * (4.0 ** -np.arange(60)) * 100_000  # power passes suffice
    flat = r.normal(size=(400, 60))
    for x, wide in ((steep, False), (flat, True)):
        df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
        rows, d = vectors.integer_vectors(df, {"vec_id": "vec_id"}, "embedding", 64)
        model = whitening.fit(rows, d, components=4)
        assert model.expanded is wide
        z = np.floor(64 * x)
        v = np.cov(z.T, bias=True)
        e, u = np.linalg.eigh(v)
        assert model.eigenvalues == pytest.approx(e[::-1][:4], rel=1e-10)
        assert np.abs(np.abs((u[:, ::-1][:, :4] * model.components).sum(0)) - 1).max() < 1e-10
        assert model.trace == pytest.approx(np.trace(v))
        assert whitening.identity_error(rows, d, model) < 1e-8


def test_deviation_is_exact_beyond_floats(spark):
    rows = [(i, [1e8 + i, -3e7 * i, float(i)], 0) for i in range(12)]
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), components=2, scale=1).collect()}
    x = np.array([[int(v) for v in r[1]] for r in rows], object)
    off = 12 * x - x.sum(0)
    want = (off * off).sum(1)
    assert 2**61 < max(want) < 2**63 and got == {i: int(w) for i, w in enumerate(want)}
    far = spark.createDataFrame([(i, [3e8 * i], 0) for i in range(12)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(far, scale=1).collect()


def test_whitening_without_spread_or_rows(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, 1), (2, [], 1)], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)], SCHEMA)).count() == 0
    line = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [1.0, 4.0], 1)], SCHEMA)).collect()
    assert [(r.component, round(abs(r.whitened), 9), round(r.explained, 9)) for r in line] == [(1, 1.0, 1.0)] * 2


def plain_codes(rows, parts=16, entries=64, rounds=2):
    x = [[math.floor(256 * v) for v in r[1]] for r in rows]
    w = len(x[0]) // parts
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, x[i]))[:entries]
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for v in x]
    books = [[cut[i][p] for i in first] for p in range(parts)]

    def near(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            of = [near(p, v[p])[1] for v in cut]
            for j in range(len(books[p])):
                mine = [v[p] for v, o in zip(cut, of) if o == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine)]  # changes no other entry's assignment: ``of`` is fixed
    found = [[near(p, v[p]) for p in range(parts)] for v in cut]
    codes = ["".join(f"{j:02x}" for _, j in f) for f in found]
    errors = [sum(d for d, _ in f) for f in found]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    total = {}
    for r, e in zip(rows, errors):
        total[r[2]] = total.get(r[2], 0) + e
    return sorted(((r[0], c, e, total[r[2]], digest) for r, c, e in zip(rows, codes, errors)), key=repr)


@pytest.mark.parametrize("dims, parts", [(64, 16), (16, 16), (48, 16)])
def test_codes(spark, dims, parts):
    rows, good = odd_rows(dims)
    got = sorted((tuple(r) for r in vector_codes.compress(table(spark, rows), parts).collect()), key=repr)
    assert got == plain_codes(usable(good, dims), parts)


def test_codes_of_few_equal_or_no_rows(spark):
    assert vector_codes.compress(spark.createDataFrame([], SCHEMA)).count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1)], SCHEMA)).count() == 0
    rows = [(i, [-0.001] * 16, None) for i in range(70)] + [(70, [0.5] * 16, 1)]
    assert sorted((tuple(r) for r in vector_codes.compress(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr) == plain_codes(rows)
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(1, [1.0] * 5, 1)], SCHEMA))


@pytest.mark.parametrize("size", [3, 1000, 10**11])
def test_partial_distance_search_is_a_full_search(size):
    r = np.random.default_rng(size % 97)
    for k, d in ((1, 4), (5, 1), (64, 4), (200, 12)):
        book, x = r.integers(-size, size + 1, (k, d)), r.integers(-size, size + 1, (300, d))
        full = ((x.astype(object)[:, None, :] - book.astype(object)[None]) ** 2).sum(2)
        at, best, work = vector_codes.nearest(x, book)
        assert [int(b) for b in best] == [int(min(f)) for f in full] and at.tolist() == [int(np.argmin(f)) for f in full]
        if k == 200:
            assert work < 0.8 * x.size * k
    assert vector_codes.order_of_dimensions(np.array([[0, 5, 1], [0, 9, 1], [0, 1, 3]])).tolist() == [1, 2, 0]
