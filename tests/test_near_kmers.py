"""K-mers near those of reads: found where the contigs' windows are made, none else leave their task, and the same as by comparing all with all."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import screen, windows
from strandloom.plans import fixtures, q_screen

SF = "/root/testdata/sf0.001"


def canonical(x):
    return min(x, x[::-1].translate(str.maketrans("ACGT", "TGCA")))


@pytest.mark.parametrize("k, mismatches", [(2, 2), (4, 1), (5, 2), (15, 1), (21, 2), (32, 2), (40, 2), (75, 1)])
def test_near_kmers_are_those_of_all_pairs(spark, k, mismatches):
    draw = random.Random(k)
    texts = ["".join(draw.choice("ACGT") for _ in range(300)) for _ in range(3)]
    texts += [texts[0][:120] + "N" + texts[1][:50].lower(), "A" * 150 + "C" + "A" * 90, "ACG"[: k - 1], None]
    rows = [(None if i == 4 else f"g{i % 2}", t) for i, t in enumerate(texts)]
    own = {canonical(t[i : i + k]) for t in texts[:1] for i in range(0, 200, 7)} | {"A" * k}
    queries = sorted({q[:i] + draw.choice("ACGT") + q[i + 1 :] for q in own for i in (draw.randrange(k), draw.randrange(k))})
    wanted = set()
    for group, text in rows:
        for i in range(len(text or "") - k + 1):
            w = text[i : i + k].upper()
            if "N" not in w and any(sum(a != b for a, b in zip(canonical(w), q)) <= mismatches for q in queries):
                wanted.add((group, canonical(w)))
    df = spark.createDataFrame(rows, "clade string, seq string").coalesce(1)
    got = [tuple(r) for r in windows.near_kmers(df, k, "clade", queries, mismatches).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted and wanted
    assert windows.near_kmers(df, k, "clade", [], mismatches).collect() == []


@pytest.mark.parametrize("k", [1, 2, 7, 15, 21, 71, 151])
@pytest.mark.parametrize("mismatches", [1, 2])
def test_of_the_kept_parts_one_has_no_error(k, mismatches):
    kept = windows.kept_parts(k, mismatches)
    draw = random.Random(k)
    for _ in range(200):
        wrong = set(draw.sample(range(k), min(k, mismatches)))
        assert any(not wrong & {i for a, b in s for i in range(a, b)} for s in kept)
    if k >= 21:
        assert min(sum(b - a for a, b in s) for s in kept) >= windows.KEY


@pytest.mark.parametrize("k, mismatches", [(15, 1), (21, 2)])
def test_a_panel_for_reads_has_only_kmers_near_them(spark, monkeypatch, k, mismatches):
    reads = q_screen.windows_of_reads(spark, SF, k)
    near, whole = q_screen.panel_near_reads(spark, SF, k, mismatches), q_screen.language_panel(spark, SF, k)
    assert near.columns == whole.columns and near.dtypes == whole.dtypes
    hits = lambda panel: sorted(map(tuple, screen.fuzzy_hits(reads, panel, mismatches, k, [k]).select("sequence_id", "query_position", "matched_kmer", "species_name", "mismatches").collect()))
    assert hits(near) == hits(whole) != []
    assert near.exceptAll(whole).isEmpty() and 0 < near.count() < whole.count() / 20
    monkeypatch.setattr(screen, "NEAR", 10)  # too many reads for an index: the whole panel is joined
    assert screen.near_contigs(reads, fixtures.contigs(spark, SF), "clade", k, mismatches) is None
    assert q_screen.panel_near_reads(spark, SF, k, mismatches).count() == whole.count()
