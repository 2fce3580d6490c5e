"""The lowest scores of each group and bin: those of all windows, at their first places, hashed by Spark; sequences are made once for all k."""

import hashlib
import random

import pytest

from strandloom.operators import markers, windows


def canonical(x):
    return min(x, x[::-1].translate(str.maketrans("ACGT", "TGCA")))


@pytest.mark.parametrize("bin_size, quota, row", [(100, 3, 1 << 16), (1000, 2, 40), (70, 1, 30), (100, 2, 100), (1, 2, 1 << 16)])
def test_lowest_scores_are_those_of_all_windows(spark, monkeypatch, bin_size, quota, row):
    monkeypatch.setattr(windows, "ROW", row)  # sent along with the function
    draw = random.Random(quota)
    dna = lambda n, letters="ACGT": "".join(draw.choice(letters) for _ in range(n))
    names, shared = ["g", "a longer name", "\u00e9\u4e16", "", None], dna(300)
    rows = [(i, names[i % 5], draw.choice([dna(400), shared, shared[50:] + dna(80, "ACGTNacgt"), "A" * 300 + dna(9)])) for i in range(40)]
    rows += [(40, "g", None), (41, "g", ""), (42, "once", dna(33)), (43, "copies", shared), *((i, "copies", shared) for i in range(44, 60))]
    shifts = {21: 0, 33: 17, 75: 5}
    places = {}
    for doc, group, text in rows:
        for k, shift in shifts.items():
            for i in range(len(text or "") - k + 1):
                w = text[i : i + k].upper()
                if "N" not in w:
                    kmers = places.setdefault((group, k, (i + shift) // bin_size), {})
                    kmers[canonical(w)] = min(kmers.get(canonical(w), (doc, i)), (doc, i))
    score = lambda group, kmer: hashlib.sha256(f"{group or ''}\t{kmer}".encode()).hexdigest()[:16]
    want = {(group, k, bin_, kmer, *kmers[kmer]) for (group, k, bin_), kmers in places.items() for kmer in sorted(kmers, key=lambda x: (score(group, x), x))[:quota]}
    df = spark.createDataFrame(rows, "doc_id int, genome string, seq string").coalesce(1)
    got = [(r.genome, r.k, r.bin, r.kmer, r.doc_id, r.position) for r in windows.scored_kmers(df, shifts, "genome", "doc_id", bin_size, quota).collect()]
    best = {}
    for *key, doc, position in got:
        best[tuple(key)] = min(best.get(tuple(key), (doc, position)), (doc, position))
    lowest = {}
    for group, k, bin_, kmer in best:
        lowest.setdefault((group, k, bin_), []).append(kmer)
    assert {(*key, kmer, *best[*key, kmer]) for key, kmers in lowest.items() for kmer in sorted(kmers, key=lambda x: (score(key[0], x), x))[:quota]} == want
    assert len(got) == len(want) if (bin_size, row) == (100, 1 << 16) else len(got) >= len(want)


def test_sequences_are_made_once_for_all_k(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    draw = random.Random(1)
    df = spark.createDataFrame([(i, f"g{i % 3}", "".join(draw.choice("ACGT") for _ in range(500))) for i in range(30)], "doc_id int, genome string, seq string")
    got = markers.scored_sequences(df.mapInArrow(count, df.schema), 100, 3, [21, 31, 51])
    assert got.groupBy("k").count().count() == 3 and seen.value == 30
