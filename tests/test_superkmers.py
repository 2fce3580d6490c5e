"""Super-k-mers against windows: the same k-mers, sources and positions, with far fewer bytes shuffled."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import seq
from strandloom.operators import panel, superkmers
from strandloom.scratch import materialise

SCHEMA = "doc_id int, genome string, species string, clade string, role string, taxid string, seq string"


def contigs(spark):
    r = random.Random(6)
    dna = lambda n, letters="ACGT": "".join(r.choice(letters) for _ in range(n))
    shared = dna(400)
    flip = str.maketrans("ACGT", "TGCA")
    rows = []
    for i in range(60):
        g = i % 7
        body = dna(r.randint(0, 300)) + shared[r.randint(0, 100) : r.randint(150, 400)] + dna(40, "ACGTNn-")
        body = r.choice([body, body.lower(), body[::-1].translate(flip), "A" * 500, "AC" * 200, dna(30)])
        rows.append((i, f"g{g}" if g else None, f"s{g % 3}", r.choice(["c1", "", None]), "target" if g % 2 else "host", f"t{g}", body))
    rows += [(60, "g1", "s1", "c1", "target", "t1", None), (61, "g1", "s1", "c1", "target", "t1", ""), (62, "g9", "s9", "c9", "target", "t9", "ACGTNACGT")]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def as_rows(df):
    return sorted(map(str, df.select("k", "kmer", "species", "genomes", "clades", "roles", "taxids", F.col("example_position").cast("int"), "n_genomes").collect()))


@pytest.mark.parametrize("k", [1, 2, 5, 15, 21, 31, 32, 33, 51, 64, 151])
def test_equal_to_grouped_windows(spark, k):
    df = contigs(spark)
    want = as_rows(panel.group_kmers(seq.kmer_windows(df, k, keep=("doc_id", *panel.SOURCE)).withColumn("k", F.lit(k))))
    assert as_rows(panel.group_sequences(df, [k])) == want and (len(want) > 100 or k < 5)


def test_a_hot_minimizer_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(superkmers, "HOT", 40)
    df = contigs(spark)
    runs = superkmers.super_kmers(df, 21, F.xxhash64("genome"))
    assert runs.groupBy("minimizer").agg(F.sum("n").alias("n")).filter("n > 40").count() > 3
    want = as_rows(panel.group_kmers(seq.kmer_windows(df, 21, keep=("doc_id", *panel.SOURCE)).withColumn("k", F.lit(21))))
    assert as_rows(panel.group_sequences(df, [21])) == want


def test_blocks_and_several_k(spark, monkeypatch):
    df = contigs(spark)
    both = panel.group_sequences(df, [15, 31])
    assert {r.k: r.n for r in both.groupBy("k").agg(F.count("*").alias("n")).collect()} == {k: seq.kmer_windows(df, k).select("kmer").distinct().count() for k in (15, 31)}
    assert panel.group_sequences(df.limit(0), [15]).count() == 0
    monkeypatch.setattr(superkmers, "BLOCK", 64)
    rows = df.select(F.xxhash64("genome"), "seq").filter("length(seq) >= 15").toArrow().to_batches()
    n = sum(int(np.sum(b.column(3).to_numpy())) for b in superkmers._cut(15)(iter(rows)))
    assert n == seq.kmer_windows(df, 15).count()


def test_fewer_bytes(spark):
    """At k = 51 the super-k-mers of real text take less than a fifth of the bytes of its windows."""
    r = random.Random(1)
    df = spark.createDataFrame([(i, "".join(r.choice("ACGT") for _ in range(2000))) for i in range(100)], "doc_id int, seq string")
    runs = materialise(superkmers.super_kmers(df, 51, F.col("doc_id")), "runs")
    total = runs.agg(F.sum("n").alias("n"), F.sum(F.length("bases") + 28).alias("bytes")).first()
    assert total["n"] == 100 * 1950 and total["bytes"] * 5 < total["n"] * (51 + 16)
