"""K-mers folded where they meet: the same counts as from one row per k-mer, without writing any."""

import pytest
from pyspark.sql import functions as F

from strandloom import scratch
from strandloom.functions import seq
from strandloom.operators import panel

from test_superkmers import contigs


@pytest.mark.parametrize("k", [5, 15, 21, 51])
def test_folded_sets_equal_grouped_kmers(spark, k):
    df = contigs(spark)
    rows = panel.group_kmers(seq.kmer_windows(df, k, keep=("doc_id", *panel.SOURCE)).withColumn("k", F.lit(k)))
    single = F.when(F.size("species") == 1, F.col("species")[0])
    by = ["clades", "roles", single.alias("one")]
    want = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.size("species").cast("long")), F.sum("n_genomes"), F.sum(F.col("example_position").cast("long")), F.min("kmer"), F.max("kmer"))
    got = panel.group_sets(df, [k]).groupBy(*by).agg(F.sum("n_kmers"), F.sum("n_species"), F.sum("n_genomes"), F.sum("example_position"), F.min("kmer"), F.max("last_kmer"))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))


def test_no_row_per_kmer_is_written(spark, monkeypatch):
    written = []
    monkeypatch.setattr(panel, "materialise", lambda df, label: written.append(scratch.materialise(df, label)) or written[-1])
    df = contigs(spark)
    n = panel.group_sets(df, [21]).agg(F.sum("n_kmers")).first()[0]
    assert n == seq.kmer_windows(df, 21).select("kmer").distinct().count() and sum(w.count() for w in written) * 4 < n


def test_only_kmers_of_other_sequences(spark):
    df = contigs(spark)
    some = df.filter("doc_id % 9 = 0").select(F.substring("seq", 20, 90).alias("seq"))
    held = seq.kmer_windows(some, 21).select("kmer").distinct()
    rows = lambda x: sorted(map(repr, x.select("kmer", "species", "genomes", "example_position").collect()))
    assert rows(panel.group_sequences(df, [21], only=some)) == rows(panel.group_sequences(df, [21]).join(held, "kmer", "left_semi"))


def test_more_genomes_than_bits(spark):
    df = contigs(spark).withColumn("genome", F.concat(F.lit("g"), F.col("doc_id")))
    df = df.union(df.withColumn("genome", F.concat(F.lit("h"), F.col("doc_id"))))
    rows = panel.group_kmers(seq.kmer_windows(df, 21, keep=("doc_id", *panel.SOURCE)).withColumn("k", F.lit(21)))
    assert panel.group_sets(df, [21]).agg(F.sum("n_genomes")).first() == rows.agg(F.sum("n_genomes")).first()


def test_windows_in_arrow_batches(spark, monkeypatch):
    """Every window, sums over them and the first of each bin, as from one row per window; sequences longer than a block included."""
    from strandloom.operators import markers, windows

    long = spark.createDataFrame([(100, "g", "ACGTTGCANC" * 9000), (101, "g", "acgtTTnACGGAT" * 6), (102, "g", "AC"), (103, "g", None)], "doc_id int, genome string, seq string")
    df = contigs(spark).select("doc_id", "genome", "seq").union(long).withColumn("seq", F.regexp_replace("seq", "-", "N"))
    rows = lambda x: sorted(map(repr, map(tuple, x.collect())))
    upper = df.withColumn("seq", F.upper("seq"))
    raw = seq.kmer_windows(upper, 31, canonicalise=False, skip_ambiguous=False, keep=("doc_id",))
    assert rows(windows.every_window(upper, 31, ["doc_id"])) == rows(raw.withColumn("valid", seq.is_valid_kmer(F.col("kmer"))))
    many = seq.multi_k_windows(df, [15, 51], keep=("doc_id",)).groupBy("doc_id", "k").agg(F.count("*"), F.min("kmer"), F.max("position"))
    assert rows(windows.summed_windows(df, [15, 51], ["doc_id"])) == rows(many)
    w = seq.multi_k_windows(df, [15, 21], keep=("doc_id", "genome"))
    columns = ("doc_id", "genome", "k", "position", "kmer", "bin")
    assert rows(markers.sample_sequences(df, 100, 3, [15, 21]).select(*columns)) == rows(markers.sample_universe(w, 100, 3, [15, 21]).select(*columns))
