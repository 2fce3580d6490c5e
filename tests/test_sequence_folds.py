"""What is folded from sequences equals what rows of windows give, and few rows leave a task."""

import pytest
from pyspark.sql import functions as F

from strandloom.functions import scores, seq
from strandloom.operators import kmersets, markers, panel, screen, taxonomy

from test_superkmers import contigs


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def windows(df, k):
    return seq.kmer_windows(df, k, keep=("doc_id", *panel.SOURCE)).withColumn("k", F.lit(k))


def tree(spark):
    nodes = [("1", "1", "no rank", "root"), ("g", "1", "genus", "g"), *((f"t{i}", "g" if i < 4 else "1", "species", f"t{i}") for i in range(10))]
    return taxonomy.index(spark.createDataFrame(nodes, "taxid string, parent string, rank string, name string"))


@pytest.mark.parametrize("k", [5, 21, 51])
def test_target_evidence_is_folded(spark, k):
    df = contigs(spark)
    e = panel.target_evidence(windows(df, k))
    n, hits = F.size("target_species"), F.sum("candidate_hits")
    want = e.groupBy(n.alias("n"), (F.size("non_target_taxids") > 0).alias("known")).agg(F.count("*"), F.sum(F.col("example_position").cast("long")), hits)
    got = panel.target_sets(df, k).groupBy("n_species", "known").agg(F.sum("n_kmers"), F.sum("positions"), F.sum("hits"))
    assert rows(got) == rows(want)
    both = panel.target_diagnostics(e).groupBy("panel_type", "species_name", "evidence_rank").agg(F.count("*"))
    assert rows(panel.diagnostic_sets(panel.target_sets(df, k)).groupBy("panel_type", "species_name", "evidence_rank").agg(F.sum("n_kmers"))) == rows(both)
    shared = e.filter("candidate_hits > 0").select("kmer", "non_target_taxids", "candidate_hits")
    assert rows(panel.target_overlaps(df, k).select("kmer", "non_target_taxids", "candidate_hits")) == rows(shared)


@pytest.mark.parametrize("k", [5, 21])
def test_merged_panels_of_sequences(spark, k):
    named = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("species"))
    df = contigs(spark).select("*", named.alias("species_name"), F.coalesce("taxid", F.lit("")).alias("evidence_taxid"))
    df = df.withColumn("clade", F.concat(F.lit("c"), F.col("doc_id") % 5))
    records = seq.kmer_windows(df, k, keep=("species_name", "clade", "evidence_taxid")).select(F.lit(k).alias("k"), "kmer", "species_name", "clade", "evidence_taxid", F.col("position").alias("example_position")).distinct()
    kept, removed = panel.merge_panels(records)
    got, gone = panel.merge_sequences(df, k)
    by = ("status", "panel_type", "species_name")
    assert rows(got.groupBy(*by).agg(F.sum("n_kmers"), F.sum("example_position"))) == rows(kept.groupBy(*by).agg(F.count("*"), F.sum(F.col("example_position").cast("long"))))
    columns = ("k", "kmer", "species_name", "clade", "reason")
    want = rows(removed.groupBy(*columns).agg(F.count("*")))
    assert rows(gone.select(*columns, "n")) == want and want
    nodes, by = tree(spark), ("evidence_taxid", "evidence_rank", "status")
    assert rows(panel.merge_sequences_by_taxonomy(df, k, nodes).groupBy(*by).agg(F.sum("n_kmers"))) == rows(panel.merge_panels_by_taxonomy(records, nodes).groupBy(*by).agg(F.count("*")))


def test_sets_of_one_taxid_stay_apart(spark):
    """Nothing but their taxids tells these sequences apart."""
    df = contigs(spark).withColumns({c: F.lit("") for c in ("genome", "species", "clade", "role")})
    want = panel.group_kmers(windows(df, 21)).filter(F.size("taxids") == 1).groupBy("taxids").agg(F.count("*"))
    assert rows(panel.group_sets(df, [21], tree(spark)).filter(F.size("taxids") == 1).groupBy("taxids").agg(F.sum("n_kmers"))) == rows(want)


def test_validation_and_levels_of_sequences(spark):
    df = contigs(spark).select(F.when(F.col("doc_id") % 5 == 0, 22).otherwise(21).alias("k"), F.when(F.col("doc_id") % 7 == 0, "").otherwise("species").alias("evidence_rank"), F.col("species").alias("evidence_name"), "seq")
    records = seq.kmer_windows(df, 21, keep=("k", "evidence_rank", "evidence_name")).drop("position").distinct()
    assert rows(panel.validate_sequences(df, 21)) == rows(panel.validate_panel(records).groupBy("severity", "issue").agg(F.count("*")))
    by = ("k", "evidence_rank", "evidence_name")
    assert rows(panel.count_sources(df, 21, by)[0].select(*by, "n_kmers")) == rows(records.groupBy(*by).agg(F.count("*")))


def test_counts_by_source_and_frequent_kmers(spark):
    df = contigs(spark).filter("genome is not null")
    w = seq.kmer_windows(df, 21, canonicalise=False, keep=("genome",))
    assert rows(panel.count_sources(df, 21, ["genome"], both=False)[0].select("genome", "n_windows", "n_kmers")) == rows(w.groupBy("genome").agg(F.count("*"), F.count_distinct("kmer")))
    panels = windows(df, 21).select("k", "kmer", "clade")
    merged = screen.merge_markers([panels.filter("clade = 'c1'"), panels], ["k", "kmer", "clade"])
    both = df.filter("clade = 'c1'").unionByName(df)
    assert rows(panel.count_sources(both, 21, ["clade"])[0].select("clade", "n_kmers")) == rows(merged.groupBy("clade").agg(F.count("*")))


def test_global_records_of_sequences(spark):
    df = contigs(spark).filter("genome is not null")
    parts = windows(df, 21).select("k", "kmer", "species", F.col("genome").alias("genomes"), F.col("position").alias("example_position"))
    assert rows(panel.merge_global_sequences(df, 21, 2)) == rows(panel.merge_global(parts).filter("contains(genomes, ';')").select("k", "kmer", "species", "genomes", "example_position"))


def _scored(df, k_values):
    w = seq.multi_k_windows(df, k_values, keep=("doc_id", "genome"))
    first = w.select("*", scores.shifted_bin(F.col("position"), F.col("k"), k_values, 100).alias("bin")).groupBy("genome", "k", "kmer", "bin").agg(F.min(F.struct("doc_id", "position")).alias("at"))
    return first.select("genome", "at.doc_id", "k", "at.position", "kmer", "bin", seq.marker_score(F.col("genome"), F.col("kmer")).alias("score"))


def test_leading_markers_of_sequences(spark):
    df, ks = contigs(spark), [21, 51]
    want, got = _scored(df, ks), markers.scored_sequences(df, 100, 3, ks)
    assert rows(markers.spread_markers(got, ["genome"], 3, 40).select(want.columns)) == rows(markers.spread_markers(want, ["genome"], 3, 40))
    assert got.count() * 2 < want.count()
    key = ["genome", "doc_id", "k", "position", "kmer"]
    assert rows(markers.independent_markers(got, ["genome"], 3, 40, 30).select(key)) == rows(markers.independent_markers(want, ["genome"], 3, 40, 30).select(key))
    df, chosen = df.filter("genome is not null"), markers.Selection("first_seen", cap=50)
    all_, first = _scored(df, [21]), markers.scored_sequences(df, 100, 50, [21], by_score=False)
    whole = markers.capped_panel(all_, ["genome"], chosen)
    some = markers.capped_panel(first, ["genome"], chosen, candidates=markers.count_candidates(df, 100, 21))
    assert rows(some[0].select(key)) == rows(whole[0].select(key)) and rows(some[1]) == rows(whole[1])


def test_spaced_sample_of_sequences(spark):
    """Long sequences, a contig in two rows and null genomes included."""
    long = spark.createDataFrame([(100, "g", "ACGTTGCANC" * 9000), (59, None, "ACGATTGC" * 90), (59, None, "ACGTTTGC" * 90)], "doc_id int, genome string, seq string")
    df = contigs(spark).select("doc_id", "genome", "seq").union(long)
    w = seq.multi_k_windows(df.filter("doc_id <> 59"), [15, 21, 31], keep=("doc_id", "genome"))
    for order in (None, [15, 31, 21]):
        want = markers.sample_universe_spaced(w, 200, 2, [15, 21, 31], 20, order)
        assert rows(markers.sample_sequences_spaced(df.filter("doc_id <> 59"), 200, 2, [15, 21, 31], 20, order)) == rows(want)
    both = seq.multi_k_windows(df.filter("doc_id = 59"), [15, 21], keep=("doc_id", "genome"))
    places = lambda x: rows(x.select("genome", "doc_id", "k", "position"))
    assert places(markers.sample_sequences_spaced(df.filter("doc_id = 59"), 200, 2, [15, 21], 20)) == places(markers.sample_universe_spaced(both, 200, 2, [15, 21], 20))
