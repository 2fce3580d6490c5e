"""Reads and panels at size: few tasks for many ranges, numbers over all files, a panel that is neither read twice nor moved."""

from pyspark.sql import functions as F

from strandloom.functions import seq
from strandloom.operators import screen
from strandloom.sources import sequences

from test_superkmers import contigs


def test_many_ranges_share_tasks_and_files_one_numbering(spark, tmp_path):
    reads = spark.range(5000).select(F.col("id").cast("string").alias("identifier"), F.lit("").alias("description"), F.lit("ACGTN" * 9).alias("sequence"), F.lit("@+III" * 9).alias("quality"))
    sequences.write_fastq(reads.orderBy(F.col("identifier").cast("long")).repartitionByRange(3, F.col("identifier").cast("long")).sortWithinPartitions(F.col("identifier").cast("long")), str(tmp_path / "x"))
    got = sequences.read_fastq(spark, str(tmp_path / "x"), 1 << 10, across=True)
    assert got.count() == 5000 and got.filter(F.col("record_index") != F.col("identifier").cast("long")).isEmpty()
    scan = sequences.read_fastq(spark, str(tmp_path / "x"), 1 << 10, numbered=False)
    assert scan.select("path", "range_start").distinct().count() > 400 and scan.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert sorted(r[0] for r in scan.groupBy("identifier").count().select("count").distinct().collect()) == [1]


def test_a_panel_of_known_k_is_not_read_for_it_nor_shuffled(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    kmers = seq.kmer_windows(contigs(spark), 21).select(F.lit(21).alias("k"), "kmer").distinct().localCheckpoint()
    panel = kmers.mapInArrow(count, "k int, kmer string")
    w = kmers.limit(200).select(F.lit("s").alias("sample_id"), F.lit("r").alias("sequence_id"), F.lit(0).alias("query_position"), "k", F.col("kmer").alias("window_kmer"), F.concat(F.substring("kmer", 1, 20), F.lit("A")).alias("query_kmer")).localCheckpoint()
    hits = screen.fuzzy_hits(w, panel, 2, 21, [21])
    assert "BroadcastHashJoin" in hits._jdf.queryExecution().toString()
    found = sorted(map(tuple, hits.select("query_kmer", "matched_kmer", "mismatches").collect()))
    assert found and seen.value == kmers.count()
    assert found == sorted(map(tuple, screen.fuzzy_hits(w, panel, 2, 21).select("query_kmer", "matched_kmer", "mismatches").collect()))
