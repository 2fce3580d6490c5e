"""Screening a stream of reads: the batch operators on micro-batches, evidence kept up to date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence, screen


def stream_hits(reads: DataFrame, panel: DataFrame, k_values: Sequence[int]) -> DataFrame:
    """Hits of streamed reads (sample_id, sequence_id, seq) against a static panel: a stateless stream-static join."""
    return screen.exact_hits(screen.read_windows(reads, k_values), panel)


def stream_label_counts(reads: DataFrame, panel: DataFrame, k_values: Sequence[int], time_col: str, delay: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Hits per sample, species and event-time window; state is dropped once the watermark has passed a window."""
    hits = reads.withWatermark(time_col, delay)
    windows = screen.multi_window(hits, k_values, time_col)
    found = windows.join(panel.select("k", F.col("kmer").alias("query_kmer"), "species_name"), ["k", "query_kmer"])
    return found.groupBy(F.window(time_col, window).alias("window"), "sample_id", "species_name").agg(F.count("*").alias("n_hits"))


#: What calls need of a hit.
COUNTED = ("sample_id", "sequence_id", "k", "matched_kmer", "mismatches", "panel_type", "species_name", "clade")


def write_hits(hits: DataFrame, path: str, checkpoint: str):
    """Write each micro-batch's distinct hits to a partition of its own; a batch that is run again replaces what it wrote."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.groupBy(*COUNTED).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return hits.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def calls_so_far(spark: SparkSession, path: str, rules: evidence.CallRules = evidence.PRESETS["legacy"]) -> DataFrame:
    """Calls over all hits written so far, when they are asked for."""
    rows = spark.read.parquet(path).select(*COUNTED, "n")
    return evidence.call_species(evidence.species_evidence(evidence.label_hits(rows, weight="n")), rules)
