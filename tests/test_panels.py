"""Panels at rest: fixed columns, joins that leave the panel where it is, choice of format."""

import re

import pytest
from pyspark.sql import functions as F

from strandloom.operators import screen
from strandloom.sources import panels, tables


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def markers(spark, n=3000):
    i = F.col("id")
    kmer = F.translate(F.lpad(F.conv((i * 7919 + 13).cast("string"), 10, 4), 15, "0"), "0123", "ACGT")
    return spark.range(n).select(F.lit(15).alias("k"), kmer.alias("kmer"), F.concat(F.lit("s"), (i % 3).cast("string")).alias("species_name"), F.array(F.lit("g1"), F.concat(F.lit("g"), (i % 2 + 2).cast("string"))).alias("source_genomes"), i.alias("extra"))


@pytest.mark.parametrize("buckets, several", [(16, False), (8, True), (12, True)])
def test_joins_leave_the_panel_in_its_buckets(spark, tmp_path, no_broadcast, buckets, several):
    path = f"file://{tmp_path}/p"
    assert panels.write_panel(markers(spark), path, buckets) == buckets
    panel = panels.read_panel(spark, path)
    assert panel.columns == list(panels.PANEL_COLUMNS) and panel.count() == 3000
    assert panel.filter("source_genomes not in ('g1;g2', 'g1;g3') or clade <> '' or example_position is not null").count() == 0
    windows = markers(spark, 6000).select(F.lit("s").alias("sample_id"), F.col("extra").cast("string").alias("sequence_id"), F.lit(0).alias("query_position"), "k", F.col("kmer").alias("window_kmer"), F.col("kmer").alias("query_kmer"))
    if several:
        windows = windows.unionByName(windows.withColumn("k", F.lit(14)).withColumn("query_kmer", F.substring("query_kmer", 1, 14)))
    hits = screen.exact_hits(windows, panel)
    assert hits.count() == 3000
    plan = hits._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"Exchange hashpartitioning\([^)]*\)[^\n]*", plan.split("Initial Plan")[-1])
    assert len(exchanges) == 1 and f", {buckets})" in exchanges[0], plan


def test_default_buckets_and_missing_columns(spark, tmp_path):
    assert panels.write_panel(markers(spark, 10), f"file://{tmp_path}/one") == 1
    assert panels.write_panel(markers(spark, 0), f"file://{tmp_path}/none") == 1 and panels.read_panel(spark, f"file://{tmp_path}/none").count() == 0
    with pytest.raises(ValueError, match="lacks columns: kmer"):
        panels.panel_columns(markers(spark).drop("kmer"))


def test_preferred_format(spark, tmp_path):
    folder, tsv = f"file://{tmp_path}/f", f"file://{tmp_path}/f.tsv.gz"
    tables.write_table(panels.panel_columns(markers(spark, 20)), tsv)
    with pytest.raises(ValueError):
        panels.prefer(spark, tsv, folder, "parquet")
    assert panels.prefer(spark, tsv, folder).count() == panels.prefer(spark, tsv, None, "both").count() == 20
    panels.write_panel(markers(spark, 30), folder, 2)
    sizes = {s: panels.prefer(spark, tsv, folder, s).count() for s in ("tsv", "parquet", "auto", "both")}
    assert sizes == {"tsv": 20, "parquet": 30, "auto": 30, "both": 30} and panels.prefer(spark, tsv, folder, prefer_folder=False).count() == 20
    assert panels.prefer(spark, tsv, folder, "tsv").dtypes == panels.read_panel(spark, folder).dtypes
    with pytest.raises(ValueError):
        panels.prefer(spark, tsv, folder, "odd")
