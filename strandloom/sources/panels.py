"""Panels at rest: fixed columns, a layout that joins without moving the panel, and the choice between formats.

A panel folder holds ``panel`` (Parquet in buckets by a hash of the k-mer, which has its k, sorted by it, with Bloom filters) and ``layout`` (the number
of buckets). Read with that layout, a join with windows on the k-mer shuffles the windows into the panel's buckets and leaves the panel where it is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table, require_columns

# The columns of a panel, in order.
PANEL_COLUMNS = ("kmer", "k", "panel_type", "species_name", "clade", "source_genomes", "source_contigs", "example_position", "evidence_taxid", "evidence_name", "evidence_rank", "lineage_taxids", "source_taxids")
NUMBERS = {"k": "int", "example_position": "long"}
#: Markers of a bucket, about; a bucket is a task's share of the panel.
BUCKET = 2_000_000


def panel_columns(panel: DataFrame) -> DataFrame:
    """The fixed columns in order: sets joined by ``;``, what is missing or null blank (null for a number). k and kmer are required."""
    require_columns(panel, ("k", "kmer"), "panel")
    kinds = dict(panel.dtypes)

    def column(c: str):
        if c not in kinds:
            return F.lit(None if c in NUMBERS else "").cast(NUMBERS.get(c, "string")).alias(c)
        if c in NUMBERS:
            return F.col(c).cast(NUMBERS[c]).alias(c)
        joined = F.array_join(c, ";") if kinds[c].startswith("array") else F.col(c).cast("string")
        return F.coalesce(joined, F.lit("")).alias(c)

    return panel.select(*map(column, PANEL_COLUMNS))


def write_panel(panel: DataFrame, path: str, buckets: int | None = None) -> int:
    """Write the panel's fixed columns to a folder; the number of buckets, by default one for every BUCKET markers."""
    spark, rows = panel.sparkSession, panel_columns(panel)
    if buckets is None:
        buckets = max(1, -(-rows.count() // BUCKET))
    name = f"panel_{uuid.uuid4().hex}"
    out = rows.repartition(buckets, "kmer").write.mode("overwrite").bucketBy(buckets, "kmer").sortBy("kmer")
    out.option("parquet.bloom.filter.enabled#kmer", "true").option("path", f"{path}/panel").format("parquet").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # of an external table, the files stay
    spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.mode("overwrite").json(f"{path}/layout")
    return buckets


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """A panel that ``write_panel`` wrote, with its buckets and columns.

    The buckets are known to Spark through a table of the session's catalogue, named after the folder, that points to the files.
    """
    buckets = spark.read.schema("buckets int").json(f"{path}/layout").first()["buckets"]
    columns = ", ".join(f"`{c}` {NUMBERS.get(c, 'string')}" for c in PANEL_COLUMNS)
    name = f"panel_at_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    location = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (kmer) SORTED BY (kmer) INTO {buckets} BUCKETS LOCATION '{location}/panel'")
    return spark.table(name)


def prefer(spark: SparkSession, tsv: str, folder: str | None, storage: str = "auto", prefer_folder: bool = True) -> DataFrame:
    """The panel in its preferred format: ``tsv`` and ``parquet`` as they say, ``auto`` and ``both`` the folder if it exists and is preferred, else the TSV."""
    if storage not in ("tsv", "parquet", "auto", "both"):
        raise ValueError(f"unsupported panel storage: {storage}")
    there = folder is not None and _exists(spark, f"{folder}/layout")
    if storage == "parquet" and not there:
        raise ValueError("a Parquet panel was asked for, but there is none")
    if storage == "parquet" or storage != "tsv" and prefer_folder and there:
        return read_panel(spark, folder)
    return panel_columns(require_columns(read_table(spark, tsv), PANEL_COLUMNS, "panel"))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)

