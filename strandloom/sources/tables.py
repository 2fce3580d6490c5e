"""Tables by suffix, column checks, genome catalogues, taxonomy dumps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names

# The roles a genome may have; exclude drops it.
ROLES = ("target", "near_neighbour", "outgroup", "background", "host", "contaminant", "vector", "exclude")


def table_format(path: str) -> str:
    for suffix, kind in ((".tsv", "tsv"), (".tsv.gz", "tsv"), (".parquet", "parquet")):
        if path.endswith(suffix):
            return kind
    raise ValueError(f"neither .tsv, .tsv.gz nor .parquet: {path}")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """TSV columns are strings, missing ones blank; Parquet keeps its types."""
    if table_format(path) == "parquet":
        return spark.read.parquet(path)
    return spark.read.csv(path, sep="\t", header=True, quote="", nullValue=None, emptyValue="", mode="PERMISSIVE").na.fill("")


def write_table(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """Array columns are joined by ``;`` in TSV; Parquet keeps them."""
    df = df.select(*columns) if columns else df
    if table_format(path) == "parquet":
        df.write.mode("overwrite").parquet(path)
        return
    joined = [F.array_join(c, ";").alias(c) if t.startswith("array") else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c, t in df.dtypes]
    df.select(*joined).write.mode("overwrite").csv(path, sep="\t", header=True, quote="", escape="", emptyValue="", compression="gzip" if path.endswith(".gz") else "none")


def require_columns(df: DataFrame, columns: Sequence[str], source: str = "table") -> DataFrame:
    """``df``, or an error that names the missing columns in the order asked for. An empty table with its columns passes."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{source} lacks columns: {', '.join(missing)}")
    return df


def genome_catalogue(df: DataFrame, require_target: bool = True) -> DataFrame:
    """Catalogue rows with genome_id (accession, else the file's stem) and is_target; excluded roles go, unknown roles are an error."""
    require_columns(df, ("genome_fasta", "species_name", "role"), "genome catalogue")
    for c in ("strain_name", "taxid", "clade", "assembly_accession", "source"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(""))
    role = F.lower(F.trim("role"))
    checked = F.when(role.isin(*ROLES), role).otherwise(F.raise_error(F.concat(F.lit("unknown role: "), "role")))
    stem = F.regexp_replace(F.element_at(F.split("genome_fasta", "/"), -1), r"\.(fa|fna|fasta)(\.gz)?$", "")
    out = df.withColumn("role", checked).filter("role <> 'exclude'").withColumn("genome_id", F.coalesce(names.blank(F.col("assembly_accession")), stem)).withColumn("is_target", F.col("role") == "target")
    if require_target and out.filter("is_target").isEmpty():
        raise ValueError("a genome catalogue needs a target")
    return out


def _dump(spark: SparkSession, path: str, fields: dict[str, int]) -> DataFrame:
    parts = F.transform(F.split("value", r"\|"), lambda x: F.trim(F.translate(x, "\t", " ")))
    rows = spark.read.text(path).select(parts.alias("p")).filter(F.size("p") > max(fields.values()) + 1)
    return rows.select(*(F.col("p")[i].alias(c) for c, i in fields.items()))


def taxonomy_dump(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes with names, merged, deleted) of a taxonomy dump; only scientific names count, short lines are skipped."""
    nodes = _dump(spark, f"{folder}/nodes.dmp", {"taxid": 0, "parent": 1, "rank": 2})
    called = _dump(spark, f"{folder}/names.dmp", {"taxid": 0, "name": 1, "kind": 3}).filter("kind = 'scientific name'").drop("kind")
    merged = _dump(spark, f"{folder}/merged.dmp", {"old_taxid": 0, "new_taxid": 1})
    deleted = _dump(spark, f"{folder}/delnodes.dmp", {"taxid": 0})
    return nodes.join(called, "taxid", "left").na.fill("", ["name"]), merged, deleted
