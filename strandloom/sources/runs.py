"""Outputs of many runs: located from a manifest, judged, and read together.

A run's outputs lie in a folder per sample; layouts differ with their age. Files are listed once, folders are matched with the manifest by joins, and call tables are read
in one scan, each row with the sample that its file belongs to. Components like ``family=x`` of partitioned tables count as ``x``; files without a byte count as not written.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names


def _folder(path: Column, root: str) -> Column:
    """Folder of a file below the root, without the root and partition names."""
    rest = F.regexp_replace(F.regexp_replace(path, r"^[a-z0-9]+:/+", "/"), "^" + _quote(_plain(root)) + "/+", "")
    return F.regexp_replace(F.regexp_replace(rest, "/?[^/]*$", ""), "(^|/)[^/=]+=", "$1")


def _plain(root: str) -> str:
    return "/" + root.split("://", 1)[-1].lstrip("/").rstrip("/") if "://" in root or root.startswith("/") else root.rstrip("/")


def _quote(text: str) -> str:
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in text)


def find_outputs(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """folder (below the root), path and length of the files whose name matches."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select(_folder(F.col("path"), root).alias("folder"), "path", "length")


def resolve_outputs(manifest: DataFrame, found: DataFrame, old_prefix: str = "") -> DataFrame:
    """``manifest`` (sample_id, benchmark_family; source_relative_dir and run_name if known) with the ``folder`` of each sample's outputs, null if there is none.

    In order: samples/family/sample, family/sample, samples/sample, sample, the same with the source's folder; then, of the folders in
    samples/family, the first whose name ends in run name and source folder, in the source folder, or in the sample without ``old_prefix``. Ends are compared by an
    equi-join: of each folder's name only ends as long as those that its family's samples ask for.
    """
    has = manifest.columns
    text = lambda c: F.coalesce(names.blank(F.trim(F.col(c))), F.lit("")) if c in has else F.lit("")
    m = manifest.select(F.col("sample_id").alias("_id"), text("benchmark_family").alias("_f"), text("source_relative_dir").alias("_s"), text("run_name").alias("_r")).distinct()
    ways = lambda x: [F.concat_ws("/", F.lit("samples"), "_f", x), F.concat_ws("/", "_f", x), F.concat_ws("/", F.lit("samples"), x), x]
    exact = [*ways(F.col("_id")), *(F.when(F.col("_s") != "", w) for w in ways(F.col("_s")))]
    folders = found.select("folder").distinct()
    tries = m.select("_id", F.posexplode(F.array(*exact)).alias("_order", "folder")).join(folders, "folder")
    tail = F.array(F.when((F.col("_r") != "") & (F.col("_s") != ""), F.concat_ws("_", "_r", "_s")), F.when(F.col("_s") != "", F.col("_s")), F.when(F.lit(bool(old_prefix)) & F.startswith("_id", F.lit(old_prefix)), F.substring("_id", len(old_prefix) + 1, 10_000)))
    ends = m.select("_id", "_f", F.posexplode(tail).alias("_order", "_end")).filter("_end <> ''").withColumn("_n", F.length("_end"))
    name = F.element_at(F.split("folder", "/"), -1)
    inside = folders.filter(F.regexp_like("folder", F.lit("^samples/[^/]+/[^/]+$"))).select("folder", F.split("folder", "/")[1].alias("_f"), name.alias("_name"))
    inside = inside.join(ends.select("_f", "_n").distinct(), "_f").filter(F.length("_name") >= F.col("_n")).select("folder", "_f", "_n", F.substring(F.col("_name"), F.length("_name") - F.col("_n") + 1, F.col("_n")).alias("_end"))
    tries = tries.select("_id", "_order", "folder").union(ends.join(inside, ["_f", "_n", "_end"]).select("_id", F.col("_order") + len(exact), "folder"))
    best = tries.groupBy("_id").agg(F.min(F.struct("_order", "folder"))["folder"].alias("folder"))
    return manifest.join(best, F.col("sample_id") == F.col("_id"), "left").drop("_id")


def read_calls(spark: SparkSession, root: str, columns: Sequence[str], pattern: str = "*.tsv") -> DataFrame:
    """folder, damaged and ``columns`` (strings, blank if a table lacks them) of all call tables below the root.

    Each table has a header of its own, so columns may differ in order and number. A table without a header, or without all ``columns``, is one row, ``damaged``; one
    without rows gives one row with null columns.
    """
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True).select(_folder(F.col("_metadata.file_path"), root).alias("folder"), "value")
    lines = F.filter(F.split(F.regexp_replace("value", "\r", ""), "\n"), lambda x: x != "")
    head = F.split(F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("")), "\t")
    damaged = reduce(lambda a, c: a | ~F.array_contains(head, c), columns, F.lit(False))
    body = F.when(~damaged, F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1)))).otherwise(F.array().cast("array<string>"))
    rows = text.select("folder", damaged.alias("damaged"), head.alias("_head"), F.explode_outer(body).alias("_line"))
    field = lambda c: F.coalesce(F.try_element_at(F.split("_line", "\t"), F.array_position("_head", c).cast("int")), F.when(F.col("_line").isNotNull(), ""))
    return rows.select("folder", "damaged", *(F.when(~F.col("damaged"), field(c)).alias(c) for c in columns))


def run_outcomes(resolved: DataFrame, calls: DataFrame) -> DataFrame:
    """``resolved`` with n_calls and status: failed (exit code), missing (no folder, or no call table there), damaged or ok; an anti-join of the manifest with what was found."""
    per = calls.groupBy("folder").agg(F.max("damaged").alias("_damaged"), F.count(F.coalesce(*[c for c in calls.columns if c not in ("folder", "damaged")])).alias("n_calls"))
    out = resolved.join(per, "folder", "left")
    code = F.coalesce(F.col("exit_code").cast("int"), F.lit(0)) if "exit_code" in resolved.columns else F.lit(0)
    status = F.when(code != 0, "failed").when(F.col("_damaged").isNull(), "missing").when(F.col("_damaged"), "damaged").otherwise("ok")
    return out.withColumn("status", status).withColumn("n_calls", F.coalesce("n_calls", F.lit(0))).drop("_damaged")


def authoritative_by_sample(calls: DataFrame, wide: DataFrame, key: str = "sample_id") -> DataFrame:
    """Each sample's rows of its call table if it has one, else those of the wide summary; columns that one side lacks are null."""
    rest = wide.join(calls.select(key).distinct(), key, "left_anti")
    return calls.withColumn("source_table", F.lit("calls")).unionByName(rest.withColumn("source_table", F.lit("wide")), allowMissingColumns=True)

