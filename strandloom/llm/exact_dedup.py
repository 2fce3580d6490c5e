"""Exact deduplication by progressive refinement, with DataFrame functions only.

Texts are equal when identical after each run of ``[\\x20\\x09-\\x0D]`` becomes one space; null counts as
empty. Rows are grouped by normalised length, rows that share a length by a hash of the text's first
characters, and only rows that share both are hashed in full. Of equal texts the row with the smallest
doc_id stays; a null doc_id comes last, and rows that also share the doc_id are told apart by their other
columns, so that one row of each group stays. Empty tables give empty results.

Counts are pre-aggregated before each shuffle, so a group that holds a third of all rows is a few rows per
task; joins carry keys, not texts, beyond the candidates, and rows without a possible equal join nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, fresh_name, materialise

PREFIX = 256


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _shared_keys(texts: DataFrame) -> DataFrame:
    """(length, prefix) that more than one row has; the prefix counts only where the length is shared."""
    pairs = texts.select(F.length("norm").alias("length"), F.xxhash64(F.substring("norm", 1, PREFIX)).alias("prefix"))
    pairs = materialise(pairs.groupBy("length", "prefix").agg(F.count("*").alias("n")), "prefixes")
    lengths = pairs.groupBy("length").agg(F.sum("n").alias("all")).filter("`all` > 1").select("length")
    return materialise(pairs.join(broadcast_if_small(materialise(lengths, "lengths")), "length", "left_semi").filter("n > 1").drop("n"), "keys")


def _marked(docs: DataFrame, text_col: str) -> tuple[DataFrame, str, str]:
    """``docs`` with its normalised text and a flag for rows that need their full hash; their names."""
    norm, flag = fresh_name(docs, "norm"), fresh_name(docs, "shared")
    keys = _shared_keys(docs.select(normalised(F.col(text_col)).alias("norm"))).withColumn(flag, F.lit(True))
    docs = docs.withColumn(norm, normalised(F.col(text_col)))
    on = (F.length(norm) == keys["length"]) & (F.xxhash64(F.substring(norm, 1, PREFIX)) == keys["prefix"])
    return docs.join(broadcast_if_small(keys), on, "left").drop(keys["length"], keys["prefix"]), norm, flag


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest (SHA-256 of the normalised text).

    ``digest``: for rows with no possible equal only if ``digest_all``. Among rows of one group that share
    its smallest doc_id, only one is kept.
    """
    marked, norm, flag = _marked(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text")
    full = F.sha2(F.col(norm), 256)
    rows = marked.select("doc_id", F.coalesce(F.col(flag), F.lit(False)).alias("shared"), (full if digest_all else F.when(F.col(flag), full)).alias("digest"))
    rows = materialise(rows, "digests")
    shared = rows.filter("shared").drop("shared")
    single = rows.filter("not shared").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "digest", F.lit(True).alias("kept"))
    groups = shared.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # A written table: the join below is then one that a hot digest's rows can be split for.
    groups = materialise(groups, "groups")
    out = shared.join(broadcast_if_small(groups), "digest").select("doc_id", "keep_id", "group_size", "digest")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    # Rows that share their group's smallest doc_id are numbered; only they are dealt by key.
    twice = materialise(shared.groupBy("digest", "doc_id").agg(F.count("*").alias("same")).filter("same > 1").join(groups, "digest").filter(kept).select("digest"), "twice")
    if twice.isEmpty():
        return out.withColumn("kept", kept).unionByName(single)
    again = broadcast_if_small(twice.withColumn("again", F.lit(True)))
    out = out.join(again, "digest", "left").withColumn("again", F.coalesce("again", F.lit(False)) & kept)
    rank = F.row_number().over(Window.partitionBy("digest").orderBy(F.lit(0)))
    numbered = out.filter("again").withColumn("kept", rank == 1)
    return out.filter("not again").withColumn("kept", kept).unionByName(numbered).drop("again").unionByName(single)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts; all columns stay. Only candidates' rows are shuffled.

    Columns must be orderable (no maps), as ties of doc_id are broken by the remaining columns.
    """
    marked, norm, flag = _marked(docs, text_col)
    columns = docs.columns
    unique = marked.filter(F.col(flag).isNull()).select(*columns)
    order = F.struct(F.col(id_col).isNull().alias("_0"), F.col(id_col).alias("_1"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)))
    first = marked.filter(F.col(flag)).groupBy(F.sha2(F.col(norm), 256).alias("digest")).agg(F.min(order).alias("row"))
    return unique.unionByName(first.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(columns))))
