"""Column functions and table functions over nucleotide sequences."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalise_sequence(seq: Column, mask_lowercase: bool = False) -> Column:
    """White space removed, upper case, U read as T; lower-case bases become N if ``mask_lowercase``."""
    seq = F.regexp_replace(seq, r"\s", "")
    if mask_lowercase:
        seq = F.regexp_replace(seq, "[acgtu]", "N")
    return F.translate(F.upper(seq), "U", "T")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def canonical(kmer: Column) -> Column:
    return F.least(kmer, reverse_complement(kmer))


def is_valid_kmer(kmer: Column) -> Column:
    return kmer.rlike("^[ACGT]+$")


#: Bases of a sequence whose windows are made at once.
SEGMENT = 1 << 16


def kmer_windows(df: DataFrame, k: int, seq_col: str = "seq", *, canonicalise: bool = True, skip_ambiguous: bool = True, skip_lowercase: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """One row per window of ``k`` bases: the columns ``keep``, position (from 0), kmer.

    A sequence is cut into segments that overlap by k - 1 bases, and each segment into windows, by one overlapping
    regular-expression match each; both are linear, and only a segment's windows are in memory at once. Ambiguous windows
    are dropped before anything is shuffled.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    upper = F.col(seq_col) if skip_lowercase else F.upper(seq_col)
    parts = F.regexp_extract_all(upper, F.lit(f"(?s)(?=(.{{1,{SEGMENT + k - 1}}})).{{1,{SEGMENT}}}"), F.lit(1))
    parts = df.select(*keep, F.posexplode(parts).alias("_part", "_bases"))
    windows = parts.select(*keep, "_part", F.posexplode(F.regexp_extract_all("_bases", F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))).alias("_at", "kmer"))
    windows = windows.select(*keep, (F.col("_part") * SEGMENT + F.col("_at")).alias("position"), "kmer")
    if skip_lowercase:
        windows = windows.filter(~F.col("kmer").rlike("[a-z]"))
    if skip_ambiguous:
        windows = windows.filter(is_valid_kmer(F.col("kmer")))
    return windows.withColumn("kmer", canonical(F.col("kmer"))) if canonicalise else windows


def multi_k_windows(df: DataFrame, k_values: Sequence[int], seq_col: str = "seq", **options) -> DataFrame:
    """Windows of several lengths with their ``k``."""
    parts = [kmer_windows(df, k, seq_col, **options).withColumn("k", F.lit(k)) for k in dict.fromkeys(k_values)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def count_kmers(df: DataFrame, k: int, seq_col: str = "seq") -> DataFrame:
    return kmer_windows(df, k, seq_col).groupBy("kmer").agg(F.count("*").alias("n"))


def hamming_distance(left: Column, right: Column) -> Column:
    """Differing places of two strings of equal length; an error if lengths differ."""
    apart = F.aggregate(F.zip_with(F.split(left, ""), F.split(right, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda a, x: a + x)
    return F.when(F.length(left) == F.length(right), apart).otherwise(F.raise_error(F.lit("sequences differ in length")).cast("int"))


def substitutions(kmer: Column) -> Column:
    """All strings at one substitution, as an array of 3 * k."""
    places = F.sequence(F.lit(1), F.length(kmer))
    return F.flatten(
        F.transform(places, lambda i: F.transform(F.filter(F.array(*map(F.lit, "ACGT")), lambda b: b != F.substring(kmer, i, F.lit(1))), lambda b: F.concat(F.substring(kmer, F.lit(1), i - 1), b, F.substring(kmer, i + 1, F.length(kmer)))))
    )


def neighbourhood(kmer: Column, mismatches: int) -> Column:
    """All distinct strings at one or exactly two substitutions or fewer (never the k-mer itself)."""
    if mismatches not in (0, 1, 2):
        raise ValueError("at most two mismatches")
    if mismatches == 0:
        return F.array().cast("array<string>")
    one = substitutions(kmer)
    if mismatches == 1:
        return one
    return F.array_remove(F.array_distinct(F.concat(one, F.flatten(F.transform(one, substitutions)))), kmer)


def marker_score(*columns: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of the tab-joined fields; they sort as the number does."""
    return F.substring(F.sha2(F.concat_ws("\t", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)), 256), 1, 16)


def group_bucket(*columns: Column, buckets: int = 10_000) -> Column:
    """Stable bucket of a group: the first 48 bits of the SHA-256 of its ``|``-joined values."""
    digits = F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)), 256), 1, 12)
    return (F.conv(digits, 16, 10).cast("long") % buckets).cast("long")


def unit_draw(identifier: Column, record_index: Column, seed: int) -> Column:
    """Deterministic draw in [0, 1) from 64 bits of BLAKE2b over seed, index and identifier."""

    @F.pandas_udf("double")
    def draw(ids: pd.Series, indexes: pd.Series) -> pd.Series:
        return pd.Series([int.from_bytes(hashlib.blake2b(f"{seed}\0{i}\0{x}".encode(), digest_size=8).digest(), "big") / 2**64 for x, i in zip(ids, indexes)])

    return draw(identifier, record_index)


def unit_draw_sha(identifier: Column, record_index: Column, seed: int) -> Column:
    """The same idea with 48 bits of SHA-256, inside the JVM."""
    digits = F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), record_index.cast("string"), identifier.cast("string")), 256), 1, 12)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(2**48))


def phred_sum(quality: Column) -> Column:
    """Sum of Phred qualities (offset 33) of a read's quality string."""
    return F.aggregate(F.transform(F.split(quality, ""), lambda c: F.ascii(c) - 33), F.lit(0).cast("long"), lambda a, x: a + x)


def phred_at_least(quality: Column, least: int) -> Column:
    """Bases of quality ``least`` or better."""
    return F.length(F.regexp_replace(quality, f"[^\\x{33 + least:02x}-\\x7e]", "")).cast("long")


def read_metrics(reads: DataFrame, group: Sequence[str], seq_col: str = "sequence", quality_col: str = "quality") -> DataFrame:
    """Per group of reads: counts, lengths, N50, base-weighted mean quality, shares of good bases, median read quality."""
    rows = reads.select(*group, F.length(seq_col).cast("long").alias("length"), phred_sum(F.col(quality_col)).alias("q"), *(phred_at_least(F.col(quality_col), q).alias(f"q{q}") for q in (10, 20, 30)))
    share = lambda c: F.round(F.sum(c) / F.sum("length"), 6)
    out = rows.groupBy(*group).agg(
        F.count("*").alias("n_reads"), F.sum("length").alias("total_bases"), F.round(F.avg("length"), 4).alias("mean_length"), F.median("length").alias("median_length"),
        share("q").alias("mean_base_quality"), *(share(f"q{q}").alias(f"q{q}_fraction") for q in (10, 20, 30)), F.round(F.median(F.col("q") / F.col("length")), 6).alias("median_read_quality"),
    )
    return out.join(n50(rows, group, "length"), list(group)) if group else out.crossJoin(n50(rows, group, "length"))


def n50(df: DataFrame, group: Sequence[str], length_col: str) -> DataFrame:
    """Longest length at which lengths at least as long hold half of all bases; only positive lengths count.

    Lengths are first counted, so the running sum runs over distinct lengths of a group.
    """
    from pyspark.sql import Window

    per = df.filter(F.col(length_col) > 0).groupBy(*group, F.col(length_col).alias("len")).agg((F.count("*") * F.first(length_col)).alias("bases"))
    run = Window.partitionBy(*group).orderBy(F.desc("len"))
    per = per.withColumn("run", F.sum("bases").over(run)).withColumn("all", F.sum("bases").over(Window.partitionBy(*group)))
    return per.filter(F.col("run") * 2 >= F.col("all")).groupBy(*group).agg(F.max("len").cast("long").alias("n50"))


