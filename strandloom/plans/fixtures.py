"""The driver's tables read as the domain: contigs, reads, a taxonomy, hits, manifests; the same in SQL.

Documents are contigs: letters map to bases, sentence ends to N, everything else is dropped. A source is a
genome, a language a genus, language and source a species. Benchmark items are reads; events are k-mer hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seq
from ..operators import panel

LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
K = 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal a narrow scan over all cores before windows multiply its rows: one file gives one task otherwise."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dna(text: Column) -> Column:
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z.!?]+", ""), f"{LETTERS}.!?", f"{BASES}NNN")


def role(lang: Column) -> Column:
    return F.when(lang.isin("en", "de"), "target").when(lang == "es", "near_neighbour").otherwise("outgroup")


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    species = F.concat_ws("_", "lang", "source")
    d = d.select("doc_id", F.col("source").alias("genome"), species.alias("species"), F.col("lang").alias("clade"), role(F.col("lang")).alias("role"), F.concat(F.lit("S_"), species).alias("taxid"), dna(F.col("text")).alias("seq"))
    return spread(d)


def windows(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    return seq.kmer_windows(contigs(spark, sf_dir), k, keep=("doc_id", "genome", "species", "clade", "role", "taxid")).withColumn("k", F.lit(k))


def groups(spark: SparkSession, sf_dir: str, k: int = K, **options) -> DataFrame:
    """The k-mers of all contigs with their sets of sources."""
    return panel.group_sequences(contigs(spark, sf_dir), [k], **options)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.concat(F.lit("s"), (F.col("item_id") % 8).cast("string")).alias("sample_id"), F.col("item_id").cast("string").alias("sequence_id"), dna(F.col("text")).alias("seq"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-mer hits from events: 50 samples, species are event types, four k."""
    e = table(spark, sf_dir, "events")
    k = F.element_at(F.array(*map(F.lit, (51, 77, 101, 151))), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(
        F.concat(F.lit("s"), (F.col("user_id") % 50).cast("string")).alias("sample_id"), F.when(F.col("event_id") % 7 == 0, "clade_core").otherwise("species_unique").alias("panel_type"),
        F.concat(F.lit("Genus_"), F.col("event_type")).alias("species_name"), F.lit("Genus").alias("clade"), k.alias("k"), F.concat_ws(":", F.get_json_object("props", "$.k"), k.cast("string")).alias("matched_kmer"),
        (F.col("event_id") % 97).cast("string").alias("sequence_id"), F.when(F.col("event_id") % 3 == 0, 1).otherwise(0).alias("mismatches"),
        F.when(F.col("event_id") % 7 == 0, "genus").otherwise("species").alias("evidence_rank"), F.when(F.col("event_id") % 7 == 0, "Genus").otherwise(F.concat(F.lit("Genus_"), F.col("event_type"))).alias("evidence_name"),
    )


SQL_SEQ = "translate(regexp_replace(regexp_replace(lower({0}), '[.!?]', 'N', 'g'), '[^a-zN]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"
SQL_RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"
SQL_ROLE = "CASE WHEN lang IN ('en', 'de') THEN 'target' WHEN lang = 'es' THEN 'near_neighbour' ELSE 'outgroup' END"

SQL_CONTIGS = f"""contigs AS (SELECT doc_id, source AS genome, lang || '_' || source AS species, lang AS clade, {SQL_ROLE} AS role,
  'S_' || lang || '_' || source AS taxid, {SQL_SEQ.format('text')} AS seq FROM documents)"""


def sql_windows(k: int = K, raw: bool = False) -> str:
    kmer = "w" if raw else f"least(w, {SQL_RC.format('w')})"
    return f"""{SQL_CONTIGS}, raw_windows AS (SELECT doc_id, genome, species, clade, role, taxid, pos AS position, substr(seq, pos + 1, {k}) AS w FROM (SELECT *, unnest(range(0, length(seq) - {k - 1})) AS pos FROM contigs)),
windows AS (SELECT doc_id, genome, species, clade, role, taxid, position::INT AS position, {k} AS k, {kmer} AS kmer FROM raw_windows WHERE NOT contains(w, 'N'))"""


SQL_HITS = """hits AS (SELECT 's' || (user_id % 50) AS sample_id, CASE WHEN event_id % 7 = 0 THEN 'clade_core' ELSE 'species_unique' END AS panel_type, 'Genus_' || event_type AS species_name, 'Genus' AS clade,
  [51, 77, 101, 151][(event_id % 4 + 1)::INT] AS k, json_extract_string(props, '$.k') || ':' || [51, 77, 101, 151][(event_id % 4 + 1)::INT] AS matched_kmer, (event_id % 97)::VARCHAR AS sequence_id,
  CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS mismatches, CASE WHEN event_id % 7 = 0 THEN 'genus' ELSE 'species' END AS evidence_rank, CASE WHEN event_id % 7 = 0 THEN 'Genus' ELSE 'Genus_' || event_type END AS evidence_name FROM events)"""


def sql_reads_windows(k: int = K) -> str:
    return f"""reads AS (SELECT 's' || (item_id % 8) AS sample_id, item_id::VARCHAR AS sequence_id, {SQL_SEQ.format('text')} AS seq FROM benchmark),
read_windows AS (SELECT sample_id, sequence_id, pos::INT AS query_position, w AS window_kmer, least(w, {SQL_RC.format('w')}) AS query_kmer FROM (SELECT *, substr(seq, pos + 1, {k}) AS w FROM (SELECT *, unnest(range(0, length(seq) - {k - 1})) AS pos FROM reads)) WHERE NOT contains(w, 'N'))"""
