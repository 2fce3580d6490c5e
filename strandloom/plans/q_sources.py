"""Round trips of sources and sinks over the driver's tables: what is written comes back as the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import screen
from ..scratch import scratch_path
from ..sources import panels, runs, sequences, tables
from .fixtures import SQL_CONTIGS, contigs, sql_windows, table
from .q_screen import SQL_EXACT, SQL_PANEL, language_panel, windows_of_reads
from .registry import query


@query("a01_fasta_round_trip", f"WITH {SQL_CONTIGS} SELECT doc_id::VARCHAR AS identifier, doc_id || ' ' || species AS description, seq AS sequence FROM contigs WHERE seq <> ''")
def a01(spark, sf):
    """Contigs as FASTA with lines of 60 bases."""
    path = scratch_path(spark, "fasta")
    c = contigs(spark, sf).filter("seq <> ''")
    sequences.write_fasta(c.select(F.col("doc_id").cast("string").alias("identifier"), F.col("species").alias("description"), F.col("seq").alias("sequence")), path)
    return sequences.read_fasta(spark, path)


_READS = "reads AS (SELECT doc_id, lang, regexp_replace(coalesce(text, ''), '[^!-~]', '', 'g') AS q FROM documents)"


def _reads(spark, sf):
    """Documents as reads: the printable letters of a text are its qualities, which may begin with @ or +, and give the bases."""
    q = F.regexp_replace(F.coalesce("text", F.lit("")), "[^!-~]", "")
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("identifier"), F.col("lang").alias("description"), F.regexp_replace(q, "[^ACGT]", "N").alias("sequence"), q.alias("quality"))


@query("a02_fastq_in_ranges", f"WITH {_READS} SELECT doc_id::VARCHAR AS identifier, doc_id || ' ' || lang AS description, regexp_replace(q, '[^ACGT]', 'N', 'g') AS sequence FROM reads")
def a02(spark, sf):
    """Reads as FASTQ, read in ranges of 256 kB."""
    path = scratch_path(spark, "fastq")
    sequences.write_fastq(_reads(spark, sf), path)
    return sequences.read_fastq(spark, path, 1 << 18, numbered=False).select("identifier", "description", "sequence")


@query("a03_fastq_numbered", f"WITH {_READS} SELECT doc_id::VARCHAR AS identifier, q AS quality, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS record_index FROM reads")
def a03(spark, sf):
    """Qualities kept and records numbered over the ranges of all files, which are written in order and by many tasks."""
    path = scratch_path(spark, "fastq")
    sequences.write_fastq(_reads(spark, sf).orderBy(F.col("identifier").cast("long")), path)
    return sequences.read_fastq(spark, path, 1 << 18, across=True).select("identifier", "quality", "record_index")


@query("a05_tsv_round_trip", "SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderpriority, o_totalprice::DOUBLE AS o_totalprice, array_to_string(list_sort(list(DISTINCT l_returnflag)), ';') AS flags FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def a05(spark, sf):
    """Orders with the set of their return flags as compressed TSV; sets are joined when written and split when read."""
    o, path = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")), scratch_path(spark, "orders.tsv.gz")
    tables.write_table(o.groupBy("o_orderkey", "o_orderpriority", "o_totalprice").agg(F.sort_array(F.collect_set("l_returnflag")).alias("flags")), path)
    back = tables.require_columns(tables.read_table(spark, path), ("o_orderkey", "o_orderpriority", "o_totalprice", "flags"))
    return back.select("o_orderkey", "o_orderpriority", F.col("o_totalprice").cast("double").alias("o_totalprice"), F.array_join(F.split("flags", ";"), ";").alias("flags"))


@query("a09_parquet_round_trip", "SELECT * FROM customer")
def a09(spark, sf):
    path = scratch_path(spark, "customer.parquet")
    tables.write_table(table(spark, sf, "customer"), path)
    return tables.read_table(spark, path)


@query("a10_panel_at_rest", f"""WITH {sql_windows()}, {SQL_PANEL} SELECT species_name, k, count(*)::BIGINT AS n, min(kmer) AS first_kmer, max(kmer) AS last_kmer, 'species_unique' AS panel_type, '' AS source_genomes FROM panel GROUP BY ALL""")
def a10(spark, sf):
    """The panel with its fixed columns, written in buckets and read again."""
    path = scratch_path(spark, "panel")
    panels.write_panel(language_panel(spark, sf), path, buckets=16)
    return panels.read_panel(spark, path).groupBy("species_name", "k", "panel_type", "source_genomes").agg(F.count("*").alias("n"), F.min("kmer").alias("first_kmer"), F.max("kmer").alias("last_kmer"))


@query("c09_panel_join", f"{SQL_EXACT} SELECT sample_id, sequence_id, query_position, matched_kmer, species_name FROM hits")
def c09(spark, sf):
    """Exact hits on a panel at rest, which stays in its buckets."""
    path = scratch_path(spark, "panel")
    panels.write_panel(language_panel(spark, sf), path, buckets=16)
    return screen.exact_hits(windows_of_reads(spark, sf), panels.read_panel(spark, path)).select("sample_id", "sequence_id", "query_position", "matched_kmer", "species_name")


@query("a15_taxonomy_dump", """SELECT DISTINCT 'S_' || lang || '_' || source AS taxid, 'G_' || lang AS parent, 'species' AS rank, lang || '_' || source AS name FROM documents
UNION ALL SELECT DISTINCT 'G_' || lang, '1', 'genus', lang FROM documents UNION ALL SELECT '1', '1', 'no rank', 'root'""")
def a15(spark, sf):
    """The taxonomy written in the layout of a dump and read again; other names than scientific ones are passed over."""
    from .q_panel import tree

    t, folder = tree(spark, sf), scratch_path(spark, "dump")
    line = lambda *c: F.concat(F.concat_ws("\t|\t", *c), F.lit("\t|"))
    t.select(line("taxid", "parent", "rank", F.lit("x"))).write.text(f"{folder}/nodes.dmp")
    t.select(F.explode(F.array(line("taxid", "name", F.lit(""), F.lit("scientific name")), line("taxid", F.concat(F.lit("also "), "name"), F.lit(""), F.lit("synonym"))))).write.text(f"{folder}/names.dmp")
    t.limit(0).select(line("taxid", "parent")).write.text(f"{folder}/merged.dmp")
    t.limit(0).select(line("taxid")).write.text(f"{folder}/delnodes.dmp")
    return tables.taxonomy_dump(spark, folder)[0].select("taxid", "parent", "rank", "name")


_RUNS = """c AS (SELECT 's' || (l_suppkey % 40) AS sample, l_returnflag AS family, l_linestatus AS species_name, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL),
m AS (SELECT DISTINCT sample, family, substr(sample, 2)::INT AS i FROM c)"""


def _runs(spark, sf):
    """(root, manifest): call tables of samples in folders of three layouts; some were never written, some are damaged, some runs failed."""
    rows = table(spark, sf, "lineitem").groupBy(F.concat(F.lit("s"), (F.col("l_suppkey") % 40).cast("string")).alias("sample"), F.col("l_returnflag").alias("family"), F.col("l_linestatus").alias("species_name")).agg(F.count("*").alias("n"))
    i, root = F.substring("sample", 2, 9).cast("int"), scratch_path(spark, "runs")
    head = F.when(i % 11 == 3, "broken").when(i % 2 == 0, "species_name\tn").otherwise("n\tspecies_name")
    line = F.when(i % 2 == 0, F.concat_ws("\t", "species_name", "n")).otherwise(F.concat_ws("\t", "n", "species_name"))
    files = rows.filter(i % 7 != 2).groupBy("sample", "family").agg(F.concat_ws("\n", F.first(head), F.sort_array(F.collect_list(line))).alias("value"))
    layout = {0: ("samples", F.col("sample")), 1: ("old", F.concat_ws("_", "family", "sample")), 2: ("samples", F.concat(F.lit("v2_"), "sample"))}
    for n, (top, folder) in layout.items():
        part = files.filter(i % 3 == n).withColumn("folder", folder)
        keys = ["family", "folder"] if top == "samples" else ["folder"]
        part.select(*keys, "value").write.mode("append").partitionBy(*keys).option("compression", "none").text(f"{root}/{top}" if top == "samples" else root)
    m = rows.select("sample", "family").distinct().select(
        F.when(i % 3 == 2, F.concat(F.lit("v1_"), "sample")).otherwise(F.concat_ws("_", "family", "sample")).alias("sample_id"), F.col("family").alias("benchmark_family"),
        F.when(i % 3 == 0, F.col("sample")).otherwise("").alias("source_relative_dir"), F.when(i % 13 == 4, 1).otherwise(0).alias("exit_code"), "sample",
    )
    return root, m


@query("g11_run_outputs", f"""WITH {_RUNS} SELECT family AS benchmark_family, sample, CASE WHEN i % 13 = 4 THEN 'failed' WHEN i % 7 = 2 THEN 'missing' WHEN i % 11 = 3 THEN 'damaged' ELSE 'ok' END AS status,
 CASE WHEN i % 7 = 2 OR i % 11 = 3 THEN 0 ELSE (SELECT count(*) FROM c WHERE c.sample = m.sample AND c.family = m.family) END::BIGINT AS n_calls FROM m""")
def g11_outputs(spark, sf):
    root, manifest = _runs(spark, sf)
    resolved = runs.resolve_outputs(manifest, runs.find_outputs(spark, root, "part-*"), old_prefix="v1_")
    return runs.run_outcomes(resolved, runs.read_calls(spark, root, ("species_name", "n"), "part-*")).select("benchmark_family", "sample", "status", "n_calls")


@query("g22_authoritative_by_sample", """WITH c AS (SELECT o_custkey AS sample_id, o_orderpriority AS species_name, count(*)::BIGINT AS n FROM orders WHERE o_custkey % 3 > 0 GROUP BY ALL), w AS (SELECT c_custkey AS sample_id, c_mktsegment AS species_name, c_nationkey::BIGINT AS n FROM customer)
SELECT *, 'calls' AS source_table FROM c UNION ALL SELECT *, 'wide' FROM w WHERE sample_id NOT IN (SELECT sample_id FROM c)""")
def g22_by_sample(spark, sf):
    o, c = table(spark, sf, "orders").filter("o_custkey % 3 > 0"), table(spark, sf, "customer")
    calls = o.groupBy(F.col("o_custkey").alias("sample_id"), F.col("o_orderpriority").alias("species_name")).agg(F.count("*").alias("n"))
    return runs.authoritative_by_sample(calls, c.select(F.col("c_custkey").alias("sample_id"), F.col("c_mktsegment").alias("species_name"), F.col("c_nationkey").cast("long").alias("n")))
