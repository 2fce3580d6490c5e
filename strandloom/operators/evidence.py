"""Evidence per sample from hits, calls by rules, consolidation within a genus, lineage interpretation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names, scores
from . import taxonomy


def label_hits(hits: DataFrame, by: Sequence[str] = ("sample_id", "panel_type", "species_name", "clade", "k"), weight: str | None = None) -> DataFrame:
    """Hits per label and k: counts, distinct k-mers and sequences, exact and fuzzy, least and most mismatches. ``weight``: a column of the hits that a row stands for."""
    n = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    return hits.groupBy(*by).agg(
        F.sum(n).alias("n_hits"), F.count_distinct("matched_kmer").alias("n_unique_kmers"), F.count_distinct("sequence_id").alias("n_positive_sequences"),
        F.sum(F.when(F.col("mismatches") == 0, n).otherwise(0)).alias("n_exact_hits"), F.sum(F.when(F.col("mismatches") > 0, n).otherwise(0)).alias("n_fuzzy_hits"),
        F.min("mismatches").alias("min_mismatches"), F.max("mismatches").alias("max_mismatches"),
    )


def _over_k(summary: DataFrame, by: Sequence[str]) -> DataFrame:
    """Unique k-mers and hits add up over k; positive sequences are the most of any k."""
    return summary.groupBy(*by).agg(
        F.sum("n_unique_kmers").alias("n_unique_kmers"), F.max("n_positive_sequences").alias("n_positive_sequences"), F.count_distinct("k").alias("n_k_values_positive"), F.max("k").alias("best_k"),
        F.sum("n_hits").alias("n_hits"), F.sum("n_exact_hits").alias("n_exact_hits"), F.sum("n_fuzzy_hits").alias("n_fuzzy_hits"),
    )


def species_evidence(summary: DataFrame) -> DataFrame:
    return _over_k(summary.filter("panel_type = 'species_unique'"), ("sample_id", "species_name"))


def taxonomic_evidence(hits: DataFrame) -> DataFrame:
    """Evidence per sample and taxon; missing ranks and names fall back to species, then clade."""
    blank = names.blank
    name = F.coalesce(blank(F.col("evidence_name")), blank(F.col("species_name")), blank(F.col("clade")))
    rank = F.coalesce(blank(F.col("evidence_rank")), F.when(blank(F.col("species_name")).isNotNull(), "species").otherwise("clade"))
    rows = hits.withColumn("evidence_rank", rank).withColumn("evidence_name", name).filter("evidence_name is not null")
    by = ("sample_id", "evidence_rank", "evidence_name")
    return _over_k(label_hits(rows, (*by, "k")), by)


def sequence_features(hits: DataFrame) -> DataFrame:
    """Per sample and sequence: counts, the two best species, their share and the share of conflicting hits."""
    by = ["sample_id", "sequence_id"]
    species = hits.filter("panel_type = 'species_unique'").groupBy(*by, "species_name").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "species_name"))
    top = species.withColumn("r", rank).groupBy(*by).agg(
        F.sum("n").alias("n_species_hits"), F.count("*").alias("n_species"), F.max(F.when(F.col("r") == 1, F.col("species_name"))).alias("best_species"), F.max(F.when(F.col("r") == 1, F.col("n"))).alias("best_species_hits"),
        F.coalesce(F.max(F.when(F.col("r") == 2, F.col("species_name"))), F.lit("")).alias("second_species"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("n"))), F.lit(0)).alias("second_species_hits"),
    )
    all_ = hits.groupBy(*by).agg(F.count("*").alias("n_hits"), F.count_distinct("matched_kmer").alias("n_unique_kmers"), F.count_distinct("k").alias("n_k_values"), F.max("k").alias("best_k"), F.sum((F.col("mismatches") == 0).cast("long")).alias("n_exact_hits"), F.sum((F.col("mismatches") > 0).cast("long")).alias("n_fuzzy_hits"))
    out = all_.join(top, by, "left").na.fill(0, ["n_species_hits", "n_species", "best_species_hits", "second_species_hits"]).na.fill("", ["best_species", "second_species"])
    best, second = F.col("best_species_hits"), F.col("second_species_hits")
    return out.select(
        "*", F.round(scores.divide_or_zero(best, best + second) + 1e-9, 6).alias("best_ratio"), F.round(scores.divide_or_zero(F.col("n_species_hits") - best, F.col("n_species_hits")) + 1e-9, 6).alias("conflict"),
        ((F.col("n_species") == 0) | (best == second)).alias("unresolved"),
    )


@dataclass(frozen=True)
class CallRules:
    """Minima of evidence for a reportable call; see ``PRESETS``."""

    min_unique_kmers: int = 3
    min_positive_sequences: int = 2
    min_k_values_positive: int = 1
    max_conflict_ratio: float = 0.10
    min_best_k: int = 0
    min_exact_hits: int = 0
    min_confidence_score: float = 0.0
    low_evidence_call: str = "present_low_confidence"
    min_mixed_species_fraction: float = 0.0
    min_total_hits: int = 0
    min_unique_kmer_margin: int = 0
    min_unique_kmer_ratio: float = 0.0
    allow_mixed_species: bool = True

    def __post_init__(self):
        if self.low_evidence_call not in ("present_low_confidence", "observed_below_threshold"):
            raise ValueError("unsupported low_evidence_call")


# The minima of the five presets.
PRESETS = {
    "legacy": CallRules(),
    "conservative": CallRules(20, 5, 2, 0.10, 101, 20, 0.50, "observed_below_threshold"),
    "lineage_aware": CallRules(20, 5, 2, 0.10, 101, 20, 0.50, "observed_below_threshold", 0.25),
    "raw_ont_sensitive": CallRules(8, 2, 1, 0.10, 77, 0, 0.45, "observed_below_threshold", 0.25, 8),
    "strict": CallRules(50, 10, 2, 0.05, 101, 50, 0.70, "observed_below_threshold", 0.50),
}


def preset(name: str, **overrides) -> CallRules:
    return replace(PRESETS[name], **{k: v for k, v in overrides.items() if v is not None})


def call_species(evidence: DataFrame, rules: CallRules = PRESETS["legacy"]) -> DataFrame:
    """Presence calls per (sample_id, species_name), of which evidence has one row each.

    All comparisons with a sample's other species are window aggregates: sums less one's own value, and the
    largest or, for the largest itself, second largest.
    """
    sample = Window.partitionBy("sample_id")
    u = F.col("n_unique_kmers")
    support = [u, F.col("n_positive_sequences"), F.col("n_k_values_positive"), F.col("best_k")]
    rows = evidence.withColumn("_place", F.row_number().over(sample.orderBy(F.desc("n_unique_kmers"), "species_name")))
    second = F.max(F.when(F.col("_place") == 2, u)).over(sample)
    rows = rows.withColumn("conflicting_unique_kmers", F.sum(u).over(sample) - u).withColumn("_next", F.coalesce(F.when(F.col("_place") == 1, second).otherwise(F.max(u).over(sample)), F.lit(0)))
    ratio = scores.conflict_ratio(u, F.col("conflicting_unique_kmers"))
    rows = rows.withColumn("_ratio", ratio).withColumn("_signal", scores.confidence(*support, F.lit(0.0))).withColumn("_score", scores.confidence(*support, ratio))
    relative = u - F.col("_next") >= rules.min_unique_kmer_margin if rules.min_unique_kmer_margin > 0 else F.lit(True)
    if rules.min_unique_kmer_ratio > 0:
        relative &= (F.col("_next") == 0) | (u / F.col("_next") >= rules.min_unique_kmer_ratio)
    passes = (
        (u >= rules.min_unique_kmers) & (F.col("n_positive_sequences") >= rules.min_positive_sequences) & (F.col("n_k_values_positive") >= rules.min_k_values_positive) & (F.col("best_k") >= rules.min_best_k)
        & (F.col("n_exact_hits") >= rules.min_exact_hits) & (F.col("n_hits") >= rules.min_total_hits) & relative & (F.round(F.col("_signal") + 1e-9, 4) >= rules.min_confidence_score)
    )
    rows = rows.withColumn("_pass", passes)
    rows = rows.withColumn("_n", F.sum(F.col("_pass").cast("int")).over(sample)).withColumn("_top", F.coalesce(F.max(F.when(F.col("_pass"), u)).over(sample), F.lit(0)))
    filtered = F.lit(rules.allow_mixed_species and rules.min_mixed_species_fraction > 0) & (F.col("_n") > 1) & (F.col("_top") > 0)
    rows = rows.withColumn("_report", F.col("_pass") & (~filtered | (u >= F.col("_top") * rules.min_mixed_species_fraction)))
    rows = rows.withColumn("_reports", F.sum(F.col("_report").cast("int")).over(sample))
    rows = rows.withColumn("reportable_conflicting_unique_kmers", F.coalesce(F.sum(F.when(F.col("_report"), u)).over(sample), F.lit(0)) - F.when(F.col("_report"), u).otherwise(0))
    reportable_ratio = scores.conflict_ratio(u, F.col("reportable_conflicting_unique_kmers"))
    mixed = F.lit(rules.allow_mixed_species) & (F.col("_reports") > 1) & F.col("_report")
    call = (
        F.when(F.col("_pass") & ~F.col("_report"), "neighbour_lineage_evidence").when(mixed, "present_in_mixed_sample")
        .when(F.col("_report") & (reportable_ratio <= rules.max_conflict_ratio), "present_high_confidence").when(F.col("_report"), "ambiguous_conflicting_signal")
        .when(u > 0, rules.low_evidence_call).otherwise("not_detected")
    )
    r4 = lambda c: F.round(c + 1e-9, 4)
    return rows.select(
        *evidence.columns, F.col("conflicting_unique_kmers").cast("long"), r4(F.col("_ratio")).alias("conflict_ratio"), F.col("reportable_conflicting_unique_kmers").cast("long"), r4(reportable_ratio).alias("reportable_conflict_ratio"),
        r4(F.when(F.col("_pass") & (F.col("_top") > 0), u / F.col("_top")).otherwise(0.0)).alias("mixed_species_support_fraction"), r4(F.when(mixed, F.col("_signal")).otherwise(F.col("_score"))).alias("confidence_score"), r4(F.col("_signal")).alias("signal_confidence_score"), call.alias("call"),
    )


REPORTABLE = ("present_high_confidence", "present_in_mixed_sample")
CONSOLIDATED = (*REPORTABLE, "ambiguous_conflicting_signal")


def background_taxa(spark: SparkSession, labels: Sequence[str] = (), path: str | None = None) -> DataFrame:
    """taxon: normalised background labels, those given and those of a text file (one a line; blank lines and comments, which begin with #, don't count)."""
    own = spark.createDataFrame([(x,) for x in labels], "value string")
    both = own.unionByName(spark.read.text(path).filter(~F.startswith(F.trim("value"), F.lit("#")))) if path else own
    return both.select(names.taxon_key(F.col("value")).alias("taxon")).filter("taxon <> ''").distinct()


def consolidate(calls: DataFrame, background: Sequence[str] | DataFrame = (), demote: bool = True, min_margin: int = 25, min_ratio: float = 2.0, min_fraction: float = 0.0, positive: Sequence[str] = REPORTABLE) -> DataFrame:
    """Within each sample and genus the best reportable species stays; dominated or too weak neighbours are demoted.

    The primary species is the first of a window over (sample, genus), so no join is needed. ``background``: labels, or a table as ``background_taxa`` gives it.
    """
    u, species = F.col("n_unique_kmers"), F.col("species_name")
    rows = calls.withColumn("taxon_genus", names.genus(species)).withColumn("_ok", F.col("call").isin(*positive))
    group = Window.partitionBy("sample_id", "taxon_genus")
    best = F.struct((-u).alias("u"), (-F.col("n_positive_sequences")).alias("s"), (-F.col("best_k")).alias("k"), species.alias("name"))
    rows = rows.withColumn("_first", F.min(F.when(F.col("_ok") & (F.col("taxon_genus") != ""), best)).over(group))
    if isinstance(background, DataFrame):
        listed = background.select(F.col("taxon").alias("_taxon")).withColumn("_listed", F.lit(True))
        rows = rows.join(listed, names.taxon_key(species) == F.col("_taxon"), "left").withColumn("_bg", F.coalesce("_listed", F.lit(False))).drop("_taxon", "_listed")
    else:
        rows = rows.withColumn("_bg", names.taxon_key(species).isin([b.replace("_", " ").strip().lower() for b in background]) if background else F.lit(False))
    other = F.col("_ok") & ~F.col("_bg") & F.lit(demote) & F.col("_first").isNotNull() & (F.col("_first.name") != species)
    top = -F.col("_first.u")
    ratio = F.when(u > 0, top / u)
    dominated = (top - u >= min_margin) & ((u <= 0) & (top > 0) | (ratio >= min_ratio))
    fraction = F.when(top > 0, u / top).otherwise(0.0)
    weak = F.lit(min_fraction > 0) & (fraction < min_fraction)
    down = other & (weak | dominated)
    low = F.col("call").isin("neighbour_lineage_evidence", "observed_below_threshold", "present_low_confidence")
    layer = F.when(F.col("_bg") & F.col("_ok"), "background_candidate").when(down, "neighbour_lineage_evidence").when(F.col("_ok") & F.lit(demote), "reportable_species").when(low, "lineage_context").when(F.col("call") == "not_detected", "not_detected").otherwise("raw_species_evidence")
    reason = (
        F.when(F.col("_bg") & F.col("_ok"), "taxon_supplied_as_empirical_background_candidate").when(other & weak, "below_same_genus_reportable_fraction").when(other & dominated, "dominated_same_genus_neighbour")
        .when(other, "co_dominant_or_insufficiently_dominated_species").when(F.col("_ok") & F.lit(demote), "primary_species_for_sample_genus").when(low, "non_reportable_species_context").when(F.col("call") == "not_detected", "no_reportable_signal").otherwise("unchanged")
    )
    call = F.when(F.col("_bg") & F.col("_ok"), "background_candidate_signal").when(down, "neighbour_lineage_evidence").otherwise(F.col("call"))
    return rows.select(
        *[c for c in calls.columns if c != "call"], F.col("call").alias("pre_consolidation_call"), call.alias("call"), layer.alias("report_layer"), reason.alias("consolidation_reason"), "taxon_genus",
        F.when(other, F.col("_first.name")).alias("primary_species"), F.when(other, top).cast("long").alias("primary_unique_kmers"), F.when(other, top - u).cast("long").alias("primary_margin"),
        F.when(other, F.round(ratio + 1e-9, 4)).alias("primary_ratio"), F.when(other, F.round(fraction + 1e-9, 4)).alias("primary_fraction"), F.col("_bg").alias("is_background_candidate"),
    )


# Order of ranks from the narrowest.
RANK_ORDER = ("species", "genus", "family", "order", "class", "phylum", "superkingdom", "clade")


def interpret_lineages(calls: DataFrame, taxa: DataFrame, ranks: Sequence[str] = ("genus", "family", "order", "class", "phylum", "superkingdom", "clade"), min_unique: int = 20, min_sequences: int = 5, min_k_values: int = 1, min_best_k: int = 77, min_score: float = 0.4, min_neighbours: int = 2) -> DataFrame:
    """One outcome per sample of calls or taxonomic evidence: from species detected down to no supported signal."""
    weak = F.col("call").isin("present_low_confidence", "observed_below_threshold", "ambiguous_conflicting_signal", "neighbour_lineage_evidence") & (F.col("n_unique_kmers") > 0)
    u = F.col("n_unique_kmers")
    order = F.struct((-u).alias("u"), (-F.col("n_positive_sequences")).alias("s"), (-F.col("best_k")).alias("k"), F.col("species_name").alias("name"))
    ranked = calls.withColumn("_r", F.row_number().over(Window.partitionBy("sample_id").orderBy(order)))
    ok = F.col("call").isin(*REPORTABLE)
    count = lambda c: F.sum(c.cast("long"))
    at = lambda i, c: F.max(F.when(F.col("_r") == i, F.col(c)))
    species = ranked.groupBy("sample_id").agg(
        count(ok).alias("n_reportable_species"), F.array_join(F.array_sort(F.collect_list(F.when(ok, F.col("species_name")))), ";").alias("_names"), count(weak).alias("n_neighbour_species"), count(u > 0).alias("n_observed_species"),
        count(F.col("call").isin("present_low_confidence", "observed_below_threshold")).alias("n_low_evidence_species"), count(F.col("call") == "ambiguous_conflicting_signal").alias("n_conflicting_species"),
        at(1, "species_name").alias("best_species"), at(1, "n_unique_kmers").alias("_u1"), at(2, "species_name").alias("second_species"), at(2, "n_unique_kmers").alias("_u2"),
    )
    priority = F.array_position(F.array(*map(F.lit, RANK_ORDER)), F.lower("evidence_rank"))
    best = F.struct(F.when(priority > 0, priority).otherwise(99).alias("p"), (-u).alias("u"), (-F.col("n_positive_sequences")).alias("s"), (-F.col("best_k")).alias("k"), F.col("evidence_name").alias("name"), F.col("evidence_rank").alias("rank"), F.col("n_k_values_positive").alias("nk"))
    tax = taxa.filter(F.lower("evidence_rank").isin(*ranks) & (u > 0)).groupBy("sample_id").agg(F.min(best).alias("t"))
    samples = calls.select("sample_id").union(taxa.select("sample_id")).distinct().filter("sample_id <> ''")
    rows = samples.join(species, "sample_id", "left").join(tax, "sample_id", "left")
    tu, ts, tk, tn = -F.col("t.u"), -F.col("t.s"), -F.col("t.k"), F.col("t.nk")
    score = F.when(F.col("t").isNotNull(), scores.taxonomic_confidence(tu, ts, tn, tk)).otherwise(0.0)
    passes = F.coalesce((tu >= min_unique) & (ts >= min_sequences) & (tn >= min_k_values) & (tk >= min_best_k) & (score >= min_score), F.lit(False))
    n, w = F.coalesce("n_reportable_species", F.lit(0)), F.coalesce("n_neighbour_species", F.lit(0))
    pick = lambda *v: F.when(n > 1, v[0]).when(n == 1, v[1]).when(passes & (w >= min_neighbours), v[2]).when(passes, v[3]).when(w > 0, v[4]).otherwise(v[5])
    lit = lambda *v: pick(*map(F.lit, v))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select(
        "sample_id", lit("mixed_species_detected", "species_detected", "possible_novel_or_unsampled_lineage", "unresolved_taxonomic_signal", "weak_unresolved_neighbour_signal", "no_supported_signal").alias("lineage_call"),
        lit("reportable_species_present", "reportable_species_present", "strong_taxonomic_signal_with_multiple_weak_neighbours", "strong_taxonomic_signal_without_species_call", "weak_species_neighbour_evidence_below_taxonomic_threshold", "no_species_or_taxonomic_evidence").alias("novelty_reason"),
        pick(F.lit("species"), F.lit("species"), F.col("t.rank"), F.col("t.rank"), F.lit("unresolved"), F.lit("none")).alias("report_rank"),
        pick(F.col("_names"), F.col("_names"), F.col("t.name"), F.col("t.name"), F.lit("weak_neighbour_signal"), F.lit("not_detected")).alias("report_name"),
        *map(zero, ("n_reportable_species", "n_observed_species", "n_low_evidence_species", "n_conflicting_species", "n_neighbour_species")),
        F.coalesce("best_species", F.lit("")).alias("best_species"), F.coalesce("second_species", F.lit("")).alias("second_species"), F.round(F.when(F.col("_u2") > 0, F.col("_u1") / F.col("_u2")) + 1e-9, 4).alias("best_species_ratio"),
        F.col("t.name").alias("best_taxonomic_name"), F.round(score, 4).alias("best_taxonomic_confidence_score"),
    )


def taxon_map(records: DataFrame, name_col: str, taxid_col: str) -> DataFrame:
    """Normalised name to taxid; a name with two taxids is an error."""
    got = records.filter(names.blank(F.col(taxid_col)).isNotNull()).groupBy(names.taxon_key(F.col(name_col), underscores=False).alias("taxon")).agg(F.min(taxid_col).alias("taxid"), F.max(taxid_col).alias("_b"))
    return got.select("taxon", F.when(F.col("taxid") == F.col("_b"), F.col("taxid")).otherwise(F.raise_error(F.concat(F.lit("conflicting taxids for "), "taxon"))).alias("taxid"))


def resolve_taxids(rows: DataFrame, mapping: DataFrame, taxid_cols: Sequence[str], name_cols: Sequence[str]) -> DataFrame:
    """``taxid``: the first non-blank taxid column, else the mapped first non-blank name."""
    name = F.coalesce(*(names.blank(F.col(c)) for c in name_cols))
    own = F.coalesce(*(names.blank(F.col(c)) for c in taxid_cols), F.lit(None)) if taxid_cols else F.lit(None).cast("string")
    m = mapping.select(F.col("taxon").alias("_taxon"), F.col("taxid").alias("_mapped"))
    return rows.withColumn("_own", own).withColumn("_name", names.taxon_key(name, underscores=False)).join(m, F.col("_name") == F.col("_taxon"), "left").withColumn("taxid", F.coalesce("_own", "_mapped")).drop("_own", "_name", "_taxon", "_mapped")


def dominant_rows(rows: DataFrame, by: Sequence[str], tree: taxonomy.Tree, min_fraction: float = 0.25, ranks: Sequence[str] = ("species", "genus", "family")) -> DataFrame:
    """Rows with a score of at least a share of the best whose common ancestor with the best has, or lies below one that has, a compatible rank.

    ``rows`` have taxid and score; the top row per group is a window value. Rows whose taxid, or whose group's best, the tree doesn't have go.
    """
    top = F.first(F.struct("taxid", "score")).over(Window.partitionBy(*by).orderBy(F.desc("score"), "taxid"))
    r = rows.withColumn("_top", top).filter(F.col("score") >= F.greatest(F.col("_top.score"), F.lit(1.0)) * min_fraction)
    r = taxonomy.assign_nodes(r.withColumn("_pair", F.array("taxid", "_top.taxid")), tree, "_pair", ranks)
    return r.filter((F.col("lca.known") == F.size("_pair")) & F.lower("node.rank").isin(*ranks)).select(rows.columns)
