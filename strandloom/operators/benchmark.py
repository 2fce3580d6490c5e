"""Benchmark analytics: flags against truth, sample and target summaries, detection limits, sweeps, audits, catalogues."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, scores
from ..scratch import materialise
from . import taxonomy

POSITIVE = ("present_high_confidence", "present_in_mixed_sample")


def _n(c: Column) -> Column:
    return F.sum(F.coalesce(c.cast("long"), F.lit(0)))


def manifest(rows: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Columns renamed by aliases; negatives are shuffled or unspiked; total spike by genomes."""
    for old, new in aliases.items():
        if old in rows.columns and new not in rows.columns:
            rows = rows.withColumnRenamed(old, new)
    shuffled = F.lower(F.coalesce(F.col("is_shuffled").cast("string"), F.lit(""))).isin("1", "true", "yes", "y") if "is_shuffled" in rows.columns else F.lit(False)
    return rows.withColumn("is_negative", shuffled | (F.col("spike_n") == 0)).withColumn("total_spike_n", F.col("spike_n") * F.coalesce("n_genomes", F.lit(1)))


def expected_targets(panel_targets: DataFrame, family_targets: DataFrame) -> DataFrame:
    """Expected labels per (family, panel): a family's own targets override its panel's."""
    pairs = panel_targets.select("panel", F.col("targets").alias("_p")).crossJoin(F.broadcast(family_targets.select("family", F.col("targets").alias("_f"))))
    return pairs.select("family", "panel", F.array_distinct(F.coalesce("_f", "_p")).alias("targets"))


def flag_calls(calls: DataFrame, background_taxa: Sequence[str] = (), background_calls: Sequence[str] = ("background_candidate_signal",), demote_genus: bool = True, positive: Sequence[str] = POSITIVE, genus_flag: str = "plasmodium") -> DataFrame:
    """Truth flags and the report layer of call rows (sample_id, label, call, targets: array, is_negative, is_species_level)."""
    label = F.lower(names.taxon_name(F.col("label")))
    targets = F.transform("targets", lambda t: F.lower(names.taxon_name(t)))
    genera = F.transform(targets, lambda t: F.split(t, " ")[0])
    pos = F.coalesce(F.col("call").isin(*positive), F.lit(False))
    background = F.col("call").isin(*background_calls) | label.isin(*[b.lower() for b in background_taxa]) if background_taxa else F.col("call").isin(*background_calls)
    rows = calls.select("*", label.alias("_l"), F.array_contains(targets, label).alias("is_expected_target"), pos.alias("is_positive_call"), F.coalesce(background, F.lit(False)).alias("is_background"), F.array_contains(genera, F.split(label, " ")[0]).alias("_g"))
    neighbour = F.lit(demote_genus) & ~F.col("is_negative") & ~F.col("is_expected_target") & ~F.col("is_background") & F.col("_g")
    rows = rows.withColumn("is_genus_neighbour", neighbour)
    p, e, b, g, s = (F.col(c) for c in ("is_positive_call", "is_expected_target", "is_background", "is_genus_neighbour", "is_species_level"))
    layer = F.when(~p, "not_positive").when(~s, "non_species_context").when(e, "expected_target").when(b, "background_candidate").when(g, "expected_genus_neighbour").otherwise("reportable_off_target")
    return rows.select(
        "*", (p & e).alias("is_positive_expected"), (s & b).alias("is_positive_background"), (p & s & g).alias("is_positive_neighbour"), (p & ~e).alias("is_positive_off_target_raw"), (p & ~e & ~b & ~g).alias("is_positive_off_target"),
        (p & ~e & ~b & ~g & F.col("_l").contains(genus_flag)).alias("is_positive_genus_off_target"), layer.alias("benchmark_report_layer"),
    ).drop("_l", "_g")


def sample_summary(status: DataFrame, flagged: DataFrame) -> DataFrame:
    """One row per sample of the manifest: distinct labels by kind, whether all expected were found, clean and strictly clean."""
    d = lambda c: F.count_distinct(F.when(F.col(c), F.lower("label")))
    got = flagged.groupBy("sample_id").agg(
        d("is_positive_call").alias("n_positive"), d("is_positive_expected").alias("n_expected"), d("is_positive_off_target").alias("n_off_target"), d("is_positive_off_target_raw").alias("n_off_target_raw"),
        d("is_positive_background").alias("n_background"), d("is_positive_neighbour").alias("n_neighbour"), F.collect_set(F.when(F.col("is_positive_expected"), F.lower("label"))).alias("_found"),
    )
    counts = ["n_positive", "n_expected", "n_off_target", "n_off_target_raw", "n_background", "n_neighbour"]
    rows = status.join(got, "sample_id", "left").na.fill(0, counts)
    wanted = F.transform("targets", lambda t: F.lower(t))
    all_ = (F.size(wanted) > 0) & (F.size(F.array_except(wanted, F.coalesce("_found", F.array().cast("array<string>")))) == 0)
    rows = rows.withColumn("all_expected", all_)
    return rows.withColumn("clean", F.col("all_expected") & (F.col("n_off_target") == 0)).withColumn("strictly_clean", F.col("all_expected") & (F.col("n_off_target_raw") == 0)).drop("_found")


def detection_limit(rows: DataFrame, by: Sequence[str], rates: Sequence[float] = (0.5, 0.95, 1.0)) -> DataFrame:
    """The lowest spike whose detection rate reaches each rate (later spikes may fall below)."""
    per = rows.filter("spike_n > 0").groupBy(*by, "spike_n").agg(F.avg(F.col("detected").cast("double")).alias("rate"))
    return per.groupBy(*by).agg(*(F.min(F.when(F.col("rate") >= r, F.col("spike_n"))).alias(f"lod{round(100 * r)}") for r in rates))


def target_performance(status: DataFrame, flagged: DataFrame) -> DataFrame:
    """Per family, panel and target: confusion counts over samples, sensitivity, specificity, precision, F1, detection limits."""
    hit = flagged.filter("is_positive_expected").select("sample_id", F.lower("label").alias("target")).distinct().withColumn("detected", F.lit(True))
    rows = status.select("sample_id", "family", "panel", "spike_n", "is_negative", F.explode(F.transform("targets", lambda t: F.lower(t))).alias("target"))
    rows = rows.join(hit, ["sample_id", "target"], "left").withColumn("detected", F.coalesce("detected", F.lit(False)))
    by = ["family", "panel", "target"]
    d, neg = F.col("detected"), F.col("is_negative")
    per = rows.groupBy(*by).agg(_n(d & ~neg).alias("tp"), _n(~d & ~neg).alias("fn"), _n(d & neg).alias("fp"), _n(~d & neg).alias("tn"))
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    r = lambda a, b: F.round(scores.divide_or_null(a, b), 6)
    per = per.select("*", r(tp, tp + fn).alias("sensitivity"), r(tn, tn + fp).alias("specificity"), r(tp, tp + fp).alias("precision"), r(2 * tp, 2 * tp + fp + fn).alias("f1"))
    return per.join(detection_limit(rows.filter("not is_negative"), by), by, "left")


def real_world(samples: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rates and means over positive and negative samples, and the median taxonomic precision of positives."""
    precision = F.when(F.col("n_positive") > 0, F.col("n_expected") / F.col("n_positive"))
    rate = lambda c, neg: F.round(F.avg(F.when(F.col("is_negative") == neg, c.cast("double"))), 6)
    return samples.groupBy(*by).agg(
        _n(~F.col("is_negative")).alias("n_positive_samples"), _n(F.col("is_negative")).alias("n_negative_samples"), rate(F.col("all_expected"), False).alias("all_expected_rate"), rate(F.col("clean"), False).alias("clean_rate"),
        rate(F.col("strictly_clean"), False).alias("strictly_clean_rate"), rate(F.col("n_expected") > 0, False).alias("any_expected_rate"), rate(F.col("n_off_target") > 0, False).alias("off_target_rate"), rate(F.col("n_positive") > 0, True).alias("false_positive_rate"),
        rate(F.col("n_off_target"), False).alias("mean_off_target"), rate(F.col("n_neighbour"), False).alias("mean_neighbour"), F.round(F.median(F.when(~F.col("is_negative"), precision)), 6).alias("median_precision"),
    )


def progress(status: DataFrame) -> DataFrame:
    return status.groupBy("family", "panel", "status").agg(F.count("*").alias("n"), F.median("runtime").alias("median_runtime"), F.max("runtime").alias("max_runtime"))


def off_targets(flagged: DataFrame, flag: str = "is_positive_off_target") -> DataFrame:
    """Labels of a kind: samples, medians, largest support, an expected target of theirs."""
    return flagged.filter(F.col(flag)).groupBy("label").agg(F.count_distinct("sample_id").alias("n_samples"), F.median("n_unique_kmers").alias("median_unique_kmers"), F.max("n_positive_sequences").alias("max_positive_sequences"), F.min(F.array_join("targets", ";")).alias("example_targets"))


def runtimes(status: DataFrame, by: Sequence[str]) -> DataFrame:
    return status.groupBy(*by).agg(F.count("*").alias("n"), F.count("runtime").alias("n_timed"), F.round(F.sum("runtime"), 4).alias("total"), F.round(F.median("runtime"), 4).alias("median"), F.max("runtime").alias("longest"))


def run_status(rows: DataFrame) -> DataFrame:
    return rows.withColumn("status", F.when(F.coalesce("exit_code", F.lit(0)) != 0, "nonzero_exit").when(~F.col("has_calls"), "missing_calls").otherwise("ok"))


@dataclass(frozen=True)
class Thresholds:
    name: str
    min_k_values: int
    min_unique: int
    min_sequences: int
    min_exact: int
    min_best_k: int
    min_confidence: float
    max_conflict: float


def parse_thresholds(spec: str) -> Thresholds:
    """``name:k1,u10,p2,e10,best101,conf0.5,conflict0.1``; all seven are required."""
    name, _, body = spec.partition(":")
    keys = {"conflict": ("max_conflict", float), "conf": ("min_confidence", float), "best": ("min_best_k", int), "k": ("min_k_values", int), "u": ("min_unique", int), "p": ("min_sequences", int), "e": ("min_exact", int)}
    got = {}
    for part in filter(None, map(str.strip, body.split(","))):
        key = next((k for k in keys if part.startswith(k) and part[len(k) :].replace(".", "", 1).isdigit()), None)
        if key is None:
            raise ValueError(f"unknown threshold {part!r}")
        got[keys[key][0]] = keys[key][1](part[len(key) :])
    if not name or len(got) != len(keys):
        raise ValueError(f"a threshold set needs a name and {len(keys)} thresholds: {spec!r}")
    return Thresholds(name, **got)


def sweep(flagged: DataFrame, sets: Sequence[Thresholds]) -> DataFrame:
    """Every call row under every threshold set; a set can only promote rows beyond the current positives."""
    grid = flagged.sparkSession.createDataFrame([asdict(s) for s in sets])
    rows = flagged.crossJoin(F.broadcast(grid.withColumnRenamed("name", "threshold_set")))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    passes = (
        F.col("is_species_level") & (z("n_unique_kmers") >= F.col("min_unique")) & (z("n_positive_sequences") >= F.col("min_sequences")) & (z("n_k_values_positive") >= F.col("min_k_values")) & (z("best_k") >= F.col("min_best_k"))
        & (z("n_exact_hits") >= F.col("min_exact")) & (z("confidence_score") >= F.col("min_confidence")) & (z("reportable_conflict_ratio") <= F.col("max_conflict"))
    )
    rows = rows.withColumn("sweep_positive", F.col("is_positive_call") | passes)
    p, e = F.col("sweep_positive"), F.col("is_expected_target")
    rows = rows.withColumn("sweep_promoted", p & ~F.col("is_positive_call")).withColumn("sweep_expected", p & e).withColumn("sweep_background", p & F.col("is_background"))
    rows = rows.withColumn("sweep_neighbour", p & F.col("is_genus_neighbour") & ~F.col("is_negative") & ~e & ~F.col("sweep_background"))
    return rows.withColumn("sweep_off_target", p & ~e & ~F.col("sweep_background") & ~F.col("sweep_neighbour")).drop(*[f for f in Thresholds.__dataclass_fields__ if f != "name"])


def sweep_targets(swept: DataFrame) -> DataFrame:
    """Distinct-sample confusion per threshold set and expected target, with the detection limits."""
    e = swept.filter("is_expected_target").groupBy("threshold_set", F.lower("label").alias("target"), "sample_id", "spike_n", "is_negative").agg(F.max("sweep_positive").alias("detected"))
    by = ["threshold_set", "target"]
    d, neg = F.col("detected"), F.col("is_negative")
    per = e.groupBy(*by).agg(_n(d & ~neg).alias("tp"), _n(~d & ~neg).alias("fn"), _n(d & neg).alias("fp"), _n(~d & neg).alias("tn"))
    return per.join(detection_limit(e.filter("not is_negative and spike_n is not null"), by), by, "left")


def sweep_samples(swept: DataFrame) -> DataFrame:
    """Per threshold set and sample: counts by kind; clean if any expected and no off-target was found."""
    n = lambda c: F.count_distinct(F.when(F.col(c), F.lower("label")))
    out = swept.groupBy("threshold_set", "sample_id", "spike_n", "is_negative").agg(n("sweep_positive").alias("n_positive"), n("sweep_expected").alias("n_expected"), n("sweep_off_target").alias("n_off_target"), n("sweep_background").alias("n_background"), n("sweep_neighbour").alias("n_neighbour"))
    return out.withColumn("clean", (F.col("n_expected") > 0) & (F.col("n_off_target") == 0))


def sweep_real_world(samples: DataFrame, by: Sequence[str] = ("threshold_set",)) -> DataFrame:
    rate = lambda c, neg: F.round(F.avg(F.when(F.col("is_negative") == neg, c.cast("double"))), 6)
    return samples.groupBy(*by).agg(F.count("*").alias("n_samples"), rate(F.col("n_expected") > 0, False).alias("any_expected_rate"), rate(F.col("clean"), False).alias("clean_rate"), rate(F.col("n_off_target") > 0, False).alias("off_target_rate"), rate(F.col("n_positive") > 0, True).alias("false_positive_rate"))


def unpivot_calls(wide: DataFrame, tool: str, labels: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Columns <tool>_<label>_<field> as rows (label, call, unique_kmers, positive_reads, confidence); missing: NA or 0."""
    fields = {"call": "NA", "unique_kmers": 0, "positive_reads": 0, "confidence": 0.0}
    part = lambda label: F.struct(F.lit(label).alias("label"), *(F.coalesce(F.col(f"{tool}_{label}_{f}") if f"{tool}_{label}_{f}" in wide.columns else F.lit(None), F.lit(d)).alias(f) for f, d in fields.items()))
    return wide.select(*keys, F.inline(F.array(*map(part, labels))))


def call_state(call: Column) -> Column:
    return F.when(call.isin(*POSITIVE), "positive").when(call.contains("ambiguous"), "ambiguous").when(F.coalesce(call, F.lit("")).isin("", "NA", "not_detected"), "not_detected").otherwise("other")


def by_spike(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    state = call_state(F.col("call"))
    text = rows.groupBy(*by, "call").agg(F.count("*").alias("n")).groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "call", F.col("n").cast("string")))), ";").alias("calls"))
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), _n(state == "positive").alias("n_positive"), _n(state == "ambiguous").alias("n_ambiguous"), F.round(F.avg((state == "positive").cast("double")), 4).alias("positive_rate"), F.round(F.avg("n_unique_kmers"), 4).alias("mean_unique_kmers"), F.round(F.median("n_unique_kmers"), 4).alias("median_unique_kmers"))
    return out.join(text, list(by))


def call_counts(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def run_qc(rows: DataFrame, by: Sequence[str], replicates: int, levels: int) -> DataFrame:
    seen = F.count_distinct("spike_n", "replicate")
    return rows.groupBy(*by).agg(F.count_distinct("replicate").alias("n_replicates"), F.count_distinct("spike_n").alias("n_levels"), seen.alias("n_observed"), F.lit(replicates * levels).cast("long").alias("n_expected"), (F.lit(replicates * levels) - seen).cast("long").alias("n_missing"))


def count_by(rows: DataFrame, column: str) -> DataFrame:
    value = F.when(F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))) == "", "<blank>").otherwise(F.col(column).cast("string"))
    return rows.groupBy(value.alias(column)).agg(F.count("*").alias("n_records"))


def numeric_summary(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    long = rows.select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns))))
    return long.groupBy("feature").agg(F.count("value").alias("n"), _n(F.col("value") != 0).alias("n_nonzero"), F.round(F.min("value"), 6).alias("min"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("max"))


def truth_issues(truth: DataFrame) -> DataFrame:
    """Problems of a truth manifest (organism, accepted_names: array, fraction, expected): repeated organisms, shared aliases, fractions above 1."""
    twice = truth.groupBy("organism").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate_organism").alias("issue"), F.col("organism").alias("subject"))
    alias = truth.select("organism", F.explode("accepted_names").alias("a")).groupBy(names.taxon_key(F.col("a")).alias("a")).agg(F.count_distinct("organism").alias("n")).filter("n > 1").select(F.lit("alias_clash").alias("issue"), F.col("a").alias("subject"))
    total = truth.agg(F.round(F.sum("fraction"), 6).alias("t")).filter("t > 1").select(F.lit("fractions_exceed_one").alias("issue"), F.col("t").cast("string").alias("subject"))
    return twice.union(alias).union(total)


def truth_category(rows: DataFrame, truth: DataFrame, label_col: str = "label") -> DataFrame:
    """Rows with the truth's tier and a category: expected or unexpected by reportable, below threshold or without evidence."""
    alias = truth.select(F.explode("accepted_names").alias("_a"), "organism", "tier", "expected").select(names.taxon_key(F.col("_a")).alias("_k"), "organism", "tier", "expected")
    out = rows.withColumn("_l", names.taxon_key(F.col(label_col))).join(alias, F.col("_l") == F.col("_k"), "left").drop("_l", "_k")
    known = F.coalesce("expected", F.lit(False))
    kind = F.when(reportable(out), "reportable").when(below(out), "below_threshold").when(has_evidence(), "evidence_only").otherwise("absent")
    return out.withColumn("category", F.concat(F.when(known, "expected").when(F.col("organism").isNotNull(), "listed").otherwise("off_target"), F.lit("_"), kind)).withColumn("coarse", F.when(known & reportable(out), "true_positive").when(known, "false_negative").when(reportable(out), "false_positive").otherwise("true_negative"))


def has_evidence(columns: Sequence[str] = ("n_hits", "n_unique_kmers", "n_positive_sequences", "n_exact_hits", "n_fuzzy_hits")) -> Column:
    return F.greatest(*(F.coalesce(F.col(c), F.lit(0)) for c in columns)) > 0


def below(_: DataFrame | None = None) -> Column:
    return F.lower(F.coalesce("call", F.lit(""))).isin("observed_below_threshold", "present_low_confidence", "low_evidence", "below_threshold")


def reportable(_: DataFrame | None = None) -> Column:
    return F.lower(F.coalesce("call", F.lit(""))).contains("present") & ~below()


# Words of calls and roles by which a screen of a mock community is judged.
REPORTABLE_CALLS = ("present", "species_detected", "detected", "positive", "reportable", "mixed_sample_species_detected")
BELOW_CALLS = ("observed_below_threshold", "below_threshold", "low_evidence", "neighbour_lineage_evidence", "neighbor_lineage_evidence")
NO_CALLS = ("not_detected", "absent", "none", "")
NEAR_ROLES = ("near_neighbour", "near_neighbor", "same_genus_neighbour", "same_genus_neighbor", "same_family_neighbour", "same_family_neighbor")
OUT_ROLES = ("outgroup", "distant_outgroup")


def community_category(rows: DataFrame) -> DataFrame:
    """``category`` and ``report_label`` of screen rows against a mock community.

    Rows: call, role, reference_label (may be blank), the flags expected_reference and expected_species, and counters. Of
    the rules the first that holds decides; other references of an expected species are kept apart from expected ones.
    """
    call, role = F.lower(F.trim(F.coalesce("call", F.lit("")))), F.lower(F.trim(F.coalesce("role", F.lit(""))))
    told = call.isin(*REPORTABLE_CALLS) | call.contains("reportable") | call.endswith("_detected") | call.contains("present")
    shown = ~call.isin(*NO_CALLS, *BELOW_CALLS) & told
    under = call.isin(*BELOW_CALLS) | call.contains("below") | call.contains("lineage")
    some, labelled = has_evidence(), F.trim(F.coalesce("reference_label", F.lit(""))) != ""
    reference, species = (F.coalesce(c, F.lit(False)) for c in ("expected_reference", "expected_species"))
    rules = (
        (reference & shown, "expected_reference_label", "expected_target"),
        (species & ~labelled & shown, "expected_species", "expected_target"),
        (species & labelled & some, "same_species_compatible_reference", "same_species_compatible_reference"),
        (shown & ~species, "true_off_target_reportable", "reportable_off_target_species"),
        (some & (role.isin(*NEAR_ROLES) | under), "near_neighbour_evidence", "observed_below_threshold"),
        (some & role.isin(*OUT_ROLES), "non_target_background_evidence", "observed_below_threshold"),
        (some, "unresolved_non_target_evidence", "observed_below_threshold"),
    )
    fine = coarse = F.lit("not_detected")
    for test, category, label in reversed(rules):
        fine, coarse = F.when(test, category).otherwise(fine), F.when(test, label).otherwise(coarse)
    return rows.withColumn("category", fine).withColumn("report_label", coarse)


def authoritative(calls: DataFrame, wide: DataFrame) -> DataFrame:
    """The samples' call files if they hold rows, else the rows unpivoted from the wide summary; older counters are renamed."""
    if calls.isEmpty():
        return wide
    if "n_positive_sequences" not in calls.columns and "n_positive_reads" in calls.columns:
        return calls.withColumn("n_positive_sequences", F.col("n_positive_reads"))
    return calls


def mock_samples(rows: DataFrame, truth: DataFrame) -> DataFrame:
    """Per sample: recall of expected organisms, off-target labels with their strongest, precision, strictly clean."""
    flagged = truth_category(rows, truth)
    n_truth = truth.filter("expected").agg(F.count_distinct("organism").alias("n_truth"))
    hit = lambda c: F.count_distinct(F.when(c, F.col("organism")))
    off = reportable() & F.col("organism").isNull()
    strongest = F.max(F.when(off, F.struct("n_unique_kmers", "n_positive_sequences", "best_k", "label")))["label"]
    out = flagged.groupBy("sample_id").agg(hit(F.col("expected") & has_evidence()).alias("n_raw"), hit(F.col("expected") & reportable()).alias("n_reported"), F.count_distinct(F.when(off, F.col("label"))).alias("n_off_target"), strongest.alias("strongest_off_target"))
    out = out.crossJoin(F.broadcast(n_truth))
    return out.select("*", F.round(F.col("n_reported") / F.col("n_truth"), 6).alias("recall"), F.round(scores.divide_or_null(F.col("n_reported"), F.col("n_reported") + F.col("n_off_target")), 6).alias("precision"), ((F.col("n_reported") == F.col("n_truth")) & (F.col("n_off_target") == 0)).alias("strictly_clean"))


def tier_recall(rows: DataFrame, truth: DataFrame) -> DataFrame:
    """Recall per sample and abundance tier; tiers nobody detects stay, with 0."""
    flagged = truth_category(rows, truth)
    hits = flagged.filter(F.col("expected") & reportable()).groupBy("sample_id", "tier").agg(F.count_distinct("organism").alias("n_found"))
    grid = rows.select("sample_id").distinct().crossJoin(F.broadcast(truth.filter("expected").groupBy("tier").agg(F.count_distinct("organism").alias("n_tier"))))
    return grid.join(hits, ["sample_id", "tier"], "left").select("sample_id", "tier", "n_tier", F.coalesce("n_found", F.lit(0)).alias("n_found"), F.round(F.coalesce("n_found", F.lit(0)) / F.col("n_tier"), 6).alias("recall"))


def depth_subsets(reads: DataFrame, draw: Column, fractions: Sequence[float]) -> DataFrame:
    """Reads once per fraction that their draw falls below: subsets of one seed are nested."""
    return reads.withColumn("fraction", F.explode(F.filter(F.array(*(F.lit(float(f)) for f in fractions)), lambda f: draw < f)))


def reference_audit(panel: DataFrame, truth: DataFrame) -> DataFrame:
    """Leakage of truth genomes into a reference panel: by accession or checksum, else same species; incomplete if neither is known."""
    t = truth.select(names.accession(F.col("accession")).alias("_acc"), F.col("checksum").alias("_sum"), names.taxon_key(F.col("species")).alias("_sp"))
    acc = t.select("_acc").filter("_acc <> ''").distinct().withColumn("a", F.lit(True))
    sums = t.select("_sum").filter("_sum <> ''").distinct().withColumn("s", F.lit(True))
    sp = t.select("_sp").distinct().withColumn("p", F.lit(True))
    rows = panel.withColumn("_acc", names.accession(F.col("accession"))).withColumn("_sum", F.col("checksum")).withColumn("_sp", names.taxon_key(F.col("species")))
    rows = rows.join(acc, "_acc", "left").join(sums, "_sum", "left").join(sp, "_sp", "left")
    status = F.when(F.col("a") | F.col("s"), "leakage").when((F.col("_acc") == "") & (F.coalesce("_sum", F.lit("")) == ""), "incomplete").when(F.col("p"), "same_species_reference").otherwise("clear")
    return rows.withColumn("status", status).drop("_acc", "_sum", "_sp", "a", "s", "p")


def reference_gate(audit: DataFrame, truth: DataFrame, minimum: int = 1) -> tuple[DataFrame, DataFrame]:
    """(coverage per expected species, summary as metric and value) of an audited reference panel.

    ``audit``: matched_truth_species, fasta_status, audit_status; ``truth``: species_name, taxid, one row a species. The gate passes (gate_status PASS, else BLOCKED) if every
    species has at least ``minimum`` references of its own, none leaks and all files are there.
    """
    if minimum <= 0:
        raise ValueError("minimum must be positive")
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    own = audit.filter(text("audit_status") == "same_species_reference").groupBy(text("matched_truth_species").alias("species_name")).agg(F.count("*").alias("n"))
    coverage = truth.join(own, "species_name", "left").select("species_name", "taxid", F.coalesce("n", F.lit(0)).alias("reference_count"))
    coverage = coverage.withColumn("panel_status", F.when(F.col("reference_count") >= minimum, "represented").otherwise("missing"))
    seen = coverage.agg(F.count("*").alias("expected"), F.count(F.when(F.col("panel_status") == "represented", 1)).alias("represented"), F.coalesce(F.min("reference_count"), F.lit(0)).alias("least"))
    bad = audit.agg(F.count(F.when(text("audit_status") == "leakage", 1)).alias("leakage"), F.count(F.when(text("fasta_status") != "present", 1)).alias("incomplete"))
    both = seen.crossJoin(bad)  # one row each
    passed = (F.col("expected") == F.col("represented")) & (F.col("leakage") == 0) & (F.col("incomplete") == 0) & (F.col("least") >= minimum)
    metrics = {
        "expected_species": F.col("expected"), "represented_species": F.col("represented"), "missing_species": F.col("expected") - F.col("represented"), "leakage_rows": F.col("leakage"), "incomplete_fasta_rows": F.col("incomplete"),
        "minimum_references_per_species": F.col("least"), "required_references_per_species": F.lit(minimum), "gate_status": F.when(passed, "PASS").otherwise("BLOCKED"),
    }
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), v.cast("string").alias("value")) for m, v in metrics.items()))).alias("x")
    return coverage, both.select(rows).select("x.*")


def taxid_plan(truth: DataFrame, tree: taxonomy.Tree, targets: int = 5, neighbours_per_genus: int = 25, clades: tuple[str, str] = ("target_species", "target_genera")) -> DataFrame:
    """What to fetch for a truth table (species_name, taxid): each species, and each distinct genus of theirs for near neighbours. A species without a genus is an error."""
    if targets <= 0 or neighbours_per_genus <= 0:
        raise ValueError("numbers of assemblies must be positive")
    genus = taxonomy.best_named(tree, ("genus",)).select("taxid", F.col("node.taxid").alias("genus_taxid"), F.col("node.name").alias("genus"), F.lower("node.rank").alias("rank"))
    rows = truth.join(genus, "taxid", "left")
    found = F.when(F.coalesce(F.col("rank") == "genus", F.lit(False)), F.col("genus_taxid")).otherwise(F.raise_error(F.concat(F.lit("no genus for "), "species_name")))
    rows = materialise(rows.withColumn("genus_taxid", found), "genera")
    row = lambda taxid, role, clade, label, most, best: (F.col(taxid).alias("taxid"), F.lit(role).alias("role"), F.lit(clade).alias("clade"), label.alias("group_label"), F.lit(most).alias("max_assemblies"), F.lit(best).alias("best_per_species"))
    own = rows.select(*row("taxid", "target_species", clades[0], F.concat(F.lit("target_"), names.safe_identifier(F.col("species_name"))), targets, targets))
    return own.unionByName(rows.select("genus_taxid", "genus").distinct().select(*row("genus_taxid", "near_neighbour", clades[1], F.concat(F.lit("genus_"), names.safe_identifier(F.col("genus"))), neighbours_per_genus, 1)))


def reference_config(rows: DataFrame, target_assemblies: int, neighbour_assemblies: int) -> DataFrame:
    """One row per assembly (accession, else path) by priority target, neighbour, background; then quotas per species or genus."""
    key = F.when(names.accession(F.col("accession")) != "", names.accession(F.col("accession"))).otherwise(F.col("path"))
    priority = F.when(F.col("role") == "target", 0).when(F.col("role") == "near_neighbour", 1).otherwise(2)
    one = rows.withColumn("_k", key).withColumn("_p", priority).withColumn("_r", F.row_number().over(Window.partitionBy("_k").orderBy("_p", "species", "path"))).filter("_r = 1")
    group = F.when(F.col("_p") == 0, F.col("species")).otherwise(names.genus(F.col("species")))
    place = F.row_number().over(Window.partitionBy("_p", group).orderBy("_k"))
    most = F.when(F.col("_p") == 0, target_assemblies).when(F.col("_p") == 1, neighbour_assemblies).otherwise(2**31 - 1)
    return one.withColumn("_n", place).filter(F.col("_n") <= most).drop("_k", "_p", "_r", "_n")


# Assembly levels from the best.
LEVELS = ("complete genome", "chromosome", "scaffold", "contig")


def assembly_reasons(rows: DataFrame, levels: Sequence[str] = (), min_scaffold_n50: int = 0, min_contig_n50: int = 0, min_length: int = 0, max_length: int | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """``reason``: the first filter an assembly fails (level, path, length, N50s, excluded accession), else empty."""
    level = ~F.lower("level").isin([x.lower() for x in levels]) if levels else F.lit(False)
    long = F.col("total_length") > max_length if max_length is not None else F.lit(False)
    reason = F.when(level, "assembly_level").when(names.blank(F.col("path")).isNull(), "missing_path").when(F.col("total_length") < min_length, "total_length_below_minimum").when(long, "total_length_above_maximum").when(F.col("scaffold_n50") < min_scaffold_n50, "scaffold_n50").when(F.col("contig_n50") < min_contig_n50, "contig_n50")
    if excluded is None:
        return rows.withColumn("reason", F.coalesce(reason, F.lit("")))
    out = rows.withColumn("_a", names.accession(F.col("accession"))).join(excluded.select(names.accession(F.col("accession")).alias("_a"), F.lit(True).alias("_x")).distinct(), "_a", "left")
    return out.withColumn("reason", F.coalesce(reason, F.when(F.col("_x"), "excluded_accession"), F.lit(""))).drop("_a", "_x")


def best_assemblies(rows: DataFrame, per_species: int = 1, limit: int = 0) -> DataFrame:
    """The best assemblies per species by level, N50s, length and accession; non-positive numbers mean no limit."""
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.lower("level"))
    order = [F.when(rank > 0, rank).otherwise(99), F.desc("scaffold_n50"), F.desc("contig_n50"), F.desc("total_length"), F.desc("accession")]
    group = F.coalesce(names.blank(F.col("species_taxid")), names.blank(F.col("species")), F.col("taxid"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    rows = rows.filter(F.col("place") <= per_species) if per_species > 0 else rows
    return rows.orderBy(*order).limit(limit) if limit > 0 else rows


def choose_path(refseq: Column, genbank: Column, source: str = "refseq") -> Column:
    first, second = (refseq, genbank) if source == "refseq" else (genbank, refseq)
    return F.coalesce(names.blank(first), names.blank(second), F.lit(""))


def group_metrics(rows: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean and median of metric columns per group; NaN counts as missing."""
    v = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    return rows.groupBy(*by).agg(*(f(v(c)).alias(f"{n}_{c}") for c in columns for n, f in (("mean", lambda x: F.round(F.avg(x), 6)), ("median", lambda x: F.round(F.median(x), 6)))))
