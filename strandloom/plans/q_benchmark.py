"""Queries of benchmark analytics. Orders are samples, line items their calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import seq
from ..operators import benchmark as bench
from ..operators import taxonomy
from .fixtures import SQL_HITS, hits, table
from .registry import query

LABELS = ("Plasmodium vivax", "Plasmodium falciparum", "Babesia bovis", "Toxoplasma gondii")
CALLS = ("present_high_confidence", "present_in_mixed_sample", "observed_below_threshold", "not_detected", "ambiguous_conflicting_signal")
SPIKES = (0, 10, 100, 1000, 4000)


def _pick(values, index):
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def status(spark, sf):
    o = table(spark, sf, "orders")
    targets = F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit(LABELS[0]))).when(F.col("o_orderpriority") == "2-HIGH", F.array(F.lit(LABELS[1]))).otherwise(F.array(*map(F.lit, LABELS[:2])))
    spike = _pick(SPIKES, F.col("o_custkey"))
    return o.select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderpriority").alias("family"), F.col("o_orderstatus").alias("panel"), spike.alias("spike_n"), (F.col("o_custkey") % 3).cast("int").alias("replicate"), (spike == 0).alias("is_negative"), targets.alias("targets"), F.col("o_totalprice").alias("runtime"))


def call_rows(spark, sf):
    i = table(spark, sf, "lineitem")
    rows = i.select(
        F.col("l_orderkey").alias("sample_id"), _pick(LABELS, F.col("l_suppkey")).alias("label"), _pick(CALLS, F.col("l_partkey")).alias("call"), F.col("l_quantity").cast("int").alias("n_unique_kmers"), F.floor(F.col("l_discount") * 100 + 0.5).cast("int").alias("n_positive_sequences"),
        (F.col("l_linenumber") % 3).cast("int").alias("n_k_values_positive"), _pick((51, 77, 101, 151), F.col("l_linenumber")).alias("best_k"), F.floor(F.col("l_quantity") / 2).cast("int").alias("n_exact_hits"), (F.col("l_tax") * 10).alias("confidence_score"), F.col("l_discount").alias("reportable_conflict_ratio"), (F.col("l_linenumber") != 5).alias("is_species_level"),
    )
    return rows.join(status(spark, sf), "sample_id")


def flagged(spark, sf):
    return bench.flag_calls(call_rows(spark, sf), background_taxa=["Babesia bovis"])


SQL_STATUS = f"""status AS (SELECT o_orderkey AS sample_id, o_orderpriority AS family, o_orderstatus AS panel, {list(SPIKES)}[(o_custkey % 5 + 1)::INT] AS spike_n, (o_custkey % 3)::INT AS replicate, o_custkey % 5 = 0 AS is_negative,
 CASE o_orderpriority WHEN '1-URGENT' THEN ['plasmodium vivax'] WHEN '2-HIGH' THEN ['plasmodium falciparum'] ELSE ['plasmodium vivax', 'plasmodium falciparum'] END AS targets, o_totalprice AS runtime FROM orders)"""
SQL_FLAGGED = f"""{SQL_STATUS}, rows AS (SELECT l_orderkey AS sample_id, {list(LABELS)}[(l_suppkey % 4 + 1)::INT] AS label, {list(CALLS)}[(l_partkey % 5 + 1)::INT] AS call, l_quantity::INT AS u, floor(l_discount * 100 + 0.5)::INT AS s, (l_linenumber % 3)::INT AS nk, [51, 77, 101, 151][(l_linenumber % 4 + 1)::INT] AS bk,
 floor(l_quantity / 2)::INT AS ex, l_tax * 10 AS conf, l_discount AS rconf, l_linenumber <> 5 AS sp FROM lineitem),
b AS (SELECT rows.*, family, panel, spike_n, replicate, is_negative, targets, list_contains(targets, lower(label)) AS e, call IN ('present_high_confidence', 'present_in_mixed_sample') AS p, label = 'Babesia bovis' AS bg, label LIKE 'Plasmodium%' AS genus FROM rows JOIN status USING (sample_id)),
f AS (SELECT *, NOT is_negative AND NOT e AND NOT bg AND genus AS g FROM b),
flagged AS (SELECT *, p AND e AS pe, sp AND bg AS pb, p AND sp AND g AS pg, p AND NOT e AS raw, p AND NOT e AND NOT bg AND NOT g AS ot FROM f)"""


@query("g01_manifest", f"WITH {SQL_STATUS} SELECT sample_id, (sample_id % 10 = 0 OR spike_n = 0) AS is_negative, (spike_n * (sample_id % 3 + 1))::BIGINT AS total_spike_n FROM status")
def g01(spark, sf):
    s = status(spark, sf).drop("is_negative").select(F.col("sample_id").alias("Sample"), F.col("spike_n").alias("spike"), F.when(F.col("sample_id") % 10 == 0, "yes").otherwise("no").alias("shuffled"), (F.col("sample_id") % 3 + 1).alias("n_genomes"))
    return bench.manifest(s, {"Sample": "sample_id", "spike": "spike_n", "shuffled": "is_shuffled"}).select("sample_id", "is_negative", F.col("total_spike_n").cast("long"))


@query("g02_expected_targets", "WITH f AS (SELECT DISTINCT o_orderpriority AS family, o_orderstatus AS panel FROM orders) SELECT DISTINCT family, panel, CASE WHEN family = '1-URGENT' THEN 'own' ELSE 'of_' || panel END AS target FROM (SELECT a.family, b.panel FROM f a, f b)")
def g02(spark, sf):
    o = table(spark, sf, "orders")
    panels = o.select(F.col("o_orderstatus").alias("panel")).distinct().withColumn("targets", F.array(F.concat(F.lit("of_"), "panel")))
    families = o.select(F.col("o_orderpriority").alias("family")).distinct().withColumn("targets", F.when(F.col("family") == "1-URGENT", F.array(F.lit("own"), F.lit("own"))))
    return bench.expected_targets(panels, families).select("family", "panel", F.explode("targets").alias("target"))


@query("g03_flag_calls", f"""WITH {SQL_FLAGGED} SELECT label, call, family, is_negative, CASE WHEN NOT p THEN 'not_positive' WHEN NOT sp THEN 'non_species_context' WHEN e THEN 'expected_target' WHEN bg THEN 'background_candidate' WHEN g THEN 'expected_genus_neighbour' ELSE 'reportable_off_target' END AS layer,
 pe, ot, raw, ot AND genus AS genus_ot, count(*)::BIGINT AS n FROM flagged GROUP BY ALL""")
def g03(spark, sf):
    f = flagged(spark, sf)
    return f.groupBy("label", "call", "family", "is_negative", F.col("benchmark_report_layer").alias("layer"), F.col("is_positive_expected").alias("pe"), F.col("is_positive_off_target").alias("ot"), F.col("is_positive_off_target_raw").alias("raw"), F.col("is_positive_genus_off_target").alias("genus_ot")).agg(F.count("*").alias("n"))


SQL_SAMPLES = f"""{SQL_FLAGGED}, a AS (SELECT sample_id, count(DISTINCT CASE WHEN p THEN label END) AS n_positive, count(DISTINCT CASE WHEN pe THEN label END) AS n_expected, count(DISTINCT CASE WHEN ot THEN label END) AS n_off_target, count(DISTINCT CASE WHEN raw THEN label END) AS n_off_target_raw, count(DISTINCT CASE WHEN pb THEN label END) AS n_background, count(DISTINCT CASE WHEN pg THEN label END) AS n_neighbour FROM flagged GROUP BY 1),
samples AS (SELECT s.*, coalesce(n_positive, 0) AS n_positive, coalesce(n_expected, 0) AS n_expected, coalesce(n_off_target, 0) AS n_off_target, coalesce(n_off_target_raw, 0) AS n_off_target_raw, coalesce(n_background, 0) AS n_background, coalesce(n_neighbour, 0) AS n_neighbour, coalesce(n_expected, 0) = len(targets) AS all_expected FROM status s LEFT JOIN a USING (sample_id))"""


@query("g04_sample_summary", f"WITH {SQL_SAMPLES} SELECT sample_id, n_positive, n_expected, n_off_target, n_off_target_raw, n_background, n_neighbour, all_expected, all_expected AND n_off_target = 0 AS clean, all_expected AND n_off_target_raw = 0 AS strictly_clean FROM samples")
def g04(spark, sf):
    s = bench.sample_summary(status(spark, sf), flagged(spark, sf))
    return s.select("sample_id", "n_positive", "n_expected", "n_off_target", "n_off_target_raw", "n_background", "n_neighbour", "all_expected", "clean", "strictly_clean")


SQL_TARGETS = f"""{SQL_FLAGGED}, t AS (SELECT sample_id, family, panel, spike_n, is_negative, unnest(targets) AS target FROM status), h AS (SELECT DISTINCT sample_id, lower(label) AS target FROM flagged WHERE pe), d AS (SELECT t.*, h.sample_id IS NOT NULL AS det FROM t LEFT JOIN h ON h.sample_id = t.sample_id AND h.target = t.target),
r AS (SELECT family, panel, target, spike_n, avg(det::INT) AS rate FROM d WHERE NOT is_negative GROUP BY ALL), lod AS (SELECT family, panel, target, min(spike_n) FILTER (rate >= 0.5) AS lod50, min(spike_n) FILTER (rate >= 0.95) AS lod95, min(spike_n) FILTER (rate >= 1) AS lod100 FROM r GROUP BY ALL),
c AS (SELECT family, panel, target, count(*) FILTER (det AND NOT is_negative)::BIGINT AS tp, count(*) FILTER (NOT det AND NOT is_negative)::BIGINT AS fn, count(*) FILTER (det AND is_negative)::BIGINT AS fp, count(*) FILTER (NOT det AND is_negative)::BIGINT AS tn FROM d GROUP BY ALL)"""


@query("g05_target_performance", f"""WITH {SQL_TARGETS} SELECT c.*, round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) END, 6) AS sensitivity, round(CASE WHEN tn + fp > 0 THEN tn::DOUBLE / (tn + fp) END, 6) AS specificity, round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) END, 6) AS precision,
 round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) END, 6) AS f1, lod50, lod95, lod100 FROM c LEFT JOIN lod USING (family, panel, target)""")
def g05(spark, sf):
    return bench.target_performance(status(spark, sf), flagged(spark, sf))


@query("g06_detection_limit", f"WITH {SQL_STATUS}, r AS (SELECT family, spike_n, avg((replicate > 0)::INT) AS rate FROM status WHERE spike_n > 0 GROUP BY ALL) SELECT family, min(spike_n) FILTER (rate >= 0.6) AS lod60, min(spike_n) FILTER (rate >= 0.7) AS lod70 FROM r GROUP BY family")
def g06(spark, sf):
    return bench.detection_limit(status(spark, sf).withColumn("detected", F.col("replicate") > 0), ["family"], (0.6, 0.7))


_RATES = "round(avg(CASE WHEN NOT is_negative THEN {0}::INT END), 6)"


@query("g07_real_world", f"""WITH {SQL_SAMPLES} SELECT family, count(*) FILTER (NOT is_negative)::BIGINT AS n_positive_samples, count(*) FILTER (is_negative)::BIGINT AS n_negative_samples, {_RATES.format('all_expected')} AS all_expected_rate, {_RATES.format('(all_expected AND n_off_target = 0)')} AS clean_rate, {_RATES.format('(all_expected AND n_off_target_raw = 0)')} AS strictly_clean_rate,
 {_RATES.format('(n_expected > 0)')} AS any_expected_rate, {_RATES.format('(n_off_target > 0)')} AS off_target_rate, round(avg(CASE WHEN is_negative THEN (n_positive > 0)::INT END), 6) AS false_positive_rate, {_RATES.format('n_off_target')} AS mean_off_target, {_RATES.format('n_neighbour')} AS mean_neighbour,
 round(median(CASE WHEN NOT is_negative AND n_positive > 0 THEN n_expected::DOUBLE / n_positive END), 6) AS median_precision FROM samples GROUP BY family""")
def g07(spark, sf):
    return bench.real_world(bench.sample_summary(status(spark, sf), flagged(spark, sf)), ["family"])


@query("g08_progress", f"WITH {SQL_STATUS}, s AS (SELECT *, CASE WHEN sample_id % 11 = 0 THEN 'nonzero_exit' WHEN sample_id % 7 = 0 THEN 'missing_calls' ELSE 'ok' END AS st FROM status) SELECT family, panel, st AS status, count(*)::BIGINT AS n, median(runtime) AS median_runtime, max(runtime) AS max_runtime FROM s GROUP BY ALL")
def g08(spark, sf):
    s = status(spark, sf).withColumn("exit_code", F.when(F.col("sample_id") % 11 == 0, 1)).withColumn("has_calls", F.col("sample_id") % 7 != 0)
    return bench.progress(bench.run_status(s))


def _kind(column, flag):
    sql = f"WITH {SQL_FLAGGED} SELECT label, count(DISTINCT sample_id)::BIGINT AS n_samples, median(u)::DOUBLE AS median_unique_kmers, max(s) AS max_positive_sequences, min(array_to_string(targets, ';')) AS example_targets FROM flagged WHERE {column} GROUP BY label"

    @query(f"g09_{flag.removeprefix('is_positive_')}_summary", sql)
    def g09(spark, sf):
        out = bench.off_targets(flagged(spark, sf), flag)
        return out.withColumn("example_targets", F.lower("example_targets"))


for _c, _f in (("ot", "is_positive_off_target"), ("pb", "is_positive_background"), ("pg", "is_positive_neighbour")):
    _kind(_c, _f)


@query("g10_runtimes", f"WITH {SQL_STATUS}, s AS (SELECT family, CASE WHEN replicate = 0 THEN NULL ELSE runtime END AS runtime FROM status) SELECT family, count(*)::BIGINT AS n, count(runtime)::BIGINT AS n_timed, round(sum(runtime), 2) AS total, round(median(runtime), 4) AS median, max(runtime) AS longest FROM s GROUP BY family")
def g10(spark, sf):
    s = status(spark, sf).withColumn("runtime", F.when(F.col("replicate") != 0, F.col("runtime")))
    return bench.runtimes(s, ["family"]).withColumn("total", F.round("total", 2))


SETS = [bench.parse_thresholds(s) for s in ("loose:k1,u5,p1,e2,best51,conf0.1,conflict0.1", "mid:k2,u20,p4,e10,best101,conf0.3,conflict0.08", "tight:k2,u40,p8,e20,best151,conf0.6,conflict0.05")]
SQL_SWEPT = f"""{SQL_FLAGGED}, sets AS (SELECT * FROM (VALUES {', '.join(f"('{s.name}', {s.min_k_values}, {s.min_unique}, {s.min_sequences}, {s.min_exact}, {s.min_best_k}, {s.min_confidence}::DOUBLE, {s.max_conflict}::DOUBLE)" for s in SETS)}) v(threshold_set, a, b, c, d, e2, f2, g2)),
sw0 AS (SELECT flagged.*, threshold_set, p OR (sp AND u >= b AND s >= c AND nk >= a AND bk >= e2 AND ex >= d AND conf >= f2 AND rconf <= g2) AS sp2 FROM flagged, sets),
sw AS (SELECT *, sp2 AND NOT p AS promoted, sp2 AND e AS se, sp2 AND bg AS sb, sp2 AND g AND NOT bg AS sg, sp2 AND NOT e AND NOT bg AND NOT (g AND NOT bg) AS so FROM sw0)"""


@query("g12_sweep", f"WITH {SQL_SWEPT} SELECT threshold_set, label, count(*) FILTER (sp2)::BIGINT AS positive, count(*) FILTER (promoted)::BIGINT AS promoted, count(*) FILTER (so)::BIGINT AS off_target, count(*) FILTER (sg)::BIGINT AS neighbour FROM sw GROUP BY ALL")
def g12(spark, sf):
    n = lambda c: F.sum(F.col(c).cast("long"))
    return bench.sweep(flagged(spark, sf), SETS).groupBy("threshold_set", "label").agg(n("sweep_positive").alias("positive"), n("sweep_promoted").alias("promoted"), n("sweep_off_target").alias("off_target"), n("sweep_neighbour").alias("neighbour"))


@query("g13_sweep_targets", f"""WITH {SQL_SWEPT}, e3 AS (SELECT threshold_set, lower(label) AS target, sample_id, spike_n, is_negative, bool_or(sp2) AS det FROM sw WHERE e GROUP BY ALL), r AS (SELECT threshold_set, target, spike_n, avg(det::INT) AS rate FROM e3 WHERE NOT is_negative AND spike_n > 0 GROUP BY ALL),
l AS (SELECT threshold_set, target, min(spike_n) FILTER (rate >= 0.5) AS lod50, min(spike_n) FILTER (rate >= 0.95) AS lod95, min(spike_n) FILTER (rate >= 1) AS lod100 FROM r GROUP BY ALL),
c AS (SELECT threshold_set, target, count(*) FILTER (det AND NOT is_negative)::BIGINT AS tp, count(*) FILTER (NOT det AND NOT is_negative)::BIGINT AS fn, count(*) FILTER (det AND is_negative)::BIGINT AS fp, count(*) FILTER (NOT det AND is_negative)::BIGINT AS tn FROM e3 GROUP BY ALL) SELECT * FROM c LEFT JOIN l USING (threshold_set, target)""")
def g13(spark, sf):
    return bench.sweep_targets(bench.sweep(flagged(spark, sf), SETS))


SQL_SWEEP_SAMPLES = f"""{SQL_SWEPT}, ss AS (SELECT threshold_set, sample_id, spike_n, is_negative, count(DISTINCT CASE WHEN sp2 THEN label END)::BIGINT AS n_positive, count(DISTINCT CASE WHEN se THEN label END)::BIGINT AS n_expected, count(DISTINCT CASE WHEN so THEN label END)::BIGINT AS n_off_target, count(DISTINCT CASE WHEN sb THEN label END)::BIGINT AS n_background, count(DISTINCT CASE WHEN sg THEN label END)::BIGINT AS n_neighbour FROM sw GROUP BY ALL)"""


@query("g14_sweep_samples", f"WITH {SQL_SWEEP_SAMPLES} SELECT *, n_expected > 0 AND n_off_target = 0 AS clean FROM ss")
def g14(spark, sf):
    return bench.sweep_samples(bench.sweep(flagged(spark, sf), SETS))


_SRATE = "round(avg(CASE WHEN NOT is_negative THEN ({0})::INT END), 6)"
_SWEEP_AGG = f"count(*)::BIGINT AS n_samples, {_SRATE.format('n_expected > 0')} AS any_expected_rate, {_SRATE.format('n_expected > 0 AND n_off_target = 0')} AS clean_rate, {_SRATE.format('n_off_target > 0')} AS off_target_rate, round(avg(CASE WHEN is_negative THEN (n_positive > 0)::INT END), 6) AS false_positive_rate"


@query("g15_sweep_real_world", f"WITH {SQL_SWEEP_SAMPLES} SELECT threshold_set, {_SWEEP_AGG} FROM ss GROUP BY threshold_set")
def g15(spark, sf):
    return bench.sweep_real_world(bench.sweep_samples(bench.sweep(flagged(spark, sf), SETS)))


@query("p3_threshold_sweep", f"WITH {SQL_SWEEP_SAMPLES} SELECT threshold_set, spike_n, {_SWEEP_AGG} FROM ss GROUP BY threshold_set, spike_n")
def p3(spark, sf):
    return bench.sweep_real_world(bench.sweep_samples(bench.sweep(flagged(spark, sf), SETS)), ("threshold_set", "spike_n"))


@query("g17_unpivot", "SELECT o_orderkey AS sample_id, l.label, CASE WHEN l.label = 'a' THEN o_orderstatus ELSE 'NA' END AS call, CASE WHEN l.label = 'a' THEN (o_custkey % 50)::INT ELSE 0 END AS unique_kmers, 0 AS positive_reads, CASE WHEN l.label = 'b' THEN 0.5::DOUBLE ELSE 0 END AS confidence FROM orders, (SELECT unnest(['a', 'b']) AS label) l")
def g17(spark, sf):
    wide = table(spark, sf, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderstatus").alias("t_a_call"), (F.col("o_custkey") % 50).cast("int").alias("t_a_unique_kmers"), F.lit(0.5).alias("t_b_confidence"))
    return bench.unpivot_calls(wide, "t", ["a", "b"], ["sample_id"])


SQL_STATE = "CASE WHEN call IN ('present_high_confidence', 'present_in_mixed_sample') THEN 'positive' WHEN contains(call, 'ambiguous') THEN 'ambiguous' WHEN call IN ('', 'NA', 'not_detected') THEN 'not_detected' ELSE 'other' END"


@query("g18_call_states", f"WITH {SQL_FLAGGED} SELECT {SQL_STATE} AS state, count(*)::BIGINT AS n FROM flagged GROUP BY 1")
def g18(spark, sf):
    return call_rows(spark, sf).groupBy(bench.call_state(F.col("call")).alias("state")).agg(F.count("*").alias("n"))


@query("g19_by_spike", f"""WITH {SQL_FLAGGED}, x AS (SELECT family, spike_n, call, count(*) AS n FROM flagged GROUP BY ALL), t AS (SELECT family, spike_n, string_agg(call || '=' || n, ';' ORDER BY call || '=' || n) AS calls FROM x GROUP BY ALL)
SELECT family, spike_n, count(*)::BIGINT AS n, count(*) FILTER (p)::BIGINT AS n_positive, count(*) FILTER (contains(call, 'ambiguous'))::BIGINT AS n_ambiguous, round(avg(p::INT), 4) AS positive_rate, round(avg(u), 4) AS mean_unique_kmers, round(median(u)::DOUBLE, 4) AS median_unique_kmers, any_value(calls) AS calls FROM flagged JOIN t USING (family, spike_n) GROUP BY family, spike_n""")
def g19(spark, sf):
    return bench.by_spike(call_rows(spark, sf), ["family", "spike_n"])


@query("g20_call_counts", f"WITH {SQL_FLAGGED} SELECT label, nullif(call, 'not_detected') AS call, count(*)::BIGINT AS n FROM flagged GROUP BY ALL")
def g20(spark, sf):
    return bench.call_counts(call_rows(spark, sf).withColumn("call", F.when(F.col("call") != "not_detected", F.col("call"))), ["label", "call"])


@query("g21_run_qc", f"WITH {SQL_STATUS} SELECT family, panel, count(DISTINCT replicate)::BIGINT AS n_replicates, count(DISTINCT spike_n)::BIGINT AS n_levels, count(DISTINCT (spike_n, replicate))::BIGINT AS n_observed, 15::BIGINT AS n_expected, 15 - count(DISTINCT (spike_n, replicate))::BIGINT AS n_missing FROM status GROUP BY ALL")
def g21(spark, sf):
    return bench.run_qc(status(spark, sf), ["family", "panel"], 3, 5)


@query("g23_count_by_column", "SELECT CASE WHEN doc_id % 9 = 0 THEN '<blank>' ELSE lang END AS lang, count(*)::BIGINT AS n_records FROM documents GROUP BY 1")
def g23(spark, sf):
    return bench.count_by(table(spark, sf, "documents").select(F.when(F.col("doc_id") % 9 == 0, " ").otherwise(F.col("lang")).alias("lang")), "lang")


@query("g23_numeric_summary", "SELECT feature, count(value)::BIGINT AS n, count(*) FILTER (value <> 0)::BIGINT AS n_nonzero, round(min(value), 6) AS min, round(avg(value), 6) AS mean, round(max(value), 6) AS max FROM (SELECT 'l_discount' AS feature, l_discount AS value FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem UNION ALL SELECT 'l_quantity', l_quantity FROM lineitem) GROUP BY feature")
def g23_numeric(spark, sf):
    return bench.numeric_summary(table(spark, sf, "lineitem"), ["l_discount", "l_tax", "l_quantity"])


def truth(spark, sf):
    """Event types as organisms of a mock community; one is listed but not expected, one is missing."""
    e = table(spark, sf, "events").select("event_type").distinct().filter("event_type <> 'click'")
    tier = F.when(F.col("event_type").isin("view", "error"), "high").otherwise("low")
    return e.select(F.concat(F.lit("Genus_"), "event_type").alias("organism"), F.array(F.concat(F.lit("Genus_"), "event_type"), F.concat(F.lit("alias "), "event_type")).alias("accepted_names"), F.lit(0.3).alias("fraction"), (F.col("event_type") != "signup").alias("expected"), tier.alias("tier"))


SQL_TRUTH = "truth AS (SELECT DISTINCT 'Genus_' || event_type AS organism, event_type <> 'signup' AS expected, CASE WHEN event_type IN ('view', 'error') THEN 'high' ELSE 'low' END AS tier FROM events WHERE event_type <> 'click')"
SQL_MOCK = f"""{SQL_HITS}, m AS (SELECT sample_id, species_name AS label, count(*) AS n_hits, count(DISTINCT matched_kmer) AS u, count(DISTINCT sequence_id) AS s, max(k) AS bk, count(*) FILTER (mismatches = 0) AS ex, count(*) FILTER (mismatches > 0) AS fz FROM hits GROUP BY ALL),
mock AS (SELECT *, CASE WHEN u % 3 = 0 THEN 'present_low_confidence' WHEN u % 3 = 1 THEN 'present_high_confidence' ELSE 'not_detected' END AS call, u % 3 = 1 AS rep FROM m), {SQL_TRUTH}, j AS (SELECT mock.*, organism, expected, tier FROM mock LEFT JOIN truth ON organism = label)"""


def mock_rows(spark, sf):
    h = hits(spark, sf).groupBy("sample_id", F.col("species_name").alias("label")).agg(F.count("*").alias("n_hits"), F.count_distinct("matched_kmer").alias("n_unique_kmers"), F.count_distinct("sequence_id").alias("n_positive_sequences"), F.max("k").alias("best_k"), F.sum((F.col("mismatches") == 0).cast("long")).alias("n_exact_hits"), F.sum((F.col("mismatches") > 0).cast("long")).alias("n_fuzzy_hits"))
    return h.withColumn("call", _pick(("present_low_confidence", "present_high_confidence", "not_detected"), F.col("n_unique_kmers")))


@query("g25_truth_issues", "WITH t AS (SELECT count(DISTINCT event_type) AS n FROM events WHERE event_type <> 'click') SELECT 'fractions_exceed_one' AS issue, (round(0.3::DOUBLE * n, 6))::VARCHAR AS subject FROM t WHERE 0.3 * n > 1 UNION ALL SELECT DISTINCT 'duplicate_organism', 'Genus_view' FROM t")
def g25(spark, sf):
    t = truth(spark, sf)
    # The repeated organism has no share of its own.
    return bench.truth_issues(t.union(t.filter("organism = 'Genus_view'").withColumn("fraction", F.lit(0.0))))


@query("g26_mock_truth_category", f"""WITH {SQL_MOCK} SELECT sample_id, label, CASE WHEN coalesce(expected, false) THEN 'expected' WHEN organism IS NOT NULL THEN 'listed' ELSE 'off_target' END || '_' || CASE WHEN rep THEN 'reportable' WHEN call = 'present_low_confidence' THEN 'below_threshold' ELSE 'evidence_only' END AS category,
 CASE WHEN coalesce(expected, false) AND rep THEN 'true_positive' WHEN coalesce(expected, false) THEN 'false_negative' WHEN rep THEN 'false_positive' ELSE 'true_negative' END AS coarse FROM j""")
def g26(spark, sf):
    return bench.truth_category(mock_rows(spark, sf), truth(spark, sf)).select("sample_id", "label", "category", "coarse")


@query("g28_predicates", f"WITH {SQL_MOCK} SELECT call, true AS has_evidence, rep AS reportable, call = 'present_low_confidence' AS below, count(*)::BIGINT AS n FROM mock GROUP BY ALL")
def g28(spark, sf):
    return mock_rows(spark, sf).groupBy("call", bench.has_evidence().alias("has_evidence"), bench.reportable().alias("reportable"), bench.below().alias("below")).agg(F.count("*").alias("n"))


@query("g29_mock_samples", f"""WITH {SQL_MOCK}, n AS (SELECT count(*) AS n_truth FROM truth WHERE expected), a AS (SELECT sample_id, count(DISTINCT CASE WHEN expected THEN organism END)::BIGINT AS n_raw, count(DISTINCT CASE WHEN expected AND rep THEN organism END)::BIGINT AS n_reported, count(DISTINCT CASE WHEN rep AND organism IS NULL THEN label END)::BIGINT AS n_off_target, max(CASE WHEN rep AND organism IS NULL THEN label END) AS strongest_off_target FROM j GROUP BY 1)
SELECT a.*, n_truth, round(n_reported::DOUBLE / n_truth, 6) AS recall, round(CASE WHEN n_reported + n_off_target > 0 THEN n_reported::DOUBLE / (n_reported + n_off_target) END, 6) AS precision, n_reported = n_truth AND n_off_target = 0 AS strictly_clean FROM a, n""")
def g29(spark, sf):
    return bench.mock_samples(mock_rows(spark, sf), truth(spark, sf))


@query("g30_tier_recall", f"""WITH {SQL_MOCK}, t AS (SELECT tier, count(*) AS n_tier FROM truth WHERE expected GROUP BY 1), h AS (SELECT sample_id, tier, count(DISTINCT organism) AS n FROM j WHERE expected AND rep GROUP BY ALL)
SELECT s.sample_id, t.tier, n_tier, coalesce(n, 0) AS n_found, round(coalesce(n, 0)::DOUBLE / n_tier, 6) AS recall FROM (SELECT DISTINCT sample_id FROM mock) s CROSS JOIN t LEFT JOIN h ON h.sample_id = s.sample_id AND h.tier = t.tier""")
def g30(spark, sf):
    return bench.tier_recall(mock_rows(spark, sf), truth(spark, sf))


@query("g31_depth_subsets", "WITH d AS (SELECT doc_id, ('0x' || substr(sha256('1001:' || doc_id || ':' || source), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS draw FROM documents), f AS (SELECT unnest([0.01::DOUBLE, 0.05, 0.1, 0.25]) AS fraction) SELECT fraction, doc_id FROM d, f WHERE draw < fraction")
def g31(spark, sf):
    d = table(spark, sf, "documents")
    return bench.depth_subsets(d, seq.unit_draw_sha(F.col("source"), F.col("doc_id"), 1001), [0.01, 0.05, 0.1, 0.25]).select("fraction", "doc_id")


@query("g32_reference_audit", """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'gcf_' || p_partkey || '.1' END AS accession, CASE WHEN p_partkey % 6 = 0 THEN '' ELSE sha256(p_name) END AS checksum, p_brand AS species FROM part),
t AS (SELECT 'GCF_' || p_partkey AS a, sha256(p_name || p_brand) AS c, lower(p_brand) AS s FROM part WHERE p_partkey % 50 = 1)
SELECT p_partkey, CASE WHEN split_part(upper(accession), '.', 1) IN (SELECT a FROM t) OR checksum IN (SELECT c FROM t) THEN 'leakage' WHEN accession = '' AND checksum = '' THEN 'incomplete' WHEN lower(species) IN (SELECT s FROM t) THEN 'same_species_reference' ELSE 'clear' END AS status FROM p""")
def g32(spark, sf):
    part = table(spark, sf, "part")
    i = F.col("p_partkey")
    p = part.select("p_partkey", F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("gcf_"), "p_partkey", F.lit(".1"))).alias("accession"), F.when(i % 6 == 0, "").otherwise(F.sha2("p_name", 256)).alias("checksum"), F.col("p_brand").alias("species"))
    t = part.filter("p_partkey % 50 = 1").select(F.concat(F.lit("GCF_"), "p_partkey").alias("accession"), F.sha2(F.concat("p_name", "p_brand"), 256).alias("checksum"), F.col("p_brand").alias("species"))
    return bench.reference_audit(p, t).select("p_partkey", "status")


SQL_ASM = """asm AS (SELECT p_partkey, 'GCA_' || p_partkey || '.2' AS accession, p_brand AS species, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS species_taxid, p_name AS taxid, ['Complete Genome', 'Chromosome', 'Scaffold', 'Contig'][(p_partkey % 4 + 1)::INT] AS level, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE 'ftp/' || p_partkey END AS path,
 p_retailprice::BIGINT AS total_length, p_size * 1000 AS scaffold_n50, p_size * 500 AS contig_n50 FROM part)"""


def assemblies(spark, sf):
    p, i = table(spark, sf, "part"), F.col("p_partkey")
    return p.select("p_partkey", F.concat(F.lit("GCA_"), "p_partkey", F.lit(".2")).alias("accession"), F.col("p_brand").alias("species"), F.when(i % 3 == 0, "").otherwise(F.col("p_brand")).alias("species_taxid"), F.col("p_name").alias("taxid"), _pick(("Complete Genome", "Chromosome", "Scaffold", "Contig"), i).alias("level"), F.when(i % 13 == 0, "").otherwise(F.concat(F.lit("ftp/"), "p_partkey")).alias("path"), F.round("p_retailprice").cast("long").alias("total_length"), (F.col("p_size") * 1000).alias("scaffold_n50"), (F.col("p_size") * 500).alias("contig_n50"))


@query("g33_reference_config", """WITH r AS (SELECT p_partkey, 'GCA_' || (p_partkey % 700) AS k, ['target', 'near_neighbour', 'outgroup'][(p_partkey % 3 + 1)::INT] AS role, p_brand AS species, 'f/' || p_partkey AS path FROM part), p AS (SELECT *, CASE role WHEN 'target' THEN 0 WHEN 'near_neighbour' THEN 1 ELSE 2 END AS pr FROM r),
o AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY k ORDER BY pr, species, path) = 1), q AS (SELECT *, row_number() OVER (PARTITION BY pr, CASE WHEN pr = 0 THEN species ELSE lower(species) END ORDER BY k) AS n FROM o) SELECT p_partkey, role, species FROM q WHERE n <= CASE pr WHEN 0 THEN 5 WHEN 1 THEN 7 ELSE 1000000 END""")
def g33(spark, sf):
    i = F.col("p_partkey")
    r = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("gca_"), (i % 700).cast("string"), F.lit(".1")).alias("accession"), _pick(("target", "near_neighbour", "outgroup"), i).alias("role"), F.col("p_brand").alias("species"), F.concat(F.lit("f/"), "p_partkey").alias("path"))
    return bench.reference_config(r, 5, 7).select("p_partkey", "role", "species")


_GATE = """au AS (SELECT p_brand AS matched_truth_species, CASE WHEN p_partkey % 9 = 0 THEN 'missing' ELSE 'present' END AS fasta_status, CASE WHEN p_partkey % 31 = 0 THEN 'leakage' WHEN p_partkey % 2 = 0 THEN 'same_species_reference' ELSE 'clear' END AS audit_status FROM part),
tr AS (SELECT DISTINCT p_brand AS species_name FROM part UNION SELECT 'Never seen'),
co AS (SELECT species_name, (SELECT count(*) FROM au WHERE matched_truth_species = species_name AND audit_status = 'same_species_reference') AS n FROM tr)"""


def _gate(spark, sf):
    part, i = table(spark, sf, "part"), F.col("p_partkey")
    audit = part.select(F.col("p_brand").alias("matched_truth_species"), F.when(i % 9 == 0, "missing").otherwise("present").alias("fasta_status"), F.when(i % 31 == 0, "leakage").when(i % 2 == 0, "same_species_reference").otherwise("clear").alias("audit_status"))
    truth = part.select(F.col("p_brand").alias("species_name")).union(spark.range(1).select(F.lit("Never seen"))).distinct().withColumn("taxid", F.lit("1"))
    return bench.reference_gate(audit, truth, 3)


@query("g33_gate_coverage", f"WITH {_GATE} SELECT species_name, n::BIGINT AS reference_count, CASE WHEN n >= 3 THEN 'represented' ELSE 'missing' END AS panel_status FROM co")
def g33_coverage(spark, sf):
    return _gate(spark, sf)[0].drop("taxid")


@query("g33_gate_summary", f"""WITH {_GATE}, c AS (SELECT count(*) AS e, count(*) FILTER (n >= 3) AS r, min(n) AS least FROM co), a AS (SELECT count(*) FILTER (audit_status = 'leakage') AS l, count(*) FILTER (fasta_status <> 'present') AS i FROM au)
SELECT 'expected_species' AS metric, e::VARCHAR AS value FROM c UNION ALL SELECT 'represented_species', r::VARCHAR FROM c UNION ALL SELECT 'missing_species', (e - r)::VARCHAR FROM c UNION ALL SELECT 'leakage_rows', l::VARCHAR FROM a UNION ALL SELECT 'incomplete_fasta_rows', i::VARCHAR FROM a
UNION ALL SELECT 'minimum_references_per_species', least::VARCHAR FROM c UNION ALL SELECT 'required_references_per_species', '3' UNION ALL SELECT 'gate_status', CASE WHEN e = r AND l = 0 AND i = 0 AND least >= 3 THEN 'PASS' ELSE 'BLOCKED' END FROM c, a""")
def g33_summary(spark, sf):
    return _gate(spark, sf)[1]


@query("g33_taxid_plan", """SELECT DISTINCT 'S_' || lang || '_' || source AS taxid, 'target_species' AS role, 'target_' || lang || '_' || source AS group_label, 5 AS max_assemblies, 5 AS best_per_species FROM documents
UNION ALL SELECT DISTINCT 'G_' || lang, 'near_neighbour', 'genus_' || lang, 25, 1 FROM documents""")
def g33_plan(spark, sf):
    from .q_panel import tree

    d = table(spark, sf, "documents").select(F.concat_ws("_", "lang", "source").alias("species_name"), F.concat_ws("_", F.lit("S"), "lang", "source").alias("taxid")).distinct()
    return bench.taxid_plan(d, taxonomy.index(tree(spark, sf))).drop("clade")


@query("g34_assembly_filter", f"""WITH {SQL_ASM} SELECT p_partkey, CASE WHEN level = 'Contig' THEN 'assembly_level' WHEN path = '' THEN 'missing_path' WHEN total_length < 950 THEN 'total_length_below_minimum' WHEN scaffold_n50 < 10000 THEN 'scaffold_n50' WHEN contig_n50 < 6000 THEN 'contig_n50' WHEN p_partkey % 17 = 0 THEN 'excluded_accession' ELSE '' END AS reason FROM (SELECT * REPLACE (round(p2.p_retailprice)::BIGINT AS total_length) FROM asm JOIN (SELECT p_partkey AS pk, p_retailprice FROM part) p2 ON pk = p_partkey)""")
def g34(spark, sf):
    a = assemblies(spark, sf)
    out = bench.assembly_reasons(a, ("complete genome", "chromosome", "scaffold"), 10_000, 6_000, 950, excluded=a.filter("p_partkey % 17 = 0").select("accession"))
    return out.select("p_partkey", "reason")


@query("g35_best_assemblies", f"""WITH {SQL_ASM}, r AS (SELECT *, row_number() OVER (PARTITION BY coalesce(nullif(species_taxid, ''), nullif(species, ''), taxid) ORDER BY CASE level WHEN 'Complete Genome' THEN 1 WHEN 'Chromosome' THEN 2 WHEN 'Scaffold' THEN 3 ELSE 4 END, scaffold_n50 DESC, contig_n50 DESC, total_length DESC, accession DESC)::INT AS place FROM asm) SELECT p_partkey, place FROM r WHERE place <= 3""")
def g35(spark, sf):
    return bench.best_assemblies(assemblies(spark, sf), 3).select("p_partkey", "place")


@query("g36_source_preference", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'gcf/' || p_partkey WHEN p_partkey % 3 = 0 THEN 'gca/' || p_partkey ELSE '' END AS path FROM part")
def g36(spark, sf):
    i = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", bench.choose_path(F.when(i % 2 == 0, F.concat(F.lit("gcf/"), "p_partkey")).otherwise(""), F.when(i % 3 == 0, F.concat(F.lit("gca/"), "p_partkey"))).alias("path"))


@query("g37_group_metrics", "SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS mean_l_quantity, round(median(l_quantity), 6) AS median_l_quantity, round(avg(l_tax), 6) AS mean_l_tax, round(median(l_tax), 6) AS median_l_tax FROM lineitem GROUP BY ALL")
def g37(spark, sf):
    return bench.group_metrics(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_tax"])


_CALLS = ("present", "Observed_below_threshold", "not_detected", "odd_lineage", "x_detected", "reportable_y", "absent", "")
_ROLES = ("near_neighbour", "outgroup", "", "host")
SQL_COMMUNITY = f"""e AS (SELECT *, lower({list(_CALLS)}[(event_id % 8 + 1)::INT]) AS call, {list(_ROLES)}[(event_id // 8 % 4 + 1)::INT] AS role, event_id % 3 = 0 AS bare, event_id % 5 = 1 AS xref, event_type = 'click' AS xsp, event_id % 7 > 0 AS hit FROM events),
k AS (SELECT *, call IN ('present', 'x_detected', 'reportable_y') AS shown, call IN ('observed_below_threshold', 'odd_lineage') AS under FROM e),
r AS (SELECT CASE WHEN xref AND shown THEN 'expected_reference_label' WHEN xsp AND bare AND shown THEN 'expected_species' WHEN xsp AND NOT bare AND hit THEN 'same_species_compatible_reference' WHEN shown AND NOT xsp THEN 'true_off_target_reportable'
 WHEN hit AND (role = 'near_neighbour' OR under) THEN 'near_neighbour_evidence' WHEN hit AND role = 'outgroup' THEN 'non_target_background_evidence' WHEN hit THEN 'unresolved_non_target_evidence' ELSE 'not_detected' END AS category FROM k)"""


@query("g27_community_category", f"""WITH {SQL_COMMUNITY} SELECT category, CASE WHEN category LIKE 'expected%' THEN 'expected_target' WHEN category = 'true_off_target_reportable' THEN 'reportable_off_target_species' WHEN category LIKE '%evidence' THEN 'observed_below_threshold' ELSE category END AS report_label, count(*)::BIGINT AS n FROM r GROUP BY ALL""")
def g27(spark, sf):
    e, i = table(spark, sf, "events"), F.col("event_id")
    zero = F.lit(0)
    rows = e.select(
        _pick(_CALLS, i).alias("call"), _pick(_ROLES, F.floor(i / 8)).alias("role"), F.when(i % 3 == 0, " ").otherwise("r").alias("reference_label"), (i % 5 == 1).alias("expected_reference"), (F.col("event_type") == "click").alias("expected_species"),
        (i % 7).alias("n_hits"), zero.alias("n_unique_kmers"), zero.alias("n_positive_sequences"), zero.alias("n_exact_hits"), zero.alias("n_fuzzy_hits"),
    )
    return bench.community_category(rows).groupBy("category", "report_label").agg(F.count("*").alias("n"))


@query("g22_authoritative_table", "SELECT o_orderkey AS sample_id, o_custkey AS n_positive_reads, o_custkey AS n_positive_sequences FROM orders")
def g22(spark, sf):
    calls = table(spark, sf, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("n_positive_reads"))
    return bench.authoritative(calls, calls.limit(0))
