"""Queries of calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibrate, evidence
from ..scratch import scratch_path
from .fixtures import table
from .q_screen import _ODD, SQL_EVIDENCE, calls, sql_calls
from .registry import ORACLES, query

def features(spark, sf):
    """Embeddings in long form: id, label, feature, value."""
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"), F.posexplode("embedding").alias("feature", "value")).withColumn("value", F.col("value").cast("double"))


SQL_LONG = "long AS (SELECT vec_id AS id, label::VARCHAR AS label, i::INT AS feature, embedding[i + 1]::DOUBLE AS value FROM (SELECT *, unnest(range(len(embedding))) AS i FROM embeddings))"
SQL_Z = f"{SQL_LONG}, sc AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM long GROUP BY 1), z AS (SELECT id, label, l.feature, (value - m) / s AS z FROM long l JOIN sc USING (feature))"
SQL_MODEL = f"""{SQL_Z}, cen AS (SELECT label, feature, avg(z) AS c FROM z GROUP BY 1, 2), far AS (SELECT z.label, id, sqrt(sum((z - c) ** 2)) AS d FROM z JOIN cen ON z.label = cen.label AND z.feature = cen.feature GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d) AS r, count(*) OVER (PARTITION BY label) AS n FROM far), thr AS (SELECT label, d AS threshold FROM rk WHERE r = greatest(1, ceil(0.95::DOUBLE * n - 1e-9)))"""
SQL_PRED = f"""{SQL_MODEL}, ds AS (SELECT id, cen.label AS l, sqrt(sum((z - c) ** 2)) AS d FROM z JOIN cen ON z.feature = cen.feature GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, l) AS r FROM ds),
pred AS (SELECT a.id, a.l AS best_label, a.d AS b, s.l AS second_label, s.d AS s, threshold AS t FROM o a LEFT JOIN o s ON a.id = s.id AND s.r = 2 JOIN thr ON thr.label = a.l WHERE a.r = 1)"""


@query("f01_numeric_columns", "SELECT unnest(['c_acctbal', 'c_custkey', 'c_nationkey']) AS feature")
def f01(spark, sf):
    found = calibrate.numeric_columns(table(spark, sf, "customer"))
    return spark.createDataFrame([(c,) for c in found], "feature string")


@query("f02_scaling", f"WITH {SQL_LONG} SELECT feature, round(avg(value), 6) AS mean, round(CASE WHEN stddev_pop(value) > 0 THEN stddev_pop(value) ELSE 1 END, 6) AS std FROM long GROUP BY 1")
def f02(spark, sf):
    return calibrate.scaling(features(spark, sf)).select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("f03_standardised_norm", f"WITH {SQL_Z} SELECT id, round(sqrt(sum(z * z)), 5) AS norm FROM z GROUP BY id")
def f03(spark, sf):
    f = features(spark, sf)
    return calibrate.standardise(f, calibrate.scaling(f)).groupBy("id").agg(F.round(F.sqrt(F.sum(F.col("z") ** 2)), 5).alias("norm"))


@query("f04_nearest_rank", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, value AS quantile FROM r WHERE r = greatest(1, ceil(0.95::DOUBLE * n - 1e-9))")
def f04(spark, sf):
    return calibrate.nearest_rank(table(spark, sf, "events").filter("value is not null"), ["event_type"], "value", 0.95)


@query("f05_train_classifier", f"WITH {SQL_MODEL} SELECT cen.label, feature, round(c, 5) AS centre, round(threshold, 5) AS threshold FROM cen JOIN thr ON cen.label = thr.label")
def f05(spark, sf):
    _, centroids, thresholds = calibrate.train(features(spark, sf))
    return centroids.join(thresholds, "label").select("label", "feature", F.round("centre", 5).alias("centre"), F.round("threshold", 5).alias("threshold"))


@query("f06_open_set_predict", f"WITH {SQL_PRED} SELECT id, CASE WHEN b <= t THEN best_label ELSE 'unknown_or_unresolved' END AS prediction, best_label, second_label, round(round(b, 6) + 1e-9, 4) AS best_distance, round(round(s - b, 6) + 1e-9, 4) AS margin, round(round(1 / (1 + b / t), 6) + 1e-9, 4) AS confidence FROM pred")
def f06(spark, sf):
    f = features(spark, sf)
    return shown(calibrate.predict(f, *calibrate.train(f)))


def shown(p):
    return p.select("id", "prediction", "best_label", "second_label", F.round(F.col("best_distance") + 1e-9, 4).alias("best_distance"), F.round(F.col("distance_margin") + 1e-9, 4).alias("margin"), F.round(F.col("ml_confidence_score") + 1e-9, 4).alias("confidence"))


def labelled(spark, sf):
    c = evidence.consolidate(calls(spark, sf, _ODD), background=["Genus_click"])
    c = c.withColumn("is_positive_expected", (F.col("species_name") == "Genus_view") & (F.col("call") == "present_in_mixed_sample")).withColumn("is_positive_off_target", F.col("call") == "present_high_confidence")
    return c.withColumn("label", calibrate.report_label(c))


_F8 = """CASE WHEN is_bg AND ok THEN 'background_candidate_signal' WHEN down THEN 'neighbour_lineage_evidence' WHEN exp THEN 'expected_target' WHEN is_bg THEN 'background_candidate_signal' WHEN off THEN 'reportable_off_target_species' WHEN ncall = 'observed_below_threshold' THEN 'observed_below_threshold' ELSE 'not_detected' END"""
SQL_LABELLED = f"""{SQL_EVIDENCE}, {sql_calls(_ODD)}, g AS (SELECT *, call IN ('present_high_confidence', 'present_in_mixed_sample') AS ok, species_name = 'Genus_click' AS is_bg FROM calls),
p AS (SELECT sample_id, first(species_name ORDER BY n_unique_kmers DESC, n_positive_sequences DESC, best_k DESC, species_name) AS ps, first(n_unique_kmers ORDER BY n_unique_kmers DESC, n_positive_sequences DESC, best_k DESC, species_name) AS pu FROM g WHERE ok GROUP BY 1),
q AS (SELECT g.*, ok AND NOT is_bg AND ps <> species_name AND pu - n_unique_kmers >= 25 AND pu::DOUBLE / n_unique_kmers >= 2 AS down FROM g LEFT JOIN p USING (sample_id)),
n AS (SELECT *, CASE WHEN is_bg AND ok THEN 'background_candidate_signal' WHEN down THEN 'neighbour_lineage_evidence' ELSE call END AS ncall FROM q),
lab AS (SELECT *, {_F8} AS label FROM (SELECT *, species_name = 'Genus_view' AND ncall = 'present_in_mixed_sample' AS exp, ncall = 'present_high_confidence' AS off FROM n))"""


@query("f08_report_label", f"WITH {SQL_LABELLED} SELECT sample_id, species_name, label FROM lab")
def f08(spark, sf):
    return labelled(spark, sf).select("sample_id", "species_name", "label")


@query("f09_call_features", f"""WITH {SQL_EVIDENCE}, {sql_calls(_ODD)} SELECT sample_id, species_name, round(ln(1 + n_hits), 6) AS log1p_n_hits, (best_k >= 101)::INT::DOUBLE AS has_long_k_support, round(n_exact_hits::DOUBLE / n_hits, 6) AS exact_hit_fraction, round(n_fuzzy_hits::DOUBLE / n_hits, 6) AS fuzzy_hit_fraction,
round(n_positive_sequences::DOUBLE / n_unique_kmers, 6) AS positive_sequences_per_unique_kmer, round(conflicting_unique_kmers::DOUBLE / (n_unique_kmers + conflicting_unique_kmers), 6) AS conflicting_unique_kmer_fraction FROM calls""")
def f09(spark, sf):
    f = calibrate.call_features(calls(spark, sf, _ODD))
    r = lambda c: F.round(c, 6).alias(c)
    return f.select("sample_id", "species_name", r("log1p_n_hits"), "has_long_k_support", *map(r, ("exact_hit_fraction", "fuzzy_hit_fraction", "positive_sequences_per_unique_kmer", "conflicting_unique_kmer_fraction")))


@query("f10_training_table", f"WITH {SQL_LABELLED}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sample_id, species_name) AS r FROM lab) SELECT sample_id, species_name, label FROM r WHERE label <> 'not_detected' OR r <= 20")
def f10(spark, sf):
    return calibrate.cap_not_detected(labelled(spark, sf).select("sample_id", "species_name", "label"), "label", ["sample_id", "species_name"], most=20)


@query("f11_scope_pivot", "SELECT user_id % 50 AS sample_id, coalesce(max(CASE WHEN event_type = 'click' THEN value END), 0)::DOUBLE AS lca_click_value, coalesce(max(CASE WHEN event_type = 'view' THEN value END), 0)::DOUBLE AS lca_view_value FROM events GROUP BY 1")
def f11(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 50).alias("sample_id"), F.col("event_type").alias("scope"), "value")
    return calibrate.pivot_scopes(e, ["click", "view"], ["value"])


SQL_PROFILES = """raw AS (SELECT ['n_hits', 'n_unique_kmers', 'n_positive_sequences', 'n_k_values_positive', 'best_k', 'n_exact_hits', 'n_fuzzy_hits', 'conflicting_unique_kmers', 'conflict_ratio', 'reportable_conflicting_unique_kmers', 'reportable_conflict_ratio',
  'mixed_species_support_fraction', 'confidence_score', 'signal_confidence_score', 'spike_n', 'spike_n_per_genome', 'total_spike_n'] AS r, ['has_long_k_support', 'has_multi_k_support', 'exact_hit_fraction'] AS b,
  ['positive_sequences_per_unique_kmer', 'unique_kmers_per_positive_sequence', 'exact_hits_per_unique_kmer', 'fuzzy_hit_fraction', 'conflicting_unique_kmer_fraction', 'reportable_conflicting_unique_kmer_fraction'] AS q),
safe AS (SELECT *, list_filter(r, lambda x: NOT contains(x, 'spike')) AS s FROM raw), t AS (SELECT *, list_concat(list_transform(s, lambda x: CASE WHEN (starts_with(x, 'n_') AND x <> 'n_k_values_positive') OR x = 'best_k' OR ends_with(x, 'conflicting_unique_kmers') THEN 'log1p_' || x ELSE x END), b, q) AS t FROM safe),
p AS (SELECT 'legacy' AS profile, list_concat(r, b) AS f FROM t UNION ALL SELECT 'safe_raw', list_concat(s, b) FROM t UNION ALL SELECT 'safe_transformed', t FROM t UNION ALL SELECT 'safe_transformed_bounded', list_filter(t, lambda x: NOT contains(x, '_per_')) FROM t),
profiles AS (SELECT profile, i::INT AS place, f[i + 1] AS feature FROM (SELECT *, unnest(range(len(f))) AS i FROM p))"""


_SHOWN = {
    "has_long_k_support": "best_k >= 101", "has_multi_k_support": "n_k_values_positive >= 2", "exact_hit_fraction": "n_hits > 0 AND n_exact_hits > 0", "fuzzy_hit_fraction": "n_hits > 0 AND n_fuzzy_hits > 0",
    "positive_sequences_per_unique_kmer": "n_unique_kmers > 0 AND n_positive_sequences > 0", "unique_kmers_per_positive_sequence": "n_unique_kmers > 0 AND n_positive_sequences > 0", "exact_hits_per_unique_kmer": "n_unique_kmers > 0 AND n_exact_hits > 0",
    "conflicting_unique_kmer_fraction": "conflicting_unique_kmers > 0", "reportable_conflicting_unique_kmer_fraction": "reportable_conflicting_unique_kmers > 0",
}


def _sql_shown(feature: str) -> str:
    """When a call's feature is above 0."""
    return _SHOWN.get(feature, "false" if "spike" in feature else f"{feature.removeprefix('log1p_')} > 0")


_FEATURES = sorted({c for cols in calibrate.feature_profiles().values() for c in cols})


@query("f12_feature_profiles", f"""WITH {SQL_EVIDENCE}, {sql_calls(_ODD)}, {SQL_PROFILES}, shown AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) FILTER ({_sql_shown(c)})::BIGINT AS n_shown FROM calls" for c in _FEATURES)})
SELECT profile, place, feature, n_shown FROM profiles JOIN shown USING (feature)""")
def f12(spark, sf):
    """Each profile's features in order, and how many calls have them above 0."""
    f = calibrate.call_features(calls(spark, sf, _ODD))
    shown = f.agg(*(F.count(F.when(F.col(c) > 0, 1)).alias(c) for c in _FEATURES))
    shown = shown.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("n_shown")) for c in _FEATURES))).alias("x")).select("x.*")
    rows = [(p, i, c) for p, cols in calibrate.feature_profiles().items() for i, c in enumerate(cols)]
    return spark.createDataFrame(rows, "profile string, place int, feature string").join(shown, "feature")


@query("f13_hash_split", "SELECT o_custkey, (('0x' || substr(sha256(o_custkey || '|' || o_orderpriority), 1, 12))::BIGINT % 10000) < 2000 AS is_test, count(*)::BIGINT AS n FROM orders GROUP BY ALL")
def f13(spark, sf):
    return calibrate.hash_split(table(spark, sf, "orders"), ["o_custkey", "o_orderpriority"]).groupBy("o_custkey", "is_test").agg(F.count("*").alias("n"))


@query("f14_leave_one_out", """WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'missing' ELSE o_orderpriority END AS p, o_orderstatus AS s FROM orders), h AS (SELECT DISTINCT p AS held FROM v WHERE p <> 'missing')
SELECT 'priority_' || replace(held, ' ', '_') AS split, held AS holdout_value, count(*) FILTER (p <> held)::BIGINT AS n_train, count(*) FILTER (p = held)::BIGINT AS n_test, count(DISTINCT s) FILTER (p <> held)::BIGINT AS n_train_labels, count(DISTINCT s) FILTER (p = held)::BIGINT AS n_test_labels, '' AS skip_reason FROM v, h GROUP BY ALL""")
def f14(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 9 == 0, " ").otherwise(F.col("o_orderpriority")).alias("priority"), F.col("o_orderstatus").alias("label"))
    return calibrate.design_summary(o, calibrate.leave_one_out(o, "priority", "priority")).drop("holdout_column")


_DESIGN_ROWS = """d AS (SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN '' ELSE 's' || (doc_id % 40) END AS sample_id, CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE 'family ' || (doc_id % 3) END AS benchmark_family, source AS panel,
 CASE WHEN doc_id = 1 THEN 'single/one' ELSE lang END AS species_name, CASE WHEN doc_id = 1 THEN '' WHEN lang = 'en' AND doc_id % 2 = 0 THEN 'expected_target' WHEN doc_id % 5 = 0 THEN '' ELSE 'label ' || (n_chars % 3) END AS label FROM documents)"""


def _sql_held(column: str, prefix: str) -> str:
    return f"SELECT id, replace(replace('{prefix}_' || trim({column}), ' ', '_'), '/', '_') AS split, '{column}' AS holdout_column, trim({column}) AS holdout_value FROM d WHERE trim({column}) <> ''"


@query("f14_validation_designs", f"""WITH {_DESIGN_ROWS},
h AS (SELECT id, 'sample_group_hash_20pct' AS split, 'sample_id_hash' AS holdout_column, 'sample_group_hash_20pct' AS holdout_value FROM d WHERE ('0x' || substr(sha256(CASE WHEN sample_id = '' THEN 'missing' ELSE sample_id END), 1, 12))::BIGINT % 10000 < 2000
 UNION ALL {" UNION ALL ".join(_sql_held(c, p) for c, p in calibrate.HOLDOUTS)}
 UNION ALL SELECT * FROM ({_sql_held("species_name", "leave_one_expected_target_species")}) WHERE holdout_value IN (SELECT species_name FROM d WHERE label = 'expected_target')),
s AS (SELECT DISTINCT split, holdout_column, holdout_value FROM h),
x AS (SELECT s.*, d.label, h.id IS NOT NULL AS test FROM s CROSS JOIN d LEFT JOIN h ON h.split = s.split AND h.id = d.id),
n AS (SELECT split, holdout_column, holdout_value, count(*) FILTER (NOT test)::BIGINT AS n_train, count(*) FILTER (test)::BIGINT AS n_test, count(DISTINCT label) FILTER (NOT test AND label <> '')::BIGINT AS n_train_labels, count(DISTINCT label) FILTER (test AND label <> '')::BIGINT AS n_test_labels FROM x GROUP BY ALL)
SELECT *, CASE WHEN n_train = 0 THEN 'no_training_records' WHEN n_train_labels < 2 THEN 'fewer_than_two_training_labels' WHEN n_test_labels = 0 THEN 'no_test_labels' ELSE '' END AS skip_reason FROM n""")
def f14_designs(spark, sf):
    i, lang = F.col("doc_id"), F.col("lang")
    rows = table(spark, sf, "documents").select(
        i.alias("id"), F.when(i % 10 == 0, "").otherwise(F.concat(F.lit("s"), (i % 40).cast("string"))).alias("sample_id"), F.when(i % 7 == 0, " ").otherwise(F.concat(F.lit("family "), (i % 3).cast("string"))).alias("benchmark_family"), F.col("source").alias("panel"),
        F.when(i == 1, "single/one").otherwise(lang).alias("species_name"), F.when(i == 1, "").when((lang == "en") & (i % 2 == 0), "expected_target").when(i % 5 == 0, "").otherwise(F.concat(F.lit("label "), (F.col("n_chars") % 3).cast("string"))).alias("label"),
    )
    return calibrate.design_summary(rows, calibrate.validation_designs(rows))


SQL_CV = f"""{SQL_LONG}, sp AS (SELECT s::INT AS split, id, id % 3 = s AS is_test FROM (SELECT DISTINCT id FROM long), range(3) t(s)), tr AS (SELECT split, l.* FROM sp JOIN long l USING (id) WHERE NOT is_test),
sc AS (SELECT split, feature, avg(value) AS m, stddev_pop(value) AS s FROM tr GROUP BY 1, 2), z AS (SELECT tr.split, id, label, tr.feature, (value - m) / s AS z FROM tr JOIN sc ON sc.split = tr.split AND sc.feature = tr.feature),
cen AS (SELECT split, label, feature, avg(z) AS c FROM z GROUP BY ALL), far AS (SELECT z.split, z.label, id, sqrt(sum((z - c) ** 2)) AS d FROM z JOIN cen ON z.split = cen.split AND z.label = cen.label AND z.feature = cen.feature GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY split, label ORDER BY d) AS r, count(*) OVER (PARTITION BY split, label) AS n FROM far), thr AS (SELECT split, label, d AS t FROM rk WHERE r = greatest(1, ceil(0.95::DOUBLE * n - 1e-9))),
te AS (SELECT sp.split, l.id, l.label, l.feature, (value - m) / s AS z FROM sp JOIN long l USING (id) JOIN sc ON sc.split = sp.split AND sc.feature = l.feature WHERE is_test),
ds AS (SELECT te.split, id, any_value(te.label) AS truth, cen.label AS l, sqrt(sum((z - c) ** 2)) AS d FROM te JOIN cen ON cen.split = te.split AND cen.feature = te.feature GROUP BY te.split, id, cen.label),
o AS (SELECT *, row_number() OVER (PARTITION BY split, id ORDER BY d, l) AS r FROM ds), pr AS (SELECT o.split, id, truth, CASE WHEN d <= t THEN l ELSE 'unknown_or_unresolved' END AS p FROM o JOIN thr ON thr.split = o.split AND thr.label = o.l WHERE r = 1),
lb AS (SELECT DISTINCT split, truth AS label FROM pr UNION SELECT DISTINCT split, p FROM pr)"""


@query("f15_holdout_validation", f"""WITH {SQL_CV} SELECT lb.split, lb.label, count(*) FILTER (truth = lb.label AND p = lb.label)::BIGINT AS tp, count(*) FILTER (truth <> lb.label AND p = lb.label)::BIGINT AS fp, count(*) FILTER (truth = lb.label AND p <> lb.label)::BIGINT AS fn FROM lb JOIN pr ON pr.split = lb.split GROUP BY ALL
UNION ALL SELECT split, 'overall', count(*) FILTER (truth = p), count(*) FILTER (truth <> p), count(*) FILTER (truth <> p) FROM pr GROUP BY split""")
def f15(spark, sf):
    f = features(spark, sf)
    held = f.select("id").distinct().withColumn("split", (F.col("id") % 3).cast("int"))
    return calibrate.validate(f, held).select("split", "label", "tp", "fp", "fn")


SQL_METRICS = """m AS (SELECT quality::VARCHAR AS t, toxic::VARCHAR AS p FROM labels), l AS (SELECT t AS label FROM m UNION SELECT p FROM m),
c AS (SELECT label, count(*) FILTER (t = label AND p = label)::BIGINT AS tp, count(*) FILTER (t <> label AND p = label)::BIGINT AS fp, count(*) FILTER (t = label AND p <> label)::BIGINT AS fn FROM l, m GROUP BY label)"""


@query("f16_metrics", f"""WITH {SQL_METRICS} SELECT label, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM c
UNION ALL SELECT 'overall', count(*) FILTER (t = p), count(*) FILTER (t <> p), count(*) FILTER (t <> p), NULL, NULL, round(count(*) FILTER (t = p)::DOUBLE / count(*), 6) FROM m""")
def f16(spark, sf):
    lab = table(spark, sf, "labels").select(F.col("quality").cast("string").alias("label"), F.col("toxic").cast("string").alias("prediction"))
    return calibrate.metrics(lab)


@query("f17_label_counts", "SELECT quality::VARCHAR AS label, count(*)::BIGINT AS n FROM labels WHERE quality = 1 GROUP BY 1")
def f17(spark, sf):
    return table(spark, sf, "labels").filter("quality = 1").groupBy(F.col("quality").cast("string").alias("label")).agg(F.count("*").alias("n"))


@query("f18_novelty_curve", f"""WITH {SQL_PRED}, g AS (SELECT s.s AS scale, round(b, 6) <= round(t, 6) * s.s AS known, best_label = l.label AS hit FROM pred JOIN (SELECT DISTINCT id, label FROM long) l USING (id), (SELECT unnest([0.5::DOUBLE, 0.8, 1.0, 2.9]) AS s) s)
SELECT scale, count(*)::BIGINT AS n, count(*) FILTER (known)::BIGINT AS n_known, count(*) FILTER (known AND hit)::BIGINT AS n_right FROM g GROUP BY scale""")
def f18(spark, sf):
    f = features(spark, sf)
    return calibrate.novelty_curve(f, calibrate.train(f), [0.5, 0.8, 1.0, 2.9]).select("scale", "n", "n_known", "n_right")


@query("f19_feature_audit", f"""WITH {SQL_PROFILES} SELECT DISTINCT feature, lower(feature) IN ('spike_n', 'spike_n_per_genome', 'total_spike_n') AS is_design, regexp_matches(lower(feature), 'expected|truth|target|label') AS is_truth, starts_with(lower(feature), 'lca_') AS is_lca FROM profiles""")
def f19(spark, sf):
    return calibrate.audit_features(f12(spark, sf).select("feature").distinct())


@query("f07_model_round_trip", ORACLES["f06_open_set_predict"])
def f07(spark, sf):
    """Predictions of a model that was written and read again."""
    f, path = features(spark, sf), scratch_path(spark, "model")
    calibrate.save_model(calibrate.train(f), path)
    return shown(calibrate.predict(f, *calibrate.load_model(spark, path)))


SQL_SCOPES = "sc AS (SELECT 's' || (user_id % 50) AS sample_id, coalesce(max(CASE WHEN event_type = 'click' THEN value END), 0)::DOUBLE AS x FROM events WHERE user_id % 3 = 0 GROUP BY 1)"


@query("g24_postprocess", f"""WITH {SQL_LABELLED}, {SQL_SCOPES} SELECT label, count(*)::BIGINT AS n, round(avg(coalesce(x, 0)), 6) AS lca_mean, round(avg(ln(1 + n_hits)), 6) AS hits_mean FROM lab LEFT JOIN sc USING (sample_id) GROUP BY label""")
def g24(spark, sf):
    """The training table, and the label's centres in the model that it gives, scaled back."""
    e = table(spark, sf, "events").filter("user_id % 3 = 0").select(F.concat(F.lit("s"), (F.col("user_id") % 50).cast("string")).alias("sample_id"), F.col("event_type").alias("scope"), "value")
    rows, (scales, centroids, _) = calibrate.postprocess(labelled(spark, sf).drop("label"), e, ["click"], ["value"])
    back = centroids.join(scales, "feature").withColumn("mean", F.round(F.col("centre") * F.col("std") + F.col("mean"), 6))
    of = lambda f: F.max(F.when(F.col("feature") == f, F.col("mean")))
    return rows.groupBy("label").agg(F.count("*").alias("n")).join(back.groupBy("label").agg(of("lca_click_value").alias("lca_mean"), of("log1p_n_hits").alias("hits_mean")), "label")

