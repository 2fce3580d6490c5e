"""Calibration: scaling, an open-set nearest-centroid classifier, call features, leakage-aware splits, metrics.

Feature rows are (id, label, feature, value) in long form for training, or arrays for prediction; both avoid
Python. Models are small tables, one row per label.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names, scores, seq
from ..scratch import broadcast_if_small, materialise

# The columns of call features, in order.
RAW = (
    "n_hits", "n_unique_kmers", "n_positive_sequences", "n_k_values_positive", "best_k", "n_exact_hits", "n_fuzzy_hits", "conflicting_unique_kmers", "conflict_ratio",
    "reportable_conflicting_unique_kmers", "reportable_conflict_ratio", "mixed_species_support_fraction", "confidence_score", "signal_confidence_score", "spike_n", "spike_n_per_genome", "total_spike_n",
)
LEAKY = ("spike_n", "spike_n_per_genome", "total_spike_n")
BINARY = ("has_long_k_support", "has_multi_k_support", "exact_hit_fraction")
LOGGED = ("n_hits", "n_unique_kmers", "n_positive_sequences", "best_k", "n_exact_hits", "n_fuzzy_hits", "conflicting_unique_kmers", "reportable_conflicting_unique_kmers")
RATIOS = ("positive_sequences_per_unique_kmer", "unique_kmers_per_positive_sequence", "exact_hits_per_unique_kmer", "fuzzy_hit_fraction", "conflicting_unique_kmer_fraction", "reportable_conflicting_unique_kmer_fraction")
UNBOUNDED = ("positive_sequences_per_unique_kmer", "unique_kmers_per_positive_sequence", "exact_hits_per_unique_kmer")


def feature_profiles() -> dict[str, tuple[str, ...]]:
    safe = tuple(c for c in RAW if c not in LEAKY)
    transformed = (*(f"log1p_{c}" if c in LOGGED else c for c in safe), *BINARY, *RATIOS)
    return {"legacy": (*RAW, *BINARY), "safe_raw": (*safe, *BINARY), "safe_transformed": transformed, "safe_transformed_bounded": tuple(c for c in transformed if c not in UNBOUNDED)}


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Columns of which every non-blank value is a number, by one aggregation; sorted."""
    cols = [c for c in df.columns if c not in exclude]
    bad = df.agg(*(F.max((F.trim(F.col(c).cast("string")).cast("string") != "") & F.expr(f"try_cast(`{c}` as double)").isNull()).alias(c) for c in cols)).first()
    return sorted(c for c in cols if not bad[c])


def call_features(calls: DataFrame) -> DataFrame:
    """Raw, binary, logarithmic and ratio features; missing columns and values count as 0."""
    num = lambda c: F.coalesce(F.expr(f"try_cast(`{c}` as double)"), F.lit(0.0)) if c in calls.columns else F.lit(0.0)
    v = {c: num(c) for c in RAW}
    div = scores.divide_or_zero
    extra = {
        "has_long_k_support": (v["best_k"] >= 101).cast("double"), "has_multi_k_support": (v["n_k_values_positive"] >= 2).cast("double"), "exact_hit_fraction": F.when(v["n_hits"] > 0, v["n_exact_hits"] / v["n_hits"]).otherwise(0.0),
        "positive_sequences_per_unique_kmer": div(v["n_positive_sequences"], v["n_unique_kmers"]), "unique_kmers_per_positive_sequence": div(v["n_unique_kmers"], v["n_positive_sequences"]),
        "exact_hits_per_unique_kmer": div(v["n_exact_hits"], v["n_unique_kmers"]), "fuzzy_hit_fraction": div(v["n_fuzzy_hits"], v["n_hits"]),
        "conflicting_unique_kmer_fraction": div(v["conflicting_unique_kmers"], v["n_unique_kmers"] + v["conflicting_unique_kmers"]),
        "reportable_conflicting_unique_kmer_fraction": div(v["reportable_conflicting_unique_kmers"], v["n_unique_kmers"] + v["reportable_conflicting_unique_kmers"]),
    }
    logs = {f"log1p_{c}": F.log1p(F.greatest(v[c], F.lit(0.0))) for c in LOGGED}
    keep = [c for c in calls.columns if c not in RAW]
    return calls.select(*keep, *(e.alias(c) for c, e in (v | extra | logs).items()))


def truthy(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))).isin("1", "true", "t", "yes", "y")


def report_label(calls: DataFrame) -> Column:
    """The training label of a call row: report layer first, then flags, then the call's own text."""
    has = calls.columns
    flag = lambda c: truthy(F.col(c)) if c in has else F.lit(False)
    text = lambda c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) if c in has else F.lit("")
    layer = text("report_layer")
    return (
        F.when(layer.isin("background_candidate_signal", "background_candidate", "empirical_background_signal"), "background_candidate_signal").when(layer.isin("neighbour_lineage_evidence", "neighbor_lineage_evidence"), "neighbour_lineage_evidence")
        .when(flag("is_positive_expected"), "expected_target").when(flag("is_background_candidate"), "background_candidate_signal").when(flag("is_neighbour_lineage"), "neighbour_lineage_evidence").when(flag("is_positive_off_target"), "reportable_off_target_species")
        .when(flag("is_positive_call") | text("call").isin("present", "species_detected", "detected", "positive"), "positive_unclassified").when(text("call").isin("observed_below_threshold", "low_evidence"), "observed_below_threshold").otherwise("not_detected")
    )


def cap_not_detected(rows: DataFrame, label_col: str, order: Sequence[str], keep: bool = True, most: int | None = None) -> DataFrame:
    """Training rows without, or with at most ``most``, rows labelled not_detected, in the stated order."""
    if not keep:
        return rows.filter(F.col(label_col) != "not_detected")
    if most is None:
        return rows
    none = F.col(label_col).eqNullSafe(F.lit("not_detected"))
    return rows.filter(~none).unionByName(rows.filter(none).orderBy(*order).limit(most))  # each task keeps its first ``most``


def pivot_scopes(rows: DataFrame, scopes: Sequence[str], values: Sequence[str], key: str = "sample_id") -> DataFrame:
    """Features per scope side by side (lca_<scope>_<value>), missing ones 0; the scopes are given, so no extra pass finds them."""
    aggs = [F.coalesce(F.max(F.when(F.col("scope") == s, F.col(v))), F.lit(0)).cast("double").alias(f"lca_{s}_{v}") for s in scopes for v in values]
    return rows.groupBy(key).agg(*aggs)


def scaling(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population standard deviation per feature; a deviation of 0 counts as 1."""
    sd = F.stddev_pop("value")
    return long.groupBy(*by, "feature").agg(F.avg("value").alias("mean"), F.when(sd > 0, sd).otherwise(1.0).alias("std"))


def standardise(long: DataFrame, scales: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return long.join(scales, [*by, "feature"]).withColumn("z", (F.col("value") - F.col("mean")) / F.col("std")).drop("mean", "std")


#: Parts into which a round of the rank search cuts each group's range of values.
BINS = 4096


def nearest_rank(values: DataFrame, by: Sequence[str], col: str, q: float) -> DataFrame:
    """Value at rank ceil(q n), at least 1, per group; null values don't count. Exact, without ordering a group.

    Rounds: each group's values between its bounds are counted in BINS parts of equal width, and the part that holds the rank gives the
    next bounds, as the least and greatest of its values. The group's two bounds lie in different parts, so rounds end when they are equal, after
    five or so for any spread of doubles. A task keeps counts only; the bounds are one row per group.
    """
    keys = [f"_g{i}" for i in range(len(by))]
    rows = materialise(values.select(*(F.col(c).alias(k) for c, k in zip(by, keys)), F.col(col).cast("double").alias("_v")).filter("_v is not null"), "values")
    rank = F.greatest(F.lit(1), F.ceil(F.lit(q) * F.count("*") - 1e-9)).cast("long")
    bounds = rows.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), rank.alias("_rank"))
    bounds = materialise(bounds if keys else bounds.filter("_lo is not null"), "bounds")
    done, turn = bounds.filter("_lo = _hi"), 0
    same = lambda left, right: reduce(and_, (F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys), F.lit(True))
    open_ = bounds.filter("_lo < _hi")
    while not open_.isEmpty():
        turn += 1
        wide = rows.alias("r").join(broadcast_if_small(open_).alias("b"), same("r", "b")).filter("_v between _lo and _hi")
        # Halves are taken first, so that the width of any two finite bounds is finite.
        part = F.coalesce(F.floor(F.try_divide(F.col("_v") / 2 - F.col("_lo") / 2, F.col("_hi") / 2 - F.col("_lo") / 2) * BINS), F.lit(0))
        part = F.when(F.col("_v") == F.col("_lo"), 0).when(F.col("_v") == F.col("_hi"), BINS - 1).otherwise(F.least(part, F.lit(BINS - 1))).cast("int")
        parts = wide.select(*(F.col(f"b.{k}").alias(k) for k in keys), "_rank", part.alias("_part"), "_v").groupBy(*keys, "_rank", "_part").agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part"))  # BINS rows a group
        hit = parts.withColumn("_upto", upto).filter((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_n") < F.col("_rank")))
        bounds = materialise(hit.select(*keys, "_lo", "_hi", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank")), f"bounds-{turn}")
        done, open_ = done.unionByName(bounds.filter("_lo = _hi")), bounds.filter("_lo < _hi")
    return done.select(*(F.col(k).alias(c) for c, k in zip(by, keys)), F.col("_lo").cast(values.schema[col].dataType).alias("quantile"))


def postprocess(calls: DataFrame, scopes_of: DataFrame, scopes: Sequence[str], values: Sequence[str], ids: Sequence[str] = ("sample_id", "species_name"), profile: str = "safe_transformed", q: float = 0.95) -> tuple[DataFrame, tuple[DataFrame, DataFrame, DataFrame]]:
    """From a benchmark's calls and its ancestors by sample and scope: the training table and the model trained on it.

    A row has its ids, label, the profile's features and those of its sample's scopes (0 where a sample has none).
    """
    rows = call_features(calls.withColumn("label", report_label(calls))).join(pivot_scopes(scopes_of, scopes, values), "sample_id", "left")
    features = [*feature_profiles()[profile], *(f"lca_{s}_{v}" for s in scopes for v in values)]
    table = rows.select(*ids, "label", *(F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in features))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in features))).alias("x")
    long = table.select(F.concat_ws("|", *ids).alias("id"), "label", pairs).select("id", "label", "x.*")
    return table, train(long, q)


MODEL = ("scales", "centroids", "thresholds")


def train(long: DataFrame, q: float = 0.95, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scales, centroids, thresholds) from (id, label, feature, value); blank labels don't count. ``by``: split columns, all trained at once."""
    rows = long.filter(F.trim("label") != "")
    scales = scaling(rows, by)
    z = standardise(rows, scales, by)
    centroids = z.groupBy(*by, "label", "feature").agg(F.avg("z").alias("centre"))
    far = z.join(centroids, [*by, "label", "feature"]).groupBy(*by, "label", "id").agg(F.sqrt(F.sum((F.col("z") - F.col("centre")) ** 2)).alias("distance"))
    thresholds = nearest_rank(far, [*by, "label"], "distance", q).withColumn("threshold", F.greatest("quantile", F.lit(1e-9))).drop("quantile")
    return scales, centroids, thresholds


def save_model(model: tuple[DataFrame, DataFrame, DataFrame], path: str) -> None:
    """Scales, centroids and thresholds as Parquet tables of one folder."""
    for name, part in zip(MODEL, model):
        part.write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{name}") for name in MODEL)


def predict(long: DataFrame, scales: DataFrame, centroids: DataFrame, thresholds: DataFrame, novelty: float = 1.0, unknown: str = "unknown_or_unresolved", by: Sequence[str] = ()) -> DataFrame:
    """Per id the nearest label if within its threshold, with distances, margin and confidence. The model's tables are one row per label
    and feature, which adaptive execution broadcasts where they are small; ties go to the smaller label."""
    z = standardise(long, scales, by)
    d = z.join(centroids.withColumnRenamed("label", "to"), [*by, "feature"]).groupBy(*by, "id", "to").agg(F.sqrt(F.sum((F.col("z") - F.col("centre")) ** 2)).alias("d"))
    ranked = d.groupBy(*by, "id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "to"))), 1, 2).alias("r"))
    best, second = F.col("r")[0], F.try_element_at("r", F.lit(2))
    out = ranked.select(*by, "id", best["to"].alias("best_label"), best["d"].alias("_b"), second["to"].alias("second_label"), second["d"].alias("_s"))
    out = out.join(thresholds.withColumnRenamed("label", "best_label"), [*by, "best_label"]).withColumn("_t", F.col("threshold") * novelty)
    known = F.col("_b") <= F.col("_t")
    return out.select(
        *by, "id", F.when(known, F.col("best_label")).otherwise(unknown).alias("prediction"), "best_label", F.round("_b", 6).alias("best_distance"), F.round("_t", 6).alias("best_threshold"), "second_label", F.round("_s", 6).alias("second_distance"),
        F.round(F.coalesce(F.col("_s") - F.col("_b"), F.col("_b")), 6).alias("distance_margin"), F.when(known, "known_like").otherwise("unknown_or_unresolved").alias("open_set_status"), F.round(1 / (1 + F.col("_b") / F.col("_t")), 6).alias("ml_confidence_score"),
    )


def hash_split(rows: DataFrame, groups: Sequence[str], test_fraction: float = 0.2) -> DataFrame:
    """``is_test`` by a stable hash of the group columns, so that a group never lies on both sides."""
    return rows.withColumn("is_test", seq.group_bucket(*(F.col(c) for c in groups)) < int(test_fraction * 10_000))


#: Designs that hold out one value of a column after the other.
HOLDOUTS = (("benchmark_family", "leave_one_benchmark_family"), ("panel", "leave_one_panel"), ("species_name", "leave_one_species"))


def _safe(column: str) -> Column:
    return F.coalesce(names.blank(F.trim(F.col(column).cast("string"))), F.lit("missing"))


def leave_one_out(rows: DataFrame, column: str, prefix: str, id_col: str = "id") -> DataFrame:
    """id, split, holdout_column, holdout_value: each row once, in the split that holds its value out. Blank values are never held out.

    A split's training rows are all others, so only what is held out is listed.
    """
    value = _safe(column)
    split = F.regexp_replace(F.concat(F.lit(f"{prefix}_"), value), "[ /]", "_")
    return rows.filter(value != "missing").select(F.col(id_col).alias("id"), split.alias("split"), F.lit(column).alias("holdout_column"), value.alias("holdout_value"))


def validation_designs(rows: DataFrame, id_col: str = "id", label_col: str = "label", sample_col: str = "sample_id", test_fraction: float = 0.2) -> DataFrame:
    """Held-out rows of the five designs: a fifth of the samples by hash, then each family, panel, species, and species with an expected target."""
    sample = rows.withColumn("_s", _safe(sample_col)).filter(seq.group_bucket(F.col("_s")) < int(test_fraction * 10_000))
    name = f"sample_group_hash_{round(test_fraction * 100)}pct"
    out = sample.select(F.col(id_col).alias("id"), F.lit(name).alias("split"), F.lit("sample_id_hash").alias("holdout_column"), F.lit(name).alias("holdout_value"))
    for column, prefix in HOLDOUTS:
        out = out.unionByName(leave_one_out(rows, column, prefix, id_col))
    wanted = rows.filter(F.col(label_col) == "expected_target").select(_safe("species_name").alias("_v")).distinct()
    own = leave_one_out(rows, "species_name", "leave_one_expected_target_species", id_col)
    return out.unionByName(own.join(wanted, F.col("holdout_value") == F.col("_v"), "left_semi"))


def design_summary(rows: DataFrame, held: DataFrame, id_col: str = "id", label_col: str = "label") -> DataFrame:
    """Per split: split, holdout_column, holdout_value, n_train, n_test, n_train_labels, n_test_labels and skip_reason (blank: valid).

    Counted by subtraction: what a split holds out is taken off the totals per label, and no training row is listed.
    """
    label = names.blank(F.col(label_col))
    own = rows.select(F.col(id_col).alias("id"), label.alias("label"))
    total = own.groupBy("label").agg(F.count("*").alias("all"))
    sums = total.agg(F.coalesce(F.sum("all"), F.lit(0)).alias("n_rows"), F.count("label").alias("n_labels"))
    parts = held.join(own, "id").groupBy("split", "holdout_column", "holdout_value", "label").agg(F.count("*").alias("n"))
    parts = parts.join(total, parts["label"].eqNullSafe(total["label"])).select("split", "holdout_column", "holdout_value", parts["label"], "n", "all")
    gone = F.count(F.when((F.col("n") == F.col("all")) & F.col("label").isNotNull(), 1))
    per = parts.groupBy("split", "holdout_column", "holdout_value").agg(F.sum("n").alias("n_test"), F.count("label").alias("n_test_labels"), gone.alias("_gone"))
    per = per.crossJoin(F.broadcast(sums))  # one row
    per = per.withColumn("n_train", F.col("n_rows") - F.col("n_test")).withColumn("n_train_labels", F.col("n_labels") - F.col("_gone"))
    reason = F.when(F.col("n_train") == 0, "no_training_records").when(F.col("n_test") == 0, "no_test_records").when(F.col("n_train_labels") < 2, "fewer_than_two_training_labels").when(F.col("n_test_labels") == 0, "no_test_labels").otherwise("")
    return per.select("split", "holdout_column", "holdout_value", "n_train", "n_test", "n_train_labels", "n_test_labels", reason.alias("skip_reason"))


def metrics(predictions: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Per label tp, fp, fn, precision, recall and f1 (0 where undefined), and a row ``overall`` whose f1 is the accuracy."""
    pairs = predictions.groupBy(*by, F.col(label).alias("t"), F.col(prediction).alias("p")).agg(F.count("*").alias("n"))
    sides = pairs.select(*by, F.explode(F.array_distinct(F.array("t", "p"))).alias("label"), "t", "p", "n")
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    same, is_t, is_p = F.col("t") == F.col("p"), F.col("label") == F.col("t"), F.col("label") == F.col("p")
    per = sides.groupBy(*by, "label").agg(n(same).alias("tp"), n(is_p & ~same).alias("fp"), n(is_t & ~same).alias("fn"))
    div = scores.divide_or_zero
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    per = per.select(*by, "label", "tp", "fp", "fn", F.round(div(tp, tp + fp), 6).alias("precision"), F.round(div(tp, tp + fn), 6).alias("recall"), F.round(div(2 * tp, 2 * tp + fp + fn), 6).alias("f1"))
    hit, total = n(same), F.sum("n")
    overall = pairs.groupBy(*by).agg(hit.alias("tp"), (total - hit).alias("fp"), (total - hit).alias("fn"), F.round(div(hit, total), 6).alias("f1"))
    return per.unionByName(overall.select(*by, F.lit("overall").alias("label"), "tp", "fp", "fn", F.lit(None).cast("double").alias("precision"), F.lit(None).cast("double").alias("recall"), "f1"))


def validate(long: DataFrame, held: DataFrame, q: float = 0.95, novelty: float = 1.0) -> DataFrame:
    """Metrics per split of (id, label, feature, value); ``held`` has the rows (id, split) that each split holds out, and trains on all others.

    Scales and centres of a split are the totals less what it holds out (numbers, sums and sums of squares per label and feature, of values that were
    standardised over all rows, so that little is lost by subtraction). Only distances, which differ in every split, are made per split and row, from
    one array of values a row.
    """
    long = long.filter(F.trim("label") != "").select("id", "label", "feature", "value")
    base = scaling(long)
    z = materialise(standardise(long, base).select("id", "label", "feature", F.col("z").alias("v")), "standardised")
    held = materialise(held.select("id", "split").distinct(), "held")
    add = lambda by: (F.count("*").alias(f"{by}n"), F.sum("v").alias(f"{by}s"), F.sum(F.col("v") ** 2).alias(f"{by}q"))
    total = materialise(z.groupBy("label", "feature").agg(*add("a")), "totals")
    mine = held.join(z, "id").groupBy("split", "label", "feature").agg(*add("h"))
    splits = held.select("split").distinct()
    less = splits.join(total).join(mine, ["split", "label", "feature"], "left")  # one row a split, label and feature
    left = {c: F.col(f"a{c}") - F.coalesce(F.col(f"h{c}"), F.lit(0)) for c in "nsq"}
    less = materialise(less.select("split", "label", "feature", *(e.alias(c) for c, e in left.items())).filter("n > 0"), "training-sums")
    mean, square = F.sum("s") / F.sum("n"), F.sum("q") / F.sum("n")
    sd = F.sqrt(F.greatest(square - mean**2, F.lit(0.0)))
    scale = less.groupBy("split", "feature").agg(mean.alias("mean"), F.when(sd > 1e-9, sd).otherwise(1.0).alias("std"))
    model = less.join(scale, ["split", "feature"]).select("split", "label", "feature", (F.col("s") / F.col("n")).alias("centre"), "std")
    features = [r[0] for r in z.select("feature").distinct().orderBy("feature").collect()]  # as many as the model has
    array = lambda c: F.transform(F.array(*map(F.lit, features)), lambda f: F.try_element_at(F.map_from_entries(F.collect_list(F.struct("feature", c))), f))
    model = materialise(model.groupBy("split", "label").agg(array("centre").alias("centre"), array("std").alias("std")), "models")
    rows = materialise(z.groupBy("id", "label").agg(array("v").alias("v")), "rows")
    terms = F.zip_with(F.zip_with("v", "centre", lambda a, b: a - b), "std", lambda d, s: (d / s) ** 2)
    apart = F.sqrt(F.aggregate(terms, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))))
    far = rows.join(model, "label").join(held, ["id", "split"], "left_anti").select("split", "label", apart.alias("distance"))
    thresholds = nearest_rank(far, ["split", "label"], "distance", q).select("split", F.col("label").alias("to"), (F.greatest("quantile", F.lit(1e-9)) * novelty).alias("_t"))
    near = held.join(rows, "id").join(model.withColumnRenamed("label", "to"), "split").select("split", "id", "label", "to", apart.alias("_d"))
    best = near.groupBy("split", "id", "label").agg(F.min(F.struct("_d", "to")).alias("x")).select("split", "id", "label", "x._d", "x.to")
    found = best.join(thresholds, ["split", "to"]).withColumn("prediction", F.when(F.col("_d") <= F.col("_t"), F.col("to")).otherwise("unknown_or_unresolved"))
    return metrics(found, by=("split",))


def novelty_curve(long: DataFrame, model: tuple[DataFrame, DataFrame, DataFrame], scales: Sequence[float]) -> DataFrame:
    """Share of known-like rows and accuracy per novelty scale; distances are computed once."""
    found = predict(long, *model).join(long.select("id", "label").distinct(), "id")
    grid = found.withColumn("scale", F.explode(F.array(*(F.lit(float(s)) for s in scales))))
    known = F.col("best_distance") <= F.col("best_threshold") * F.col("scale")
    right = known & (F.col("best_label") == F.col("label"))
    return grid.groupBy("scale").agg(F.count("*").alias("n"), F.sum(known.cast("long")).alias("n_known"), F.sum(right.cast("long")).alias("n_right"), F.round(F.sum(right.cast("long")) / F.count("*"), 6).alias("recall"), F.round(scores.divide_or_zero(F.sum(right.cast("long")), F.sum(known.cast("long"))), 6).alias("precision"))


def audit_features(names: DataFrame) -> DataFrame:
    """Flags of feature names (column ``feature``) that reveal the experiment's design or truth."""
    f = F.lower("feature")
    return names.select("feature", f.isin(*LEAKY).alias("is_design"), (f.contains("expected") | f.contains("truth") | f.contains("target") | f.contains("label")).alias("is_truth"), f.startswith("lca_").alias("is_lca"))
