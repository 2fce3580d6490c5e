"""Rank selection and held-out validation against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import calibrate


@pytest.mark.parametrize("q", [0.0, 0.3, 0.95, 1.0])
def test_ranks_of_any_values(spark, monkeypatch, q):
    monkeypatch.setattr(calibrate, "BINS", 4)
    r = random.Random(2)
    groups = {
        "one": [3.5], "equal": [2.0] * 50, "ties": [float(r.randrange(4)) for _ in range(200)], "wide": [r.choice([-1, 1]) * 10.0 ** r.randint(-300, 300) for _ in range(150)], "odd": [1.7e308, -1.7e308, 0.0],
        "tiny": [0.0, 5e-324, 1e-323, 5e-324], "plain": [r.random() for _ in range(333)], None: [r.gauss(0, 1) for _ in range(40)],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in [*vs, None]], "g string, v double")
    got = {x.g: x.quantile for x in calibrate.nearest_rank(df, ["g"], "v", q).collect()}
    assert got == {g: sorted(vs)[max(1, math.ceil(q * len(vs) - 1e-9)) - 1] for g, vs in groups.items()}
    every = sorted(v for vs in groups.values() for v in vs)
    assert [x.quantile for x in calibrate.nearest_rank(df, [], "v", q).collect()] == [every[max(1, math.ceil(q * len(every) - 1e-9)) - 1]]
    assert calibrate.nearest_rank(df.limit(0), ["g"], "v", q).count() == calibrate.nearest_rank(df.limit(0), [], "v", q).count() == 0


def test_cap_of_rows_not_detected(spark):
    df = spark.createDataFrame([(i, "not_detected" if i % 2 else "x" if i % 4 else None) for i in range(20)], "i int, label string")
    got = {r.i for r in calibrate.cap_not_detected(df, "label", ["i"], most=3).collect()}
    assert got == {1, 3, 5, *range(0, 20, 2)}


def plain_metrics(rows, held, q, novelty):
    """rows: id -> (label, vector); held: split -> ids. Trained on all other rows, without any shortcut."""
    out = {}
    for split, ids in held.items():
        train = {i: r for i, r in rows.items() if i not in ids}
        x = np.array([v for _, v in train.values()])
        mean, std = x.mean(0), x.std(0)
        std = np.where(std > 0, std, 1)
        z = {i: (np.array(v) - mean) / std for i, (_, v) in rows.items()}
        labels = sorted({t for t, _ in train.values()})
        centre = {t: np.mean([z[i] for i, (u, _) in train.items() if u == t], 0) for t in labels}
        limit = {}
        for t in labels:
            d = sorted(float(np.linalg.norm(z[i] - centre[t])) for i, (u, _) in train.items() if u == t)
            limit[t] = max(d[max(1, math.ceil(q * len(d) - 1e-9)) - 1], 1e-9) * novelty
        for i in ids:
            d, t = min((float(np.linalg.norm(z[i] - centre[t])), t) for t in labels)
            p = t if d <= limit[t] else "unknown_or_unresolved"
            for side in {rows[i][0], p}:
                c = out.setdefault((split, side), [0, 0, 0])
                c[0] += p == rows[i][0] == side
                c[1] += p == side != rows[i][0]
                c[2] += rows[i][0] == side != p
    return {k: tuple(v) for k, v in out.items()}


def test_validation_by_subtraction(spark):
    r = random.Random(4)
    rows = {i: (f"t{i % 3}", [1e6 + r.gauss(i % 3, 1.2), r.gauss(0, 1) * 1e-3, 7.0, r.gauss(-(i % 3), 1)]) for i in range(90)}
    held = {"a": {i for i in rows if i % 5 == 0}, "b": {i for i in rows if i % 3 == 1}, "c": {3}, "d": {i for i in rows if i < 60}}
    long = spark.createDataFrame([(i, t, f"f{j}", v) for i, (t, vs) in rows.items() for j, v in enumerate(vs)], "id int, label string, feature string, value double")
    splits = spark.createDataFrame([(i, s) for s, ids in held.items() for i in ids], "id int, split string")
    got = {(x.split, x.label): (x.tp, x.fp, x.fn) for x in calibrate.validate(long, splits, 0.9, 1.1).filter("label <> 'overall'").collect()}
    assert got == plain_metrics(rows, held, 0.9, 1.1)


def test_designs_and_reasons_to_skip(spark):
    fields = ("id", "sample_id", "benchmark_family", "panel", "species_name", "label")
    rows = [(1, "s1", "f", "p", "a b", "expected_target"), (2, "s2", "f", "p", "c", ""), (3, "s3", "f", "q", "c", None), (4, "", "f", "q", " ", "other")]
    df = spark.createDataFrame(rows, "id int, sample_id string, benchmark_family string, panel string, species_name string, label string")
    held = calibrate.validation_designs(df)
    assert {(x.split, x.id) for x in held.collect() if not x.split.startswith("sample")} == {
        *(("leave_one_benchmark_family_f", i) for i in (1, 2, 3, 4)), ("leave_one_panel_p", 1), ("leave_one_panel_p", 2), ("leave_one_panel_q", 3), ("leave_one_panel_q", 4),
        ("leave_one_species_a_b", 1), ("leave_one_species_c", 2), ("leave_one_species_c", 3), ("leave_one_expected_target_species_a_b", 1),
    }
    got = {x.split: (x.n_train, x.n_test, x.n_train_labels, x.n_test_labels, x.skip_reason) for x in calibrate.design_summary(df, held).collect()}
    assert got["leave_one_benchmark_family_f"] == (0, 4, 0, 2, "no_training_records")
    assert got["leave_one_panel_p"] == (2, 2, 1, 1, "fewer_than_two_training_labels")
    assert got["leave_one_species_c"] == (2, 2, 2, 0, "no_test_labels")
    assert set(fields) == set(df.columns)
