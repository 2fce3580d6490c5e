"""Outputs of many runs: folders of all layouts, tables of all kinds of damage."""

from pyspark.sql import functions as F

from strandloom.sources import runs


def test_outputs_are_located_and_judged(spark, tmp_path):
    table = "species_name\tn\nA\t1\nB\t2\n"
    files = {
        "samples/f/a/calls.tsv": table, "samples/f/v2_b/calls.tsv": "n\tspecies_name\r\n7\tX\r\n", "f/c/calls.tsv": "species_name\tn\n", "samples/d/calls.tsv": "", "e/calls.tsv": "odd\n", "samples/f/x_run1_mix_n1/calls.tsv": table,
        "samples/f/x_run1_mix_n10/calls.tsv": "species_name\tn\textra\nC\t3\tz\n", "samples/g/a/calls.tsv": "species_name\tn\n" + "Z\t9\n" * 3, "samples/f/h/other.txt": "x",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    rows = [("a", "f", "", "", 0), ("v1_b", "f", "", "", None), ("c", "f", "", "", 0), ("d", "f", "", "", 0), ("e", "f", None, None, 0), ("m1", "f", "mix_n1", "run1", 0), ("m10", "f", "mix_n10", "run1", 2), ("a2", "g", "a", "", 0), ("h", "f", "", "", 0), ("gone", "f", "", "", 0)]
    manifest = spark.createDataFrame(rows, "sample_id string, benchmark_family string, source_relative_dir string, run_name string, exit_code int")
    root = f"file://{tmp_path}"
    resolved = runs.resolve_outputs(manifest, runs.find_outputs(spark, root), old_prefix="v1_")
    calls = runs.read_calls(spark, root, ("species_name", "n"), "calls.tsv")
    got = {r.sample_id: (r.folder, r.status, r.n_calls) for r in runs.run_outcomes(resolved, calls).collect()}
    assert got == {
        "a": ("samples/f/a", "ok", 2), "v1_b": ("samples/f/v2_b", "ok", 1), "c": ("f/c", "ok", 0), "d": (None, "missing", 0), "e": ("e", "damaged", 0), "m1": ("samples/f/x_run1_mix_n1", "ok", 2),
        "m10": ("samples/f/x_run1_mix_n10", "failed", 1), "a2": ("samples/g/a", "ok", 3), "h": ("samples/f/h", "missing", 0), "gone": (None, "missing", 0),
    }
    assert sorted((r.species_name, r.n) for r in calls.filter("folder = 'samples/f/v2_b'").collect()) == [("X", "7")]


def test_preference_is_per_sample(spark):
    calls = spark.createDataFrame([("a", 1), ("a", 2)], "sample_id string, n int")
    wide = spark.createDataFrame([("a", 9, "x"), ("b", 8, "y")], "sample_id string, n int, more string")
    got = sorted(map(tuple, runs.authoritative_by_sample(calls, wide).select("sample_id", "n", "more", "source_table").collect()), key=str)
    assert got == [("a", 1, None, "calls"), ("a", 2, None, "calls"), ("b", 8, "y", "wide")]
    assert runs.authoritative_by_sample(calls.limit(0), wide).filter(F.col("source_table") == "wide").count() == 2
