"""Queries over whole texts and all dimensions, against plain versions on the smallest tables."""

import re
from collections import defaultdict
from statistics import mean, median

import numpy as np
from pyspark.sql import functions as F

from strandloom.plans import catalogue
from strandloom.plans.fixtures import contigs, dna

SF = "/root/testdata/sf0.001"
Q = catalogue.QUERIES


def test_read_metrics_of_whole_texts(spark):
    lengths = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        if n := len(re.sub("[^!-~]", "", r.text or "")):
            lengths[r.lang].append(n)
    assert max(map(max, lengths.values())) > 400
    for r in Q["b27_read_metrics"](spark, SF).collect():
        own = sorted(lengths.pop(r.lang), reverse=True)
        run = np.cumsum(own)
        assert (r.n_reads, r.total_bases, r.n50) == (len(own), sum(own), own[int(np.argmax(2 * run >= run[-1]))])
        assert abs(r.mean_length - mean(own)) < 1e-3 and r.median_length == median(own)
    assert not lengths


def test_windows_of_whole_texts(spark):
    kmers = {(r.doc_id, i + 1): r.seq[i : i + 31] for r in contigs(spark, SF).collect() for i in range(len(r.seq) - 30)}
    got = Q["b03_valid_kmer_whole"](spark, SF).collect()
    assert len(got) == len(kmers)
    assert all(r.kmer == kmers[r.doc_id, r.position] and r.valid == bool(re.fullmatch("[ACGT]+", r.kmer)) for r in got)
    texts = {r.item_id: r.s for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", dna(F.col("text")).alias("s")).collect()}
    want = sorted((i, n + 1, sum(a != b for a, b in zip(s[n : n + 51], s[n + 10 : n + 61]))) for i, s in texts.items() for n in range(len(s) - 60))
    assert sorted(map(tuple, Q["b07_hamming_distance"](spark, SF).collect())) == want
    want = sorted((i, n + 1, s[n : n + j] + c + s[n + j + 1 : n + 15]) for i, s in texts.items() for n in range(len(s) - 14) for j in range(15) for c in "ACGT" if c != s[n + j])
    assert sorted(map(tuple, Q["b08_mismatch_neighbourhood"](spark, SF).collect())) == want


def test_all_dimensions(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x, labels, ids = np.array([r.embedding for r in rows], float), np.array([str(r.label) for r in rows]), [r.vec_id for r in rows]
    std = x.std(0)
    z = (x - x.mean(0)) / np.where(std > 0, std, 1)
    got = {r.feature: (r["mean"], r["std"]) for r in Q["f02_scaling"](spark, SF).collect()}
    assert len(got) == x.shape[1] and all(np.allclose(got[i], (x[:, i].mean(), std[i]), atol=1e-5) for i in got)
    norm = dict(map(tuple, Q["f03_standardised_norm"](spark, SF).select("id", "norm").collect()))
    assert np.allclose([norm[i] for i in ids], np.sqrt((z**2).sum(1)), atol=1e-4)
    names = sorted(set(labels))
    centres = np.array([z[labels == n].mean(0) for n in names])
    trained = {(r.label, r.feature): r.centre for r in Q["f05_train_classifier"](spark, SF).collect()}
    assert np.allclose([[trained[n, i] for i in range(x.shape[1])] for n in names], centres, atol=1e-4)
    distance = np.sqrt(((z[:, None] - centres) ** 2).sum(2))
    best = {r.id: r.best_distance for r in Q["f06_open_set_predict"](spark, SF).collect()}
    assert np.allclose([best[i] for i in ids], distance.min(1), atol=1e-3)
    right = np.mean(np.array(names)[distance.argmin(1)] == labels)
    curve = Q["f18_novelty_curve"](spark, SF).collect()
    assert all(r.n == len(ids) and r.n_right <= round(right * len(ids)) for r in curve)
    overall = [r for r in Q["f15_holdout_validation"](spark, SF).collect() if r.label == "overall"]
    assert sum(r.tp + r.fp for r in overall) == len(ids)
