"""Order-dependent selections against plain loops, sources against hand-written files, streams, control functions."""

import gzip
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandloom.functions import scores, seq
from strandloom.operators import benchmark, evidence, markers, screen
from strandloom.sources import sequences, tables
from strandloom.streaming import screening


def test_neighbourhood_sizes(spark):
    row = spark.sql("select 'ACGTA' as k").select(seq.neighbourhood(F.col("k"), 1).alias("one"), seq.neighbourhood(F.col("k"), 2).alias("two")).first()
    assert len(row["one"]) == len(set(row["one"])) == 15
    # All strings at one or two substitutions: 15 + C(5,2) * 9.
    assert len(set(row["two"])) == len(row["two"]) == 15 + 90
    with pytest.raises(ValueError):
        seq.neighbourhood(F.col("k"), 3)


def test_windows_of_short_and_ambiguous_sequences(spark):
    df = spark.createDataFrame([(1, "ACGTN"), (2, "AC"), (3, ""), (4, None), (5, "acgta")], "id int, seq string")
    got = sorted(map(tuple, seq.kmer_windows(df, 3, keep=("id",), canonicalise=False).collect()))
    assert got == [(1, 0, "ACG"), (1, 1, "CGT"), (5, 0, "ACG"), (5, 1, "CGT"), (5, 2, "GTA")]
    assert seq.kmer_windows(df, 3, keep=("id",), skip_lowercase=True).filter("id = 5").count() == 0
    with pytest.raises(ValueError):
        seq.kmer_windows(df, 0)


def test_windows_of_long_sequences(spark, monkeypatch):
    monkeypatch.setattr(seq, "SEGMENT", 100)
    r = random.Random(1)
    text = "".join(r.choice("ACGTN" if i % 90 == 0 else "ACGT") for i in range(1234))
    texts = {1: text, 2: text[:100], 3: text[:101], 4: text[:7], 5: text[:200], 6: text[:6]}
    df = spark.createDataFrame(list(texts.items()), "id int, seq string")
    for k in (7, 51, 151):
        want = {(i, p, t[p : p + k]) for i, t in texts.items() for p in range(len(t) - k + 1) if "N" not in t[p : p + k]}
        got = list(map(tuple, seq.kmer_windows(df, k, keep=("id",), canonicalise=False).collect()))
        assert len(got) == len(want) and set(got) == want


def test_independent_markers_match_a_plain_loop(spark):
    r = random.Random(5)
    rows = [("g", c, k, p, f"{k}:{c}:{p}", p // 50, f"{r.randrange(40):02d}") for c in (1, 2) for k in (5, 9) for p in range(0, 300, 4)]
    df = spark.createDataFrame(rows, "genome string, doc_id int, k int, position int, kmer string, bin int, score string")
    got = {(x.k, x.doc_id, x.position) for x in markers.independent_markers(df, ["genome"], 4, 9, 6).collect()}
    by_bin = {}
    for x in sorted(rows, key=lambda x: (x[6], x[4])):
        by_bin.setdefault((x[2], x[5]), []).append(x)
    want, full = [], Counter()
    for x in sorted((x for v in by_bin.values() for x in v[:4]), key=lambda x: (x[6], -x[2], x[4], x[1], x[3])):
        gap = lambda y: max(0, max(x[3], y[3]) - min(x[3] + x[2], y[3] + y[2]))  # noqa: B023, E731
        if full[x[2]] < 9 and not any(y[2] != x[2] and y[1] == x[1] and gap(y) < 6 for y in want):
            full[x[2]] += 1
            want.append(x)
    assert got == {(x[2], x[1], x[3]) for x in want} and {x[2] for x in want} == {5, 9}


@pytest.mark.parametrize("seed, cap", [(1, 3), (2, 7), (3, 1000)])
def test_independent_markers_with_caps_in_several_buckets(spark, seed, cap):
    r = random.Random(seed)
    rows = [(b, f"g{r.randrange(2)}", r.randrange(2), k, r.randrange(400), f"{b}:{k}:{i}", 0, f"{r.randrange(30):02d}") for b in ("x", "y", None) for k in (5, 9, 14) for i in range(25)]
    df = spark.createDataFrame(rows, "b string, genome string, doc_id int, k int, position int, kmer string, bin int, score string").repartition(4)
    got = {(x.b, x.kmer) for x in markers.independent_markers(df, ["b"], 20, cap, 8).collect()}
    want = set()
    for b in ("x", "y", None):
        taken, full = [], Counter()
        kept = [x for k in (5, 9, 14) for x in sorted((x for x in rows if x[0] == b and x[3] == k), key=lambda x: (x[7], x[5]))[:20]]
        for x in sorted(kept, key=lambda x: (x[7], -x[3], x[5])):
            near = any(y[3] != x[3] and y[1:3] == x[1:3] and y[4] < x[4] + x[3] + 8 and x[4] < y[4] + y[3] + 8 for y in taken)
            if full[x[3]] < cap and not near:
                full[x[3]] += 1
                taken.append(x)
        want |= {(b, x[5]) for x in taken}
    assert got == want


def test_profiles_and_selections(spark):
    assert markers.resolve_profile("raw_ont_lod_balanced", [77, 51]) == ([77, 51], 150, {51: 4, 77: 6, 101: 4, 151: 1})
    assert markers.resolve_profile("default", [51, 151, 77]) == ([151, 77, 51], 5000, {})
    assert markers.resolve_profile("raw_ont_balanced", [151, 51], "long_to_short", 0, "51:2") == ([151, 51], 0, {51: 2})
    assert markers.parse_quotas(None) == markers.parse_quotas(" ") == {}
    for bad in ("51", "51:x", "0:3", "51:0", "51:-1"):
        with pytest.raises(ValueError):
            markers.parse_quotas(bad)
    for wrong in ({"strategy": "odd"}, {"cap": 0}, {"bin_size": 0}, {"quota": -1}, {"distance": -1}, {"quota_by_k": {51: 0}}):
        with pytest.raises(ValueError):
            markers.Selection(**wrong)
    for wrong in (("odd", [51]), ("default", [51], "odd"), ("default", [51], "auto", -1)):
        with pytest.raises(ValueError):
            markers.resolve_profile(*wrong)
    rows = [("g", 1, k, p, f"{p:03d}", f"{p % 7}") for k in (51, 77) for p in range(0, 900, 90)]
    df = spark.createDataFrame(rows, "genome string, doc_id int, k int, position int, kmer string, score string")
    pick = lambda **o: Counter(x.k for x in markers.select_markers(df, ["genome"], markers.Selection(**o)).collect())
    assert pick(strategy="first_seen", cap=3) == {51: 3, 77: 3} and pick(strategy="first_seen") == {51: 10, 77: 10}
    assert pick(strategy="genome_spread", bin_size=300, quota=1, quota_by_k={77: 2}) == {51: 3, 77: 6}
    assert sum(pick(distance=10_000).values()) == 10 and pick(distance=0, cap=4)[51] == 4


def test_mismatches_of_long_kmers(spark):
    r = random.Random(7)
    for k, most in ((77, 1), (151, 2)):
        base = ["".join(r.choice("ACGT") for _ in range(k)) for _ in range(8)]

        def change(s, n):
            places = set(r.sample(range(len(s)), n))
            return "".join(r.choice([x for x in "ACGT" if x != c]) if i in places else c for i, c in enumerate(s))

        reads = [change(s, n) for s in base for n in (0, 1, 1, 2, 2, 3)] * 2
        windows = spark.createDataFrame([("s", str(i), 0, k, q, q) for i, q in enumerate(reads)], "sample_id string, sequence_id string, query_position int, k int, window_kmer string, query_kmer string")
        panel = spark.createDataFrame([(k, b, "sp") for b in base], "k int, kmer string, species_name string")
        got = sorted((x.sequence_id, x.matched_kmer, x.mismatches) for x in screen.fuzzy_hits(windows, panel, most, 71).collect())
        apart = lambda a, b: sum(x != y for x, y in zip(a, b))
        assert got == sorted((str(i), b, apart(q, b)) for i, q in enumerate(reads) for b in base if 0 < apart(q, b) <= most)


def test_authoritative_table(spark):
    calls, wide = spark.createDataFrame([(1, 2)], "sample_id int, n_positive_reads int"), spark.createDataFrame([(5,)], "sample_id int")
    assert benchmark.authoritative(calls.limit(0), wide).first()["sample_id"] == 5
    assert benchmark.authoritative(calls, wide).first()["n_positive_sequences"] == 2


def test_spaced_sample_matches_a_plain_loop(spark):
    rows = [("g", c, k, p, f"{k}:{p}") for c in (1, 2) for k in (5, 9) for p in range(0, 120, 3)]
    df = spark.createDataFrame(rows, "genome string, doc_id int, k int, position int, kmer string")
    got = {(r.doc_id, r.k, r.position) for r in markers.sample_universe_spaced(df, 30, 2, [5, 9], 4).collect()}
    offsets, want = scores.bin_offsets([5, 9], 30), set()
    for c in (1, 2):
        taken, full = [], Counter()
        for k in (9, 5):
            for p in range(0, 120, 3):
                b = (p + offsets[k]) // 30
                gap = lambda q, j: max(0, max(p, q) - min(p + k, q + j))  # noqa: B023, E731
                if full[k, b] < 2 and not any(j != k and gap(q, j) < 4 for q, j in taken):
                    full[k, b] += 1
                    taken.append((p, k))
        want |= {(c, k, p) for p, k in taken}
    assert got == want


def test_two_mismatches_against_all_pairs(spark):
    r = random.Random(3)
    base = ["".join(r.choice("ACGT") for _ in range(33)) for _ in range(20)]
    change = lambda s, n: "".join(r.choice([x for x in "ACGT" if x != c]) if i in set(r.sample(range(33), n)) else c for i, c in enumerate(s))
    reads = [change(s, n) for s in base for n in (0, 1, 2, 3)]
    windows = spark.createDataFrame([("s", str(i), 0, 33, q, q) for i, q in enumerate(reads)], "sample_id string, sequence_id string, query_position int, k int, window_kmer string, query_kmer string")
    panel = spark.createDataFrame([(33, b, "sp") for b in base], "k int, kmer string, species_name string")
    got = sorted((x.sequence_id, x.matched_kmer, x.mismatches) for x in screen.fuzzy_hits(windows, panel, 2, 31).collect())
    apart = lambda a, b: sum(x != y for x, y in zip(a, b))
    assert got == sorted((str(i), b, apart(q, b)) for i, q in enumerate(reads) for b in base if 0 < apart(q, b) <= 2)


def test_presets_and_threshold_specs():
    assert evidence.preset("strict", min_best_k=77).min_best_k == 77
    with pytest.raises(ValueError):
        evidence.CallRules(low_evidence_call="maybe")
    t = benchmark.parse_thresholds("x:k1,u10,p2,e10,best101,conf0.5,conflict0.1")
    assert (t.min_k_values, t.min_best_k, t.min_confidence, t.max_conflict) == (1, 101, 0.5, 0.1)
    for bad in ("x:k1", "k1,u10", "x:k1,u10,p2,e10,best101,conf0.5,zzz1"):
        with pytest.raises(ValueError):
            benchmark.parse_thresholds(bad)


def test_fasta_and_fastq(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nACgu\nAC\n\n>two\nNNN\n")
    got = sorted(map(tuple, sequences.read_fasta(spark, str(tmp_path / "a.fa")).collect()))
    assert got == [("one", "one first", "ACGTAC"), ("two", "two", "NNN")]
    assert sequences.read_fasta(spark, str(tmp_path / "a.fa"), mask_lowercase=True).filter("identifier = 'one'").first()["sequence"] == "ACNNAC"
    text = "@r1 x\nACGT\n+\nIIII\n@r2\nAC\n+r2\n!!\n"
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as f:
        f.write(text)
    rows = sequences.read_fastq(spark, str(tmp_path / "b.fastq.gz")).orderBy("record_index").collect()
    assert [(r.identifier, r.sequence, r.quality) for r in rows] == [("r1", "ACGT", "IIII"), ("r2", "AC", "!!")]
    for bad in ("@r\nACGT\n+\nIII\n", "r\nA\n+\nI\n", "@r\nA\n+\n", "@\nA\n+\nI\n"):
        (tmp_path / "bad.fastq").write_text(bad)
        with pytest.raises(ValueError):
            list(sequences.fastq_records(sequences.Range(f"file://{tmp_path}/bad.fastq", 0, len(bad))))


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"], None), ("b", [], "z")], "id string, set array<string>, v string")
    tables.write_table(df, str(tmp_path / "t.tsv.gz"))
    assert sorted(map(tuple, tables.read_table(spark, str(tmp_path / "t.tsv.gz")).collect())) == [("a", "x;y", ""), ("b", "", "z")]
    with pytest.raises(ValueError):
        tables.table_format("t.csv")
    with pytest.raises(ValueError, match="lacks columns: q, r"):
        tables.require_columns(df, ("id", "q", "r"))
    (tmp_path / "nodes.dmp").write_text("1\t|\t1\t|\tno rank\t|\t\t|\n9\t|\t1\t|\tgenus\t|\t\t|\nbad\n")
    (tmp_path / "names.dmp").write_text("9\t|\tGenusname\t|\t\t|\tscientific name\t|\n9\t|\tOther\t|\t\t|\tsynonym\t|\n")
    (tmp_path / "merged.dmp").write_text("5\t|\t9\t|\n")
    (tmp_path / "delnodes.dmp").write_text("7\t|\n")
    nodes, merged, deleted = tables.taxonomy_dump(spark, str(tmp_path))
    assert sorted(map(tuple, nodes.collect())) == [("1", "1", "no rank", ""), ("9", "1", "genus", "Genusname")]
    assert (merged.first()["new_taxid"], deleted.first()["taxid"]) == ("9", "7")


def test_genome_catalogue(spark):
    rows = [("x/a.fna.gz", "s1", "target"), ("b.fa", "s2", "exclude"), ("c.fa", "s3", "Outgroup")]
    df = spark.createDataFrame(rows, "genome_fasta string, species_name string, role string")
    assert sorted((r.genome_id, r.is_target) for r in tables.genome_catalogue(df).collect()) == [("a", True), ("c", False)]
    with pytest.raises(ValueError):
        tables.genome_catalogue(df.filter("role <> 'target'"))
    with pytest.raises(Exception, match="unknown role"):
        tables.genome_catalogue(spark.createDataFrame([("a.fa", "s", "odd")], df.schema), require_target=False).collect()


def test_stream(spark, tmp_path):
    reads = spark.createDataFrame([("s", str(i), "ACGTACGTAC") for i in range(4)], "sample_id string, sequence_id string, seq string")
    reads.write.parquet(str(tmp_path / "reads"))
    panel = spark.createDataFrame([(5, "ACGTA", "species_unique", "sp", "c", "species", "sp")], "k int, kmer string, panel_type string, species_name string, clade string, evidence_rank string, evidence_name string")
    stream = spark.readStream.schema(reads.schema).parquet(str(tmp_path / "reads"))
    out = str(tmp_path / "out")
    for checkpoint in ("cp", "cp again"):  # a second run of the same batch replaces the first's rows
        screening.write_hits(screening.stream_hits(stream, panel, [5]), out, str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination()
    call = screening.calls_so_far(spark, out).first()
    assert (call["species_name"], call["n_positive_sequences"], call["n_unique_kmers"]) == ("sp", 4, 1)
