"""The first k-mers of each bucket of a panel leave the grouping and hardly any others; sequences are made once; sets of many values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom import scratch
from strandloom.operators import kmersets, panel, taxonomy
from strandloom.plans import fixtures, q_panel

from test_sequence_folds import rows, tree, windows
from test_superkmers import contigs

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("k, most", [(5, 1), (51, 7)])
def test_thinned_panels_of_first_kmers(spark, k, most):
    df = contigs(spark)
    groups, columns = panel.group_kmers(windows(df, k)), ("panel_type", "evidence_taxid", "species_name", "clade", "k", "kmer", "example_position")
    clade = df.filter("clade is not null").first()["clade"]
    few = panel.first_of_sets(df, [k], most)
    assert rows(panel.build_panel(few, clade, most=most).select(*columns)) == rows(panel.build_panel(groups, clade, most=most).select(*columns))
    nodes = tree(spark)
    few = panel.first_of_sets(df, [k], most, nodes)
    assert rows(panel.build_panel(few, tree=nodes, most=most).select(*columns)) == rows(panel.build_panel(groups, tree=nodes, most=most).select(*columns))


def test_paths_hold_the_named_nodes(spark):
    nodes = [("1", "1", "no rank", "root"), ("f", "1", "family", "f"), ("x", "f", "clade", "x"), ("g", "x", "genus", "g"), ("a", "g", "species", "a"), ("b", "x", "species", "b"), ("c", "1", None, "c")]
    t = taxonomy.index(spark.createDataFrame(nodes, "taxid string, parent string, rank string, name string"))
    low = {r.taxid: r.low for r in t.nodes.collect()}
    got = {r.taxid: r.path for r in taxonomy.named_paths(t).collect()}
    assert got == {x: [low[p] for p in path] for x, path in {"1": "", "f": "f", "x": "f", "g": "fg", "a": "fga", "b": "fb", "c": ""}.items()}


@pytest.mark.parametrize("name", ["p1", "c46"])
def test_panels_write_few_kmers(spark, monkeypatch, name):
    """However many distinct sets of sources there are: these tables have nearly as many as shared k-mers."""
    written = []
    monkeypatch.setattr(panel, "materialise", lambda df, label: written.append(scratch.materialise(df, label)) or written[-1])
    monkeypatch.setattr(kmersets, "CHUNK", 1 << 14)
    k, most, classes = {"p1": (21, 50, 400), "c46": (21, 200, 90)}[name]
    n = getattr(q_panel, name)(spark, SF).count()
    few = panel.first_of_sets(fixtures.contigs(spark, SF), [k], most, taxonomy.index(q_panel.tree(spark, SF)) if name == "c46" else None)
    # Each of the 8 tasks keeps so many of a class, however many chunks it has.
    assert n and few.count() <= 8 * most * classes
    assert sum(w.count() for w in written) <= 2 * 8 * most * classes


def test_sequences_are_made_once(spark):
    df = panel.group_sets(fixtures.contigs(spark, SF), [21])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1


@pytest.mark.parametrize("n", [3, 64, 65, 200, 1500])
def test_sets_of_many_values(n):
    rng = np.random.default_rng(n)
    c = kmersets._Chunk.__new__(kmersets._Chunk)
    sizes = np.minimum(rng.integers(1, 9, 500), n + 3)
    c.ids, c.at = np.arange(n + 3), np.concatenate(([0], np.cumsum(sizes)))
    c.src = np.concatenate([np.sort(rng.choice(n + 3, s, replace=False)) for s in sizes])
    c.of = np.repeat(np.arange(500), sizes)
    lists = [[None, " ", *(f"v{i:04}" for i in range(n)), "v0000"], [None, *(f"w{i % 3}" for i in range(n + 2))]]
    for values, (number, size, get) in zip(lists, kmersets._each(c, lists)):
        want = [tuple(sorted({values[i] for i in c.src[a:b] if values[i] and values[i].strip()})) for a, b in zip(c.at, c.at[1:])]
        assert [get(i) for i in range(500)] == want and size.tolist() == list(map(len, want))
        assert len(set(number.tolist())) == len(set(want)) == len(set(zip(number.tolist(), want)))
