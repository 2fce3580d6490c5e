"""Taxonomies and module hierarchies of any size and depth against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import screen, taxonomy

SCHEMA = "taxid string, parent string, rank string, name string"


def plain_lineages(rows):
    """Of each rooted taxid the path from its root; rows: (taxid, parent, rank, name)."""
    parent = {t: p for t, p, *_ in rows}
    out = {}
    for t in parent:
        path = [t]
        while (p := parent[path[-1]]) in parent and p != path[-1] and len(path) <= len(parent):
            path.append(p)
        if len(path) <= len(parent):
            out[t] = path[::-1]
    return out


def plain_lca(lines, taxids):
    known = [lines[t] for t in taxids if t in lines]
    common = []
    for level in zip(*known):
        if len(set(level)) > 1:
            break
        common.append(level[0])
    return common[-1] if known and common else None


@pytest.fixture(scope="module")
def forest():
    r = random.Random(4)
    ranks = ["no rank", "clade", "Genus", "species", "family"]
    rows = [("1", "1", "no rank", "root"), ("2", None, "no rank", "other root"), ("3", "gone", "clade", "of a missing parent"), ("4", "", "genus", "blank parent")]
    for i in range(5, 400):
        rows.append((str(i), r.choice(rows[: max(4, i // 4)])[0] if i % 3 else rows[-1][0], r.choice(ranks), f"n{i}"))
    rows += [("deep0", "7", "genus", "d")] + [(f"deep{i}", f"deep{i - 1}", "no rank", "d") for i in range(1, 130)]
    cycle = [("c1", "c2", "species", "c"), ("c2", "c3", "genus", "c"), ("c3", "c1", "no rank", "c"), ("c4", "c1", "species", "below a cycle"), ("c5", "c4", "species", "far below")]
    return rows + cycle


def test_lineages_and_intervals(spark, forest):
    df = spark.createDataFrame(forest + [(None, "1", "species", "no id"), forest[9]], SCHEMA)
    want = plain_lineages(forest)
    assert max(map(len, want.values())) > 130 and "c4" not in want and want["3"] == ["3"]
    got = {r.taxid: [n.taxid for n in r.lineage] for r in taxonomy.lineages(df).collect()}
    assert got == want
    tree = taxonomy.index(df)
    nodes = {r.taxid: r for r in tree.nodes.collect()}
    assert set(nodes) == set(want) and {r.taxid for r in tree.unrooted.collect()} == {"c1", "c2", "c3", "c4", "c5"}
    assert sorted(r.low for r in nodes.values()) == list(range(len(nodes)))
    for t, path in want.items():
        assert nodes[t].depth == len(path) - 1
        for u in random.Random(t).sample(list(want), 25) + path:
            assert (u in path) == (nodes[u].low <= nodes[t].low <= nodes[u].high)
    below = {r.taxid for r in tree.nodes.filter(tree.below(F.col("low"), "7")).collect()}
    assert below == {t for t, p in want.items() if "7" in p}
    assert tree.interval("c1") is None and tree.nodes.filter(tree.below(F.col("low"), "no such id")).count() == 0


def test_common_ancestors_and_names(spark, forest):
    r = random.Random(8)
    want = plain_lineages(forest)
    ids = [t for t, *_ in forest] + ["unknown"]
    sets = [[], ["unknown"], ["c1", "c2"], ["deep129", "deep3"], ["deep129"], ["deep129", "deep129"], ["2", "1"], ["5", None], None] + [r.sample(ids, r.randint(1, 4)) for _ in range(300)]
    rank = {t: k for t, _, k, _ in forest}
    tree = taxonomy.index(spark.createDataFrame(forest, SCHEMA))
    got = taxonomy.assign_nodes(spark.createDataFrame(list(enumerate(sets)), "i int, taxids array<string>"), tree, ranks=("genus", "species")).collect()
    assert len(got) == len(sets)
    for x in got:
        s = [t for t in sets[x.i] or [] if t]
        lca = plain_lca(want, s)
        assert (x.lca and x.lca.taxid) == lca
        if lca:
            named = [t for t in want[lca] if rank[t].lower() in ("genus", "species")]
            assert x.node.taxid == (named[-1] if named else lca) and x.lca.known == len({t for t in s if t in want})


def test_empty_and_flat_trees(spark):
    none = taxonomy.index(spark.createDataFrame([], SCHEMA))
    sets = spark.createDataFrame([(["1"],), ([],)], "taxids array<string>")
    assert none.nodes.count() == 0 and [r.lca for r in taxonomy.assign_nodes(sets, none).collect()] == [None, None]
    flat = taxonomy.index(spark.createDataFrame([("1", None, "species", "a"), ("2", "2", "no rank", "b")], SCHEMA))
    assert flat.steps == 0 and sorted((r.lca and r.lca.taxid) or "" for r in taxonomy.assign_nodes(sets, flat).collect()) == ["", "1"]


def test_more_nodes_than_a_recursive_query_may_return(spark):
    """1 050 000 taxa, 200 levels deep at one place, and a cycle."""
    n = 1_050_000
    i = F.col("id")
    parent = F.when(i <= 200, i - 1).when(i <= 2000, F.pmod(F.xxhash64("id"), F.lit(200))).otherwise(F.pmod(F.xxhash64("id"), F.lit(2000)))
    nodes = spark.range(n).select(i.cast("string").alias("taxid"), F.when(i == 0, 0).when(i == n - 1, n - 2).when(i == n - 2, n - 1).otherwise(parent).cast("string").alias("parent"), F.when(i % 5 == 0, "genus").otherwise("no rank").alias("rank"), F.lit("").alias("name"))
    tree = taxonomy.index(nodes)
    row = tree.nodes.agg(F.count("*").alias("n"), F.max("depth").alias("d"), F.min("low").alias("a"), F.max("high").alias("z"), F.count_distinct("low").alias("u")).first()
    assert tuple(row) == (n - 2, row.d, 0, n - 3, n - 2) and row.d >= 200 and tree.unrooted.count() == 2
    sets = spark.createDataFrame([(["199", "200"],), (["200", "100"],), ([str(n - 1)],)], "taxids array<string>")
    got = {tuple(r.taxids): r.lca and r.lca.taxid for r in taxonomy.assign_nodes(sets, tree).collect()}
    assert got == {("199", "200"): "199", ("100", "200"): "100", (str(n - 1),): None}


def test_modules_of_any_depth(spark):
    deep = [("m0", "", False)] + [(f"m{i}", f"m{i - 1}", True) for i in range(1, 100)] + [("other", None, True)]
    schema = "module_id string, parent_module_id string, has_gate boolean"
    df = spark.createDataFrame(deep, schema)
    assert {r.module_id: r.depth for r in screen.module_depths(df).collect()} == {"m0": 0, "other": 0} | {f"m{i}": i for i in range(1, 100)}
    gates = spark.createDataFrame([(f"m{i}", 5, 5) for i in range(1, 100) if i != 80], "module_id string, n_kmers long, n_sequences long")
    got = {r.module_id: (r.active, r.reason) for r in screen.activate(df, gates, 3, 2).collect()}
    assert len(got) == 101 and got["m0"] == (True, "root_without_gate") and got["other"] == (False, "gate_below_threshold")
    assert all(got[f"m{i}"] == (True, "gate_passed") for i in range(1, 80)) and got["m80"] == (False, "gate_below_threshold")
    assert all(got[f"m{i}"] == (False, "parent_not_active") for i in range(81, 100))
    for wrong in ([("a", "b", True), ("b", "a", True)], [("a", "nowhere", True)]):
        with pytest.raises(ValueError):
            screen.module_depths(spark.createDataFrame(wrong, schema))
