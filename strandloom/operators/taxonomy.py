"""Taxonomy trees of any size and depth: lineages, ancestor intervals, lowest common ancestors of sets of taxids, named ancestors.

``nodes``: taxid, parent, rank, name (taxids are strings). A root is its own parent, has none, or one that is not in the table.
A taxid with several rows takes the least of them; rows without taxid don't count. Nodes on a cycle, and those below one, hang on no root:
they have no lineage and no interval, count as unknown, and are listed by ``Tree.unrooted``.

Nothing walks the tree level by level. Rounds of pointer doubling over written tables (each joins the table with itself on the ancestor reached so far,
so their number is the logarithm of the depth) give depths, subtree sizes and pre-order numbers. A node's descendants are then those
whose ``low`` lies in its own [low, high], and a set's lowest common ancestor is the smallest such interval around the set's least and
greatest ``low``, found by descending powers of two of ancestors. Lineages are only put together where they are the result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import broadcast_if_small, materialise, scratch_path

RANKS = ("species", "genus", "family", "order", "class", "phylum", "superkingdom")
#: Parts in which a parent's children are numbered, as one parent may have millions.
PARTS = 64


def normalise_taxid(df: DataFrame, taxid_col: str, merged: DataFrame, deleted: DataFrame) -> DataFrame:
    """``taxid_col`` replaced: deleted ids become null, merged ids their target (one step, not checked again)."""
    m = merged.select(F.col("old_taxid").alias("_old"), F.col("new_taxid").alias("_new"))
    d = deleted.select(F.col("taxid").alias("_gone"))
    out = df.join(d, F.col(taxid_col) == F.col("_gone"), "left").join(m, F.col(taxid_col) == F.col("_old"), "left")
    fixed = F.when(F.col("_gone").isNotNull() | (F.trim(taxid_col) == ""), None).otherwise(F.coalesce("_new", F.col(taxid_col)))
    return out.withColumn(taxid_col, fixed).drop("_gone", "_old", "_new")


def double(rows: DataFrame, fold: Mapping[str, Column], down: str | None = None, label: str = "rounds") -> tuple[DataFrame, DataFrame, int]:
    """Pointer doubling over a forest, as (rooted rows, unrooted rows, rounds).

    ``rows``: id, up (the parent; null for a root, else an id of the table) and columns to fold. In each round a row whose ``up`` is set
    takes the ``up`` of its ``up`` for its own, and ``fold`` gives its columns' new values from those of the row (a.) and of its ``up`` (b.), so that in
    the end a column is folded over the whole path to the root. ``down``: a column that is summed over all descendants instead. Rows that never
    reach a root hang on a cycle; rounds end when only those are open.
    """
    rows = materialise(rows, f"{label}-0")
    opened, turn = rows.filter("up is not null").count(), 0
    while opened:
        turn += 1
        going, carried = rows.filter("up is not null"), [c for c in rows.columns if c not in ("id", "up")]
        step = going.alias("a").join(rows.alias("b"), F.col("a.up") == F.col("b.id")).select("a.id", "b.up", *(fold.get(c, F.col(f"a.{c}")).alias(c) for c in carried))
        new = rows.filter("up is null").unionByName(step)
        if down:
            below = going.groupBy(F.col("up").alias("_up")).agg(F.sum(down).alias("_down"))
            new = new.join(below, F.col("id") == F.col("_up"), "left").withColumn(down, F.col(down) + F.coalesce("_down", F.lit(0))).drop("_up", "_down")
        rows = materialise(new.select("id", "up", *carried), f"{label}-{turn}")
        left = rows.filter("up is not null").count()
        if left == opened:  # a rooted node as deep as the round's distance would have reached its root
            break
        opened = left
    return rows.filter("up is null").drop("up"), rows.filter("up is not null").select("id"), turn


def _clean(nodes: DataFrame) -> DataFrame:
    """One row per taxid, with a null parent for roots."""
    one = nodes.filter("taxid is not null").groupBy(F.col("taxid").cast("string").alias("taxid")).agg(F.min(F.struct(F.col("parent").cast("string").alias("parent"), "rank", "name")).alias("x"))
    one = materialise(one.select("taxid", "x.*"), "nodes")
    known = one.select(F.col("taxid").alias("_up"))
    parent = F.when(F.col("_up") != F.col("taxid"), F.col("_up"))
    return materialise(one.join(known, F.col("parent") == F.col("_up"), "left").select("taxid", parent.alias("parent"), "rank", "name"), "parents")


@dataclass(frozen=True)
class Tree:
    """``nodes``: taxid, parent (null for roots), rank, name, depth (0 for roots), low, high. ``jumps``: step, taxid, up, up_high: the
    ancestor 2 ** step levels up. ``unrooted``: taxids on or below a cycle. All are written tables."""

    nodes: DataFrame
    jumps: DataFrame
    unrooted: DataFrame
    steps: int

    def interval(self, taxid: str) -> tuple[int, int] | None:
        """(low, high) of one node, None if it is unknown."""
        row = self.nodes.filter(F.col("taxid") == taxid).select("low", "high").first()
        return (row["low"], row["high"]) if row else None

    def below(self, low: Column, taxid: str) -> Column:
        """Whether the node with that pre-order number is ``taxid`` or descends from it: a range test. Nothing descends from an unknown taxid."""
        span = self.interval(taxid)
        return low.between(*span) if span else F.when(low.isNotNull(), False)


def index(nodes: DataFrame) -> Tree:
    """Depths, ancestor intervals and power-of-two ancestors of a taxonomy."""
    spark, nodes = nodes.sparkSession, _clean(nodes)
    rows = nodes.select(F.col("taxid").alias("id"), F.col("parent").alias("up"), F.when(F.col("parent").isNotNull(), 1).otherwise(0).alias("depth"), F.lit(1).cast("long").alias("size"), F.when(F.col("parent").isNotNull(), F.array("parent")).otherwise(F.array().cast("array<string>")).alias("ups"))
    higher = F.when(F.col("b.up").isNotNull(), F.array_append("a.ups", F.col("b.up"))).otherwise(F.col("a.ups"))
    rooted, unrooted, steps = double(rows, {"depth": F.col("a.depth") + F.col("b.depth"), "ups": higher}, down="size", label="depths")
    all_ = materialise(rooted.withColumnRenamed("id", "taxid").join(nodes, "taxid"), "rooted")
    # Pre-order: a parent's number, then one for itself and the sizes of the siblings before.
    by, part = F.coalesce("parent", F.lit("")), F.pmod(F.xxhash64("taxid"), F.lit(PARTS))
    sib = all_.select("taxid", "parent", "size", by.alias("_by"), part.alias("_part"))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sib.groupBy("_by", "_part").agg(F.sum("size").alias("_size"))
    parts = parts.select("_by", "_part", before(Window.partitionBy("_by").orderBy("_part"), "_size").alias("_ahead"))
    sib = sib.withColumn("_in", before(Window.partitionBy("_by", "_part").orderBy("taxid"), "size")).join(parts, ["_by", "_part"])
    start = F.col("_in") + F.col("_ahead") + F.when(F.col("parent").isNotNull(), 1).otherwise(0)
    numbers, _, _ = double(sib.select(F.col("taxid").alias("id"), F.col("parent").alias("up"), start.cast("long").alias("low")), {"low": F.col("a.low") + F.col("b.low")}, label="numbers")
    done = all_.join(numbers.withColumnRenamed("id", "taxid"), "taxid")
    done = materialise(done.select("taxid", "parent", "rank", "name", "depth", "low", (F.col("low") + F.col("size") - 1).alias("high"), "ups"), "tree")
    jumps = done.select("taxid", F.posexplode("ups").alias("step", "up")).join(done.select(F.col("taxid").alias("up"), F.col("high").alias("up_high")), "up").select("taxid", "up", "up_high", "step")
    path = scratch_path(spark, "jumps")
    jumps.write.partitionBy("step").parquet(path)
    return Tree(done.drop("ups"), spark.read.schema(jumps.schema).parquet(path), unrooted.withColumnRenamed("id", "taxid"), steps)


def lineages(nodes: DataFrame) -> DataFrame:
    """taxid, lineage: array<struct<taxid, rank, name>> from root to taxid, whatever its length."""
    own = F.array(F.struct("taxid", "rank", "name"))
    rows = _clean(nodes).select(F.col("taxid").alias("id"), F.col("parent").alias("up"), own.alias("lineage"))
    return double(rows, {"lineage": F.concat("b.lineage", "a.lineage")}, label="lineages")[0].withColumnRenamed("id", "taxid")


def lca_of_sets(sets: DataFrame, tree: Tree, set_col: str = "taxids") -> DataFrame:
    """(set_col, lca: struct<taxid, rank, name, low, high, known>) of each distinct set; unknown taxids are ignored, and sets without
    known ones or without a common ancestor have no row. ``known``: taxids of the set that the tree has."""
    place = tree.nodes.select("taxid", "low")
    distinct = sets.select(F.array_sort(F.array_distinct(set_col)).alias(set_col)).distinct()
    spans = distinct.select(set_col, F.explode(set_col).alias("taxid")).join(place, "taxid").groupBy(set_col).agg(F.min("low").alias("_lo"), F.max("low").alias("_hi"), F.count("*").alias("_known"))
    spans = materialise(spans, "spans")
    at = spans.select("_lo", "_hi").distinct().join(tree.nodes.select(F.col("low").alias("_lo"), F.col("taxid").alias("_at"), F.col("high").alias("_end")), "_lo")
    for step in range(tree.steps - 1, -1, -1):
        jump = tree.jumps.filter(F.col("step") == step).select(F.col("taxid").alias("_at"), "up", "up_high")
        go = F.coalesce((F.col("_end") < F.col("_hi")) & (F.col("up_high") < F.col("_hi")), F.lit(False))
        at = at.join(jump, "_at", "left").select("_lo", "_hi", F.when(go, F.col("up")).otherwise(F.col("_at")).alias("_at"), F.when(go, F.col("up_high")).otherwise(F.col("_end")).alias("_end"))
    here = tree.nodes.select(F.col("taxid").alias("_at"), F.col("parent").alias("_parent"))
    at = at.join(here, "_at").select("_lo", "_hi", F.when(F.col("_end") >= F.col("_hi"), F.col("_at")).otherwise(F.col("_parent")).alias("taxid"))
    found = at.join(tree.nodes, "taxid").select("_lo", "_hi", "taxid", "rank", "name", "low", "high")
    return spans.join(found, ["_lo", "_hi"]).select(set_col, F.struct("taxid", "rank", "name", "low", "high", F.col("_known").alias("known")).alias("lca"))


def best_named(tree: Tree, ranks: Sequence[str] = RANKS) -> DataFrame:
    """(taxid, node: struct<taxid, rank, name>): the node itself or its nearest ancestor of a preferred rank; else the node itself."""
    wanted = F.lower("rank").isin([r.lower() for r in ranks])
    own = F.struct("taxid", "rank", "name")
    # Preferred nodes are the roots of this forest; what lies between is passed by doubling.
    rows = tree.nodes.select(F.col("taxid").alias("id"), F.when(wanted, None).otherwise(F.col("parent")).alias("up"), F.when(wanted, own).alias("node"), own.alias("self"))
    named = double(rows, {"node": F.coalesce("a.node", "b.node")}, label="named")[0]
    return named.select(F.col("id").alias("taxid"), F.coalesce("node", "self").alias("node"))


def named_paths(tree: Tree, ranks: Sequence[str] = RANKS) -> DataFrame:
    """(taxid, path): the places of the nodes of a preferred rank from the root down to the taxid, itself included. The last place that the paths of a set's taxids share is that of the ``best_named``
    of their common ancestor, if such a node has a preferred rank."""
    wanted = F.coalesce(F.lower("rank").isin([r.lower() for r in ranks]), F.lit(False))
    own = F.when(wanted, F.array("low")).otherwise(F.array().cast("array<bigint>"))
    rows = tree.nodes.select(F.col("taxid").alias("id"), F.col("parent").alias("up"), own.alias("path"))
    return double(rows, {"path": F.concat("b.path", "a.path")}, label="paths")[0].withColumnRenamed("id", "taxid")


def assign_nodes(df: DataFrame, tree: Tree, set_col: str = "taxids", ranks: Sequence[str] = RANKS) -> DataFrame:
    """``df`` with ``lca`` and ``node`` (its best named ancestor) of each row's taxid set; null where there is none.

    ``df`` is written once, as both its distinct sets and its rows are needed; sets are solved once each.
    """
    keyed = materialise(df.withColumn(set_col, F.array_sort(F.array_distinct(set_col))), "sets")
    solved = lca_of_sets(keyed, tree, set_col)
    solved = materialise(solved.join(best_named(tree, ranks).withColumnRenamed("taxid", "_t"), F.col("lca.taxid") == F.col("_t")).select(set_col, "lca", "node"), "solved")
    return keyed.join(broadcast_if_small(solved), set_col, "left")
