"""Screening reads against a panel: exact and fuzzy joins, rescue passes, module gates.

Windows of reads: sample_id, sequence_id, query_position, k, window_kmer (as read), query_kmer (canonical).
Panel: k, kmer (canonical) and labels. A hit is a window joined with a marker; all joins are equi-joins on
(k, kmer) or on (k, half), so Spark may broadcast a small panel or shuffle both sides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, seq
from ..scratch import broadcast_if_small, materialise
from . import taxonomy
from .windows import kept_parts, near_kmers

HIT = ("sample_id", "sequence_id", "k", "query_position", "matched_kmer", "query_kmer", "mismatches", "panel_type", "species_name", "clade", "evidence_rank", "evidence_name")


def read_windows(reads: DataFrame, k_values: Sequence[int], seq_col: str = "seq") -> DataFrame:
    w = seq.multi_k_windows(reads, k_values, seq_col, canonicalise=False, keep=("sample_id", "sequence_id"))
    return w.select("sample_id", "sequence_id", F.col("position").alias("query_position"), "k", F.col("kmer").alias("window_kmer"), seq.canonical(F.col("kmer")).alias("query_kmer"))


def both_strands(panel: DataFrame) -> DataFrame:
    """A panel whose k-mers need not be canonical, with a key per strand; palindromes once."""
    rc = seq.reverse_complement(F.col("kmer"))
    return panel.withColumn("key", F.explode(F.when(rc == F.col("kmer"), F.array("kmer")).otherwise(F.array("kmer", rc))))


def exact_hits(windows: DataFrame, panel: DataFrame, oriented: bool = False) -> DataFrame:
    """Windows equal to a marker. ``oriented``: markers of either strand, the query reported as read."""
    if oriented:
        p = both_strands(panel.withColumn("kmer", F.upper("kmer"))).withColumnRenamed("kmer", "matched_kmer")
        hits = windows.drop("query_kmer").withColumnRenamed("window_kmer", "query_kmer").join(p.withColumnRenamed("key", "query_kmer"), ["k", "query_kmer"])
    else:
        # Only the k-mer is a key, as it has its k: so a panel at rest may stay in its buckets. The difference of k is a condition that Spark makes no key of.
        p = panel.withColumnRenamed("kmer", "matched_kmer").withColumnRenamed("k", "_k")
        hits = windows.drop("window_kmer").join(p, (F.col("query_kmer") == F.col("matched_kmer")) & (F.col("k") - F.col("_k") == 0)).drop("_k")
    return hits.withColumn("mismatches", F.lit(0))


#: Bases that are packed into one long, two bits each.
WORD = 31


def packed(kmer: Column, k: int) -> list[Column]:
    """A k-mer as longs of two bits a base."""
    return [F.conv(F.translate(F.substring(kmer, i + 1, WORD), "ACGT", "0123"), 4, 10).cast("long") for i in range(0, k, WORD)]


def packed_distance(a: Column, b: Column) -> Column:
    """Differing bases of two longs of packed bases."""
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x1555555555555555)))


def _parts(kmer: Column, k: int, n: int) -> list[Column]:
    cuts = [i * k // n for i in range(n + 1)]
    return [F.substring(kmer, a + 1, b - a) for a, b in zip(cuts, cuts[1:])]


def _keys(kmer: Column, k: int, mismatches: int) -> list[Column]:
    """Parts of a k-mer, one of which is the same in any k-mer with so many mismatches."""
    return [F.concat(*(F.substring(kmer, a + 1, b - a) for a, b in kept)) for kept in kept_parts(k, mismatches)]


#: The most k-mers of reads that each task holds an index of.
NEAR = 1 << 19


def near_contigs(windows: DataFrame, contigs: DataFrame, group: str, k: int, mismatches: int) -> DataFrame | None:
    """group, kmer of the contigs' windows with at most ``mismatches`` substitutions from a window of the reads, not distinct: all that a panel of the contigs needs to hold for ``fuzzy_hits`` and ``exact_hits``.
    None where the reads have more than ``NEAR`` distinct k-mers: a panel must hold all of the contigs' k-mers then, and is joined."""
    own = materialise(windows.filter((F.col("k") == k) & (F.length("query_kmer") == k)).select("query_kmer").distinct(), "queries")
    if own.count() > NEAR:
        return None
    return near_kmers(contigs, k, group, [r[0] for r in own.collect()], mismatches)


def fuzzy_hits(windows: DataFrame, panel: DataFrame, mismatches: int = 1, fuzzy_min_k: int = 71, k_values: Sequence[int] | None = None) -> DataFrame:
    """Windows at one (or up to two) substitutions from a marker of the same k, canonical forms compared.

    A k-mer is cut into more parts than there may be mismatches, so of the sets of parts that leave out as many one is free of errors (pigeonhole); candidates come from one equi-join of
    distinct k-mers on (set, content), and a candidate found through several sets is made only by its first equal one. Distances are
    counted on packed bases, then matches go back to the windows that hold the k-mer. The windows' k-mers are broadcast where they are few enough, so that the panel stays
    where it is made. ``k_values``: the panel's k, where they are known; else the panel is read once more for them.
    """
    if mismatches not in (1, 2):
        raise ValueError("one or two mismatches")
    out = None
    known = [r[0] for r in panel.select("k").distinct().collect()] if k_values is None else set(k_values)  # a handful of k
    for k in sorted(k for k in known if k >= fuzzy_min_k):
        p = panel.filter((F.col("k") == k) & (F.length("kmer") == k)).withColumnRenamed("kmer", "matched_kmer").drop("k")
        w = windows.filter(F.col("k") == k).select("sample_id", "sequence_id", "query_position", "query_kmer")
        longs = range(0, k, WORD)

        def side(rows: DataFrame, kmer: str, name: str) -> DataFrame:
            words = [x.alias(f"{name}{i}") for i, x in zip(longs, packed(F.col(kmer), k))]
            return rows.select("*", *words, F.posexplode(F.array(*_keys(F.col(kmer), k, mismatches))).alias("part", "content"))

        apart = sum((packed_distance(F.col(f"q{i}"), F.col(f"m{i}")) for i in longs), F.lit(0)).cast("int")
        own = materialise(w.select("query_kmer").distinct(), "queries")
        pairs = side(broadcast_if_small(own), "query_kmer", "q").join(side(p, "matched_kmer", "m"), ["part", "content"]).withColumn("mismatches", apart)
        pairs = pairs.filter((F.col("mismatches") > 0) & (F.col("mismatches") <= mismatches))
        first = F.lit(None).cast("int")
        for i, (x, y) in reversed(list(enumerate(zip(_keys(F.col("query_kmer"), k, mismatches), _keys(F.col("matched_kmer"), k, mismatches))))):
            first = F.when(x == y, i).otherwise(first)
        pairs = pairs.filter(F.col("part") == first).select("query_kmer", *p.columns, "mismatches")
        hits = w.join(pairs, "query_kmer").withColumn("k", F.lit(k))
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        empty = exact_hits(windows, panel).filter("false")
        return empty
    return out


def screen(windows: DataFrame, panel: DataFrame, mismatches: int = 0, fuzzy_min_k: int = 71) -> DataFrame:
    """Exact and, for long enough k, fuzzy hits."""
    exact = exact_hits(windows, panel)
    return exact.unionByName(fuzzy_hits(windows, panel, mismatches, fuzzy_min_k)) if mismatches else exact


def deduplicate(hits: DataFrame) -> DataFrame:
    return hits.dropDuplicates([c for c in HIT if c in hits.columns])


def filter_panel(panel: DataFrame, species: DataFrame, min_k: int = 0) -> DataFrame:
    """Markers of the listed species (species_name) with at least ``min_k``; no species, no markers."""
    return panel.filter(F.col("k") >= min_k).join(species.select("species_name").distinct(), "species_name", "left_semi")


def rescue_species(evidence: DataFrame, most: int, min_unique: int, min_sequences: int) -> DataFrame:
    """The species with the best support that passes the minima, at most ``most``; ties by name, descending."""
    keys = ("n_positive_sequences", "n_unique_kmers", "best_k", "n_hits", "species_name")
    rows = evidence.filter((F.col("n_unique_kmers") >= min_unique) & (F.col("n_positive_sequences") >= min_sequences))
    best = rows.groupBy("species_name").agg(F.max(F.struct(*keys)).alias("x"))
    return best.orderBy(*(F.desc(f"x.{k}") for k in keys)).limit(most).select("species_name")


def two_stage(windows: DataFrame, panel: DataFrame, species: DataFrame, mismatches: int = 1, fuzzy_min_k: int = 101, k_values: Sequence[int] | None = None) -> DataFrame:
    """Exact hits of all markers, and fuzzy hits of the rescue species only. Windows are written, and broadcast where they are small, so that the panel stays where it is made."""
    windows = materialise(windows, "windows")
    fuzzy = fuzzy_hits(windows, filter_panel(panel, species, fuzzy_min_k), mismatches, fuzzy_min_k, k_values)
    return deduplicate(exact_hits(broadcast_if_small(windows), panel).unionByName(fuzzy))


def merge_markers(panels: Sequence[DataFrame], signature: Sequence[str]) -> DataFrame:
    out = panels[0]
    for p in panels[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(list(signature))


def _hierarchy(modules: DataFrame, fold: dict[str, Column], *columns: Column) -> DataFrame:
    """``columns`` folded from each module's root down to it; modules below an unknown parent or on a cycle are an error."""
    parent = names.blank(F.col("parent_module_id"))
    known = modules.select(F.col("module_id").alias("_up"))
    lost = modules.filter(parent.isNotNull()).join(known, parent == F.col("_up"), "left_anti").select("module_id").limit(3).collect()
    if lost:
        raise ValueError(f"modules with an unknown parent_module_id: {', '.join(r['module_id'] for r in lost)}")
    rooted, unrooted, _ = taxonomy.double(modules.select(F.col("module_id").alias("id"), parent.alias("up"), *columns), fold, label="modules")
    cyclic = unrooted.limit(3).collect()
    if cyclic:
        raise ValueError(f"cyclic module parents: {', '.join(r['id'] for r in cyclic)}")
    return rooted.withColumnRenamed("id", "module_id")


def module_depths(modules: DataFrame) -> DataFrame:
    """module_id, depth (0 for modules without a parent), at any depth."""
    depth = F.when(names.blank(F.col("parent_module_id")).isNull(), 0).otherwise(1)
    return _hierarchy(modules, {"depth": F.col("a.depth") + F.col("b.depth")}, depth.alias("depth"))


def gate_summary(hits: DataFrame, by: Sequence[str] = ("module_id",)) -> DataFrame:
    return hits.groupBy(*by).agg(F.count("*").alias("n_hits"), F.count_distinct("matched_kmer").alias("n_kmers"), F.count_distinct("sequence_id").alias("n_sequences"), F.count_distinct("k").alias("n_k"), F.max("k").alias("best_k"))


def activate(modules: DataFrame, gates: DataFrame, min_kmers: int, min_sequences: int, fail_open: bool = False) -> DataFrame:
    """Per module whether its panel is used, and why: its gate passes and so do those of all its ancestors, however deep it lies.

    ``modules``: module_id, parent_module_id, has_gate; ``gates``: a gate summary per module. An unknown parent or a cycle is an error.
    """
    m = modules.join(gates, "module_id", "left")
    passes = (F.coalesce("n_kmers", F.lit(0)) >= min_kmers) & (F.coalesce("n_sequences", F.lit(0)) >= min_sequences)
    root = names.blank(F.col("parent_module_id")).isNull()
    own = (~F.col("has_gate") & root) | (F.col("has_gate") & passes)
    m = materialise(m.select("module_id", "parent_module_id", "has_gate", own.alias("own")), "modules")  # the gates are counted once
    # ``open``: the module and all its ancestors pass by themselves; ``above``: its ancestors do.
    fold = {"depth": F.col("a.depth") + F.col("b.depth"), "open": F.col("a.open") & F.col("b.open"), "above": F.col("a.above") & F.col("b.open")}
    out = _hierarchy(m, fold, F.when(root, 0).otherwise(1).alias("depth"), F.col("own").alias("open"), F.lit(True).alias("above"), "own", "has_gate")
    out = out.withColumn("barred", ~F.col("above"))
    reason = F.when(F.col("barred"), "parent_not_active").when(F.col("own") & F.col("has_gate"), "gate_passed").when(F.col("own"), "root_without_gate").otherwise("gate_below_threshold")
    active = F.col("own") & ~F.col("barred")
    out = out.select("module_id", "depth", active.alias("active"), reason.alias("reason"))
    if fail_open:
        none = out.groupBy().agg(F.max(F.col("active").cast("int")).alias("any"))
        weak = gates.groupBy().agg(F.coalesce(F.sum("n_kmers"), F.lit(0)).alias("signal"))
        opened = out.crossJoin(none).crossJoin(weak).filter("any = 0 and signal > 0").select("module_id", "depth", F.lit(True).alias("active"), F.lit("fail_open_weak_gate_signal").alias("reason"))
        out = out.unionByName(opened)
    return out


def hierarchical(windows: DataFrame, gate_markers: DataFrame, module_markers: DataFrame, modules: DataFrame, min_kmers: int = 3, min_sequences: int = 2, fail_open: bool = False) -> DataFrame:
    """Gate hits of all modules, plus hits on the panels of active ones; distinct. Markers carry module_id."""
    gate_hits = exact_hits(windows, gate_markers)
    state = activate(modules, gate_summary(gate_hits), min_kmers, min_sequences, fail_open)
    active = state.filter("active").select("module_id").distinct()
    hits = gate_hits.unionByName(exact_hits(windows, module_markers.join(active, "module_id", "left_semi")))
    return deduplicate(hits.drop("module_id"))


def complete_species(evidence: DataFrame, species: DataFrame) -> DataFrame:
    """Zero rows for panel species that a sample doesn't show; both sides are small tables of labels."""
    samples = evidence.select("sample_id").distinct()
    grid = samples.crossJoin(broadcast_if_small(materialise(species.select("species_name").distinct(), "species")))
    counts = [c for c, t in evidence.dtypes if t in ("int", "bigint")]
    return grid.join(evidence, ["sample_id", "species_name"], "left").na.fill(0, counts)


def multi_window(reads: DataFrame, k_values: Sequence[int], *keep: str) -> DataFrame:
    """Windows of reads with further columns kept, for streams with an event time."""
    w = seq.multi_k_windows(reads, k_values, canonicalise=True, keep=("sample_id", "sequence_id", *keep))
    return w.withColumnRenamed("kmer", "query_kmer").withColumnRenamed("position", "query_position")
