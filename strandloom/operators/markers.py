"""Marker selection spread over genomes, and the greedy choices that depend on order.

Quotas and caps are ranks in windows. Two selections are greedy along an order; neighbours are found by joins on bins, and rounds over all
buckets at once decide what a loop along the order would, so no task holds a bucket.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, seq
from ..scratch import broadcast_if_small, materialise
from . import panel, windows


# Build profiles with their order of k, distance between markers of different k, and quota per bin by k.
PROFILES = {
    "default": ("long_to_short", 5000, {}),
    "raw_ont_balanced": ("short_to_long", 5000, {}),
    "raw_ont_multik_balanced": ("input", 0, {51: 3, 77: 3, 101: 2, 151: 2}),
    "raw_ont_multik_locus_balanced": ("input", 250, {51: 3, 77: 3, 101: 2, 151: 2}),
    "raw_ont_lod_balanced": ("input", 150, {51: 4, 77: 6, 101: 4, 151: 1}),
}
STRATEGIES = ("first_seen", "genome_spread", "independent_multik_genome_spread")


@dataclass(frozen=True)
class Selection:
    """How markers are chosen: strategy, cap per bucket and k, bin size, quota per bin (also by k), distance across k."""

    strategy: str = "independent_multik_genome_spread"
    cap: int | None = None
    bin_size: int = 10_000
    quota: int = 10
    quota_by_k: Mapping[int, int] = field(default_factory=dict)
    distance: int = 5000

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}")
        sizes = {"cap": 1 if self.cap is None else self.cap, "bin_size": self.bin_size, "quota": self.quota} | {f"quota of k = {k}": q for k, q in self.quota_by_k.items()} | {f"k = {k}": k for k in self.quota_by_k}
        wrong = [name for name, n in sizes.items() if n <= 0]
        if wrong or self.distance < 0:
            raise ValueError(f"not positive: {', '.join(wrong) or 'distance'}")

    def quota_of(self, k: Column) -> Column:
        out = F.lit(self.quota)
        for value, quota in self.quota_by_k.items():
            out = F.when(k == value, quota).otherwise(out)
        return out


def parse_quotas(spec: str | None) -> dict[int, int]:
    """``"51:4,77:3"`` as a mapping from k to its quota; null and blank give none."""
    out = {}
    for part in filter(None, map(str.strip, (spec or "").split(","))):
        k, colon, quota = part.partition(":")
        if not colon or not k.strip().isdigit() or not quota.strip().isdigit() or not int(k) or not int(quota):
            raise ValueError(f"not a pair of positive numbers k:quota: {part!r}")
        out[int(k)] = int(quota)
    return out


def resolve_profile(profile: str, k_values: Sequence[int], order: str = "auto", distance: int | None = None, quotas: str | None = None) -> tuple[list[int], int, dict[int, int]]:
    """(k in the order of sampling, distance, quotas by k) of a build profile; what is given explicitly goes before."""
    if profile not in PROFILES or order not in ("auto", "long_to_short", "short_to_long", "input"):
        raise ValueError(f"unknown profile or order: {profile}, {order}")
    if distance is not None and distance < 0:
        raise ValueError("distance must not be negative")
    own_order, own_distance, own_quotas = PROFILES[profile]
    order, ks = own_order if order == "auto" else order, list(dict.fromkeys(k_values))
    ks = ks if order == "input" else sorted(ks, reverse=order == "long_to_short")
    return ks, own_distance if distance is None else distance, parse_quotas(quotas) or dict(own_quotas)


def select_markers(markers: DataFrame, bucket: Sequence[str], selection: Selection) -> DataFrame:
    """Markers (bucket columns, genome, doc_id, k, position, kmer, score) by the selection's strategy."""
    if selection.strategy == "first_seen":
        if selection.cap is None:
            return markers
        place = F.row_number().over(Window.partitionBy(*bucket, "k").orderBy("kmer", "genome", "doc_id", "position"))
        return markers.withColumn("_r", place).filter(F.col("_r") <= selection.cap).drop("_r")
    rows = markers.withColumn("bin", F.floor(F.greatest(F.col("position"), F.lit(0)) / selection.bin_size).cast("long"))
    quota = selection.quota_of(F.col("k"))
    if selection.strategy == "genome_spread":
        return spread_markers(rows, bucket, quota, selection.cap)
    return independent_markers(rows, bucket, quota, selection.cap or 2**31 - 1, selection.distance)


def capped_panel(markers: DataFrame, bucket: Sequence[str], selection: Selection | None, order: Sequence[str] = ("kmer",), candidates: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(panel, summary per bucket: candidates, written, left_out) of markers; without a selection all are written and none counts as left out. ``candidates`` (bucket columns,
    candidates): how many there are, where ``markers`` holds only those that may be selected."""
    kept = markers if selection is None else select_markers(markers, bucket, selection).select(markers.columns)
    kept = materialise(kept.orderBy(*bucket, *order), "panel")
    count = lambda df, name: df.groupBy(*bucket).agg(F.count("*").alias(name))
    keys = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in bucket]
    both = (count(markers, "candidates") if candidates is None else candidates).alias("a").join(count(kept, "written").alias("b"), reduce(and_, keys), "left")
    written = F.coalesce("written", F.lit(0))
    return kept, both.select(*(F.col(f"a.{c}").alias(c) for c in bucket), "candidates", written.alias("written"), (F.col("candidates") - written).alias("left_out"))


def spread_markers(markers: DataFrame, bucket: Sequence[str], quota: int | Column, cap: int | None) -> DataFrame:
    """Per (bucket, k, bin) the ``quota`` lowest scores; over ``cap`` per bucket, first each bin's best, then by score."""
    by_bin = Window.partitionBy(*bucket, "k", "bin").orderBy("score", "kmer")
    rows = markers.withColumn("_r", F.row_number().over(by_bin)).filter(F.col("_r") <= quota)
    if cap is not None:
        order = Window.partitionBy(*bucket, "k").orderBy((F.col("_r") > 1).cast("int"), "score", "bin", "kmer")
        rows = rows.withColumn("_c", F.row_number().over(order)).filter(F.col("_c") <= cap).drop("_c")
    return rows.drop("_r")


def sample_universe(observations: DataFrame, bin_size: int, quota: int, k_values: Sequence[int]) -> DataFrame:
    """Positional sample without spacing: the first ``quota`` windows per (genome, k, contig, bin)."""
    b = scores.shifted_bin(F.col("position"), F.col("k"), k_values, bin_size)
    place = F.row_number().over(Window.partitionBy("genome", "k", "doc_id", "bin").orderBy("position"))
    return observations.withColumn("bin", b).withColumn("_r", place).filter(F.col("_r") <= quota).drop("_r")


def sample_sequences(contigs: DataFrame, bin_size: int, quota: int, k_values: Sequence[int], keep: Sequence[str] = ("doc_id", "genome")) -> DataFrame:
    """``sample_universe`` of all windows of the sequences: each task makes only windows that are among the first of their bin in their own sequence."""
    rows = [windows.first_windows(contigs, k, bin_size, scores.bin_offsets(k_values, bin_size)[k], quota, keep) for k in dict.fromkeys(k_values)]
    return sample_universe(reduce(DataFrame.unionByName, rows), bin_size, quota, k_values)


def scored_sequences(contigs: DataFrame, bin_size: int, quota: int, k_values: Sequence[int], by_score: bool = True) -> DataFrame:
    """genome, doc_id, k, position, kmer, bin, score: each (genome, k, k-mer, bin) of the sequences at its first contig and position, so far as it may be among the ``quota``
    lowest scores of its (genome, k, bin), or else (not ``by_score``) among the first ``quota`` k-mers of its (genome, k). All windows are looked at; the others never leave their task."""
    shifts = scores.bin_offsets(k_values, bin_size)
    shifts = {k: shifts[k] for k in dict.fromkeys(k_values)}
    if by_score:
        rows = windows.scored_kmers(contigs, shifts, "genome", "doc_id", bin_size, quota)
    else:
        rows = reduce(DataFrame.unionByName, (windows.leading_kmers(contigs, k, "genome", "doc_id", bin_size, shift, quota) for k, shift in shifts.items()))
    first = rows.groupBy("genome", "k", "kmer", "bin").agg(F.min(F.struct("doc_id", "position")).alias("at"))
    return first.select("genome", "at.doc_id", "k", "at.position", "kmer", "bin", seq.marker_score(F.col("genome"), F.col("kmer")).alias("score"))


def count_candidates(contigs: DataFrame, bin_size: int, k: int, seq_col: str = "seq") -> DataFrame:
    """genome, candidates: distinct (k-mer, bin) of all windows of each genome. Sequences are cut at their bins, so that a k-mer's sources are a genome's bins; none is written."""
    pieces = F.regexp_extract_all(seq_col, F.lit(f"(?s)(?=(.{{1,{bin_size + k - 1}}})).{{1,{bin_size}}}"), F.lit(1))
    rows = contigs.select("genome", F.posexplode(pieces).alias("bin", seq_col))
    return panel.count_sources(rows, k, ("genome", "bin"), seq_col=seq_col)[0].groupBy("genome").agg(F.sum("n_kmers").alias("candidates"))


def near_pairs(left: DataFrame, right: DataFrame, scope: Sequence[str], distance: int, longest: int) -> DataFrame:
    """Pairs (l., r.) of windows of different k on one ``scope`` that overlap or have fewer than ``distance`` bases between them.

    Both sides have the scope's columns, k (at most ``longest``) and position. Starts of such pairs lie in the same or in neighbouring bins of that reach, so it is an equi-join on scope and
    bin; only the right side is dealt to three bins.
    """
    reach = distance + longest
    bin_ = F.floor(F.greatest("position", F.lit(0)) / reach).cast("long")
    one = left.withColumn("_bin", bin_).alias("l")
    three = right.withColumn("_bin", F.explode(F.array(bin_ - 1, bin_, bin_ + 1))).alias("r")
    start = lambda side: F.greatest(F.col(f"{side}.position"), F.lit(0))
    near = (start("r") < start("l") + F.col("l.k") + distance) & (start("l") < start("r") + F.col("r.k") + distance)
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in scope]
    return one.join(three, reduce(and_, same, (F.col("l._bin") == F.col("r._bin")) & (F.col("l.k") != F.col("r.k")) & near))


def sample_universe_spaced(observations: DataFrame, bin_size: int, quota: int, k_values: Sequence[int], distance: int, k_order: Sequence[int] | None = None) -> DataFrame:
    """The same with spacing: in order of contig, k and position, a window is taken if its bin has room and no
    window of another k that was taken on the contig is nearer than ``distance``.

    One k after the other, as in that order; of each, the windows near to taken ones go, and the first of each bin stay. A bin's windows are ranked
    with a limit, so that a task keeps no more of them than the quota.
    """
    rows = observations.select("genome", "doc_id", "k", "position", "kmer")
    scope, taken = ("genome", "doc_id"), None
    for k in k_order or sorted(k_values, reverse=True):
        own = rows.filter(F.col("k") == k).withColumn("_bin_", scores.shifted_bin(F.col("position"), F.col("k"), k_values, bin_size))
        if taken is not None:
            hit = near_pairs(own, taken, scope, distance, max(k_values)).select(*(F.col(f"l.{c}") for c in (*scope, "position"))).distinct()
            same = [F.col(f"o.{c}").eqNullSafe(F.col(f"h.{c}")) for c in (*scope, "position")]
            own = own.alias("o").join(hit.alias("h"), reduce(and_, same), "left_anti")
        place = F.row_number().over(Window.partitionBy(*scope, "_bin_").orderBy("position"))
        own = materialise(own.withColumn("_r", place).filter(F.col("_r") <= quota).select(*rows.columns), f"taken-{k}")
        taken = own if taken is None else taken.unionByName(own)
    return taken


def sample_sequences_spaced(contigs: DataFrame, bin_size: int, quota: int, k_values: Sequence[int], distance: int, k_order: Sequence[int] | None = None) -> DataFrame:
    """``sample_universe_spaced`` of all windows of the sequences: for each k, contigs get the places that taken windows bar, and each task makes only windows that are among the
    first of their bin in their own sequence."""
    scope, columns, taken, shifts = ("genome", "doc_id"), ("genome", "doc_id", "k", "position", "kmer"), None, scores.bin_offsets(k_values, bin_size)
    for k in k_order or sorted(k_values, reverse=True):
        own = contigs.select(*scope, "seq")
        if taken is not None:
            span = F.struct((F.col("position") - (k + distance - 1)).cast("long").alias("first"), (F.col("position") + F.col("k") + (distance - 1)).cast("long").alias("last"))
            spans = taken.groupBy(*scope).agg(F.collect_list(span).alias("_spans"))
            same = [F.col(f"c.{c}").eqNullSafe(F.col(f"t.{c}")) for c in scope]
            own = own.alias("c").join(spans.alias("t"), reduce(and_, same), "left").select("c.*", "t._spans")
        rows = windows.first_windows(own, k, bin_size, shifts[k], quota, scope, barred=None if taken is None else "_spans")
        rows = sample_universe(rows, bin_size, quota, k_values)
        rows = materialise(rows.select(*columns), f"taken-{k}")
        taken = rows if taken is None else taken.unionByName(rows)
    return taken


def _refused(pairs: DataFrame) -> DataFrame:
    """Of pairs (later, earlier) in one total order, the ids that a loop along that order refuses because an earlier one that it took is near.

    Rounds: whoever has no earlier one left is taken, and refuses its later ones, which refuse no one any more.
    """
    refused, turn = None, 0
    while True:
        turn += 1
        first = pairs.select("earlier").distinct().join(pairs.select(F.col("later").alias("earlier")).distinct(), "earlier", "left_anti")
        now = materialise(pairs.join(first, "earlier", "left_semi").select(F.col("later").alias("id")).distinct(), f"refused-{turn}")
        refused = now if refused is None else refused.union(now)
        gone = now.select(F.col("id").alias("later"))
        pairs = materialise(pairs.join(gone, "later", "left_anti").join(gone.withColumnRenamed("later", "earlier"), "earlier", "left_anti"), f"pairs-{turn}")
        if pairs.isEmpty():
            return refused


def independent_markers(markers: DataFrame, bucket: Sequence[str], quota: int | Column, cap_per_k: int, distance: int) -> DataFrame:
    """Quota per bin, then per bucket greedily by (score, longer k first, k-mer, place): at most ``cap_per_k`` per k and no two of
    different k within ``distance`` on one (genome, contig).

    Equal to a loop along that order, but without one: pairs that are too near are found by a join, and rounds of local minima decide
    them (``_refused``). Where a k then has more than its cap, its markers after the cap's one never counted: they go, in each bucket the k that is full
    first, and the pairs are decided anew, at most once for each k.
    """
    by_bin = Window.partitionBy(*bucket, "k", "bin").orderBy("score", "kmer")
    rows = markers.withColumn("_r", F.row_number().over(by_bin)).filter(F.col("_r") <= quota).drop("_r")
    out = rows.columns
    rows = materialise(rows.withColumn("_id", F.monotonically_increasing_id()), "markers")  # ids hold as they are written
    k_values = [r[0] for r in rows.select("k").distinct().collect()]  # a handful of k
    if not k_values:
        return rows.select(out)
    order = F.struct("score", (-F.col("k")).alias("_k"), "kmer", "doc_id", "position", "genome", "_id")
    rows = materialise(rows.withColumn("_order", order), "ordered")
    scope = list(dict.fromkeys([*bucket, "genome", "doc_id"]))
    side = rows.select(*scope, "k", "position", "_id", "_order")
    pairs = near_pairs(side, side, scope, distance, max(k_values)).filter(F.col("r._order") < F.col("l._order"))
    pairs = materialise(pairs.select(F.col("l._id").alias("later"), F.col("r._id").alias("earlier")), "pairs")
    while True:
        refused = _refused(pairs)
        taken = rows.join(refused.select(F.col("id").alias("_id")), "_id", "left_anti")
        # The cap-th of each k, where there are more; the k of each bucket that reaches its cap first.
        ranked = taken.withColumn("_n", F.row_number().over(Window.partitionBy(*bucket, "k").orderBy("_order"))).filter(F.col("_n") <= cap_per_k + 1)
        full = ranked.groupBy(*bucket, "k").agg(F.max("_n").alias("_n"), F.max(F.when(F.col("_n") == cap_per_k, F.col("_order"))).alias("_last")).filter(F.col("_n") > cap_per_k)
        full = materialise(full.groupBy(*bucket).agg(F.min(F.struct("_last", "k")).alias("x")).select(*(F.col(c).alias(f"_b{i}") for i, c in enumerate(bucket)), F.col("x.k").alias("_full_k"), F.col("x._last").alias("_last")), "full")
        if full.isEmpty():
            return taken.select(out)
        same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(bucket)), (F.col("k") == F.col("_full_k")) & (F.col("_order") > F.col("_last")))
        rows = materialise(rows.join(broadcast_if_small(full), same, "left_anti"), "open")
        for end in ("later", "earlier"):
            pairs = pairs.join(rows.select(F.col("_id").alias(end)), end, "left_semi")
        pairs = materialise(pairs, "pairs")
