"""Sharding by a k-d tree over metadata: recursive splits at distributed weighted medians.

Rows with equal texts form a group that stays together; a group weighs its rows' sizes (UTF-8 bytes of the
text, null: none, plus a fixed 8). Law ``bytes``: shards have nearly equal sizes. Groups are points in metadata
space (first doc_id, size, text hash). From the root down, a node that stands for several shards is split along its
widest dimension, relative to the whole table, where the weight below is what its first half of shards
still lacks, until each leaf is one shard. All nodes of a level are split in the same jobs: weighted histograms per
node, refined inside the bin that holds the cut until the bin is one point; only what lies in that bin is
read again. One row per node reaches the driver.

Groups heavier than a whole shard (fewer than there are shards) cannot be halved by a cut; they are laid on the emptiest
shard, largest first, and the tree gives the rest to what the shards still lack. A cut misses its goal by half a group's weight at most;
where leaves differ by more than 1/EVEN of a shard for that reason, groups of at least that weight (at most ``shards * EVEN``) move or change
places between the fullest and the emptiest shard as long as that brings the two nearer together. A table of many light groups has nothing to move.

A group larger than a shard stays whole, so its shard is then larger than the others. Null doc_ids count
as -1 for the metadata only. Empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise

OVERHEAD = 8
#: Shards may differ by 1/EVEN of their size.
EVEN = 40
BINS = 1 << 16
DIMENSIONS = ("d0", "d1", "d2")


def _groups(docs: DataFrame) -> DataFrame:
    """One row per text: digest, weight, and the dimensions as distinct 62-bit codes (value, then a hash)."""
    tie = F.conv(F.substring("digest", 1, 5), 16, 10).cast("long")
    code = lambda value: F.shiftleft(F.greatest(value, F.lit(-1)) + 1, 20) + tie
    per = docs.groupBy("digest").agg(F.sum("size").alias("weight"), F.min(F.coalesce("doc_id", F.lit(-1))).alias("first"), F.max("size").alias("one"))
    return per.select(
        "digest", "weight",
        code(F.least("first", F.lit(2**41))).alias("d0"),
        code(F.least("one", F.lit(2**41))).alias("d1"),
        F.conv(F.substring("digest", 1, 15), 16, 10).cast("long").alias("d2"),
    )


def _lay(heavy: list[tuple[str, int]], total: int, shards: int) -> tuple[list[int], dict[str, int]]:
    """Heavy groups on the emptiest shard, largest first: weight laid per shard, shard per group."""
    laid, at = [0] * shards, {}
    for digest, weight in sorted(heavy, key=lambda x: (-x[1], x[0])):
        i = min(range(shards), key=lambda s: (laid[s], s))
        laid[i] += weight
        at[digest] = i
    return laid, at


def _wants(laid: list[int], rest: int) -> list[float]:
    """What each shard takes of the rest so that all reach one level; shards above it take nothing."""
    order = sorted(laid)
    level = 0.0
    for k in range(1, len(order) + 1):
        level = (rest + sum(order[:k])) / k
        if k == len(order) or level <= order[k]:
            break
    return [max(0.0, level - x) for x in laid]


def _cuts(points: DataFrame, goals: dict[int, float], bounds: dict[int, tuple[int, int]]) -> dict[int, int]:
    """Per node the code up to which points go left, so that their weight is nearest to the goal.

    ``points``: node, code, weight. Rounds of histograms with BINS bins per node, each inside the last bin.
    """
    spark = points.sparkSession
    low, high = ({n: bounds[n][i] for n in goals} for i in (0, 1))
    left, cut = dict(goals), {}
    while True:
        open_ = [(n, low[n], high[n], -(-(high[n] - low[n] + 1) // BINS), float(left[n])) for n in goals if n not in cut]
        frame = F.broadcast(spark.createDataFrame(open_, "node int, low long, high long, step long, goal double"))
        bin_ = F.floor((F.col("code") - F.col("low")) / F.col("step")).cast("long")
        bins = points.join(frame, "node").filter("code between low and high").groupBy("node", "goal", bin_.alias("bin")).agg(F.sum("weight").alias("w"))
        upto = F.sum("w").over(Window.partitionBy("node").orderBy("bin"))
        first = bins.withColumn("upto", upto).filter("upto >= goal").groupBy("node").agg(F.min_by(F.struct("bin", "w", "upto"), "bin").alias("x"))
        found = {r["node"]: r["x"] for r in first.collect()}  # one row a node
        for n, a, _, step, goal in open_:
            if n not in found:
                cut[n] = high[n]
                continue
            b, w, upto_ = found[n]
            if step == 1:
                cut[n] = a + b if upto_ - goal <= goal - (upto_ - w) else a + b - 1
            else:
                low[n], high[n], left[n] = a + b * step, min(high[n], a + (b + 1) * step - 1), goal - (upto_ - w)
        if len(cut) == len(goals):
            return cut
        ends = F.broadcast(spark.createDataFrame([(n, low[n], high[n]) for n in goals if n not in cut], "node int, low long, high long"))
        points = materialise(points.join(ends, "node").filter("code between low and high").select("node", "code", "weight"), "bin")


def _even(sizes: list[int], heavy: list[tuple[str, int, int]], limit: float) -> dict[str, int]:
    """Groups (digest, weight, shard) that change their shard so that the largest and the smallest size differ by ``limit`` at most, if they can."""
    sizes, moved = list(sizes), {}
    of: list[dict[str, int]] = [{} for _ in sizes]
    for digest, weight, shard_ in heavy:
        of[shard_][digest] = weight
    for _ in range(20 * len(heavy)):
        full, empty = max(range(len(sizes)), key=sizes.__getitem__), min(range(len(sizes)), key=sizes.__getitem__)
        gap = sizes[full] - sizes[empty]
        if gap <= limit:
            break
        # One group from the fullest to the emptiest shard, for none or a lighter one in return.
        back = [(0, None), *((w, d) for d, w in of[empty].items())]
        best = min(((abs(gap - 2 * (w - v)), d, e) for d, w in of[full].items() for v, e in back if 0 < w - v < gap), key=lambda x: (x[0], x[1], x[2] or ""), default=None)
        if best is None:
            break
        for digest, a, b in ((best[1], full, empty), (best[2], empty, full)):
            if digest is not None:
                of[b][digest] = of[a].pop(digest)
                sizes[a] -= of[b][digest]
                sizes[b] += of[b][digest]
                moved[digest] = b
    return moved


def _tree(light: DataFrame, wants: list[float]) -> tuple[DataFrame, dict[int, int]]:
    """Points with their leaf (column ``node``), and the shard of each leaf. ``light``: digest, weight and the dimensions."""
    light = light.withColumn("node", F.lit(0))
    nodes: dict[int, range] = {0: range(len(wants))}
    whole = None
    while any(len(s) > 1 for s in nodes.values()):
        spans = (f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("min", F.min), ("max", F.max)))
        here = {r["node"]: r for r in light.groupBy("node").agg(F.sum("weight").alias("w"), *spans).collect()}  # one row a node
        if not here:
            break
        whole = whole or here[0]
        split = {n: s for n, s in nodes.items() if len(s) > 1 and n in here}
        if not split:
            break
        wide = {n: max(DIMENSIONS, key=lambda d: (here[n][f"max_{d}"] - here[n][f"min_{d}"]) / max(1, whole[f"max_{d}"] - whole[f"min_{d}"])) for n in split}
        spark = light.sparkSession
        # One row a node that is split, joined rather than put into one expression, whose depth would be the number of shards.
        along = F.broadcast(spark.createDataFrame([(n, DIMENSIONS.index(d)) for n, d in wide.items()], "node int, along int"))
        code = F.lit(None).cast("long")
        for i, d in enumerate(DIMENSIONS):
            code = F.when(F.col("along") == i, F.col(d)).otherwise(code)
        light = light.join(along, "node", "left")
        points = light.withColumn("code", code)
        # A node's weight may differ a little from what its shards want; the cut shares it in proportion.
        goals = {n: here[n]["w"] * (sum(wants[i] for i in s[: len(s) // 2]) / (sum(wants[i] for i in s) or 1.0)) for n, s in split.items()}
        cuts = _cuts(points.select("node", "code", "weight"), goals, {n: (here[n][f"min_{wide[n]}"], here[n][f"max_{wide[n]}"]) for n in split})
        fresh = {n: s for n, s in nodes.items() if n not in split and len(s) == 1}
        ends, free = [], max([*nodes, *fresh]) + 1
        for n, s in split.items():
            fresh |= {free: s[: len(s) // 2], free + 1: s[len(s) // 2 :]}
            ends.append((n, cuts[n], free, free + 1))
            free += 2
        ends = F.broadcast(spark.createDataFrame(ends, "node int, cut long, left int, right int"))
        node = F.coalesce(F.when(F.col("code") <= F.col("cut"), F.col("left")).otherwise(F.col("right")), F.col("node"))
        nodes = fresh
        light = materialise(points.join(ends, "node", "left").withColumn("node", node).drop("code", "along", "cut", "left", "right"), "level")
    return light, {n: s[0] for n, s in nodes.items()}


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot (gapless from 0 in its shard)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("digest"))
    rows = materialise(rows, "rows")
    groups = materialise(_groups(rows), "groups")
    total = groups.agg(F.sum("weight")).first()[0] or 0
    giant = F.col("weight") * shards > total
    laid, at = _lay([(r["digest"], r["weight"]) for r in groups.filter(giant).select("digest", "weight").collect()], total, shards)  # fewer rows than shards
    light, leaves = _tree(groups.filter(~giant), _wants(laid, total - sum(laid)))
    of = F.broadcast(spark.createDataFrame(list(leaves.items()), "node int, shard int"))  # one row a shard
    light = light.join(of, "node").select("digest", "weight", "shard")
    sizes = list(laid)
    for r in light.groupBy("shard").agg(F.sum("weight").alias("w")).collect():  # one row a shard
        sizes[r["shard"]] += r["w"]
    if max(sizes) - min(sizes) > total / (shards * EVEN):
        heavy = light.filter(F.col("weight") * (shards * EVEN) >= total).orderBy("digest").collect()  # at most shards * EVEN rows
        at |= _even(sizes, [tuple(r) for r in heavy], total / (shards * EVEN))
    placed = light.select("digest", "shard")
    if at:
        fixed = spark.createDataFrame(list(at.items()), "digest string, shard int")
        placed = placed.join(F.broadcast(fixed), "digest", "left_anti").union(fixed)
    placed = rows.join(placed, "digest")

    # Slots: counts per bucket of a shard, then order inside the bucket.
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(4096)))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = materialise(counts.select("shard", "bucket", ahead.alias("ahead")), "slots")
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "digest")) - 1
    out = placed.withColumn("rank", rank).join(broadcast_if_small(counts), ["shard", "bucket"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") + F.col("ahead")).cast("long").alias("slot"))
