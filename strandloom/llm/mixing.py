"""Mixing sources to target weights: capped water-filling over sources, seeded repetitions of documents.

Sources share ``share`` times all sizes by weight. Sources whose part exceeds ``max_epochs`` times their
size are clamped there and the excess goes to the others by weight, until none exceeds its cap. A source
whose target is e times its size takes each document floor(e) times, and the fractional rest once more for
documents in seeded random order until the target is reached; the document at the target gives the words
that are still missing, so a source's words equal its target, rounded.

Sizes are words ``[^\\x20\\x09-\\x0D]+``; null text has none. Source null is a source of its own, last.
Ranks inside a source come from counts per hash bucket and order inside a bucket, so no task sees a whole
source. The number of sources must be small enough for one task to rank them (they are aggregates).
Repeated rows count each; rows that share a doc_id are ordered by size, rows without one by their text's hash. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, fresh_name, materialise

WORD = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of a hash bucket: 4096 buckets a source.
DIGITS = 3


def words(text: Column) -> Column:
    """Number of words: each becomes one letter, then white space goes; no list of words is built."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.length(F.translate(F.regexp_replace(text, WORD, "w"), " \t\n\x0b\f\r", "")).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """The text up to its n-th word's end."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), n.cast("int")), "")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """(source, source_size, target) from (source, size): rounds of clamping until no target exceeds its cap."""
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights)).cast("int") + 1)
    state = materialise(per.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(max_epochs)).alias("cap")), "sources")
    budget = share * (state.agg(F.sum("source_size")).first()[0] or 0)
    clamped = state.withColumn("clamped", F.lit(False))
    done = state.withColumn("target", F.lit(0.0))
    for _ in range(state.count() + 1):
        free = clamped.agg(F.sum(F.when(F.col("clamped"), F.col("cap"))).alias("used"), F.sum(F.when(~F.col("clamped"), F.col("weight"))).alias("weight")).first()
        left, weight = budget - (free["used"] or 0.0), free["weight"]
        part = F.col("weight") * left / weight if weight else F.col("cap")
        done = clamped.withColumn("target", F.when(F.col("clamped"), F.col("cap")).otherwise(part))
        over = ~F.col("clamped") & (F.col("target") > F.col("cap"))
        if done.filter(over).isEmpty():
            break
        clamped = materialise(done.withColumn("clamped", F.col("clamped") | over).drop("target"), "clamped")
    return done.select("source", "source_size", "target")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    size: Callable[[Column], Column] = words,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target (its source's), taken (words, repeats counted)."""
    # Rows without an id are drawn by their text, so that they don't share one bucket.
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))))
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), name))
    rows = materialise(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size(F.col(text_col)).alias("size"), draw.alias("draw")), "sizes")
    targets = materialise(source_targets(rows, weights, share, max_epochs), "targets")
    bucket = F.substring("draw", 1, DIGITS)
    buckets = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = materialise(buckets.select(F.col("source").alias("of"), F.col("bucket").alias("in"), ahead.alias("ahead")), "buckets")
    inside = Window.partitionBy("source", "bucket").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("bucket", bucket).withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(broadcast_if_small(buckets), F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("in")))
    targets = targets.withColumnRenamed("source", "from")
    rows = rows.join(broadcast_if_small(targets), F.col("source").eqNullSafe(F.col("from")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.round(F.col("target") - whole * F.col("source_size")).cast("long")
    extra = F.least(F.greatest(rest - F.col("ahead") - F.col("inside"), F.lit(0)), F.col("size"))
    return rows.select("doc_id", "source", "size", "source_size", "target", (whole * F.col("size") + extra).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str | None = "n_chars", **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, all columns kept; the one at its source's target with its first words only.

    A document without words is taken once, as it costs nothing. ``n_chars_col``, if present, follows the text.
    """
    plan = mix(docs, id_col=id_col, text_col=text_col, **options)
    key, taken = fresh_name(docs, "mix_id"), fresh_name(docs, "mix_taken")
    # Rows that share a doc_id share its words: the plan is summed by doc_id and dealt out evenly.
    plan = materialise(plan.groupBy("doc_id").agg(F.sum("taken").alias(taken), F.sum("size").alias("sizes"), F.count("*").alias("rows")).withColumnRenamed("doc_id", key), "plan")
    n = words(F.col(text_col))
    rows = docs.join(broadcast_if_small(plan), F.col(id_col).eqNullSafe(F.col(key)))
    size, part = fresh_name(docs, "mix_size"), fresh_name(docs, "mix_part")
    rows = rows.withColumn(size, n).withColumn(taken, F.when(F.col("rows") == 1, F.col(taken)).otherwise(F.floor(F.col(taken) * F.col(size) / F.greatest("sizes", F.lit(1)))))
    copies = F.when(F.col(size) == 0, F.array(F.lit(-1).cast("long"))).otherwise(
        F.concat(F.array_repeat(F.lit(-1).cast("long"), (F.col(taken) / F.col(size)).cast("int")), F.filter(F.array((F.col(taken) % F.col(size)).cast("long")), lambda x: x > 0))
    )
    rows = rows.withColumn(part, F.explode(copies))
    rows = rows.withColumn(text_col, F.when(F.col(part) < 0, F.col(text_col)).otherwise(first_words(F.col(text_col), F.col(part))))
    if n_chars_col and n_chars_col in docs.columns:
        rows = rows.withColumn(n_chars_col, F.when(F.col(part) < 0, F.col(n_chars_col)).otherwise(F.length(text_col).cast("long")))
    return rows.select(*docs.columns)

