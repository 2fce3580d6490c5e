"""Interval, bin and score arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def interval_gap(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    return F.greatest(F.lit(0), F.greatest(start_a, start_b) - F.least(end_a, end_b))


def padded_overlap(start_a: Column, end_a: Column, start_b: Column, end_b: Column, pad: int) -> Column:
    return (start_a < end_b + pad) & (end_a > start_b - pad)


def bin_offsets(k_values: Sequence[int], bin_size: int) -> dict[int, int]:
    """Per k, the shift of its bins: its rank among the distinct k, in parts of a bin."""
    ks = sorted(set(k_values))
    return {k: i * bin_size // len(ks) for i, k in enumerate(ks)}


def shifted_bin(position: Column, k: Column, k_values: Sequence[int], bin_size: int) -> Column:
    offset = F.lit(0)
    for key, value in bin_offsets(k_values, bin_size).items():
        offset = F.when(k == key, value).otherwise(offset)
    return F.floor((F.greatest(position, F.lit(0)) + offset) / bin_size).cast("long")


def confidence(unique: Column, sequences: Column, k_values: Column, best_k: Column, conflict: Column) -> Column:
    """Weighted saturation of four kinds of support, lowered by the conflicting share; 0 to 1."""
    part = lambda c, full, w: F.least(F.greatest(c, F.lit(0)) / full, F.lit(1.0)) * w
    total = part(unique, 10.0, 0.35) + part(sequences, 5.0, 0.25) + part(k_values, 3.0, 0.20) + part(best_k, 101.0, 0.20)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total * (1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), conflict)))))


def taxonomic_confidence(unique: Column, sequences: Column, k_values: Column, best_k: Column) -> Column:
    """Rounded to four places; halves are nudged up, so that binary fractions just below them round alike everywhere."""
    part = lambda c, full, w: F.least(F.greatest(c, F.lit(0)) / full, F.lit(1.0)) * w
    return F.round(part(unique, 20.0, 0.35) + part(sequences, 5.0, 0.25) + part(k_values, 2.0, 0.20) + part(best_k, 101.0, 0.20) + 1e-9, 4)


def conflict_ratio(target: Column, conflicting: Column) -> Column:
    return F.when(target + conflicting > 0, conflicting / (target + conflicting)).otherwise(F.lit(0.0))


def evidence_score(unique: Column, sequences: Column, best_k: Column, k_values: Column) -> Column:
    return unique + 0.20 * sequences + 0.05 * best_k + 5.0 * k_values


def divide_or_zero(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def divide_or_null(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)
