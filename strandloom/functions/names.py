"""Column functions over taxon names, label lists, accessions and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _spaces(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"\s+", " "))


def taxon_key(value: Column, underscores: bool = True) -> Column:
    """Lower-case name with single spaces; underscores count as spaces unless told otherwise."""
    value = F.coalesce(value.cast("string"), F.lit(""))
    return F.lower(_spaces(F.translate(value, "_", " ") if underscores else value))


def taxon_name(value: Column) -> Column:
    """The name with single spaces, its case kept."""
    return _spaces(F.translate(F.coalesce(value.cast("string"), F.lit("")), "_", " "))


def reference_species(label: Column) -> Column:
    """Species of a reference label: the first two ``_`` parts of what stands before ``__``."""
    head = F.split(F.coalesce(label.cast("string"), F.lit("")), "__")[0]
    return F.array_join(F.slice(F.split(head, "_"), 1, 2), " ")


def genus(species: Column) -> Column:
    return F.split(taxon_key(species), " ")[0]


def split_set(value: Column, sep: str = ";") -> Column:
    """Trimmed, non-blank, distinct members of a joined set, sorted."""
    parts = F.transform(F.split(F.coalesce(value.cast("string"), F.lit("")), sep), lambda x: F.trim(x))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def join_set(values: Column, sep: str = ";") -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.filter(values, lambda x: x != ""))), sep)


def label_list(value: Column) -> Column:
    """Labels parted by commas or semicolons, in order, joined by ``; ``."""
    parts = F.transform(F.split(F.coalesce(value.cast("string"), F.lit("")), "[,;]"), lambda x: F.trim(x))
    return F.array_join(F.filter(parts, lambda x: x != ""), "; ")


def accession(value: Column) -> Column:
    """Upper case, without the version."""
    return F.substring_index(F.upper(F.trim(F.coalesce(value.cast("string"), F.lit("")))), ".", 1)


def safe_identifier(value: Column) -> Column:
    """Letters, digits, dot, dash and underscore; other runs become one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(value.cast("string"), F.lit(""))), "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")


def blank(value: Column) -> Column:
    """Null for the empty string."""
    return F.when(F.trim(value.cast("string")) != "", value)
