"""Scalar expressions on identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_id(c: Column) -> Column:
    return F.split_part(c, F.lit("."), F.lit(1))


def reverse_complement(c: Column) -> Column:
    return F.reverse(F.translate(c, "ACGT", "TGCA"))


def without_leading_zeros(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(c, "^0+", ""), F.lit("")), F.lit("0"))


def is_pseudogene(symbol: Column) -> Column:
    """Whether a symbol ends in P and a number."""
    return symbol.rlike("P[0-9]+$")


def respelt(symbol: Column, spelling: dict[str, str]) -> Column:
    """The spelling of a fixed list for what it holds, others as they are."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in spelling.items() for x in pair]), symbol), symbol)
