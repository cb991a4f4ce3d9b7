"""Scores of pairs of documents, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def value_score(a: Column, b: Column) -> Column:
    """1 within five cents, then by relative difference: 0.85, 0.7, 0.5 at 2, 5, 10 per cent; 0 beyond or for a zero amount."""
    diff = F.abs(a - b)
    rel = diff / F.nullif(a, F.lit(0))
    return F.when(a == 0, 0.0).when(diff <= 5, 1.0).when(rel <= 0.02, 0.85).when(rel <= 0.05, 0.7).when(rel <= 0.1, 0.5).otherwise(0.0)


def date_score(first: Column, last: Column) -> Column:
    """0.5 if a date is missing, 0.3 in the wrong order, then 1, 0.7, 0.5, 0.3 up to 45, 90, 180 days and beyond."""
    gap = F.datediff(last, first)
    return F.when(gap.isNull(), 0.5).when(gap < 0, 0.3).when(gap <= 45, 1.0).when(gap <= 90, 0.7).when(gap <= 180, 0.5).otherwise(0.3)


def confidence(value: Column, day: Column, supplier: Column) -> Column:
    return value * 0.40 + day * 0.25 + supplier * 0.25 + 0.05


def match_cost(first: Column, last: Column, sa: Column, sb: Column, ta: Column, tb: Column) -> Column:
    """0 to 1: distance of dates, unlike suppliers, different entities."""
    gap = F.abs(F.datediff(last, first))
    day = F.when(gap.isNull(), 0.2).when(gap > 45, 0.5).otherwise(gap / 45.0 * 0.3)
    name = F.when(sa.isNull() | sb.isNull() | (sa == sb), 0.0).when(F.contains(sa, sb) | F.contains(sb, sa), 0.1).otherwise(0.3)
    return F.least(F.lit(1.0), day + name + F.when(ta != tb, 1.0).otherwise(0.0))


def arbitrate_numbers(a: Column, b: Column, name_a: str, name_b: str) -> tuple[Column, Column]:
    """(winner, confidence) of two readings of a number: equal, one missing, within one per cent, or in conflict."""
    near = F.abs(a - b) <= b * 0.01
    missing = a.isNull() | (a == 0)
    return F.when(a == b, "BOTH").when(missing, name_b).when(near, name_a).otherwise("CONFLICT"), F.when(a == b, 1.0).when(missing, 0.8).when(near, 0.9).otherwise(0.5)
