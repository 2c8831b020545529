"""Exact small statistics over arrays, and text forms of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def median(values: Column) -> Column:
    """Median of an array of numbers; null if empty."""
    s = F.sort_array(values)
    n = F.size(values)
    pick = lambda i: F.get(s, i.cast("int")).cast("double")
    return F.when(n > 0, (pick(F.floor((n - 1) / 2)) + pick(F.floor(n / 2))) / 2)


def mad(values: Column, center: Column) -> Column:
    """Median absolute deviation from ``center``, which must be a column, computed before.

    It is named twice here: an expression used once would be put back into the lambda and be
    computed anew for every element.
    """
    return F.when(center.isNotNull(), median(F.transform(values, lambda x: F.abs(x - center))))


def spread_over(values: Column, bound: float) -> Column:
    """Whether the sample standard deviation exceeds ``bound``, from whole-number sums (no rounding)."""
    one = F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)
    two = F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x * x)
    return spread_over_sums(F.size(values), one, two, bound)


def spread_over_sums(n: Column, one: Column, two: Column, bound: float) -> Column:
    """:func:`spread_over` from the number of values, their sum and the sum of their squares."""
    n, one, two = (c.cast("double") for c in (n, one, two))
    return (n > 1) & (n * two - one * one > F.lit(float(bound) ** 2) * n * (n - 1))


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x) / F.size(values)


def text3(value: Column) -> Column:
    """The shortest text of a number correctly rounded to three places (``0.667``, ``1.0``).

    ``format_number`` rounds the binary value itself, ties to even; ``round`` and ``bround`` round its
    decimal text and differ there. Below 0.001 it doesn't (0.0005 is above the tie), so that is settled here.
    """
    tiny = F.concat(F.when(value < 0, "-").otherwise(""), F.when(F.abs(value) >= 0.0005, "0.001").otherwise("0.0"))
    fixed = F.regexp_replace(F.format_number(value.cast("double"), 3), ",", "")
    return F.when(F.abs(value) < 0.001, tiny).when(value.isNotNull(), F.regexp_replace(fixed, r"(\.\d)(\d*?)0+$", "$1$2"))
