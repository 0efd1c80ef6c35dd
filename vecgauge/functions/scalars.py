"""Scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros_between(start: Column, end: Column) -> Column:
    """Elapsed microseconds, without regard to any time zone."""
    return F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))


def years_between(start: Column, end: Column) -> Column:
    """Whole elapsed days as years of 365.25 days; null if either end is missing."""
    return F.floor(micros_between(start, end) / F.lit(86_400_000_000)) / F.lit(365.25)


def binary_outcome(value: Column, label_type: Column) -> Column:
    """1 or 0 from a label: booleans by word, other types by whether the number is at least 1; else null."""
    word = F.lower(F.trim(value))
    number = word.try_cast("double")
    by_word = F.when(word.isin("true", "1", "yes"), 1).when(word.isin("false", "0", "no"), 0)
    return F.when(label_type == "boolean", by_word).otherwise(F.when(number.isNotNull(), (number >= 1).cast("int")))


def missing(x: Column) -> Column:
    """Null or NaN."""
    return x.isNull() | F.isnan(x)


def verdict(beats_null: Column, margin: Column, threshold: float = 0.10) -> Column:
    """CONTINUOUS unless the null is beaten, WEAK below the margin, else DISCRETE; null where nothing ran."""
    return F.when(beats_null.isNull(), None).when(~beats_null, "CONTINUOUS").when(margin < threshold, "WEAK").otherwise("DISCRETE")


def null_margin(real: Column, null_median: Column) -> Column:
    """Headroom above the null, half-even to four digits; null where the null is at 1."""
    return F.bround(F.try_divide(real - null_median, 1 - null_median), 4)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(a: Column) -> Column:
    length = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(a, lambda x: x / length)


def pool(hidden: Column, mask: Column, pooling: str) -> Column:
    """One vector from the states ``hidden`` (an array of vectors) where ``mask`` is 1: the ``last`` of them or their ``mean``.

    The mask holds ones, then zeros. Without any one, the last is the first
    state and the mean is zero. Other poolings are refused.
    """
    length = F.greatest(F.aggregate(mask, F.lit(0), lambda s, x: s + x.cast("int")), F.lit(1))
    if pooling == "last":
        return F.element_at(hidden, length)
    if pooling != "mean":
        raise ValueError(f"unknown pooling {pooling!r}")
    zero = F.transform(F.element_at(hidden, F.lit(1)), lambda x: F.lit(0.0))
    seen = F.filter(F.zip_with(hidden, mask, lambda h, m: F.when(m > 0, h)), lambda h: h.isNotNull())
    return F.transform(F.aggregate(seen, zero, lambda s, h: F.zip_with(s, h, lambda x, y: x + y)), lambda x: x / length)
