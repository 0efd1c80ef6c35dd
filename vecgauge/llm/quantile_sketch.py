"""Percentiles of very large numeric columns from logarithmic buckets.

A value ``v`` falls into bucket ``ceil(log(|v|) / log(gamma))`` of its sign with
``gamma = (1 + accuracy) / (1 - accuracy)``; zero has a bucket of its own. The
middle of a bucket differs from any value in it by at most the relative
``accuracy``. Sketches are tables of bucket counts, so sketches of separate
partitions or days combine by adding the counts of matching buckets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 0.01


def gamma_of(accuracy: float) -> float:
    return (1 + accuracy) / (1 - accuracy)


def bucket_of(value: Column, accuracy: float = ACCURACY) -> Column:
    """Signed order-preserving bucket: 0 for zero, else sign * (offset + logarithmic index)."""
    offset = _offset(accuracy)
    index = F.ceil(F.log(F.abs(value)) / math.log(gamma_of(accuracy))).cast("long") + offset
    return F.when(value == 0, F.lit(0).cast("long")).when(value > 0, index).otherwise(-index)


def _offset(accuracy: float) -> int:
    """Makes the index of the smallest positive double positive."""
    return math.ceil(750 / math.log(gamma_of(accuracy)))


def bucket_bounds(bucket: Column, accuracy: float = ACCURACY) -> tuple[Column, Column]:
    """Every value ``v`` of the bucket has ``low <= v <= high``."""
    gamma, offset = gamma_of(accuracy), _offset(accuracy)
    outer = F.pow(F.lit(gamma), (F.abs(bucket) - offset).cast("double"))
    inner = outer / gamma
    zero = F.lit(0.0)
    return (
        F.when(bucket == 0, zero).when(bucket > 0, inner).otherwise(-outer),
        F.when(bucket == 0, zero).when(bucket > 0, outer).otherwise(-inner),
    )


def sketch(rows: DataFrame, keys: Sequence[str], value: str, accuracy: float = ACCURACY, limit: str | None = None) -> DataFrame:
    """``keys, bucket, n[, n_within]``: bucket counts; null, NaN and infinite values do not count.

    ``limit`` names a column to which the values of the bucket are compared:
    ``n_within`` counts those not above it. Counts are formed in the map tasks,
    so a hot group costs no more than its buckets. Empty input gives no rows.
    """
    v = F.col(value).cast("double")
    good = rows.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    counts = [F.count("*").alias("n")]
    if limit:
        counts.append(F.count_if(v <= F.col(limit)).alias("n_within"))
    return good.groupBy(*keys, bucket_of(v, accuracy).alias("bucket")).agg(*counts)


def merge_sketches(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the counts of matching buckets; ``keys`` are those that remain."""
    sums = [F.sum(c).alias(c) for c in ("n", "n_within") if c in sketches.columns]
    return sketches.groupBy(*keys, "bucket").agg(*sums)


def sketch_percentiles(merged: DataFrame, keys: Sequence[str], percents: Sequence[int], accuracy: float = ACCURACY) -> DataFrame:
    """``keys, pct, n_values, bucket, low, high, estimate`` and the counts before and in the bucket.

    The percentile is the smallest value such that at least ``pct`` % of the
    values are not above it; ``low <= percentile <= high`` always holds, and the
    estimate is within the relative accuracy. The windows run over the buckets
    of a group, whose number does not grow with the rows.
    """
    group = Window.partitionBy(*keys)
    upto = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = merged.withColumn("n_values", F.sum("n").over(group)).withColumn("n_upto", F.sum("n").over(upto))
    at = F.explode(F.array(*[F.lit(p).cast("long") for p in percents])).alias("pct")
    rank = F.floor((F.col("pct") * F.col("n_values") + 99) / 100).cast("long")
    low, high = bucket_bounds(F.col("bucket"), accuracy)
    return (
        ranked.select("*", at)
        .withColumn("rank", rank)
        .where("rank between n_upto - n + 1 and n_upto")
        .withColumns({"low": low, "high": high})
        .withColumn("estimate", F.when(F.col("low") + F.col("high") == 0, F.lit(0.0)).otherwise(2 * F.col("low") * F.col("high") / (F.col("low") + F.col("high"))))
    )


def exceeding(percentiles: DataFrame, limit: str) -> DataFrame:
    """Rows whose percentile is above ``limit``; exact, also where the limit falls into the percentile's bucket."""
    edge = F.lit(1e-9)
    above = F.col("low") > F.col(limit) * (1 + edge)
    below = F.col("high") < F.col(limit) * (1 - edge)
    exact = F.col("n_upto") - F.col("n") + F.col("n_within") < F.col("rank")
    return percentiles.where(F.when(above, True).when(below, False).otherwise(exact))
